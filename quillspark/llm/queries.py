"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import cws, filter_audit, jaccard_rtree, mixing, nbsvm, odd_sketch, packing, pii, ppm, sharding, substring_dedup, time_partitions, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The byte-level vocabulary's file; it is installed on driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pseudonym_key(spark: SparkSession) -> str:
    """The secret from the session's setting; the public stand-in is for tests and benchmarks only."""
    return spark.conf.get("spark.quillspark.pseudonym.key", "quillspark")


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(table(spark, sf_dir, "documents"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.lpt_shards(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_rtree.near_groups(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(table(spark, sf_dir, "documents"))


def op11_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_partitions.time_partitions(table(spark, sf_dir, "clicks"), "2024-05-01 00:00:00")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": topk.SQL, "op4_mix_sources": mixing.SQL, "op12_filter_audit": filter_audit.SQL}
