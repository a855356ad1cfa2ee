"""A corpus pipeline over documents: quality, near duplicates, pseudonyms, mixing, packing.

Every stage but the last returns the columns it was given, whatever they are called, and works on null, empty and very long
texts and on repeated rows as its operator says; an empty table goes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jaccard_rtree, mixing, nbsvm, packing, pii
from quillspark.llm.common import Tables
from quillspark.llm.queries import pseudonym_key, tokenizer_path
from quillspark.llm.rows import fresh

#: Bytes at which an Arrow batch to a Python worker is full.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Set the session's limit of Arrow batches to BATCH_BYTES, unless it has one of its own.

    By Spark's default a batch is up to 64 MB, mostly a partition's whole texts, of which the JVM holds a vector and a buffer and the worker a copy or two.
    """
    if spark.conf.get(_BATCHES, None) is None:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Rows of null or empty text are scored by the bias; without labelled documents of both classes all rows stay.
    """
    bounded(spark)
    return nbsvm.of_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one of least doc_id (null is last), of these that of the least hash.

    Rows of null text or without words link with nothing and all stay; of rows equal in doc_id and text, one stays.
    """
    bounded(spark)
    return jaccard_rtree.one_of_each(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates, addresses and secrets become pseudonyms; n_chars, where there is one, is counted again.  A null text stays null."""
    out = pii.pseudonymised(docs, pseudonym_key(spark), count=fresh(docs, "replaced"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it; a null source is a source, a document without words goes by its source's certain copies."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences, a row a piece with its ids; a null text is one id, repeated rows are packed one by one."""
    bounded(spark)
    return packing.packed(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mixture", mixture), ("sequences", sequences)]
#: The classifier, pseudonyms and packing can't be said in SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again as the next one's input; inputs that are done with are deleted."""
    tables = Tables(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            tables.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
