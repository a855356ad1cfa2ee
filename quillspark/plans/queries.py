"""The engine's queries over the test tables, with the same in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import graph, links, manifest, retrieval, stats
from quillspark.operators.balls import Balls
from quillspark.operators.payload import Payload
from quillspark.plans import markdown
from quillspark.sources.shared import Tables, written
from quillspark.sources.vault import document_names, document_notes


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _built(notes: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of notes, whose texts are read once: their links are written, and nodes and edges come from these and the notes' names."""
    return graph.build(names, written(links.resolve_links(links.extract_links(notes), names), "links"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, d)
    return _built(document_notes(docs), document_names(docs))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    query = vectors.where("vec_id = 0").first()
    out = retrieval.dense_top_k(vectors, list(query.embedding), 10, "vec_id", "embedding")
    return out.select("vec_id", F.round("score", 6).alias("score"))


def nearest_balls(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of each twentieth vector among all, from an index of balls."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    index = Balls.write(vectors, f"{Tables(spark, 'vectors').root}/balls", "vec_id", "embedding")
    out = index.top_k(vectors.where("vec_id % 20 = 0"), 10, query_id="vec_id", query="embedding")
    return out.select("query_id", "rank", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.token_distribution(_docs(spark, d).select(T.tokens(F.col("text")).alias("token_estimate"))).select("chunks", "min", "max", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


def top_tags(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_tags(document_notes(_docs(spark, d)))


def top_folders(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_folders(document_notes(_docs(spark, d)))


def filtered_notes(spark: SparkSession, d: str) -> DataFrame:
    notes = document_notes(_docs(spark, d))
    return retrieval.filtered(notes, ["en", "t3"], "src0", dt.date(2024, 2, 1), dt.date(2024, 11, 30)).select("note_id")


def payload_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A filter answered from the files that may hold such notes, of all notes laid out by folder and date."""
    notes = document_notes(_docs(spark, d))
    index = Payload.write(notes, f"{Tables(spark, 'payload').root}/notes", "note_id", 2000)
    return index.filtered(["fr", "t5"], "src1", dt.date(2024, 3, 1), dt.date(2024, 5, 31)).select("note_id", "created", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    notes = document_notes(_docs(spark, d))
    return links.resolve_links(links.extract_links(notes), notes).select("note_id", "target_raw", "target_note_id", "kind")


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(*_graph(spark, d))


def graph_ghosts(spark: SparkSession, d: str) -> DataFrame:
    return graph.ghosts(_graph(spark, d)[0])


def graph_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Only each third note keeps its links."""
    notes = document_notes(_docs(spark, d)).withColumn("body", F.when(F.col("doc_id") % 3 == 0, F.col("body")).otherwise("no links"))
    return graph.orphans(*_built(notes, document_names(_docs(spark, d))))


def graph_hubs(spark: SparkSession, d: str) -> DataFrame:
    return graph.hubs(*_graph(spark, d), threshold=3)


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.col("doc_id").alias("note_id"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """The whole table against a perturbed copy: some notes renamed (added and deleted), some changed."""
    hashed, n = _hashed(spark, d), F.col("note_id")
    old = hashed.select(F.when(n % 10 == 0, -n - 1).otherwise(n).alias("note_id"), F.when(n % 7 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"))
    return manifest.diff(hashed, old)


def sparse_weights(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.term_weights(_docs(spark, d), "doc_id", "text")
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 4).alias("weight"))


def fused_ranks(spark: SparkSession, d: str) -> DataFrame:
    """All documents in two lists: by length, and by a hash of the text."""
    docs = _docs(spark, d)
    hashed = F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double")
    a = docs.select(F.lit(0).alias("list_no"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("score"))
    b = docs.select(F.lit(1).alias("list_no"), F.col("doc_id").alias("chunk_id"), hashed.alias("score"))
    return retrieval.rank_fusion(a.unionByName(b)).select("chunk_id", F.round("score", 9).alias("score"), F.col("best").cast("long").alias("best"))


def context_window(spark: SparkSession, d: str) -> DataFrame:
    ranked = _docs(spark, d).select(F.col("doc_id").alias("rank"), T.tokens(F.col("text")).alias("token_estimate"))
    return retrieval.context(ranked).select("rank", "key", "token_estimate")


FLAGSHIP = dense_topk
_QUERIES = (dense_topk, nearest_balls, token_stats, top_tags, top_folders, filtered_notes, payload_filtered, resolved_links, graph_degrees, graph_ghosts, graph_orphans, graph_hubs, manifest_diff, sparse_weights, fused_ranks, context_window)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | markdown.queries()


_NOTES = """n AS (SELECT doc_id, text, lang, source, source || '/' || lang || '-' || doc_id AS note_id, lang || '-' || doc_id AS title, (SELECT count(*) FROM documents) AS c FROM documents),
l AS (SELECT x.note_id, a.note_id AS t1, upper(b.title) AS r2, b.note_id AS t2, 'missing-' || (x.doc_id % 17) AS r3, x.doc_id,
             '[[' || a.note_id || ']] [[' || upper(b.title) || ']] [[missing-' || (x.doc_id % 17) || ']]' || chr(10) || coalesce(x.text, '') AS body
      FROM n x JOIN n a ON a.doc_id = (7 * x.doc_id + 1) % x.c JOIN n b ON b.doc_id = (13 * x.doc_id + 5) % x.c),
r AS (SELECT note_id, t1 AS target_raw, t1 AS target_note_id FROM l UNION ALL SELECT note_id, r2, t2 FROM l UNION ALL SELECT note_id, r3, NULL FROM l),
e AS (SELECT DISTINCT note_id AS src, coalesce(target_note_id, target_raw) AS dst FROM r),
d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
v AS (SELECT note_id AS id, false AS ghost FROM n UNION ALL SELECT DISTINCT target_raw, true FROM r WHERE target_note_id IS NULL),
g AS (SELECT v.id, v.ghost, coalesce(d.degree, 0)::BIGINT AS degree FROM v LEFT JOIN d ON v.id = d.id)"""
_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0B\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> ''))"


def oracle_sql() -> dict[str, str]:
    top = lambda col, sub: f"SELECT {col}, count(*) AS n FROM ({sub}) GROUP BY {col} ORDER BY n DESC, {col} LIMIT 10"
    return {
        "dense_topk": "SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id LIMIT 10",
        "nearest_balls": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
        "token_stats": f"SELECT count(*) AS chunks, min(t)::BIGINT AS min, max(t)::BIGINT AS max, round(avg(t), 6) AS mean, round(median(t), 6)::DOUBLE AS median FROM (SELECT {_WORDS} AS t FROM documents)",
        "top_tags": top("tag", "SELECT unnest([lang, 't' || (doc_id % 7)]) AS tag FROM documents"),
        "top_folders": top("folder", "SELECT source AS folder FROM documents"),
        "filtered_notes": "SELECT source || '/' || lang || '-' || doc_id AS note_id FROM documents WHERE (lang = 'en' OR doc_id % 7 = 3) AND source = 'src0' AND DATE '2024-01-01' + (doc_id % 365)::INTEGER BETWEEN DATE '2024-02-01' AND DATE '2024-11-30'",
        "payload_filtered": f"WITH {_NOTES} SELECT note_id, DATE '2024-01-01' + (doc_id % 365)::INTEGER AS created, md5(body) AS body_md5 FROM l WHERE note_id IN (SELECT note_id FROM n WHERE (lang = 'fr' OR doc_id % 7 = 5) AND source = 'src1') AND DATE '2024-01-01' + (doc_id % 365)::INTEGER BETWEEN DATE '2024-03-01' AND DATE '2024-05-31'",
        "resolved_links": f"WITH {_NOTES} SELECT *, 'link' AS kind FROM r",
        "graph_degrees": f"WITH {_NOTES} SELECT * FROM g",
        "graph_ghosts": f"WITH {_NOTES} SELECT id FROM v WHERE ghost",
        "graph_orphans": f"WITH {_NOTES}, o AS (SELECT e.* FROM e JOIN n ON src = note_id WHERE doc_id % 3 = 0) SELECT note_id AS id FROM n WHERE note_id NOT IN (SELECT src FROM o UNION ALL SELECT dst FROM o)",
        "graph_hubs": f"WITH {_NOTES} SELECT id, degree FROM g WHERE degree > 3 AND NOT ghost ORDER BY degree DESC, id LIMIT 10",
        "manifest_diff": """WITH c AS (SELECT doc_id AS note_id, sha256(text) AS h, true AS here FROM documents),
            p AS (SELECT CASE WHEN note_id % 10 = 0 THEN -note_id - 1 ELSE note_id END AS note_id, CASE WHEN note_id % 7 = 0 THEN 'other' ELSE h END AS h, true AS here FROM c)
            SELECT coalesce(c.note_id, p.note_id) AS note_id, CASE WHEN p.here IS NULL THEN 'added' WHEN c.here IS NULL THEN 'deleted' WHEN c.h IS DISTINCT FROM p.h THEN 'modified' ELSE 'unchanged' END AS change FROM c FULL JOIN p ON c.note_id = p.note_id""",
        "sparse_weights": r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents),
            s AS (SELECT doc_id, count(*) AS size FROM w GROUP BY doc_id), t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term)
            SELECT doc_id, count(*) AS terms, round(sum(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / 256.0::DOUBLE))), 4) AS weight FROM t JOIN s USING (doc_id) GROUP BY doc_id""",
        "fused_ranks": """WITH l AS (SELECT 0 AS no, doc_id, n_chars AS score FROM documents UNION ALL SELECT 1, doc_id, ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT FROM documents),
            r AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id) AS r FROM l)
            SELECT doc_id AS chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, min(r) AS best FROM r WHERE r <= 50 GROUP BY doc_id""",
        "context_window": f"WITH t AS (SELECT doc_id AS rank, ({_WORDS})::BIGINT AS token_estimate FROM documents), s AS (SELECT *, sum(token_estimate) OVER (ORDER BY rank) AS upto, row_number() OVER (ORDER BY rank) AS i FROM t) SELECT rank, 'S' || i AS key, token_estimate FROM s WHERE i = 1 OR upto <= 2000",
    } | markdown.oracle_sql()
