"""Retrieval: dense and sparse top-k, rank fusion, reranking, context and citations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import quoted
from quillspark.operators.balls import Balls
from quillspark.sources.shared import Tables

#: Query vectors that are sent to every task, at most.
MOST_SENT = 1000


def filtered(chunks: DataFrame, tags: list[str] | None = None, folder: str | None = None, after=None, before=None) -> DataFrame:
    """Any of the tags, the very folder ('' is the root), created in the closed range; an open end, no tags or None doesn't filter."""
    tests: list[Column] = []
    if tags:
        tests.append(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if folder is not None:
        tests.append(F.col("folder") == folder)
    if after is not None:
        tests.append(F.col("created") >= after)
    if before is not None:
        tests.append(F.col("created") <= before)
    return chunks.where(reduce(lambda a, b: a & b, tests)) if tests else chunks


def by_notes(chunks: DataFrame, ids: DataFrame, most: int = 1000) -> DataFrame:
    return chunks.join(ids, "note_id", "left_semi").orderBy("chunk_id").limit(most)


def cosine(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    own = sum(float(x) * float(x) for x in query) ** 0.5
    return dot / (norm * own)


def dense_top_k(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id", vector: str = "dense") -> DataFrame:
    """The k nearest by cosine, ties by key: a scan and a bounded sort."""
    return vectors.select(key, cosine(F.col(vector), query).alias("score")).orderBy(F.desc("score"), key).limit(k)


def dense_top_k_each(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", vector: str = "dense") -> DataFrame:
    """The k nearest of each query (query_id, query): (query_id, key, score, rank).

    Up to MOST_SENT queries are sent to every task, by their counted rows; more go through an index of balls, whose ties are those of scores of nine places.
    """
    if queries.count() > MOST_SENT:
        found = Balls.write(vectors, f"{Tables(vectors.sparkSession, 'vectors').root}/balls", key, vector).top_k(queries, k)
        return found.select("query_id", F.col("key").alias(key), "score", "rank")
    number = lambda a, f: F.aggregate(a, F.lit(0.0), f)
    length = lambda v: F.sqrt(number(v, lambda s, x: s + x.cast("double") * x.cast("double")))
    asked = queries.select("query_id", "query", length(F.col("query")).alias("own"))
    held = vectors.select(key, F.col(vector).alias("v"), length(F.col(vector)).alias("norm"))
    dot = number(F.zip_with("v", "query", lambda a, b: a.cast("double") * b.cast("double")), lambda s, x: s + x)
    scored = held.join(F.broadcast(asked)).select("query_id", key, (dot / (F.col("norm") * F.col("own"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def term_weights(texts: DataFrame, key: str, text: str, k1: float = 1.2, b: float = 0.75, mean: float = 256.0) -> DataFrame:
    """(key, term, weight): saturated term frequency; documents and queries alike."""
    words = texts.select(key, F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("term"))
    counts = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    sizes = words.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    return counts.join(sizes, key).select(key, "term", (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / mean))).alias("weight"))


def sparse_top_k(weights: DataFrame, query: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """Dot products of term weights; only texts that share a term with ``query`` (term, weight)."""
    q = query.select("term", F.col("weight").alias("q"))
    return weights.join(F.broadcast(q), "term").groupBy(key).agg(F.round(F.sum(F.col("weight") * F.col("q")), 9).alias("score")).orderBy(F.desc("score"), key).limit(k)


def rank_fusion(lists: DataFrame, key: str = "chunk_id", k: int = 60, candidate_k: int = 50) -> DataFrame:
    """Reciprocal rank fusion of rows (list_no, key, score): sum of 1 / (k + rank), then best rank, then key."""
    rank = F.row_number().over(Window.partitionBy("list_no").orderBy(F.desc("score"), key))
    near = lists.withColumn("rank", rank).where(F.col("rank") <= candidate_k)
    out = near.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best"), F.min_by("list_no", F.struct("list_no", "rank")).alias("source"))
    return out.orderBy(F.desc("score"), "best", key)


def overlap_score(query: str, text: Column) -> Column:
    """Default scorer: the share of the query's words in the text."""
    words = sorted(set(query.lower().split()))
    return F.size(F.array_intersect(F.split(F.lower(text), r"\s+"), F.array(*map(F.lit, words)))) / F.lit(float(max(1, len(words))))


def rerank(candidates: DataFrame, score: Column, rerank_n: int = 30, final_k: int = 8, key: str = "chunk_id") -> DataFrame:
    """Candidates with a position ``rank``: each key once, the first rerank_n scored, the best final_k; equal scores keep their order."""
    first = candidates.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where("n = 1").drop("n")
    return first.orderBy("rank").limit(rerank_n).withColumn("score", score).orderBy(F.desc("score"), "rank").limit(final_k)


def context(ranked: DataFrame, budget: int = 2000, start: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """The best chunks by rank while their tokens fit the budget; the first always stays.  Adds key S1, S2, ...

    Of one list, what can't fit is cut off first: at most ``budget`` chunks with tokens do, so the windows see these only.  ``by``:
    columns that name a list of its own, each of which is ordered by itself.
    """
    if not by:
        ends = ranked.where("token_estimate > 0").select("rank", "token_estimate").orderBy("rank").limit(budget + 1)
        upto = F.sum("token_estimate").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
        last = ends.withColumn("upto", upto).where((F.col("upto") > budget)).agg(F.min("rank").alias("last"))
        ranked = ranked.join(F.broadcast(last)).where(F.col("last").isNull() | (F.col("rank") <= F.col("last"))).drop("last")
    of = Window.partitionBy(*by).orderBy("rank") if by else Window.orderBy("rank")
    whole, place = F.sum("token_estimate").over(of.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(of)
    out = ranked.withColumn("upto", whole).withColumn("n", place).where((F.col("n") == 1) | (F.col("upto") <= budget))
    return out.withColumn("key", F.concat(F.lit("S"), (F.col("n") + start - 1).cast("string"))).drop("n", "upto")


def cited(answers: DataFrame, known: DataFrame, keys: Callable[[Column], Column]) -> DataFrame:
    """Keys of ``answers`` (id, answer), each once by first place pos, with the columns of ``known`` (id, key, ...) and whether it is ``known``."""
    used = answers.select("id", F.posexplode(keys(F.col("answer"))).alias("pos", "key")).groupBy("id", "key").agg(F.min("pos").alias("pos"))
    return used.join(known.withColumn("known", F.lit(True)), ["id", "key"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def validated_citations(answers: DataFrame, known: DataFrame, keys: Callable[[Column], Column]) -> DataFrame:
    """The known ones of ``cited``."""
    return cited(answers, known, keys).where("known").drop("known")


def unknown_citations(answers: DataFrame, known: DataFrame, keys: Callable[[Column], Column]) -> DataFrame:
    """(id, key) of keys that were never given, to be reported."""
    return cited(answers, known, keys).where("not known").select("id", "key")


def sources_footer(citations: DataFrame, vault: str) -> DataFrame:
    """(id, footer): a line a citation (id, key, path, start_line, end_line), by key as text: [S1] path:L1-L2 and a link that opens the note."""
    link = F.concat(F.lit("obsidian://open?vault="), quoted(F.lit(vault)), F.lit("&file="), quoted(F.col("path")))
    line = F.format_string("[%s] %s:L%d-L%d (%s)", F.col("key"), F.col("path"), F.col("start_line"), F.col("end_line"), link)
    rows = F.sort_array(F.collect_list(F.struct("key", line.alias("line"))))
    return citations.groupBy("id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("footer"))
