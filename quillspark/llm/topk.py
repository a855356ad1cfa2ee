"""Exact top-k search: tiled matrix products of queries and shards, partial selection per tile, tree merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Tables
from quillspark.llm.rows import named

#: Bytes of a block of queries and of a shard of candidates, as doubles; shards at least, if there are as many rows.
BLOCK_BYTES, SHARD_BYTES, LEAST_SHARDS = 8 << 20, 16 << 20, 8
#: Queries and candidates of a tile, whose products are held at a time.
TILE_QUERIES, TILE_ROWS = 512, 4096
#: Lists that one merge step joins.
FAN = 16
_EXACT = float(1 << 53)


def _floor(x: Column) -> Column:
    """floor() as a double; Spark's own gives a long, and doubles beyond 2^52 are whole already."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-numbered doubles: by floating point where that is exact, else in Python's integers, held to 64 bits."""
    dim = q.shape[1]
    if dim == 0 or len(c) == 0 or np.abs(q).max() * np.abs(c).max() * dim < _EXACT:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row: higher score first, ties to the smaller id; ``own`` rows are no candidates.

    Returns row numbers, ids and scores of what is selected.
    """
    n = scores.shape[1]
    at = np.searchsorted(own, ids)
    mine = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == ids)
    scores[at[mine], mine] = -(1 << 63)
    if n > 2 * k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        r, c = np.nonzero(scores >= least[:, None])
    else:
        r, c = np.divmod(np.arange(scores.size), n)
    keep = ids[c] != own[r]
    r, c = r[keep], c[keep]
    order = np.lexsort((ids[c], ~scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    r, c = r[place < k], c[place < k]
    return r, ids[c], scores[r, c]


def _vectors(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the rows (vec_id, v), by length."""
    out: dict[int, list] = {}
    for b in table.to_batches():
        vec = b.column("v")
        ids, at = b.column("vec_id").to_numpy(zero_copy_only=False), np.asarray(vec.offsets)
        flat, sizes, first = np.asarray(vec.flatten(), dtype=np.float64), np.diff(at), at[:-1] - at[0]
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            out.setdefault(d, []).append((ids[rows], flat[first[rows][:, None] + np.arange(d)]))
    return {d: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for d, parts in out.items()}


def _cell(key: tuple[pa.Scalar, ...], queries: pa.Table, shard: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """The top lists of a block of queries over a shard of candidates: products tile by tile, the best of each kept."""
    tile, asked, held = key[1].as_py(), _vectors(queries), _vectors(shard)
    out: dict[str, list] = {"query_id": [], "score": [], "back": [], "size": []}
    for d, (q_ids, q_vec) in asked.items():
        if d not in held:
            continue
        order = np.argsort(q_ids)
        q_ids, q_vec = q_ids[order], q_vec[order]
        ids, vec = held[d]
        for x in range(0, len(q_ids), TILE_QUERIES):
            mine, best = q_ids[x : x + TILE_QUERIES], (np.zeros(0, np.int64),) * 3
            for at in range(0, len(ids), TILE_ROWS):
                some = _select(_product(q_vec[x : x + TILE_QUERIES], vec[at : at + TILE_ROWS]), ids[at : at + TILE_ROWS], mine, k)
                r, i, s = (np.concatenate(c) for c in zip(best, some, strict=True))
                order = np.lexsort((i, ~s, r))
                r, i, s = r[order], i[order], s[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                best = r[keep], i[keep], s[keep]
            r, i, s = best
            rows, sizes = np.unique(r, return_counts=True)
            for name, values in zip(out, (mine[rows], s, ~i, sizes), strict=True):
                out[name].append(values)
    flat = {n: np.concatenate(v) if v else np.zeros(0, np.int64) for n, v in out.items()}
    entries = pa.StructArray.from_arrays([pa.array(flat["score"], pa.int64()), pa.array(flat["back"], pa.int64())], names=["score", "back"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(flat["size"])), pa.int32()), entries)
    return pa.table([pa.array(flat["query_id"], pa.int64()), pa.array([tile] * len(flat["query_id"]), pa.int32()), lists], schema=schema)


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k best inner products of each query, exactly.

    Components become floor(scale * x).  Queries are the rows whose id is divisible by
    ``every``; candidates all rows but the query's own id.  Queries are dealt into blocks of about BLOCK_BYTES
    and candidates into shards of about SHARD_BYTES, and every block meets every shard in a task of its own, which multiplies
    them tile by tile and keeps k a query; the tasks' lists are merged FAN at a time.  Neither queries nor
    candidates pass through the driver.  Ties go to the smaller id.  Only vectors of the query's length count.
    Products beyond 64 bits are held at the limit.

    Nulls: rows with a null id or vector, or a null or non-finite component take no
    part.  Repeated ids: each row is a candidate; rows of a query's id are none of its
    own, and queries of one id give one list for its first vector (by component order).
    Empty tables or no queries: no rows.  Other columns are not read.

    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    v = named(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: _floor(x.cast("double") * scale))
    clean = vectors.where(named(vec_id).isNotNull() & v.isNotNull() & fine).select(named(vec_id).cast("long").alias("vec_id"), whole.alias("v"))
    queries = clean.where(F.col("vec_id") % every == 0)
    rows, n, longest = clean.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(8, 8 * longest)
    blocks, shards = -(-n * width // BLOCK_BYTES), max(min(LEAST_SHARDS, rows), -(-rows * width // SHARD_BYTES))
    entry = pa.struct([("score", pa.int64()), ("back", pa.int64())])
    arrow = pa.schema([("query_id", pa.int64()), ("tile", pa.int32()), ("best", pa.list_(entry))])
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("tile", every_one(shards))
    # Rows are dealt by their place, so that repeated rows are spread.
    held = clean.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")).withColumn("home", every_one(blocks))
    cells = asked.groupBy("block", "tile").cogroup(held.groupBy("home", "shard"))
    tables = Tables(spark, "topk")
    lists = tables.write(cells.applyInArrow(lambda key, q, c: _cell(key, q, c, k, arrow), "query_id long, tile int, best array<struct<score:long,back:long>>"), "lists")
    left = (lists.agg(F.max("tile")).first()[0] or 0) + 1
    while left > 0:
        merged = F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k)
        lists = lists.groupBy("query_id", F.floor(F.col("tile") / FAN).cast("int").alias("tile")).agg(merged.alias("best"))
        left = 0 if left <= FAN else -(-left // FAN)
    return lists.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.bitwise_not("x.back").alias("vec_id"), F.col("x.score").alias("score"))


SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM c q JOIN c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""
