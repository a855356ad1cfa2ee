"""Exact nearest vectors by balls: vectors are stored around pivots, with the angle that each ball reaches, and balls that can't hold one of the k nearest aren't read."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sources.shared import Tables

#: Vectors of a ball, about, as long as all pivots fit into PIVOT_BYTES; beyond it balls grow.
BALL_ROWS, PIVOT_BYTES = 512, 4 << 20
#: Bytes of the vectors that meet a home of queries in one group, of a home, and of a file.
SALT_BYTES, HOME_BYTES, FILE_BYTES = 16 << 20, 8 << 20, 32 << 20
#: Neighbouring queries that visit balls together; balls that each visits first, at least; vectors multiplied at a time.
BLOCK, FIRST, TILE = 256, 2, 2048
#: Room for the rounding of angles in a bound.  Scores are rounded to PLACES, so that equal vectors tie wherever they stand.
ROOM, PLACES = 1e-6, 9


def _clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of the vectors that have a direction: no null in them, a length above zero and finite."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(F.col(key).alias("key"), v.alias("v"))
    # NaN is above infinity in Spark's order.
    return rows.where(F.col("key").isNotNull() & (norm > 0) & (norm < float("inf")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors from a column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _lists(values: pa.Array, cuts: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)


def _top(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k largest scores from ``least`` on, ties to the lesser column."""
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
    r, c = np.nonzero(scores >= least[:, None])
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    few = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[few], c[few]


class _Pivots:
    """Pivots in shelves around some of them, so that the nearest is looked for among about twice their square root; the vectors of each one's ball and the angle that it reaches.

    This is what tasks are sent.
    """

    def __init__(self, pivots: np.ndarray, n: np.ndarray | None = None, reach: np.ndarray | None = None):
        self.n, self.reach = n, reach
        tops = pivots[: math.isqrt(len(pivots) - 1) + 1]
        held, shelf = np.unique(np.argmax(pivots @ tops.T, axis=1), return_inverse=True)
        self.pivots, self.tops, self.shelf = pivots, tops[held], shelf

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ball of each vector, and the cosine to its pivot."""
        of, ball, cos = np.argmax(x @ self.tops.T, axis=1), np.zeros(len(x), np.int32), np.zeros(len(x))
        for s in np.unique(of):
            rows, mine = np.flatnonzero(of == s), np.flatnonzero(self.shelf == s)
            dots = x[rows] @ self.pivots[mine].T
            at = dots.argmax(axis=1)
            ball[rows], cos[rows] = mine[at], dots[np.arange(len(rows)), at]
        return ball, cos

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The largest cosine that each of the unit vectors ``x`` can have with a vector of each ball: that of the angle to its pivot less what the ball reaches."""
        away = np.arccos(np.clip(x @ self.pivots.T, -1, 1)) - self.reach
        return np.where(self.n > 0, np.cos(np.maximum(away, 0)) + ROOM, -np.inf)

    def wanted(self, bounds: np.ndarray, k: int, least: np.ndarray | None) -> np.ndarray:
        """Which balls each query visits: at first those of largest bounds, until they hold k vectors; then all others that can reach ``least``."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        many = np.cumsum(self.n[order], axis=1) - self.n[order]
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, order, (many < k) | (np.arange(bounds.shape[1]) < FIRST), axis=1)
        first &= bounds > -np.inf
        return first if least is None else (bounds >= least[:, None]) & (bounds > -np.inf) & ~first.any(axis=0)

    def placed(self, rows: DataFrame) -> DataFrame:
        """(key, v, shelf, ball, cos) of rows (key, v)."""

        def place(batches):
            for whole in batches:
                for i in range(0, len(whole), TILE):
                    part = whole.slice(i, TILE)
                    ball, cos = self.nearest(_matrix(part.column("v")))
                    yield pa.RecordBatch.from_arrays([part.column("key"), part.column("v"), pa.array(self.shelf[ball].astype(np.int32)), pa.array(ball), pa.array(cos)], names=["key", "v", "shelf", "ball", "cos"])

        return rows.mapInArrow(place, f"key {rows.schema['key'].dataType.simpleString()}, v array<double>, shelf int, ball int, cos double")


class Balls:
    """Folders ``root``/rows (key, v, shelf, ball, salt), clustered by ball, and ``root``/balls, a row a ball: its pivot, the angle it reaches, its vectors.

    There are at most PIVOT_BYTES of pivots, whatever the table's size, so what tasks are sent is bounded; a ball of any size is spread over files and
    groups by its rows' salt.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.rows = spark.read.parquet(f"{self.root}/rows")
        balls = spark.read.parquet(f"{self.root}/balls").orderBy("ball").collect()
        self.near = _Pivots(np.array([b.pivot for b in balls]), np.array([b.n for b in balls], np.int64), np.array([b.reach for b in balls])) if balls else None
        self.salts = {b.shelf: b.salts for b in balls}

    @classmethod
    def write(cls, vectors: DataFrame, root: str, key: str = "chunk_id", vector: str = "dense", ball_rows: int = BALL_ROWS) -> Balls:
        """Lay ``vectors`` out under ``root``, a new folder.

        Pivots are vectors picked by a hash of what they hold, equal ones once.  Rows with a null key, vector or component, or a length of zero or beyond doubles
        take no part; vectors of several lengths raise an error.  Repeated rows are rows.  Other columns aren't read.
        """
        root, spark = root.rstrip("/"), vectors.sparkSession
        tables = Tables(spark, "balls")
        rows = _clean(vectors, key, vector)
        n, least, dim = rows.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
        if least != dim:
            raise ValueError(f"vectors of lengths from {least} to {dim}")
        width, pivots, held = 8 * (dim or 1), None, []
        if n:
            wanted = max(1, min(-(-n // ball_rows), PIVOT_BYTES // width))
            name = F.xxhash64("v")
            some = rows.where(F.shiftrightunsigned(name, 33) <= int(wanted / n * (1 << 31)))
            picked = some.groupBy(name.alias("h")).agg(F.first("v").alias("v")).orderBy("h").limit(2 * wanted).collect()
            picked = picked or rows.orderBy(name).limit(1).collect()
            x = np.array([r.v for r in picked])
            pivots = _Pivots(x / np.linalg.norm(x, axis=1, keepdims=True))
            rows = tables.write(pivots.placed(rows), "placed")
            held = rows.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("least")).collect()
        else:
            rows = rows.selectExpr("key", "v", "0 as shelf", "0 as ball", "0D as cos")
        found, of_shelf = {r.ball: r for r in held}, {}
        for r in held:
            s = int(pivots.shelf[r.ball])
            of_shelf[s] = of_shelf.get(s, 0) + r.n
        salts = {s: max(1, -(-m * width // SALT_BYTES)) for s, m in of_shelf.items()}
        balls = []
        for b in range(len(pivots.pivots) if n else 0):
            reach = math.acos(min(1.0, max(-1.0, found[b].least))) if b in found else 0.0
            s = int(pivots.shelf[b])
            balls.append((b, s, salts.get(s, 1), found[b].n if b in found else 0, reach, pivots.pivots[b].tolist()))
        spark.createDataFrame(balls, "ball int, shelf int, salts int, n long, reach double, pivot array<double>").write.parquet(f"{root}/balls")
        # Rows of a written table, so that a task run again deals them alike; by place, so that repeated rows are spread.
        parts = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps({str(s): m for s, m in salts.items()})), "map<string, int>"), F.col("shelf").cast("string")), F.lit(1))
        salted = rows.drop("cos").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int")).withColumn("spread", F.xxhash64("key", "v"))
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * width // FILE_BYTES))
        salted.repartitionByRange(files, "ball", "salt", "spread").drop("spread").sortWithinPartitions("ball").write.parquet(f"{root}/rows")
        if n:
            tables.drop(rows)
        return cls(spark, root)

    def _visits(self, blocks: DataFrame, k: int) -> DataFrame:
        """(block, shelf, ids, v, least, balls, products): what a block of queries visits on a shelf.  Blocks with ``known`` have been to their first balls."""
        first = "known" not in blocks.columns
        ids, near = blocks.schema["ids"].dataType.simpleString(), self.near

        def visit(batches):
            for whole in batches:
                for i in range(len(whole)):
                    row = whole.slice(i, 1)
                    own = row.column("ids")[0].values
                    x = np.asarray(row.column("v")[0].values).reshape(len(own), -1)
                    least = np.full(len(own), -np.inf)
                    if not first:
                        told = {r["id"]: r["least"] for r in row.column("known")[0].as_py() or []}
                        least = np.array([told.get(q, -np.inf) for q in own.to_pylist()])
                    seen = near.wanted(near.bounds(x), k, None if first else least).any(axis=0)
                    for s in np.unique(near.shelf[seen]):
                        balls = np.flatnonzero(seen & (near.shelf == s)).astype(np.int32)
                        cells = [pa.array([balls.tolist()], pa.list_(pa.int32())), pa.array([int(near.n[balls].sum()) * len(own)], pa.int64())]
                        yield pa.RecordBatch.from_arrays([row.column("block"), pa.array([s], pa.int32()), row.column("ids"), row.column("v"), pa.array([least.tolist()], pa.list_(pa.float64())), *cells], names=["block", "shelf", "ids", "v", "least", "balls", "products"])

        return blocks.mapInArrow(visit, f"block long, shelf int, ids {ids}, v array<double>, least array<double>, balls array<int>, products long")

    def _found(self, visits: DataFrame, k: int, kept: DataFrame | None, homes: int) -> DataFrame:
        """(block, query_id, key, score): the k best of each query in each group of vectors that its block visits."""
        visits = visits.withColumn("home", F.pmod(F.xxhash64("block"), F.lit(homes)).cast("int"))
        asked = visits.select(F.col("home").alias("to"), F.explode("balls").alias("ball")).distinct()
        # Balls are at most as many as pivots; what files and row groups hold none of them isn't read.
        balls = sorted(r.ball for r in asked.select("ball").distinct().collect())
        rows = self.rows if kept is None else self.rows.join(kept.select(F.col(kept.columns[0]).alias("key")), "key", "left_semi")
        rows = rows.where(F.col("ball").isin(balls)).join(asked, "ball").select("shelf", "salt", "to", "ball", "key", "v")
        parts = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps({str(s): m for s, m in self.salts.items()})), "map<string, int>"), F.col("shelf").cast("string")), F.lit(1))
        spread = visits.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("products")
        of = spread.schema["ids"].dataType.elementType.simpleString()

        def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
            keys = held.column("key").combine_chunks()
            # Rows in the order of their keys, so that ties go to the lesser one.
            order = pc.sort_indices(keys)
            held = held.take(order)
            keys, ball = held.column("key").combine_chunks(), held.column("ball").to_numpy()
            x = _matrix(held.column("v").combine_chunks()) if len(held) else np.zeros((0, 1))
            out = []
            for row in asked.to_batches():
                for i in range(len(row)):
                    ids = row.column("ids")[i].values
                    q = np.asarray(row.column("v")[i].values).reshape(len(ids), -1)
                    least, mine = np.asarray(row.column("least")[i].values), np.flatnonzero(np.isin(ball, np.asarray(row.column("balls")[i].values)))
                    r, c, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
                    for at in range(0, len(mine), TILE):
                        cols = mine[at : at + TILE]
                        scores = np.round(q @ x[cols].T, PLACES)
                        nr, nc = _top(scores, least, k)
                        r, c, s = np.append(r, nr), np.append(c, cols[nc]), np.append(s, scores[nr, nc])
                        by = np.lexsort((c, -s, r))
                        r, c, s = r[by], c[by], s[by]
                        few = np.arange(len(r)) - np.searchsorted(r, r) < k
                        r, c, s = r[few], c[few], s[few]
                    out.append(pa.table({"block": pa.array(np.full(len(r), row.column("block")[i].as_py()), pa.int64()), "query_id": ids.take(pa.array(r)), "key": keys.take(pa.array(c)), "score": pa.array(s)}))
            return pa.concat_tables(out) if out else pa.table({"block": pa.array([], pa.int64()), "query_id": pa.array([], asked.schema.field("ids").type.value_type), "key": keys.slice(0, 0), "score": pa.array([], pa.float64())})

        return spread.groupBy("shelf", "salt", "home").cogroup(rows.groupBy("shelf", "salt", "to")).applyInArrow(meet, f"block long, query_id {of}, key {rows.schema['key'].dataType.simpleString()}, score double")

    def top_k(self, queries: DataFrame, k: int, kept: DataFrame | None = None, query_id: str = "query_id", query: str = "query", counted: dict | None = None) -> DataFrame:
        """(query_id, rank, key, score): the k vectors of largest cosine for each query, exactly, ties to the lesser key; of ``kept`` (a column of keys), if given.

        Queries are ordered by their nearest pivot and visit balls in blocks.  Each block goes to the balls of largest bounds first; then the k-th score of each query is known, and
        the others whose bound is below it for all queries of the block are never read.  Neither queries nor vectors pass through the driver.

        A query with a null id, without a direction or of another length than the index's vectors has no rows; of rows with one id, the least vector asks.
        ``counted`` is given the products made and those of a scan, the balls read and all balls.
        """
        spark, key = self.spark, self.rows.schema["key"].dataType.simpleString()
        qid = queries.schema[query_id].dataType.simpleString()
        if self.near is None or k < 1:
            return spark.createDataFrame([], f"query_id {qid}, rank int, key {key}, score double")
        tables, dim = Tables(spark, "nearest"), self.near.pivots.shape[1]
        asked = _clean(queries, query_id, query).where(F.size("v") == dim).groupBy("key").agg(F.min("v").alias("v"))

        def block(batches):
            for whole in batches:
                for i in range(0, len(whole), BLOCK):
                    part = whole.slice(i, BLOCK)
                    yield pa.RecordBatch.from_arrays([_lists(part.column("key"), [0, len(part)]), _lists(pa.array(_matrix(part.column("v")).ravel()), [0, len(part) * dim])], names=["ids", "v"])

        near = self.near.placed(asked).repartitionByRange("shelf", "ball", "key").sortWithinPartitions("shelf", "ball", "key")
        # Written, so that a block stays what it is when a task runs again.
        blocks = tables.write(near.select("key", "v").mapInArrow(block, f"ids array<{qid}>, v array<double>").withColumn("block", F.monotonically_increasing_id()), "blocks")
        n, size = blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
        homes = max(1, -(-size * 8 // HOME_BYTES))
        best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
        one = tables.write(self._visits(blocks, k), "first")
        found = tables.write(best(self._found(one, k, kept, homes)), "found")
        least = found.groupBy("block", F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        known = least.groupBy("block").agg(F.collect_list(F.struct("id", "least")).alias("known"))
        two = tables.write(self._visits(blocks.join(known, "block", "left"), k), "rest")
        out = best(found.drop("rank").unionByName(self._found(two, k, kept, homes)))
        if counted is not None:
            both = one.select("balls", "products").unionByName(two.select("balls", "products"))
            made, read = both.agg(F.sum("products")).first()[0] or 0, both.select(F.explode("balls").alias("b")).distinct().count()
            counted |= {"products": made, "scan": int(self.near.n.sum()) * n, "read": read, "balls": int((self.near.n > 0).sum())}
        return out.select("query_id", F.col("rank").cast("int").alias("rank"), "key", "score")
