"""Connected components of a table of links, by forests of parts and by stars that shrink."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Tables

#: Links that a task joins in a forest of its own, about.
PART_LINKS = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part's links as stars: each node with the least node that this part joins it to."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = np.fromiter(up, np.int64, len(up))
    roots = np.fromiter((find(x) for x in list(up)), np.int64, len(up))
    for i in range(0, len(nodes), 1 << 16):
        a, b = nodes[i : i + (1 << 16)], roots[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])


def _summary(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node that it is joined to.

    Every round joins the links of a part, about PART_LINKS, in a forest and keeps its stars.
    While there are more parts than one, a round of large and small stars follows: each node's
    larger neighbours, then its smaller ones, are joined to the least of them; the end is when
    that changes nothing, as every component is one star.  Every round is written to the
    shared folder and the one before deleted; only a count and a checksum reach the driver.
    Every round but the last lowers some node's least neighbour, so there is an end.  Links that are null
    on a side are left out; repeated links and loops don't matter.
    """
    fine = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tables = Tables(links.sparkSession, "components")
    edges = tables.write(fine, "links")
    while True:
        parts = -(-edges.count() // PART_LINKS)
        old, edges = edges, tables.write(edges.coalesce(max(1, parts)).mapInArrow(_forest, "a long, b long"), "stars")
        tables.drop(old)
        if parts <= 1:
            break
        before = _summary(edges)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).join(least, F.col("u") == least.a).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b"))
        old, edges = edges, tables.write(small.where("a <> b").distinct(), "links")
        tables.drop(old)
        if _summary(edges) == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
