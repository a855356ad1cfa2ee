"""Sharding: longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import written
from quillspark.llm.rows import sent

#: Groups of one size that a task numbers together, about.
CELL = 50_000


def lpt_runs(sizes: list[tuple[int, int]], n_shards: int) -> Iterator[tuple[int, int, int, int]]:
    """Longest processing time first over runs (size, count of groups): (size, first, end, shard), where groups of one size are numbered from 0.

    Each group goes to the least loaded shard, ties to the lower one, just as with one group after the other; but as soon as a size's
    groups go round all shards in one order, the rounds are dealt at once.
    """
    heap = [(0, s) for s in range(n_shards)]
    for size, count in sorted(sizes, reverse=True):
        at = 0
        while at < count:
            # Once the least loaded shard comes last after a group, and so each of the others, the order of shards repeats.
            if (heap[0][0] + size, heap[0][1]) >= max(heap) and count - at >= 2 * n_shards:
                turns = (count - at) // n_shards
                yield from ((size, at + i * turns, at + (i + 1) * turns, s) for i, (_, s) in enumerate(sorted(heap)))
                heap = [(load + turns * size, s) for load, s in sorted(heap)]
                at += turns * n_shards
                continue
            load, s = heap[0]
            # As many as it takes until another shard is less loaded.
            upto = min(heap[1:], default=(load + size * count, s))
            n = max(1, min(count - at, -(-(upto[0] - load) // size)))
            yield size, at, at + n, s
            heapq.heapreplace(heap, (load + n * size, s))
            at += n


def lpt_shards(docs: DataFrame, n_shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Put documents into shards of near equal bytes; equal texts share a shard.

    Size is the text's UTF-8 bytes plus 1.  Groups of equal texts (by 128 bits of hashes) are scheduled one by one, longest first: as the
    schedule depends on sizes only, the heap runs over the distinct sizes and how many groups have each, and hands out runs
    of groups by their number within their size.  Groups of a size are numbered by hash, in cells that hold a bounded number of them, so no size is
    numbered in one task.

    The driver holds a number for each distinct size of groups: the sizes of texts and multiples of these, not the groups.

    Nulls: a null text counts as empty; a null id is kept.  Repeated rows each get a slot.
    An empty table gives an empty result.  Other columns are not read.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless in each shard,
    in the order of input partition, doc_id, text_crc32), grown_shard (null).
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    base = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("g1"),
            F.xxhash64(F.lit(1), body).alias("g2"),
            F.spark_partition_id().alias("part"),
        ),
        "shard-base",
    )
    groups = written(base.groupBy("g1", "g2").agg(F.sum("size").alias("total")), "shard-groups")
    n_groups = groups.count()
    # Cells of a size by the first bits of the hash: about CELL groups of one size share one.
    cell = F.shiftrightunsigned("g1", 63 - max(0, (n_groups // CELL).bit_length()))
    cells = groups.groupBy("total", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = written(cells, "shard-cells")
    sizes = [(r.total, r.n) for r in cells.groupBy("total").agg(F.sum("n").alias("n")).collect()]
    runs = list(lpt_runs(sizes, n_shards))
    ahead = F.sum("n").over(Window.partitionBy("total").orderBy("cell")) - F.col("n")
    cells = cells.withColumn("ahead", ahead).drop("n")
    own = F.row_number().over(Window.partitionBy("total", "cell").orderBy("g1", "g2")) - 1
    numbered = groups.withColumn("cell", cell).withColumn("own", own).join(cells, ["total", "cell"]).select("g1", "g2", "total", (F.col("ahead") + F.col("own")).alias("number"))
    dealt = spark.createDataFrame(runs, "run_size long, first long, end long, shard int")
    placed = numbered.join(sent(dealt, len(runs)), (F.col("total") == F.col("run_size")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end")))
    placed = written(placed.select("g1", "g2", "shard"), "shard-placed")
    rows = base.join(sent(placed, n_groups), ["g1", "g2"]).select("doc_id", "size", "text_crc32", "part", "shard")
    before = (
        rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    )
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1
    return (
        rows.withColumn("place", place)
        .join(before, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
