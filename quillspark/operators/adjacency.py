"""The link graph stored by node: packed neighbour lists in buckets, of which a walk reads those of its front."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.graph import both_ways, degrees
from quillspark.sources.shared import Tables, shared_dir

#: Links of a piece of a node's list, about.
PIECE = 4096
#: Nodes of a bucket, about, and buckets at most.
BUCKET, MOST = 20_000, 4096
#: Nodes of a front whose ids go into the scan's filter.
NAMED = 1000


class Adjacency:
    """A row for each node and piece of its list: id, piece, ghost, degree, links (other, way, seq), in folders bucket=<hash of id>.

    Way is 0 for links from the node and 1 for links to it.  A node that a third of all notes link to is as many rows as its list needs, dealt out by a
    hash of the neighbour, so no task or row holds it whole.  A node without links has piece 0 with an empty list.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.rows = spark.read.parquet(path)

    @classmethod
    def write(cls, nodes: DataFrame, edges: DataFrame, path: str | None = None) -> Adjacency:
        """Store a graph as graph.build() gives it."""
        spark = edges.sparkSession
        path = path or f"{shared_dir(spark)}/quillspark/adjacency-{uuid.uuid4().hex}"
        tables = Tables(spark, "adjacency")
        # The graph is derived from texts: it is made once for the two uses below.
        known, links = tables.write(degrees(nodes, own := tables.write(edges, "edges")), "degrees"), both_ways(own)
        buckets = min(MOST, 1 + known.count() // BUCKET)
        long = known.where(F.col("degree") > PIECE).select("id", F.ceil(F.col("degree") / PIECE).alias("pieces"))
        lists = links.join(long, "id", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("other", "way"), F.col("pieces")), F.lit(0)).cast("int"))
        lists = lists.groupBy("id", "piece").agg(F.collect_list(F.struct("other", "way", "seq")).alias("links"))
        # Each node has a piece 0, which tells its degree; the others tell their links only.
        first = known.withColumn("piece", F.lit(0)).join(lists.where("piece = 0"), ["id", "piece"], "left")
        rest = lists.where("piece > 0").join(known, "id").select(*first.columns)
        empty = F.array().cast(lists.schema["links"].dataType)
        rows = first.unionByName(rest).withColumn("links", F.coalesce("links", empty)).withColumn("bucket", bucket(buckets))
        rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "id", "piece").write.partitionBy("bucket").parquet(path)
        tables.drop(known, own)
        return cls(spark, path, buckets)

    def of(self, ids: DataFrame, *columns: str) -> DataFrame:
        """The stored rows of the nodes ``ids`` (id), read from their buckets only; of a short front, from the row groups that can have them."""
        named = [r.id for r in ids.select("id").distinct().limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            buckets = {r.b for r in self.spark.createDataFrame([(x,) for x in named], "id string").select(bucket(self.buckets).alias("b")).distinct().collect()}
            rows = self.rows.where(F.col("bucket").isin(sorted(buckets))).where(F.col("id").isin(named))
        else:
            buckets = {r.b for r in ids.select(bucket(self.buckets).alias("b")).distinct().collect()}
            rows = self.rows.where(F.col("bucket").isin(sorted(buckets))).join(ids.select("id").distinct(), "id", "left_semi")
        return rows.select(*columns)

    def neighbors(self, node: str) -> DataFrame:
        """(other) of a node: successors, then predecessors, in the order of their links; mutual links twice."""
        rows = self.of(self.spark.createDataFrame([(node,)], "id string"), "links")
        return rows.select(F.explode("links").alias("x")).select("x.*").orderBy("way", "seq").select("other")

    def expand(self, seeds: DataFrame, max_depth: int = 1, max_nodes: int = 20, decay: float = 0.5, hub: int = 50) -> DataFrame:
        """Breadth-first expansion of seeds (id, score, pos): (id, score, depth, place) of the first max_nodes notes reached, place from 1 in that order.

        score = seed score * decay ^ depth / log2(2 + degree).  Ghosts are passed through but not returned; nodes of more
        than ``hub`` links other than seeds are returned but not passed through.  A node's path (its seed's pos, then way and seq of each
        link) is its place in the order of a queue, so a level is one join and one minimum a node; no level is ranked as a whole.
        A level reads the lists of its front, and the degrees of what these name; only fronts are written.  Levels end once
        max_nodes are found, so a front that is gone on from holds fewer notes than that, and ghosts.
        """
        tables = Tables(self.spark, "expand")
        kinds = self.rows.schema["links"].dataType.elementType
        steps = f"struct<way:{kinds['way'].dataType.simpleString()},seq:{kinds['seq'].dataType.simpleString()}>"
        seen = seeds.select("id")
        front = seeds.select("id", "score", F.col("pos").cast("long").alias("pos"), F.array().cast(f"array<{steps}>").alias("path"))
        found, n = None, 0
        for depth in range(1, max_depth + 1):
            lists = self.of(front, "id", F.explode("links").alias("x")).select("id", F.col("x.other").alias("other"), F.struct("x.way", "x.seq").alias("step"))
            step = front.join(lists, "id").select(F.col("other").alias("id"), F.struct("pos", F.concat("path", F.array("step")).alias("path"), "score").alias("via")).join(seen, "id", "left_anti")
            reached = tables.write(step.groupBy("id").agg(F.min("via").alias("via")), "reached")
            front = tables.write(self.of(reached, "id", "piece", "degree", "ghost").where("piece = 0").join(reached, "id").select("id", "via.*", "degree", "ghost"), "front")
            tables.drop(reached)
            level = front.where("not ghost").select("id", (F.col("score") * decay**depth / F.log2(F.col("degree") + 2)).alias("score"), F.lit(depth).alias("depth"), "pos", "path")
            found = level if found is None else found.unionByName(level)
            before, n = n, n + level.count()
            if n >= max_nodes or (n == before and front.isEmpty()):
                break
            seen = seen.unionByName(front.select("id"))
            front = front.where(F.col("degree") <= hub).select("id", "score", "pos", "path")
        if found is None:
            return self.spark.createDataFrame([], "id string, score double, depth int, place int")
        # At most max_nodes rows are numbered.
        best = found.orderBy("depth", "pos", "path").limit(max_nodes)
        return best.withColumn("place", F.row_number().over(Window.orderBy("depth", "pos", "path"))).orderBy("place").select("id", "score", "depth", "place")


def bucket(buckets: int):
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
