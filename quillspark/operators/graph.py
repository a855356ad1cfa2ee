"""The notes' link graph: nodes, edges, degrees and neighbours; see adjacency.py for walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(notes: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, ghost) and edges (src, dst, kind, count, seq); an edge keeps its first kind, ghosts are targets that no note answers."""
    target = F.coalesce("target_note_id", "target_raw")
    seq = F.struct("note_id", "line", "class", "pos")
    edges = resolved.select(F.col("note_id").alias("src"), target.alias("dst"), "kind", seq.alias("seq")).groupBy("src", "dst")
    edges = edges.agg(F.min_by("kind", "seq").alias("kind"), F.count(F.lit(1)).alias("count"), F.min("seq").alias("seq"))
    ghosts = resolved.where(~F.col("resolved")).select(F.col("target_raw").alias("id")).distinct()
    nodes = notes.select(F.col("note_id").alias("id"), F.lit(False).alias("ghost")).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    return nodes, edges


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ghost, degree): edges in and out; a loop counts twice."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(ends, "id", "left").select("id", "ghost", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).where("degree = 0").select("id")


def ghosts(nodes: DataFrame) -> DataFrame:
    return nodes.where("ghost").select("id")


def hubs(nodes: DataFrame, edges: DataFrame, threshold: int = 50, most: int = 10) -> DataFrame:
    return degrees(nodes, edges).where((F.col("degree") > threshold) & ~F.col("ghost")).orderBy(F.desc("degree"), "id").limit(most).select("id", "degree")


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, way, seq): successors (way 0), then predecessors (way 1); mutual links twice."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(0).alias("way"), "seq")
    return out.unionAll(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(1).alias("way"), "seq"))


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    return both_ways(edges).where(F.col("id") == node).orderBy("way", "seq").select("other")


def report(nodes: DataFrame, edges: DataFrame, hub: int = 50) -> DataFrame:
    """(id, ghost, degree, is_hub, neighbors): a row a node; mutual links and loops count twice."""
    near = both_ways(edges).groupBy("id").agg(F.count(F.lit(1)).alias("neighbors"))
    out = degrees(nodes, edges).join(near, "id", "left")
    return out.select("id", "ghost", "degree", (F.col("degree") > hub).alias("is_hub"), F.coalesce("neighbors", F.lit(0)).cast("long").alias("neighbors"))
