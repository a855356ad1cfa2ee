"""Corpus statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import graph


def token_distribution(chunks: DataFrame) -> DataFrame:
    """min, max, mean and median of the chunks' tokens; no row for no chunks."""
    t = F.col("token_estimate")
    out = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.min(t).alias("min"), F.max(t).alias("max"), F.avg(t).alias("mean"), F.median(t).alias("median"))
    return out.where("chunks > 0")


def top_tags(notes: DataFrame, most: int = 10) -> DataFrame:
    tags = notes.select(F.explode("tags").alias("tag")).where("tag <> ''")
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def top_folders(notes: DataFrame, most: int = 10) -> DataFrame:
    return notes.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "folder").limit(most)


def corpus(notes: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """The statistics bundle as one table (section, item, value): counts, tokens a chunk, top tags and folders, orphans, unresolved targets."""
    row = lambda df, section, item, value: df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("double").alias("value"))
    one, zero = F.lit(1), F.lit(0)
    # The chunks are made from texts, so they are gone through once, for their number and their tokens.
    t, told = F.col("token_estimate"), ("min", "max", "mean", "median")
    sums = chunks.agg(F.count(one).alias("chunks"), F.min(t).alias("min"), F.max(t).alias("max"), F.avg(t).alias("mean"), F.median(t).alias("median"))
    tokens = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for s, c in (("count", "chunks"), *(("tokens", c) for c in told))]))
    parts = [
        row(notes.agg(F.count(one).alias("n")), "count", F.lit("notes"), F.col("n")), sums.select("chunks", tokens.alias("x")).where("chunks > 0 or x.section = 'count'").select("x.*"),
        row(top_tags(notes, most), "tag", F.col("tag"), F.col("n")), row(top_folders(notes, most), "folder", F.col("folder"), F.col("n")),
        row(graph.orphans(nodes, edges), "orphan", F.col("id"), zero), row(graph.ghosts(nodes), "unresolved", F.col("id"), zero),
    ]
    return reduce(DataFrame.unionByName, parts)
