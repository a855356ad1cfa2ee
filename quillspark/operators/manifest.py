"""Incremental refresh: manifest differences, upserts and deletes over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(note_id, change): added, modified, deleted or unchanged, from (note_id, content_hash) on both sides; a null hash equals another."""
    side = lambda df, h, here: df.select("note_id", F.col("content_hash").alias(h), F.lit(True).alias(here))
    both = side(current, "new", "is_new").join(side(previous, "old", "is_old"), "note_id", "full_outer")
    change = F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "deleted").when(~F.col("new").eqNullSafe(F.col("old")), "modified").otherwise("unchanged")
    return both.select("note_id", change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, ids: DataFrame, key: str = "note_id") -> DataFrame:
    return rows.join(ids, key, "left_anti")
