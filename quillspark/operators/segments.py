"""Tables of notes in immutable segments: what changed is written, and merged with the rest when it is read."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.sources.commits import Log

MANIFEST = "note_id string, content_hash string"


class Segments:
    """Folders ``root``/segments/<id> with a table notes (note_id, content_hash, listed, covers) and others, and ``root``/log, whose commits say which of them make a version.

    A note's rows are those of the last segment that ``covers`` it; ``listed`` tells whether it is there by then.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, f"{self.root}/log")

    def versions(self) -> list[int]:
        return self.log.versions()

    def version(self) -> int:
        """The last whole version; 0 for none."""
        return max(self.versions(), default=0)

    def segments(self, version: int | None = None) -> list[dict]:
        """The segments of a version, oldest first: id, notes (their number), tables (their schemas)."""
        v = self.version() if version is None else version
        return self.log.read(v)["segments"] if v else []

    def _table(self, segment: dict, table: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(segment["tables"][table])).parquet(f"{self.root}/segments/{segment['id']}/{table}")

    def _union(self, segments: list[dict], table: str) -> DataFrame:
        """The rows of all segments, with column seq: the segment's place."""
        parts = [self._table(s, table).withColumn("seq", F.lit(i)) for i, s in enumerate(segments)]
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)

    def _owners(self, segments: list[dict]) -> DataFrame:
        """(note_id, last): the segment that a note's rows are in, of notes that several segments have."""
        covered = self._union(segments, "notes").where("covers").groupBy("note_id")
        return covered.agg(F.max("seq").alias("last"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")

    def _live(self, segments: list[dict], table: str) -> DataFrame:
        rows = self._union(segments, table)
        if len(segments) > 1:
            last = self._owners(segments).withColumnRenamed("note_id", "of")
            rows = rows.join(last, (F.col("note_id") == F.col("of")) & (F.col("seq") < F.col("last")), "left_anti")
        return rows

    def _manifest(self, segments: list[dict]) -> DataFrame:
        """(note_id, content_hash) of the notes that are there."""
        if not segments:
            return self.spark.createDataFrame([], MANIFEST)
        latest = F.max_by(F.struct("listed", "content_hash"), "seq").alias("x")
        return self._union(segments, "notes").groupBy("note_id").agg(latest).where("x.listed").select("note_id", "x.content_hash")

    @staticmethod
    def _balanced(df: DataFrame, path: str) -> None:
        """Files of the size that the session's advisory size asks for, however many tasks made the rows."""
        df.hint("rebalance").write.parquet(path)

    def _keep(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _write(self, segment: dict, table: str, df: DataFrame, write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
        path = f"{self.root}/segments/{segment['id']}/{table}"
        (write or self._balanced)(df, path)
        segment["tables"][table] = json.loads(df.schema.json())
        return self._table(segment, table)

    def _delete(self, path: str) -> None:
        self.log.fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def vacuum(self, keep: int = 2, older: float = 3600) -> None:
        """Delete commits but the last ``keep``, and segments that none of these points to and that are older than ``older`` seconds (a refresh under way may yet commit them)."""
        versions = self.versions()
        for v in versions[:-keep]:
            self.log.forget(v)
        held = {x for v in versions[-keep:] for body in (self.log.read(v),) for x in [*(s["id"] for s in body["segments"]), body.get("change")]}
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/segments")
        for status in self.log.fs().listStatus(top) if self.log.fs().exists(top) else []:
            if status.getPath().getName() not in held and time.time() - status.getModificationTime() / 1000 >= older:
                self.log.fs().delete(status.getPath(), True)
