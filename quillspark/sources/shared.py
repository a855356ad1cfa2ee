"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and Spark runs in one process, as in tests, a folder of our own
    that goes with it.  On a cluster without the setting, an error: executors would not see each other's files."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quillspark-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


class Tables:
    """The tables that one run of an operator writes: each cuts lineage in a form that outlives executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this run that nothing reads any more."""
        for df in tables:
            for file in df.inputFiles()[:1]:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back."""
    return Tables(df.sparkSession, name).write(df, name)
