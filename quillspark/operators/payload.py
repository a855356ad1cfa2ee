"""Payload indexes: rows laid out by folder and day of creation, with what each file holds, so that filters pick files before they are opened."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators import retrieval

#: Bits of a row's place by folder and by day: 2^BITS parts each, and the square of that in all; a part that is larger than a file is cut by the key's hash.
BITS = 8
#: Rows of a file, about.
FILE_ROWS = 50_000
#: Bits of a file's Bloom filter of tags (the size of a bitmap of Spark's), and the bits that a tag sets.
BLOOM, PROBES = 32768, 4
STATS = "file string, n long, least_folder long, most_folder long, least_created date, most_created date, tags binary"


def _folder(folder: Column) -> Column:
    """Filters ask for equal folders only, so folders are ordered by hash, which spreads them evenly."""
    return F.when(folder.isNotNull(), F.xxhash64(folder))


def _probes(tag: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(tag, F.lit(i)), F.lit(BLOOM)).cast("long") for i in range(PROBES)]


def _interleaved(a: Column, b: Column) -> Column:
    bit = lambda x, i: F.shiftright(x, i).bitwiseAND(F.lit(1))
    parts = [F.shiftleft(bit(x, i), 2 * i + k) for i in range(BITS) for k, x in enumerate((a, b))]
    return reduce(lambda x, y: x + y, parts)


def place(rows: DataFrame) -> Column:
    """A row's place on the Z-order curve of its folder's hash and its day's rank among all days, in 2^BITS parts of as many rows."""
    day = F.unix_date("created")
    cuts = rows.agg(F.percentile_approx(day, [i / (1 << BITS) for i in range(1, 1 << BITS)], 10000)).first()[0] or []
    # Equal cuts are one: a day of many rows is a part by itself.
    below = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<int>")
    rank = F.when(day.isNull(), F.lit(0)).otherwise(F.size(F.filter(below, lambda c: c <= day)))
    top = F.coalesce(F.shiftrightunsigned(_folder(F.col("folder")), 64 - BITS).cast("int"), F.lit(0))
    return _interleaved(rank, top)


class Payload:
    """A table of chunks or notes with columns folder, created and tags, and a row of what is in each of its files: number, ranges of folder hashes and days, tags as a Bloom filter.

    The row of a file has a bounded size; there are as many as files.  What a filter picks, its paths, goes through the driver, as all paths of a scan do.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    @classmethod
    def write(cls, rows: DataFrame, root: str, key: str = "chunk_id", file_rows: int = FILE_ROWS) -> Payload:
        """Lay ``rows`` out under ``root``, a new folder.

        One shuffle, by ranges of the curve and then of the key's hash, so that a folder or day of any size is many files.  ``rows`` are read
        three times (cuts, ranges, shuffle), the first two without the columns that these don't need.  Nulls: a row without folder, date or tags is in no filter on these, but is kept.
        """
        root, spark = root.rstrip("/"), rows.sparkSession
        files = max(1, -(-rows.count() // file_rows))
        placed = rows.withColumn("place_", place(rows)).withColumn("spread_", F.xxhash64(key))
        placed.repartitionByRange(files, "place_", "spread_").drop("place_", "spread_").write.parquet(f"{root}/rows")
        out = cls(spark, root, rows.schema)
        out._describe()
        return out

    def _describe(self) -> None:
        held = self.spark.read.schema(self.schema).parquet(f"{self.root}/rows")
        places = F.flatten(F.transform(F.filter("tags", lambda t: t.isNotNull()), lambda t: F.array(*_probes(t))))
        folder = _folder(F.col("folder"))
        held = held.select(F.col("_metadata.file_name").alias("file"), folder.alias("f"), F.col("created").cast("date").alias("d"), F.posexplode_outer(places).alias("i", "p"))
        stats = held.groupBy("file").agg(
            F.count_if(F.coalesce("i", F.lit(0)) == 0).alias("n"), F.min("f").alias("least_folder"), F.max("f").alias("most_folder"),
            F.min("d").alias("least_created"), F.max("d").alias("most_created"), F.bitmap_construct_agg("p").alias("tags"),
        )
        stats.write.parquet(f"{self.root}/files")

    def files(self, tags: list[str] | None = None, folder: str | None = None, after=None, before=None) -> DataFrame:
        """What is known of the files that may hold a row of the filter; all others hold none."""
        stats = self.spark.read.schema(STATS).parquet(f"{self.root}/files")
        tests: list[Column] = []
        if folder is not None:
            tests.append(_folder(F.lit(folder)).between(F.col("least_folder"), F.col("most_folder")))
        if after is not None:
            tests.append(F.col("most_created") >= F.lit(after).cast("date"))
        if before is not None:
            tests.append(F.col("least_created") <= F.lit(before).cast("date"))
        if tags:
            byte = lambda p: F.conv(F.hex(F.substring("tags", F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            is_set = lambda p: F.floor(byte(p) / F.pow(F.lit(2), p % 8)).cast("int") % 2 == 1
            tests.append(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(is_set, _probes(F.lit(t)))) for t in tags]))
        return stats.where(reduce(lambda a, b: a & b, tests)) if tests else stats

    def filtered(self, tags: list[str] | None = None, folder: str | None = None, after=None, before=None, counted: dict | None = None) -> DataFrame:
        """The rows that retrieval.filtered() leaves, from the files that may hold any; ``counted`` is given the files read and all files."""
        picked = [r.file for r in self.files(tags, folder, after, before).select("file").collect()]
        if counted is not None:
            counted |= {"read": len(picked), "files": self.spark.read.schema(STATS).parquet(f"{self.root}/files").count()}
        if not picked:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/rows/{f}" for f in picked])
        return retrieval.filtered(rows, tags, folder, after, before)
