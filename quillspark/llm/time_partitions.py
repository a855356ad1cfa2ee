"""Adaptive time partitions: files of bounded rows by year, month, day or hour, and their rewriting when late rows arrive."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Tables
from quillspark.llm.rows import fresh, named, row_key
from quillspark.sources.shared import shared_dir

#: The table is cut for about so many files of equal size: a leaf has at most 1 + rows / PARTS rows, or is cut into parts of these.
PARTS = 500
#: Units by level below a year; an hour isn't cut by time any more.
UNITS = ("M", "D", "h")
LEAF = "leaf string, first_hour long, end_hour long, n long"
NULL_LEAF = "null"
#: Slots of whole days by which rows look up their leaf, at most; a slot is a day up to 1,000 years.
SLOTS = 400_000


def moment(ts: Column, click_id: Column) -> Column:
    """The time that a row is filed by: ts, moved by the row's k = crc32(decimal id) mod 128.

    k < 16: back by (k+6)^3 days; k > 111: to Monday 00:00.  A null id has no k and isn't moved; a null ts stays null.  All
    is done in wall-clock time; a ts with a zone is taken as the session's zone shows it.
    """
    ts, k = ts.cast("timestamp_ntz"), F.pmod(F.crc32(click_id.cast("string").cast("binary")), F.lit(128)).cast("int")
    back = ts - F.make_dt_interval((k + 6) * (k + 6) * (k + 6))
    return F.when(k < 16, back).when(k > 111, F.trunc(ts.cast("date"), "week").cast("timestamp_ntz")).otherwise(ts)


def hour_number(time: Column) -> Column:
    """Hours since 1970-01-01 00:00."""
    return F.unix_date(time.cast("date")).cast("long") * 24 + F.hour(time)


def folded(sizes: list[int], most: int) -> Iterator[tuple[int, int, int]]:
    """Runs (first, last, size) of siblings in order: one within ``most`` joins the run just before it if that stays within, else it starts one.

    A sibling above ``most`` is a run by itself, which nothing joins.
    """
    first, total = 0, None
    for i, n in enumerate(sizes):
        if total is not None and n <= most and total + n <= most:
            total += n
            continue
        if total is not None:
            yield first, i - 1, total
        first, total = i, n
    if total is not None:
        yield first, len(sizes) - 1, total


def subtree(stem: str, first: int, end: int, level: int, hours: np.ndarray, upto: np.ndarray, most: int) -> Iterator[tuple[str, int, int, int]]:
    """Leaves (name, first hour, end hour, rows) of the node of hours first .. end, cut into its months, days or hours.

    ``hours`` are the hours with rows, ``upto`` the rows before each of them and in all.
    """
    unit = UNITS[level]
    begin, stop = (np.datetime64(int(x), "h").astype(f"M8[{unit}]") for x in (first, end))
    edges = np.arange(begin, stop + 1).astype("M8[h]").astype(np.int64)
    counts = np.diff(upto[np.searchsorted(hours, edges)])
    # Members go by their number in the node: months and days from 1, hours from 0.
    name = lambda i: f"{i + (unit != 'h'):02d}"
    for i, j, n in folded(counts.tolist(), most):
        if n > most and unit != "h":
            yield from subtree(f"{stem}/{name(i)}", int(edges[i]), int(edges[i + 1]), level + 1, hours, upto, most)
        elif n:
            yield f"{stem}/{name(i)}-{name(j)}", int(edges[i]), int(edges[j + 1]), n


def year_hours(year: int) -> tuple[int, int]:
    first, end = (np.datetime64(y - 1970, "Y").astype("M8[h]").astype(np.int64) for y in (year, year + 1))
    return int(first), int(end)


def planned(histogram: DataFrame, most: int) -> list[tuple[str, int, int, int]]:
    """The leaves of a histogram (year, hour, n): name, first hour, end hour, rows.

    Each year's hours, at most 8784 rows, are planned in a task of their own (applyInPandas); that also tells the year's rows.
    The last pass folds the years, whose number the calendar bounds, and takes the subplans of years above ``most`` only.  Two
    neighbouring runs of one node have more than ``most`` rows together, so leaves are at most a few times
    PARTS by level whatever the table's size: the plan may go to the driver and to every task.
    """

    def subplan(hours: pd.DataFrame) -> pd.DataFrame:
        hours = hours.sort_values("hour")
        year, n = int(hours["year"].iloc[0]), hours["n"].to_numpy(np.int64)
        upto = np.append(0, np.cumsum(n))
        leaves = list(subtree(f"{year:04d}", *year_hours(year), 0, hours["hour"].to_numpy(np.int64), upto, most))
        return pd.DataFrame([(year, int(upto[-1]), *x) for x in leaves], columns=["year", "of_year", "leaf", "first_hour", "end_hour", "n"])

    plans = Tables(histogram.sparkSession, "time-partitions").write(histogram.groupBy("year").applyInPandas(subplan, f"year int, of_year long, {LEAF}"), "subplans")
    sizes = {r.year: r.of_year for r in plans.select("year", "of_year").distinct().collect()}
    if not sizes:
        return []
    first = min(sizes)
    runs = list(folded([sizes.get(y, 0) for y in range(first, max(sizes) + 1)], most))
    out = [(f"{first + i:04d}-{first + j:04d}", year_hours(first + i)[0], year_hours(first + j)[1], n) for i, j, n in runs if 0 < n <= most]
    used = plans.where(F.col("of_year") > most).select("leaf", "first_hour", "end_hour", "n")
    return sorted(out + [tuple(r) for r in used.collect()], key=lambda x: x[1])


class Layout:
    """The rows of a table in the files that a plan gives them.

    ``rows`` has the table's ``columns`` and helpers: time (the moment) and is_new.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame, columns: list[str], helpers: dict[str, str], order: list[str], histogram: DataFrame, nulls: int, most: int):
        self.h, self.most, self.columns = helpers, most, columns
        leaves = planned(histogram, most) + ([(NULL_LEAF, None, None, nulls)] if nulls else [])
        parts = lambda n: -(-n // most)
        first = np.cumsum([0] + [parts(x[3]) for x in leaves])
        #: (leaf, part) by the number of the file.
        self.files = [(name, p + 1) for name, _, _, n in leaves for p in range(parts(n))]
        self.sizes = [min(most, n - p * most) for _, _, _, n in leaves for p in range(parts(n))]
        h, spots = helpers, []
        dated = [(lo, hi, int(f), n > most) for (_, lo, hi, n), f in zip(leaves, first, strict=False) if lo is not None]
        if dated:
            # A leaf for each slot of days that it touches, so that a row meets the few leaves of its own slot; the calendar bounds
            # the slots by SLOTS, and planned() the leaves, so this may go to every task.
            width = 24 * (1 + (dated[-1][1] - dated[0][0]) // (24 * SLOTS))
            spots = [(s, *x) for x in dated for s in range(x[0] // width, (x[1] - 1) // width + 1)]
            rows = rows.withColumn(h["hour"], hour_number(F.col(h["time"])))
            spots = spark.createDataFrame(spots, f"{h['slot']} long, {h['lo']} long, {h['hi']} long, {h['file']} int, {h['cut']} boolean")
            inside = (F.floor(F.col(h["hour"]) / width) == F.col(h["slot"])) & (F.col(h["hour"]) >= F.col(h["lo"])) & (F.col(h["hour"]) < F.col(h["hi"]))
            placed = rows.join(F.broadcast(spots), inside, "left").drop(h["hour"], h["slot"], h["lo"], h["hi"])
        else:
            placed = rows.withColumn(h["file"], F.lit(None).cast("int")).withColumn(h["cut"], F.lit(None).cast("boolean"))
        # What has no leaf has no time.
        placed = placed.withColumn(h["file"], F.coalesce(F.col(h["file"]), F.lit(int(first[-2]) if leaves else 0))).withColumn(h["cut"], F.coalesce(F.col(h["cut"]), F.lit(nulls > most)))
        content = lambda df: df.withColumn(h["key"], row_key(df, columns)[0])
        self.order = [F.asc_nulls_last(c) for c in [h["time"], *order, h["key"]]]
        if any(x[3] > most for x in leaves):
            self.placed = content(placed.where(~F.col(h["cut"]))).drop(h["cut"]).unionByName(self._cut(spark, content(placed.where(h["cut"])).drop(h["cut"])))
        else:
            self.placed = content(placed.drop(h["cut"]))

    def _cut(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        """Rows of leaves above ``most``, each with its part's file: sorted by ranges of the whole order, so that a leaf spreads over tasks, and numbered
        by the rows that earlier ranges have of the leaf."""
        h, tables = self.h, Tables(spark, "time-partitions")
        ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = tables.write(rows, "above")
        ordered = rows.repartitionByRange(ranges, F.col(h["file"]), *self.order).sortWithinPartitions(F.col(h["file"]), *self.order)
        # Written, as ranges come from a sample and must be the same for the numbers and for the rows.
        ordered = tables.write(ordered.withColumn(h["place"], F.monotonically_increasing_id()), "ordered")
        tables.drop(rows)
        piece = F.shiftrightunsigned(h["place"], 33)
        pieces = ordered.groupBy(h["file"], piece.alias(h["piece"])).agg(F.count(F.lit(1)).alias(h["n"]), F.min(h["place"]).alias(h["from"]))
        before = F.sum(h["n"]).over(Window.partitionBy(h["file"]).orderBy(h["piece"])) - F.col(h["n"])
        # A row for each range and leaf in it: ranges + PARTS at most.
        pieces = pieces.withColumn(h["before"], before).drop(h["n"])
        number = F.col(h["before"]) + F.col(h["place"]) - F.col(h["from"])
        out = ordered.withColumn(h["piece"], piece).join(F.broadcast(pieces), [h["file"], h["piece"]])
        return out.withColumn(h["file"], (F.col(h["file"]) + F.floor(number / self.most)).cast("int")).drop(h["piece"], h["before"], h["from"], h["place"])

    def in_files(self, only: list[int] | None = None, by: Column | None = None) -> DataFrame:
        """The rows by file, in order: all of a file in one task, which sorts on disk and streams.  ``by`` names the file in the sort's stead."""
        h, rows = self.h, self.placed
        if only is not None:
            rows = rows.where(F.col(h["file"]).isin(only)) if only else rows.limit(0)
        n = max(1, min(len(self.files) if only is None else len(only), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        # Dealt out evenly by the files' numbers.
        dealt = rows.repartitionById(n, F.pmod(F.col(h["file"]), F.lit(n)).cast("int"))
        if by is not None:
            dealt = dealt.withColumn(h["folder"], by)
        return dealt.sortWithinPartitions(h["file"] if by is None else h["folder"], *self.order)

    def described(self, click_id: str, only: list[int] | None = None) -> dict[int, tuple[int, int, str, str]]:
        """Of each file: rows, new rows, SHA-256 of the ids in order, digest of the rows in order.  A task holds a batch at a time."""
        h = self.h
        rows = self.in_files(only).select(F.col(h["file"]).alias("file"), named(click_id).cast("string").alias("id"), F.col(h["key"]).alias("key"), F.col(h["is_new"]).alias("is_new"))
        found = rows.mapInArrow(_digests, "file int, n_rows long, n_new long, ids string, content string").collect()
        return {r.file: (r.n_rows, r.n_new, r.ids, r.content) for r in found}

    def write(self, root: str, only: list[int] | None = None) -> None:
        """A Parquet file for each (leaf, part), or those of the numbers ``only``, in folders by_file=<leaf>.<part>."""
        names = F.from_json(F.lit(json.dumps([folder(*f) for f in self.files])), "array<string>")
        # Sorted by the folder that the files go to, which is never null: else the writer sorts again, and the order within a file is lost.
        rows = self.in_files(only, F.coalesce(F.try_element_at(names, F.col(self.h["file"]) + 1), F.lit("")))
        rows.select(*map(named, self.columns), self.h["folder"]).write.mode("append").partitionBy(self.h["folder"]).parquet(root)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, n, new, ids, content, out = None, 0, 0, None, None, []
    for batch in batches:
        file = batch.column("file").to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, file[1:] != file[:-1])), len(file)).tolist()
        for i, j in zip(cuts, cuts[1:], strict=False):
            if file[i] != at:
                if at is not None:
                    out.append((at, n, new, ids.hexdigest(), content.hexdigest()))
                at, n, new, ids, content = int(file[i]), 0, 0, hashlib.sha256(), hashlib.sha256()
            part = batch.slice(i, j - i)
            ids.update(("," * (n > 0) + ",".join(x or "" for x in part.column("id").to_pylist())).encode())
            content.update(part.column("key").to_numpy().tobytes())
            n += j - i
            new += int(part.column("is_new").to_numpy(zero_copy_only=False).sum())
    if at is not None:
        out.append((at, n, new, ids.hexdigest(), content.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "n_rows", "n_new", "ids", "content"])


def folder(leaf: str, part: int) -> str:
    return f"{leaf.replace('/', '_')}.{part}"


def data_files(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Parquet files by their folder under ``root``; their number is bounded by the plan's."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, list[str]] = {}
    if fs.exists(top):
        found = fs.listFiles(top, True)
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().endswith(".parquet"):
                out.setdefault(path.getParent().getName().split("=", 1)[-1], []).append(path.toString())
    return out


def recurring(start: Layout, final: Layout, found: dict[int, tuple[int, int, str, str]], click_id: str) -> set[tuple[str, int]]:
    """Files (leaf, part) with the same rows in both layouts.

    A leaf of one name has the same range, so its rows of the first layout are its rows of the last one but for the new.  Its
    parts before the first new row recur, if they are as long; parts with new rows don't.  Parts behind have moved on, and
    recur only where repeated rows hide that: their digests tell.
    """
    at, stay, moved, late = {f: i for i, f in enumerate(start.files)}, set(), [], set()
    for i, f in enumerate(final.files):
        n, n_new = found[i][:2]
        if n_new:
            late.add(f[0])
        elif f in at and start.sizes[at[f]] == n:
            moved.append(i) if f[0] in late else stay.add(f)
    if moved:
        was = start.described(click_id, [at[final.files[i]] for i in moved])
        stay |= {final.files[i] for i in moved if was[at[final.files[i]]][3] == found[i][3]}
    return stay


def time_partitions(rows: DataFrame, before: str, root: str | None = None, click_id: str = "click_id", ts: str = "ts", arrived_at: str = "arrived_at", parts: int = PARTS) -> DataFrame:
    """Write the rows that arrived before a time into a new folder ``root``, then rewrite it for all rows; the final files.

    A row's time is moment().  Years are siblings from the first to the last; a node above L = 1 + floor(rows / ``parts``) rows is cut
    into all its months, days or hours; siblings within L are folded into runs from left to right.  Leaves are runs with rows, hours
    above L, and the rows without a time.  A leaf's rows in the order of time, arrived_at, id and content are cut into parts of
    L rows, one Parquet file each, with the table's columns.  L is that of all rows for both layouts.  Files whose
    leaf, part and rows recur stay where they are; only the others are written, and the files that they replace are deleted then.

    Only counts by hour go to the planner (see planned()); the plan, a few rows for each file, is all that the driver holds or
    broadcasts.  A leaf above L is numbered by ranges, never in one task; a file is sorted and written by one task, which spills.

    Nulls: a null ts is in the leaf 'null'; a null arrived_at or id comes last in the order, a row of null arrived_at isn't
    in the first layout and counts as new; a null id is empty among the ids.  Repeated rows are kept one by one.  An empty table gives an empty
    result, and a folder without data files.  All columns of the table are kept, whatever they are called.

    Returns for each final file: leaf, part, columns, n_rows, n_new, ids_sha256, path, rewritten.
    """
    spark, columns = rows.sparkSession, rows.columns
    root = root or f"{shared_dir(spark)}/quillspark/time-partitions-{uuid.uuid4().hex}/files"
    h = {c: fresh(rows, f"_{c}") for c in ("time", "hour", "slot", "lo", "hi", "file", "cut", "key", "is_new", "place", "piece", "n", "from", "before")}
    h["folder"] = fresh(rows, "by_file")
    new = ~F.coalesce(named(arrived_at).cast("timestamp_ntz") < F.lit(before).cast("timestamp_ntz"), F.lit(False))
    keyed = rows.withColumns({h["time"]: moment(named(ts), named(click_id)), h["is_new"]: new})
    time, is_new = F.col(h["time"]), F.col(h["is_new"])
    # One row for each hour that has rows, and one for rows without a time.
    hours = keyed.groupBy(F.year(time).alias("year"), hour_number(time).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~is_new).alias("old"))
    hours = Tables(spark, "time-partitions").write(hours, "hours")
    n_rows, nulls, old_nulls = hours.agg(F.coalesce(F.sum("n"), F.lit(0)), *[F.coalesce(F.sum(F.when(F.col("hour").isNull(), F.col(c))), F.lit(0)) for c in ("n", "old")]).first()
    most, dated = 1 + n_rows // parts, hours.where("hour is not null")
    order = [f"`{c.replace('`', '``')}`" for c in (arrived_at, click_id)]

    start = Layout(spark, keyed.where(~is_new), columns, h, order, dated.where("old > 0").select("year", "hour", F.col("old").alias("n")), old_nulls, most)
    start.write(root)
    had = data_files(spark, root)
    final = Layout(spark, keyed, columns, h, order, dated.select("year", "hour", "n"), nulls, most)
    found = final.described(click_id)
    stay = recurring(start, final, found, click_id)
    if fresh_files := [i for i, f in enumerate(final.files) if f not in stay]:
        final.write(root, fresh_files)
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in set(start.files) - stay:
        for path in had[folder(*f)]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), False)
    paths = data_files(spark, root)
    out = []
    for i, (n, n_new, ids, _) in found.items():
        f = final.files[i]
        (path,) = paths[folder(*f)]
        out.append((f[0], f[1], ",".join(columns), n, n_new, ids, path, f not in stay))
    return spark.createDataFrame(out, "leaf string, part long, columns string, n_rows long, n_new long, ids_sha256 string, path string, rewritten boolean")
