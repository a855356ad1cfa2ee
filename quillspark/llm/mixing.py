"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Tables
from quillspark.llm.rows import named, repeated, row_key, sent

WORDS = r"[^\x20\x09-\x0D]+"
#: Cells into which a source's ranks are cut; a task orders one cell, a source's total needs one row a cell.
CELLS = 1024
#: Steps of a power of two in which a document's length is told.
STEPS = 1 << 20


def level(sources: DataFrame, budget: float) -> float | None:
    """The level at which sources (cap, weight) that get least(cap, level * weight) share ``budget``; None if all are filled.

    A level that leaves out what the caps can't take is raised until no further source is filled: every round is one
    aggregate, and fills at least one more source.
    """
    at, filled = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(at) * F.col("weight")
        sums = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if not sums.weight:
            return None
        if sums.n == filled:
            return at
        at, filled = (budget - (sums.cap or 0.0)) / sums.weight, sums.n


def targets(tables: Tables, sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Sources (source, size) with target: their share of ``share`` times all sizes, by weight and at most ``cap`` times their own.

    Sources in code point order, null last, weigh ``weights`` in turn.  They are numbered by ranges, so that no task holds all.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = tables.write(ranged, "sources")
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    caps = ranged.join(F.broadcast(before), "part").withColumn("i", place).select("source", "size", weight.alias("weight"), (F.lit(cap) * F.col("size")).alias("cap"))
    caps = tables.write(caps, "caps")
    total = caps.agg(F.sum("size")).first()[0] or 0
    at = level(caps, share * total)
    return caps.select("source", "size", (F.col("cap") if at is None else F.least(F.col("cap"), F.lit(at) * F.col("weight"))).alias("target"))


def _numbered(tables: Tables, base: DataFrame) -> DataFrame:
    """Rows (n1, n2, part, ...) with occ, their number among rows of equal key; a task numbers what one part of the table has of a key."""
    again = tables.write(base.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    n = again.count()
    if not n:
        return base.withColumn("occ", F.lit(0).cast("long"))
    keys = sent(again.select("n1", "n2"), n)
    several = base.join(keys, ["n1", "n2"])
    by_part = several.groupBy("n1", "n2", "part").agg(F.count(F.lit(1)).alias("n"))
    by_part = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("n1", "n2").orderBy("part")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("n1", "n2", "part").orderBy("k1", "k2")) - 1
    several = several.withColumn("place", place).join(by_part, ["n1", "n2", "part"]).withColumn("occ", (F.col("before") + F.col("place")).cast("long"))
    return base.join(keys, ["n1", "n2"], "left_anti").withColumn("occ", F.lit(0).cast("long")).unionByName(several.drop("place", "before"))


def mixed_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """How often the mix takes each document.

    Size: words of the text (null: 0).  Sources in code point order, null last, weigh
    ``weights`` in turn and share ``share`` times all words; a target stops at ``cap``
    times its source's words.  With ratio = target / source words, every document is
    certain of floor(ratio) copies.  Of what is left, a fraction f of the source's words, one more copy is drawn by Pareto order
    sampling with unequal odds: a document's inclusion probability is p = f + f (1 - f) e, with e between -1 and 1 by how far
    the logarithm of its size is below the source's mean over words.  So long documents, each of which moves the total a lot, are
    drawn less often than short ones, all p are between 0 and 1, and the words expected are the target: sum of p * size =
    f * source words.  With U uniform from the seed and the row, documents are ranked by (U / (1 - U)) / (p / (1 - p)), and
    the first are taken until their size, in words, is what is left of the target (the last one if that brings it
    nearer): samples are of fixed size in the unit of the target, up to half of one document.

    A source's ranks are cut into CELLS cells.  Word sums of cells say which cells are
    taken whole; only the rows of the one cell in which the target is met are ordered.
    So no task holds a source, however large, and there may be any number of sources.

    Nulls: a null id draws like the text 'null', a null text like 'null' too, a null source is a source.  U depends on id, text and source,
    and for rows equal in these on their number among them.  A source without words gets
    target 0.  An empty table gives an empty result.  Other columns are not read.

    Returns doc_id, source, size, source_size, target, copies, taken (= copies * size), inclusion (p), and the row's key k1, k2 over all columns of ``docs`` (see rows.py).
    """
    tables = Tables(docs.sparkSession, "mix")
    k1, k2 = row_key(docs)
    n1, n2 = row_key(docs, [doc_id, text, source])
    body = F.coalesce(F.md5(named(text).cast("binary")), F.lit("null"))
    name = named(source).cast("string")
    size = F.coalesce(F.regexp_count(named(text), F.lit(WORDS)), F.lit(0)).cast("long")
    base = docs.select(
        named(doc_id).alias("doc_id"), name.alias("source"), size.alias("size"), k1.alias("k1"), k2.alias("k2"), n1.alias("n1"), n2.alias("n2"), F.spark_partition_id().alias("part"),
        F.concat_ws("|", F.lit(str(seed)), F.coalesce(named(doc_id).cast("string"), F.lit("null")), body, F.coalesce(name, F.lit("null"))).alias("own"),
    )
    base = tables.write(base, "base")
    length = F.round(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")) * STEPS).cast("long")
    drawn = F.md5(F.concat_ws("|", "own", F.col("occ").cast("string")).cast("binary"))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    ranked = _numbered(tables, base).select("doc_id", "source", "size", "k1", "k2", length.alias("length"), u.alias("u"))
    sums = base.withColumn("length", length).groupBy("source")
    # Whole numbers, so that sums don't depend on their order.
    whole = F.sum(F.col("size").cast("decimal(38,0)") * F.col("length").cast("decimal(20,0)"))
    sums = tables.write(sums.agg(F.sum("size").alias("size"), whole.alias("spread"), F.min("length").alias("shortest"), F.max("length").alias("longest")), "sums")
    plan = targets(tables, sums.select("source", "size"), weights, share, cap).withColumnRenamed("source", "src").join(sums.drop("size"), F.col("src").eqNullSafe(F.col("source"))).drop("source")
    floor = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    mean = F.when(F.col("size") > 0, F.col("spread").cast("double") / F.col("size").cast("double")).otherwise(0.0)
    plan = plan.withColumn("whole", floor).withColumn("rest", F.when(F.col("size") > 0, F.col("target") - F.col("whole") * F.col("size")).otherwise(0.0)).withColumn("mean", mean)
    plan = plan.withColumn("reach", F.greatest(F.col("longest") - F.col("mean"), F.col("mean") - F.col("shortest")))
    plan = tables.write(plan.select("src", F.col("size").alias("source_size"), "target", "whole", "rest", "mean", "reach"), "plan")

    ranked = ranked.join(sent(plan), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    f = F.col("rest") / F.col("source_size")
    less = F.when(F.col("reach") > 0, (F.col("mean") - F.col("length")) / F.col("reach")).otherwise(0.0)
    ranked = ranked.withColumn("p", F.when(F.col("rest") > 0, f + f * (1 - f) * less))
    ranked = ranked.withColumn("rank", (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    ranked = ranked.withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS))
    cells = ranked.where("rank is not null").groupBy("source", "cell", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
    cells = cells.withColumn("upto", upto).select(F.col("source").alias("src"), F.col("cell").alias("cell_"), (F.col("upto") - F.col("words")).alias("before"), (F.col("upto") <= F.col("rest")).alias("all_in"))
    cells = tables.write(cells, "cells")
    ranked = ranked.join(sent(cells), F.col("source").eqNullSafe(F.col("src")) & (F.col("cell") == F.col("cell_")), "left").drop("src", "cell_")
    cut = F.coalesce(~F.col("all_in") & (F.col("before") < F.col("rest")), F.lit(False))
    clear = ranked.where(~cut).withColumn("more", F.coalesce(F.col("all_in"), F.lit(False)).cast("int"))
    at = F.col("before") + F.sum("size").over(Window.partitionBy("source", "cell").orderBy("rank", "doc_id", "size", "k1", "k2").rowsBetween(Window.unboundedPreceding, 0))
    near = (F.col("at") <= F.col("rest")) | ((F.col("at") - F.col("size") < F.col("rest")) & (F.col("at") - F.col("rest") < F.col("rest") - (F.col("at") - F.col("size"))))
    edge = ranked.where(cut).withColumn("at", at).withColumn("more", near.cast("int")).drop("at")
    copies = F.col("whole") + F.col("more")
    return clear.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), F.coalesce("p", F.lit(0.0)).alias("inclusion"), "k1", "k2")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as mixed_sources() takes it; rows that are equal in all columns share their copies."""
    taken = mixed_sources(docs, **options).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times"), F.sum("copies").alias("copies"))
    return repeated(docs, Tables(docs.sparkSession, "mix").write(taken, "copies"))


SQL = r"""
WITH d0 AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(md5(text), 'null') AS body,
         row_number() OVER (PARTITION BY doc_id, text, source) - 1 AS occ
  FROM documents),
d AS (SELECT doc_id, source, size, round(log2(greatest(size, 1)::DOUBLE) * 1048576.0::DOUBLE)::BIGINT AS length,
             (('0x' || substr(md5(concat_ws('|', '42', coalesce(doc_id::VARCHAR, 'null'), body, coalesce(source, 'null'), occ::VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
      FROM d0),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i,
             sum(size::HUGEINT * length)::DOUBLE AS spread, min(length) AS shortest, max(length) AS longest FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0) AS budget_left,
             (sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER before, 0)::DOUBLE AS weight_left
      FROM w WINDOW before AS (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(budget_left / weight_left, cap / weight) FILTER (budget_left / weight_left * weight < cap) AS level FROM o),
t AS (SELECT *, least(cap, coalesce(level, 1e300) * weight) AS target FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN spread / source_size::DOUBLE ELSE 0 END AS mean FROM t),
p AS (SELECT d.*, r.source_size, r.target, r.whole, CASE WHEN r.source_size > 0 THEN target - whole * r.source_size ELSE 0 END AS rest,
             CASE WHEN greatest(longest - mean, mean - shortest) > 0 THEN (mean - length) / greatest(longest - mean, mean - shortest) ELSE 0 END AS less
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
c AS (SELECT *, CASE WHEN rest > 0 THEN rest / source_size + rest / source_size * (1 - rest / source_size) * less END AS chance FROM p),
q AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (chance / (1 - chance)), doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND (run <= rest OR (run - size < rest AND run - rest < rest - (run - size))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q"""
