"""Filter interaction audit: joint failures of five filters, inverted over the lattice of filter sets."""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.rows import named

#: The filters in the order of their bits: a set of them is the sum of 2^place.
FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: Counted for each set: documents, good ones and toxic ones.
MEASURES = ("docs", "good", "toxic")
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def failures(text: Column) -> dict[str, Column]:
    """The filters that a text decides by itself, true where it fails.

    A: under 200 words; B: fewer than half of the words are distinct; C: over 3 % capital letters; D: a sign of ``#$%&*|``.
    A text without words fails A alone, as 0 is not below 0.
    """
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.size(F.split(text, "[A-Z]")) - 1
    return {"A": n < 200, "B": 100 * distinct.cast("long") < 50 * n.cast("long"), "C": 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def joint_failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """How many documents of each part fail all filters of each set: part, and arrays docs, good and toxic of SETS longs.

    The counts are sums of products of failure flags, so every task sums up its rows before they travel.  Filter E (the text
    stands at a smaller doc_id, table-wide) needs the least id of each text: rows are counted by digest of the text, part
    and labels, and all but those of the digest's least id fail E.  A text that a third of the rows have is a few rows to
    every task by then.  Labels are joined by id; of several labels of an id, any good and any toxic one counts.

    Nulls: a null text is empty, a null lang is the part ''; a null id has no label, and repeats nothing and is repeated by
    nothing.  Rows equal in id and text don't fail E by each other.  Equal texts are told by SHA-256.  An empty table
    has no parts.  Other columns are not read.
    """
    body = F.coalesce(named(text).cast("string"), F.lit(""))
    fails = failures(body)
    rows = docs.select(
        named(doc_id).cast("long").alias("id"), F.coalesce(named(lang).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), *[f.cast("int").alias(k) for k, f in fails.items()]
    ).groupBy("id", "part", "digest", *fails).agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    known = F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)
    groups = rows.groupBy("digest", "part", "good", "toxic", *fails).agg(F.sum("n").alias("n"), F.sum(known).alias("known"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("again", F.col("known") - F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0))

    def failing(of: int, measure: str) -> Column:
        flags = [F.col(k) for i, k in enumerate(FILTERS[:-1]) if of >> i & 1] + ([F.col(measure)] if measure != "docs" else [])
        return F.sum(reduce(lambda x, y: x * y, flags, F.col("again" if of >> 4 else "n")))

    return groups.groupBy("part").agg(*[F.array(*[failing(s, m) for s in range(SETS)]).alias(m) for m in MEASURES])


def survivors(failing: Column) -> Column:
    """Möbius inversion: of the joint failures of each set, the documents that pass all filters of each set."""
    signed = lambda within: F.aggregate(F.sequence(F.lit(0), F.lit(SETS - 1)), F.lit(0).cast("long"), lambda out, s: out + F.when(s.bitwiseAND(F.bitwise_not(within)) == 0, F.try_element_at(failing, s + 1) * (1 - 2 * (F.bit_count(s) % 2))).otherwise(0))
    return F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), signed)


def audit(joint: DataFrame) -> DataFrame:
    """What each filter of each order removes: from joint_failures(), a row for each part, order and step.

    Returns part, filter_order, step (from 1) and counts: kept after the step, removed by it, redundant (failing the step's
    filter but removed earlier), unique_fails (failing this filter only), good_lost and toxic_lost (of the removed), and
    shapley (removed by the filter over all 120 orders).  The game of removed documents has the dividend (-1)^(k+1) times the
    joint failures for a set of k filters; a filter gets a k-th of it, and 120 is divisible by every k.
    """
    steps = [{"o": order, "k": k + 1, "i": FILTERS.index(order[k]), "own": 1 << FILTERS.index(order[k]), "p": sum(1 << FILTERS.index(f) for f in order[:k])} for order in ORDERS for k in range(len(FILTERS))]
    # The orders are a constant of 600 entries, unfolded inside of each part's row.
    spots = F.from_json(F.lit(json.dumps(steps)), "array<struct<o string, k int, i int, own int, p int>>")
    pick = lambda column, s: F.try_element_at(F.col(column), (s + 1).cast("int"))
    each = joint.select("part", "docs", *[survivors(F.col(m)).alias(f"pass_{m}") for m in MEASURES])
    of_filter = lambda i: sum((F.col("docs")[s] * ((-1) ** (s.bit_count() + 1) * len(ORDERS) // s.bit_count()) for s in range(1, SETS) if s >> i & 1), F.lit(0).cast("long"))
    shares = F.array(*map(of_filter, range(len(FILTERS))))
    each = each.withColumn("shares", shares).withColumn("spot", F.explode(spots)).select("*", "spot.*")
    lost = lambda m: pick(f"pass_{m}", F.col("p")) - pick(f"pass_{m}", F.col("p") + F.col("own"))
    return each.select(
        "part", F.col("o").alias("filter_order"), F.col("k").alias("step"), pick("pass_docs", F.col("p") + F.col("own")).alias("kept"), lost("docs").alias("removed"),
        (pick("docs", F.col("own")) - lost("docs")).alias("redundant"), (pick("pass_docs", SETS - 1 - F.col("own")) - pick("pass_docs", F.lit(SETS - 1))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), pick("shares", F.col("i")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """audit() of joint_failures(); odd rows are treated as said there."""
    return audit(joint_failures(docs, labels, doc_id, text, lang))


#: By counting documents step by step in every order.
SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), least AS (SELECT text, min(doc_id) AS first FROM words GROUP BY text),
flags AS (
  SELECT words.part,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(words.text, '[^A-Z]', '', 'g')) > 3 * length(words.text), regexp_matches(words.text, '[#$%&*|]'), coalesce(words.doc_id > first, false)] AS fails,
    EXISTS (FROM labels l WHERE l.doc_id = words.doc_id AND l.quality = 1) AS good, EXISTS (FROM labels l WHERE l.doc_id = words.doc_id AND l.toxic = 1) AS toxic
  FROM words JOIN least ON words.text = least.text
), kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (SELECT filter_order, o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
counted AS (
  SELECT part, filter_order, step, o[step] AS f, n, good, toxic, fails, fails[o[step]] AS own,
    coalesce(list_bool_or(list_transform(o[1:step - 1], lambda j: fails[j])), false) AS before FROM kinds, steps
), table_ AS (
  SELECT part, filter_order, step, any_value(f) AS f,
    sum(n) FILTER (NOT before AND NOT own) AS kept, sum(n) FILTER (NOT before AND own) AS removed, sum(n) FILTER (before AND own) AS redundant,
    sum(n) FILTER (own AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails, sum(good) FILTER (NOT before AND own) AS good_lost, sum(toxic) FILTER (NOT before AND own) AS toxic_lost
  FROM counted GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM table_
"""
