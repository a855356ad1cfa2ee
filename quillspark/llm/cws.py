"""Document fingerprints: consistent weighted sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import written
from quillspark.llm.rows import once, sent

WHITE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: Samples in a fingerprint; rows aimed at in a bucket of neighbouring ids, and the most buckets.
SAMPLES, BUCKET_ROWS, MOST_BUCKETS = 64, 400, 100_000
#: The least a of a text of n words is looked for up to WITHIN / n, and found there but once in e ** WITHIN samples; up to ANY / n are those of all terms.
WITHIN, ANY = 16.0, 1e12
#: Bits of a sample's name; the highest one is that of a text without words.
NAME_BITS = 24
BLANK = (1 << NAME_BITS) - 1
#: An odd number, by which the steps t of one term get different names.
STRIDE = 7368787
_LAST = (1 << 63) - 1
_LEAST = -(1 << 63)


def drawn(counted: DataFrame, samples: int = SAMPLES, within: float = WITHIN) -> DataFrame:
    """The samples k of every term that may have a <= within / words, with r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1) from a hash and the hash of that.

    Rows (bucket, n, words, term, s, z), with the term's counts in both texts, become rows (.., ls, lz, k, r, ln c as c, b).  By its
    definition a = c / (y e^r) with y <= S, and so a >= c e^-r / S >= u (1 - v) / S, where e^-r = u and c = -ln v: this takes no logarithm.
    """
    unit = lambda x, n: f"((cast({x} as double) + 0.5D) / {1 << n}D)"
    part = lambda h, at, n: unit(f"(shiftrightunsigned({h}, {at}) & {(1 << n) - 1})", n)
    terms = counted.selectExpr("*", "ln(cast(s as double)) as ls", "ln(cast(z as double)) as lz", f"greatest(s, z) * ({within!r}D / words) as most")
    out = terms.selectExpr("*", f"explode(sequence(0, {samples - 1})) as k").selectExpr("*", "xxhash64(term, k) as one")
    out = out.selectExpr("*", f"{part('one', 32, 32)} * {part('one', 0, 32)} as u", "xxhash64(one) as two")
    out = out.selectExpr("*", f"{part('two', 42, 22)} * {part('two', 20, 22)} as v").where("u * (1D - v) <= most")
    return out.selectExpr("bucket", "n", "words", "term", "s", "z", "ls", "lz", "k", "-ln(u) as r", "ln(-ln(v)) as c", f"{part('two', 0, 20)} as b")


def sample_value(weight: str, log_weight: str) -> str:
    """SQL for ln a of the term in a sample above the bits that name (term, t); the least one of a document is its sample.

    t = floor(ln S / r + b), ln y = r (t - b), ln a = ln c - ln y - r.  The term is a hash already, so its name needs no other one; t is below
    2^38, as r is above 2^-33.
    """
    t = f"floor({log_weight} / r + b)"
    key = f"cast((c - r * ({t} - b + 1D) + 128D) * 1073741824D as bigint)"
    return f"if({weight} > 0, shiftleft({key}, {NAME_BITS}) | least((shiftrightunsigned(term, 20) + {t} * {STRIDE}L) & {BLANK}L, {BLANK - 1}L), null)"


def _sure(count: str, most: str, samples: int, within: float) -> str:
    """SQL for whether all least values are right: below within / words (less a thousandth for rounding), where no term was left out."""
    return f"{count} = {samples} and {most} < shiftleft(cast((ln({within!r}D / words) + 127.999D) * 1073741824D as bigint), {NAME_BITS})"


def _before(x, key, th):
    """Whether a cut (k, t) stands before (key, th)."""
    return (x["k"] < key) | ((x["k"] == key) & (x["t"] < th))


def _cuts(docs: DataFrame, bucket_rows: int) -> list[tuple[int, int]]:
    """Cuts (key, th) of rows (key, th, weight) into buckets of about ``bucket_rows`` rows, between ids and within those of many rows."""
    n = docs.count()
    wanted = max(1, min(MOST_BUCKETS, -(-n // bucket_rows)))
    if wanted == 1:
        return []
    cuts = docs.agg(F.percentile_approx("key", [i / wanted for i in range(1, wanted)], max(10_000, 10 * wanted))).first()[0]
    out = {(k, _LAST) for k in cuts}
    # At most wanted / 2 ids have so many rows; their rows are cut by the hash of the text, which is even.
    for r in docs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * -(-n // wanted)).collect():
        pieces = -(-r.n * wanted // n)
        out |= {(r.key, _LEAST + i * (1 << 64) // pieces - 1) for i in range(1, pieces)} | {(r.key, _LAST)}
    return sorted(out)


def _bucketed(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """Deal rows (doc_id, text, th, k2, weight) into buckets of neighbouring ids, and each bucket's first row (in descending
    order) as a guest into the bucket whose last row it follows.  Where a row goes depends on what it holds only."""
    spark = docs.sparkSession
    docs = docs.withColumn("key", F.coalesce(F.col("doc_id"), F.lit(_LEAST).cast("long")))
    cuts = _cuts(docs.select("key", "th"), bucket_rows)
    # Two steps of a search tree: groups of about sqrt(cuts) cuts.
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if groups:
        cut = "array<struct<k:long,t:long>>"
        tree = spark.createDataFrame([([g[-1] for g in groups], groups)], f"tops {cut}, cuts array<{cut}>")
        behind = lambda x: _before(x, F.col("key"), F.col("th"))
        inner = F.coalesce(F.size(F.filter(F.get("cuts", F.col("at")), behind)), F.lit(0))
        dealt = docs.join(F.broadcast(tree)).withColumn("at", F.size(F.filter("tops", behind))).withColumn("bucket", F.col("at") * step + inner).drop("tops", "cuts", "at")
    else:
        dealt = docs.withColumn("bucket", F.lit(0))
    heads = dealt.groupBy("bucket").agg(F.max(F.struct("key", "th", "k2", "weight")).alias("head")).select("bucket", "head.*").collect()
    heads.sort(key=lambda r: r.bucket)
    guests = [(h.bucket, h.th, h.k2, h.weight, heads[(i + 1) % len(heads)].bucket) for i, h in enumerate(heads)]
    first = spark.createDataFrame(guests, "bucket int, th long, k2 long, weight long, to int")
    dealt = dealt.join(F.broadcast(first), ["bucket", "th", "k2", "weight"], "left")
    place = lambda b, g: F.struct(F.col(b).cast("int").alias("bucket"), F.lit(g).alias("guest"))
    places = F.when(F.col("to").isNull(), F.array(place("bucket", False))).otherwise(F.array(place("bucket", False), place("to", True)))
    # A bucket that may not be null gets no null filter, which would keep two readers from sharing one exchange.
    bucket = F.coalesce("place.bucket", F.lit(0)).alias("bucket")
    return dealt.withColumn("place", F.explode(places)).drop("bucket").select("doc_id", "text", "th", "k2", "weight", bucket, "place.guest")


def fingerprints(docs: DataFrame, samples: int = SAMPLES, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS, within: float = WITHIN) -> DataFrame:
    """Consistent weighted samples of every text and of its edited text.

    Terms are the words of the whole text, weighted by their counts.  Sample k of a text is
    the (term, t) with the least a; two texts agree in a sample with the probability of
    their generalised Jaccard similarity, so likeness is the share of equal samples.  The
    edited text has its last floor(n_chars / 3) code points replaced by the first as many
    (or all) of the next document by descending id; after the last comes the first.

    Texts travel once, by bucket of neighbouring ids; terms are counted and samples are
    taken in those buckets without a further shuffle.  Buckets have about ``bucket_rows`` rows, also where
    one id has many, up to MOST_BUCKETS buckets (then they grow, and spill); so the tables that are broadcast are bounded.

    Most terms can't be the least of a sample, which a bound without logarithms tells (see ``drawn``).  Where a text has no value
    below ``within`` by its words in some sample, its bucket is worked on once more with all terms, so the bound changes no result.

    Nulls: a null text counts as empty, a null id is least.  Equal ids follow each other by
    text hash; repeated rows are worked on as two, one followed by its like and the last, and each gets a row.  A text without words has the fingerprint
    of empty slots, alike only to another such.  A lone document follows itself.  An
    empty table gives an empty result.  Other columns are not read.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (24 bits a
    sample in hex), near_edited, near_next: the shares of equal samples in these fingerprints.
    """
    rows = once(docs, doc_id, text)
    # Of equal rows all but the last are followed by their like.
    weights = F.explode(F.when(F.col("times") > 1, F.array(F.col("times") - 1, F.lit(1).cast("long"))).otherwise(F.array("times")))
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("k1").alias("th"), "k2", weights.alias("weight"))
    placed = _bucketed(rows, bucket_rows)
    out = written(_sampled(placed, samples, within), "fingerprints")
    unsure = out.where(~F.col("sure")).select("bucket").distinct()
    n = unsure.count()
    if n:
        unsure = written(unsure, "unsure")
        out = out.join(sent(unsure, n), "bucket", "left_anti").unionByName(_sampled(placed.join(sent(unsure, n), "bucket", "left_semi"), samples, ANY).select(out.columns))
    shown = [F.lower(F.hex(x)).alias(x) for x in ("fingerprint", "edited_fingerprint")]
    out = out.select("doc_id", "weight", "n_chars", "edited_sha256", *shown, "near_edited", "near_next")
    return out.withColumn("weight", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).drop("weight")


def _sampled(placed: DataFrame, samples: int, within: float) -> DataFrame:
    """Fingerprints of the rows of buckets, as bytes, and whether they are sure."""
    # Both branches below need all of these columns, so that they share one exchange of the texts.
    order = [F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("th").desc(), F.col("k2").desc(), F.col("weight").desc()]
    here = Window.partitionBy("bucket").orderBy(*order)
    n_chars, cut = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - cut), F.substring(F.lead("text").over(here), F.lit(1), cut))
    pairs = placed.withColumn("n", F.row_number().over(here)).withColumn("edited", edited)

    ours = F.split("text", WHITE)
    theirs = F.split(F.coalesce("edited", F.lit("")), WHITE)
    words = F.least(F.size(ours), F.size(theirs)).alias("words")
    terms = pairs.select("bucket", "n", words, F.size(ours).alias("mine"), F.concat(ours, theirs).alias("all")).select("bucket", "n", "words", "mine", F.posexplode_outer("all").alias("pos", "word"))
    counted = (
        terms.where("word <> ''").select("bucket", "n", "words", F.xxhash64("word").alias("term"), (F.col("pos") < F.col("mine")).cast("int").alias("own"))
        .groupBy("bucket", "n", "words", "term").agg(F.sum("own").alias("s"), F.sum(1 - F.col("own")).alias("z"))
    )
    # Most terms weigh the same in both texts.
    values = drawn(counted, samples, within).selectExpr("*", f"{sample_value('s', 'ls')} as f").selectExpr("bucket", "n", "words", "k", "f", f"if(s = z, f, {sample_value('z', 'lz')}) as e")
    least = values.groupBy("bucket", "n", "words", "k").agg(F.min("f").alias("f"), F.min("e").alias("e"))
    # What stays of a sample is its name: both names of sample k in one number.
    name = lambda x: f"coalesce({x} & {BLANK}L, {BLANK}L)"
    names = f"sort_array(collect_list(shiftleft(cast(k as bigint), {2 * NAME_BITS}) | shiftleft({name('f')}, {NAME_BITS}) | {name('e')})) as names"
    packed = least.groupBy("bucket", "n", "words").agg(*map(F.expr, [names, "count(f) as fs", "count(e) as es", "max(f) as ft", "max(e) as et"]))
    packed = packed.selectExpr("bucket", "n", "names", f"{_sure('fs', 'ft', samples, within)} as sure_f", f"{_sure('es', 'et', samples, within)} as sure_e")
    wordless = lambda x: ~F.coalesce(F.col(x), F.lit("")).rlike(WORD)
    info = pairs.select(
        "bucket", "n", "guest", "doc_id", "weight", n_chars.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        wordless("text").alias("no_f"), wordless("edited").alias("no_e"),
    )
    blank = F.array_repeat(F.lit(BLANK << NAME_BITS | BLANK).cast("long"), samples)
    full = info.join(packed, ["bucket", "n"], "left").withColumn("names", F.coalesce("names", blank))
    for x in "fe":
        full = full.withColumn(f"sure_{x}", F.col(f"no_{x}") | F.coalesce(f"sure_{x}", F.lit(False)))
    after = Window.partitionBy("bucket").orderBy("n")
    full = full.withColumn("next", F.lead("names").over(after)).withColumn("sure", F.col("sure_f") & F.col("sure_e") & F.lead("sure_f").over(after)).where(~F.col("guest"))
    of_f = lambda x: F.transform(x, lambda v: F.shiftrightunsigned(v, NAME_BITS).bitwiseAND(F.lit(BLANK)))
    full = full.select("*", of_f("names").alias("f"), F.transform("names", lambda v: v.bitwiseAND(F.lit(BLANK))).alias("e"), of_f("next").alias("g"))
    alike = lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda p: p)) / F.lit(float(samples))
    bytes_of = lambda x: F.unhex(F.array_join(F.transform(x, lambda v: F.lpad(F.hex(v), NAME_BITS // 4, "0")), ""))
    return full.select(
        "bucket", "sure", "doc_id", "weight", "n_chars", "edited_sha256", bytes_of("f").alias("fingerprint"), bytes_of("e").alias("edited_fingerprint"),
        alike("f", "e").alias("near_edited"), alike("f", "g").alias("near_next"),
    )
