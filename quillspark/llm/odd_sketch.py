"""MinHash near-dedup: bands find candidates, odd sketches weigh them, whole sets confirm them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Tables, lowered, mixed, ranges, slices, span_names, word_spans
from quillspark.llm.components import components
from quillspark.llm.jaccard_rtree import COUNTED, LINKS, Forest, _cells, _links, _meetings
from quillspark.llm.rows import once, sent

#: Words of a shingle; two sets link at 100 * common >= LEAST * union.
SHINGLE, LEAST = 2, 80
#: Samples of a set, by band; a pair at the threshold shares no band with odds of (1 - 0.8^4)^64, about 2e-15.
BANDS, ROWS = 64, 4
SAMPLES = BANDS * ROWS
#: Bits of a sketch.  A pair at the threshold is taken for less than LOW with odds below 1e-10: its samples' similarity and the sketch's
#: estimate together have a standard deviation of 0.03.
BITS, LOW = 1024, 0.6
#: Sketches whose XOR has at most so many bits are weighed as LOW or more similar.
MOST_ODD = int(BITS / 2 * (1 - math.exp(-2 * 2 * SAMPLES * (1 - LOW) / BITS)))
#: Bands by which stars are looked for; links of a star that a task compares; rows of a tile of a hot band, and of a large group of candidates.
FIRSTS, STAR, BLOCK, TILE = 4, 512, 4096, 512
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mixed(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * _ODD)


def linked(common, a, b):
    """100 * common >= LEAST * (a + b - common)."""
    return (100 + LEAST) * common >= LEAST * (a + b)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles, as sorted 64-bit names; a text of fewer words is one shingle."""
    data = lowered(data)
    starts, ends, place = word_spans(data, offsets)
    words = span_names(data, starts, ends)
    n = np.diff(place)
    many = np.maximum(n - SHINGLE + 1, 0)
    at = ranges(place[:-1], many)
    h = np.full(len(at), np.uint64(SHINGLE))
    for j in range(SHINGLE):
        h = mixed(h * _ODD + words[at + j])
    cuts = np.append(0, np.cumsum(many)).tolist()
    few = [mixed(np.array([n[d]], np.uint64) * _ODD + words[place[d] : place[d] + 1]) if 0 < n[d] < SHINGLE else h[:0] for d in range(len(n))]
    return [np.unique(h[x:y]) if y > x else few[d] for d, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash: for each of SAMPLES orders of all names, the first name's rank in it; a row for each set, none of which may be empty."""
    flat, first = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SAMPLES), np.uint64)
    for i in range(SAMPLES):
        out[:, i] = np.minimum.reduceat((flat ^ _SEEDS[2 * i]) * (_SEEDS[2 * i + 1] | np.uint64(1)), first)
    return out


def bands(signs: np.ndarray) -> np.ndarray:
    """A name for the samples of each band."""
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signs), BANDS))
    for i in range(ROWS):
        out = mixed(out * _ODD + signs[:, i::ROWS])
    return out


def sketches(signs: np.ndarray) -> np.ndarray:
    """Odd sketches: each sample flips a bit of BITS; a row of BITS / 64 words for each set."""
    bits = mixed(signs ^ _SEEDS[:SAMPLES]) >> np.uint64(65 - BITS.bit_length())
    flips = np.bincount((np.arange(len(signs))[:, None] * BITS + bits.astype(np.int64)).ravel(), minlength=len(signs) * BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(signs), BITS), axis=1).view(np.uint64)


def likeness(odd: float) -> float:
    """The similarity that an XOR of ``odd`` bits speaks for: samples that differ flip two bits, and some of these meet."""
    return 1 + BITS / (4 * SAMPLES) * math.log(max(1 - 2 * odd / BITS, 1e-9))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ("doc_id", "k1", "k2", "times")
    for batch in batches:
        for i, j, data, offsets in slices(batch, "text"):
            sets = shingle_sets(data, offsets)
            n = np.array([len(s) for s in sets])
            lo, hi = ([int(f(s).sum(dtype=np.uint64).view(np.int64)) for s in sets] for f in (lambda s: s, lambda s: mixed(s ^ _ODD)))
            signs = samples([s for s in sets if len(s)]) if n.any() else np.zeros((0, SAMPLES), np.uint64)
            lists = lambda x, width: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((n > 0) * width)), pa.int32()), pa.array(x.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k).slice(i, j - i) for k in keys), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()),
                lists(np.ascontiguousarray(bands(signs)), BANDS), lists(sketches(signs), BITS // 64),
            ], names=[*keys, "n", "lo", "hi", "bands", "sketch"])


def odd_bits(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda out, n: out + n)


def _overlap(x: np.ndarray, y: np.ndarray) -> bool:
    return bool(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))


def _text_sets(table: pa.Table) -> list[np.ndarray]:
    return [x for batch in table.to_batches() for _, _, data, offsets in slices(batch, "text") for x in shingle_sets(data, offsets)]


def _stars(edges: pa.Table, texts: pa.Table) -> pa.Table:
    """The part's pairs of a document and the centre of its star that link, by their whole sets."""
    sets = dict(zip(texts.column("rid").to_pylist(), _text_sets(texts), strict=True))
    pairs = list(zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True))
    return _links([(a, b) for a, b in pairs if _overlap(sets[a], sets[b])], dict.fromkeys(COUNTED, len(pairs)))


def _words_of(column) -> np.ndarray:
    return np.ascontiguousarray(_cells(column)[0]).view(np.uint64).reshape(-1, BITS // 64)


def _met(forest: Forest, rows: np.ndarray, words: np.ndarray, size: np.ndarray, fits, done: dict[str, int]) -> Iterator[tuple[int, int]]:
    """Of these rows, the pairs that sizes and sketches allow and ``fits`` confirms, as far as they join what was apart."""
    done["pairs"] += len(rows) * (len(rows) - 1) // 2
    root = forest.roots(rows)
    if (root == root[0]).all():
        return
    step = max(1, (1 << 18) // len(rows))
    for x in range(0, len(rows), step):
        a, b = rows[x : x + step], rows[x:]
        odd = np.bitwise_count(words[a][:, None, :] ^ words[b][None, :, :]).sum(axis=2, dtype=np.int32)
        small, large = np.minimum(size[a][:, None], size[b][None, :]), np.maximum(size[a][:, None], size[b][None, :])
        fine = (odd <= MOST_ODD) & (100 * small >= LEAST * large) & (root[x : x + step, None] != root[None, x:]) & (np.arange(len(a))[:, None] < np.arange(len(b))[None, :])
        for i, j in zip(*(p.tolist() for p in np.nonzero(fine)), strict=True):
            done["boxed"] += 1
            i, j = int(a[i]), int(b[j])
            if forest.find(i) != forest.find(j):
                done["fitted"] += 1
                if fits(i, j):
                    forest.join(i, j)
                    yield i, j


def _candidates(groups: pa.Table, docs: pa.Table) -> pa.Table:
    """In the part's groups of documents with a common band: labels joined by the pairs that the sketches allow."""
    docs = docs.sort_by("rid")
    rid, label, size = (docs.column(c).to_numpy() for c in ("rid", "label", "n"))
    words = _words_of(docs.column("sketch"))
    members, cuts = _cells(groups.column("members"))
    place = np.searchsorted(rid, members)
    forest, done = Forest(label), dict.fromkeys(COUNTED, 0)
    found = [p for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False) for p in _met(forest, place[x:y], words, size, lambda i, j: True, done)]
    return _links([(int(label[i]), int(label[j])) for i, j in found], done)


def _verified(table: pa.Table) -> pa.Table:
    """In each tile of candidates: links between labels, by whole sets; pairs that are joined already need none."""
    rid, tile, label, size = (table.column(c).to_numpy() for c in ("rid", "tile", "label", "n"))
    sets, words = _text_sets(table.select(["text"])), _words_of(table.column("sketch"))
    found, done = [], dict.fromkeys(COUNTED, 0)
    order = np.lexsort((rid, tile))
    for rows in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
        forest = Forest(label[rows])
        fits = lambda i, j, rows=rows: _overlap(sets[rows[i]], sets[rows[j]])
        found += [(int(rid[rows[i]]), int(rid[rows[j]])) for i, j in _met(forest, np.arange(len(rows)), words[rows], size[rows], fits, done)]
    return _links(found, done)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counted: dict | None = None) -> DataFrame:
    """Groups of documents joined by links: Jaccard similarity of 2-word shingle sets of 0.8 or more.

    Documents of equal sets are one class.  A class has SAMPLES MinHash samples, named by BANDS bands, and folded into an odd
    sketch: the XOR of two sketches has as many bits as samples differ, nearly, which is sharp where sets are very similar.
    First stars: classes that share one of the first FIRSTS bands are compared with the least class that has it; what links has one label.
    Then the classes of each band that has several labels meet; sketches below LOW and sizes that can't link are left out, and a
    spanning forest of the rest goes on.  Joined, these are groups of candidates; their whole texts meet in tiles and pairs of different labels are compared
    in full.  A band or group of many classes is cut into tiles, so that each label meets every other; none is left out, and no
    step sends out all pairs.  ``counted`` is given how many pairs met, how many the sketches left (boxed) and how many were compared (fitted), by step.

    Links are confirmed on whole sets of 64-bit names.  One may be missed with odds of about 2e-15 by the bands and 1e-10 by the sketch at the threshold itself, less above it.

    Nulls: a null text has an empty set and no links; so has a text without words.  A null id counts as larger than all
    others.  Repeated rows are one row with their number in ``times``.  An empty table gives an empty result.  Other columns are not read.

    Returns a row for each distinct (doc_id, text): its key k1, k2 (see rows.py), times, doc_id, n_shingles, component_id (the least
    doc_id of the group) and kept (whether doc_id is that; of a group without ids, its first row).
    """
    spark = docs.sparkSession
    tables = Tables(spark, "odd-sketch")
    rows = once(docs, doc_id, text)
    schema = "doc_id long, k1 long, k2 long, times long, n long, lo long, hi long, bands array<long>, sketch array<long>"
    # Numbered as they are written: from here on rows are read from this table.
    sets = tables.write(rows.mapInArrow(_sets, schema).withColumn("rid", F.monotonically_increasing_id()), "sets")
    classes = tables.write(sets.where("n > 0").groupBy("n", "lo", "hi").agg(F.min("rid").alias("class")), "classes")
    copies = tables.write(sets.select("rid", "n", "lo", "hi").join(classes, ["n", "lo", "hi"]).where("rid <> class").select("rid"), "copies")
    heads = sets.where("n > 0").join(sent(copies), "rid", "left_anti")

    def compared(found: DataFrame, step: str) -> DataFrame:
        links = tables.write(found, step)
        if counted is not None:
            counted[step] = links.agg(*[F.sum(c).alias(c) for c in COUNTED]).first().asDict()
        return links.where("a is not null").select("a", "b")

    key = ("rid", "n", "sketch", "k1", "k2")
    firsts = heads.select(*key, F.explode(F.slice("bands", 1, FIRSTS)).alias("name"))
    centres = firsts.groupBy("name").agg(F.min(F.struct(*key)).alias("c"), F.count(F.lit(1)).alias("often")).where("often > 1")
    # Written, so that the join is of two plain exchanges, whose hot bands Spark can split.
    centres = tables.write(centres, "centres")
    fits = (100 * F.least("n", "c.n") >= LEAST * F.greatest("n", "c.n")) & (odd_bits(F.col("sketch"), F.col("c.sketch")) <= MOST_ODD)
    edges = firsts.join(centres, "name").where((F.col("rid") != F.col("c.rid")) & fits)
    edges = edges.select(F.col("rid").alias("a"), F.col("c.rid").alias("b"), "k1", "k2", F.col("c.k1").alias("c1"), F.col("c.k2").alias("c2")).distinct()
    edges = tables.write(edges, "edges")
    # A star's links are dealt out STAR at a time; small stars share a part.
    of_star = edges.groupBy("b").agg(F.count(F.lit(1)).alias("many"))
    parts = max(64, edges.count() // STAR)
    part = F.when(F.col("many") > STAR, F.xxhash64("b", F.pmod(F.xxhash64("a"), F.ceil(F.col("many") / STAR)))).otherwise(F.pmod(F.xxhash64("b"), F.lit(parts)))
    dealt = tables.write(edges.join(of_star, "b").withColumn("part", part), "dealt")
    ends = dealt.select("part", F.col("a").alias("rid"), "k1", "k2").unionByName(dealt.select("part", F.col("b").alias("rid"), F.col("c1").alias("k1"), F.col("c2").alias("k2"))).distinct()
    texts = rows.select("k1", "k2", "text").join(sent(ends), ["k1", "k2"]).select(F.col("part").alias("home"), "rid", "text")
    stars = compared(dealt.select("part", "a", "b").groupBy("part").cogroup(texts.groupBy("home")).applyInArrow(lambda e, t: _stars(e, t), LINKS), "stars")
    labels = tables.write(components(stars), "labels")
    tables.drop(edges, dealt, centres)

    n_labels = labels.count()
    labelled = lambda df: df.join(sent(labels.select(F.col("node").alias("rid"), "component"), n_labels), "rid", "left").withColumn("label", F.coalesce("component", "rid")).drop("component")
    entries = heads.select("rid", F.explode("bands").alias("name"))
    often = tables.write(entries.groupBy("name").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    shared = labelled(entries.join(often, "name").select("rid", "name"))
    met = _meetings(tables.write(shared, "shared"), "name", BLOCK).groupBy("name", "kind", "lo", "hi").agg(F.sort_array(F.collect_set("rid")).alias("members"), F.max("many").alias("many"))
    # Bands of one pair of documents have the same members; these are joined once.
    groups = met.groupBy(F.xxhash64("members").alias("grp")).agg(F.first("members").alias("members"), F.max("many").alias("many"))
    # Groups with one first document share a part, so that a part gets its documents once; tiles of a hot band go their own ways.
    first_of = F.when(F.col("many") > BLOCK, F.col("grp")).otherwise(F.col("members")[0])
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), sets.count() // 4096)
    groups = tables.write(groups.select(F.pmod(F.xxhash64(first_of), F.lit(parts)).cast("int").alias("part"), "members"), "groups")
    needed = groups.select(F.col("part").alias("home"), F.explode("members").alias("rid")).distinct()
    met_docs = labelled(needed.join(sets.select("rid", "n", "sketch"), "rid"))
    maybe = compared(groups.groupBy("part").cogroup(met_docs.groupBy("home")).applyInArrow(lambda g, d: _candidates(g, d), LINKS), "maybe")
    tables.drop(often, groups)

    found = components(maybe)
    sized = labelled(heads.select(*key)).join(sent(found.select(F.col("node").alias("label"), "component")), "label")
    sized = tables.write(_meetings(sized, "component", TILE), "candidates")
    n_found = sized.count()
    texts = rows.select("k1", "k2", "text").join(sent(sized, n_found), ["k1", "k2"]).withColumn("tile", F.xxhash64("component", "kind", "lo", "hi"))
    # Small groups share a part; a large group's tiles are parts of their own.
    part = F.when(F.col("many") > TILE // 2, F.col("tile")).otherwise(F.pmod(F.xxhash64("component"), F.greatest(F.lit(64), F.lit(n_found // 256))))
    links = compared(texts.withColumn("part", part).select("part", "tile", "rid", "label", "n", "sketch", "text").groupBy("part").applyInArrow(lambda t: _verified(t), LINKS), "links")
    joined = tables.write(components(stars.unionByName(links)), "joined")
    tables.drop(sized, labels, copies)

    big = F.lit((1 << 63) - 1)
    placed = (
        sets.select("doc_id", "k1", "k2", "times", "rid", "n", "lo", "hi").join(classes, ["n", "lo", "hi"], "left").join(joined, F.col("class") == F.col("node"), "left")
        .withColumn("grp", F.coalesce("component", "class")).drop("component", "node", "class")
    )
    least = placed.where("grp is not null").groupBy("grp").agg(F.min(F.struct(F.coalesce("doc_id", big).alias("id"), "k1", "k2")).alias("least"))
    done = placed.join(least, "grp", "left")
    nameless = F.col("least.id") == big
    own = F.when(nameless, F.col("doc_id")).otherwise(F.coalesce("least.id", "doc_id"))
    first = F.coalesce((F.col("least.k1") == F.col("k1")) & (F.col("least.k2") == F.col("k2")), F.lit(True))
    kept = F.when(F.coalesce(nameless, F.lit(False)), first).otherwise(F.coalesce(F.col("doc_id") == own, F.col("grp").isNull()))
    return done.select("k1", "k2", "times", "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), kept.alias("kept"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """near_copies(), a row per document: doc_id, n_shingles, component_id, kept."""
    found = near_copies(docs, doc_id, text)
    return found.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc_id", "n_shingles", "component_id", "kept")
