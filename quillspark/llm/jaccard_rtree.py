"""N-gram Jaccard join over a count-vector R-tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Tables, lowered, mixed, ranges, slices, span_names, word_spans
from quillspark.llm.components import components
from quillspark.llm.rows import once, repeated, sent

#: Words of a shingle; groups that shingles are hashed into (a power of two); entries of a leaf and children of a node.
SHINGLE, GROUPS, LEAF, FAN = 5, 64, 32, 8
#: Documents of a tile: a hot shingle's documents (BLOCK), and a large group of candidates (TILE), are joined tile by tile.
BLOCK, TILE = 4096, 512
#: Least shingles of a set by which stars are looked for; links of a star, and of small stars together, that a task compares.
FIRSTS, STAR = 2, 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles, as sorted 64-bit names; a text of fewer words is one shingle."""
    data = lowered(data)
    starts, ends, place = word_spans(data, offsets)
    words = span_names(data, starts, ends)
    n = np.diff(place)
    at = ranges(place[:-1], np.maximum(n - SHINGLE + 1, 0))
    h = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        h = h * _ODD + words[at + j]
    h = mixed(h)
    cuts = np.append(0, np.cumsum(np.maximum(n - SHINGLE + 1, 0)))
    out = []
    for d in range(len(n)):
        if n[d] >= SHINGLE:
            out.append(np.unique(h[cuts[d] : cuts[d + 1]]))
        elif n[d]:
            name = np.array([n[d]], np.uint64)
            for w in range(place[d], place[d + 1]):
                name = mixed(name * _ODD + words[w : w + 1])
            out.append(name)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def count_vector(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(65 - GROUPS.bit_length())).astype(np.int64), minlength=GROUPS).astype(np.int32)


def spare(n):
    """Names of a head that a set needn't be found by."""
    return n // 16


def head_size(n):
    """Two sets that link share an l of the n - ceil(3n / 4) + l least names of each.

    With l = 2 * spare + 1, they still share one if each leaves out as many as spare(n) of
    these: the names that most sets have.
    """
    return n // 4 + 2 * spare(n) + 1


def linked(common, a, b):
    """100 * common >= 75 * (a + b - common)."""
    return 7 * common >= 3 * (a + b)


class CountRTree:
    """Points (a set's counts by group, and its size) in boxes of boxes.

    The overlap of two sets is at most the sum of the lesser counts, so two boxes hold no
    link if the sum of the lesser of their largest counts can't meet the least sizes.
    """

    def __init__(self, points: np.ndarray, labels: np.ndarray | None = None):
        self.points, self.sizes = points, points.sum(axis=1)
        self.labels = np.arange(len(points)) if labels is None else labels
        order = self._tiled(np.arange(len(points)), 0)
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        level = [(points[x].max(axis=0), int(self.sizes[x].min()), int(self.sizes[x].max()), int(self.labels[x].min()), int(self.labels[x].max())) for x in self.leaves]
        self.levels = [level]
        while len(level) > 1:
            level = [self._box(level[i : i + FAN]) for i in range(0, len(level), FAN)]
            self.levels.append(level)

    def _tiled(self, rows: np.ndarray, depth: int) -> np.ndarray:
        """Sort-tile-recursive: cut by size, then by one group's counts after the other."""
        if len(rows) <= LEAF or depth > GROUPS:
            return rows
        by = self.sizes[rows] if depth == 0 else self.points[rows, depth - 1]
        rows = rows[np.lexsort((rows, by))]
        cuts = max(2, round(len(rows) / LEAF) ** 0.5) if depth == 0 else 2
        size = max(LEAF, int(np.ceil(len(rows) / cuts / LEAF)) * LEAF)
        return np.concatenate([self._tiled(rows[i : i + size], depth + 1) for i in range(0, len(rows), size)])

    @staticmethod
    def _box(boxes):
        return np.max([b[0] for b in boxes], axis=0), *(f(b[i] for b in boxes) for i, f in ((1, min), (2, max), (3, min), (4, max)))

    @staticmethod
    def _may(x, y) -> bool:
        if x[3] == x[4] == y[3] == y[4] or 4 * x[2] < 3 * y[1] or 4 * y[2] < 3 * x[1]:
            return False
        return bool(linked(min(int(np.minimum(x[0], y[0]).sum()), x[2], y[2]), x[1], y[1]))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of point pairs of different labels whose bound allows a link, a pair of leaves at a time."""
        top = len(self.levels) - 1
        stack = [(top, i, j) for i in range(len(self.levels[top])) for j in range(i, len(self.levels[top]))]
        while stack:
            level, i, j = stack.pop()
            boxes = self.levels[level]
            if not self._may(boxes[i], boxes[j]):
                continue
            if level:
                n = len(self.levels[level - 1])
                for x in range(i * FAN, min(n, i * FAN + FAN)):
                    for y in range(max(x, j * FAN), min(n, j * FAN + FAN)):
                        stack.append((level - 1, x, y))
                continue
            a, b = self.leaves[i], self.leaves[j]
            apart = self.labels[a][:, None] != self.labels[b][None, :]
            bound = np.minimum(self.points[a][:, None, :], self.points[b][None, :, :]).sum(axis=2)
            fine = apart & linked(bound, self.sizes[a][:, None], self.sizes[b][None, :])
            if i == j:
                fine &= np.triu(np.ones(fine.shape, bool), 1)
            x, y = np.nonzero(fine)
            if len(x):
                yield a[x], b[y]


class Forest:
    """Joined rows; rows of one label are joined from the start."""

    def __init__(self, labels: np.ndarray):
        first, back = np.unique(labels, return_index=True, return_inverse=True)[1:]
        self.up = first[back].tolist()

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def roots(self, rows: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.find, rows.tolist()), np.int64, len(rows))

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)

    def meet(self, rows: np.ndarray, points: np.ndarray, fits, done: dict[str, int]) -> Iterator[tuple[int, int]]:
        """Of these rows, the pairs that the tree allows and ``fits`` confirms, as far as they join what was apart."""
        root = self.roots(rows)
        done["pairs"] += len(rows) * (len(rows) - 1) // 2
        if (root == root[0]).all():
            return
        for a, b in CountRTree(points[rows], root).pairs():
            done["boxed"] += len(a)
            for i, j in zip(rows[a].tolist(), rows[b].tolist(), strict=True):
                if self.find(i) != self.find(j):
                    done["fitted"] += 1
                    if fits(i, j):
                        self.join(i, j)
                        yield i, j


COUNTED = ("pairs", "boxed", "fitted")
LINKS = "a long, b long, pairs long, boxed long, fitted long"


def _links(found: list[tuple[int, int]], done: dict[str, int]) -> pa.Table:
    """Pairs, and one row without a pair that holds what was counted."""
    a, b = ([p[i] for p in found] + [None] for i in (0, 1))
    counts = [pa.array([None] * len(found) + [done[k]], pa.int64()) for k in COUNTED]
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *counts], names=["a", "b", *COUNTED])


def _sets(batches):
    keys = ("doc_id", "k1", "k2", "times")
    for batch in batches:
        for i, j, data, offsets in slices(batch, "text"):
            sets = shingle_sets(data, offsets)
            n = np.array([len(s) for s in sets])
            lo = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
            hi = [int(mixed(s ^ _ODD).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            heads = [s[: head_size(len(s))].view(np.int64) for s in sets]
            lists = lambda parts, none: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in parts])), pa.int32()), pa.array(np.concatenate(parts) if parts else none))
            counts = [count_vector(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k).slice(i, j - i) for k in keys), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()),
                lists(heads, np.zeros(0, np.int64)), lists(counts, np.zeros(0, np.int32)),
            ], names=[*keys, "n", "lo", "hi", "head", "counts"])


def _cells(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and each cell's place among them."""
    cells = column.combine_chunks()
    cells = cells.chunk(0) if isinstance(cells, pa.ChunkedArray) else cells
    n = pa.compute.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
    return cells.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(n))


def _text_sets(table: pa.Table) -> list[np.ndarray]:
    return [x for batch in table.to_batches() for _, _, data, offsets in slices(batch, "text") for x in shingle_sets(data, offsets)]


def _overlap(x: np.ndarray, y: np.ndarray) -> bool:
    return bool(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))


def _stars(edges: pa.Table, texts: pa.Table) -> pa.Table:
    """The part's pairs of a document and the centre of its star that link, by exact overlap."""
    sets = dict(zip(texts.column("rid").to_pylist(), _text_sets(texts), strict=True))
    pairs = list(zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True))
    return _links([(a, b) for a, b in pairs if _overlap(sets[a], sets[b])], dict.fromkeys(COUNTED, len(pairs)))


def _candidates(groups: pa.Table, docs: pa.Table) -> pa.Table:
    """In the part's groups of documents with a common shingle: labels joined by the pairs that the tree's bound and the heads' allow."""
    docs = docs.sort_by("rid")
    rid, label = docs.column("rid").to_numpy(), docs.column("label").to_numpy()
    points = _cells(docs.column("counts"))[0].reshape(-1, GROUPS)
    top = docs.column("top").to_numpy().view(np.uint64).tolist()
    names, at = _cells(docs.column("names"))
    members, cuts = _cells(groups.column("members"))
    place = np.searchsorted(rid, members)
    size = points.sum(axis=1)
    beyond = (size - head_size(size)).tolist()
    size = size.tolist()

    def may(i: int, j: int) -> bool:
        # What two sets share beyond the heads is less than what the set whose head ends first has there.
        common = len(np.intersect1d(names[at[i] : at[i + 1]], names[at[j] : at[j + 1]], assume_unique=True))
        return linked(common + (beyond[i] if top[i] <= top[j] else beyond[j]), size[i], size[j])

    forest, done = Forest(label), dict.fromkeys(COUNTED, 0)
    found = [p for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False) for p in forest.meet(place[x:y], points, may, done)]
    return _links([(int(label[i]), int(label[j])) for i, j in found], done)


def _verified(table: pa.Table) -> pa.Table:
    """In each tile of candidates: links between labels, by exact overlap; pairs that are joined already need none."""
    rid, tile = table.column("rid").to_numpy(), table.column("tile").to_numpy()
    sets = _text_sets(table.select(["text"]))
    points = np.array([count_vector(s) for s in sets], np.int32).reshape(-1, GROUPS)
    found, done, label = [], dict.fromkeys(COUNTED, 0), table.column("label").to_numpy()
    order = np.lexsort((rid, tile))
    for rows in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
        forest = Forest(label[rows])
        found += [(int(rid[rows[i]]), int(rid[rows[j]])) for i, j in forest.meet(np.arange(len(rows)), points[rows], lambda i, j, rows=rows: _overlap(sets[rows[i]], sets[rows[j]]), done)]
    return _links(found, done)


def _meetings(rows: DataFrame, by: str, most: int) -> DataFrame:
    """Deal rows (``by``, rid, label, ...) into groups in which every two rows of one ``by`` that have different labels meet.

    Up to ``most`` rows meet in one group.  Beyond it, the largest label and the others are cut into tiles, and every tile
    of the others meets every tile; rows of the largest label need not meet each other.  Values of one label are left out.
    Adds kind, lo, hi (the group) and many (rows of the value).
    """
    sizes = rows.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n_")).groupBy(by)
    sizes = sizes.agg(F.max(F.struct("n_", "label")).alias("main"), F.sum("n_").alias("many"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(most))).cast("int")
    mains, others = tiles(F.col("main.n_")), tiles(F.col("many") - F.col("main.n_"))
    spot = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    own = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")
    every = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    of_main = every(others, lambda j: spot(1, own(mains), j))
    of_rest = F.concat(every(mains, lambda i: spot(1, i, own(others))), every(others, lambda j: spot(2, F.least(j, own(others)), F.greatest(j, own(others)))))
    met = F.when(F.col("many") <= most, F.array(spot(0, F.lit(0), F.lit(0)))).when(F.col("label") == F.col("main.label"), of_main).otherwise(of_rest)
    return rows.join(sizes, by).withColumn("meet", F.explode(met)).drop("main").withColumns({c: F.col(f"meet.{c}") for c in ("kind", "lo", "hi")}).drop("meet")


def near_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counted: dict | None = None) -> DataFrame:
    """Groups of documents joined by links: Jaccard similarity of 5-word shingle sets of 0.75 or more.

    Documents of equal sets are one class.  First stars: classes that share one of their least-hashed shingles are compared
    with the least class that has it, as far as the summed lesser counts allow a link; what links has one label.  Then
    all others: a class sends out its least-hashed shingles, so many that two linked classes share one.  Shingles whose
    classes have one label are done; the classes of each other one are put in an R-tree of their counts by shingle
    group, whose bound leaves pairs of different labels, to which the heads' overlap sets another bound; only a
    spanning forest of these goes on.  Joined, these are groups of candidates; their whole texts meet in tiles, are put in
    an R-tree again, and pairs of different labels that pass it are compared in full.  A shingle or group with many
    classes is cut into tiles, so that each label meets every other; none is left out.  So the shared
    shingle finds pairs and the tree is the second filter: ``counted`` is given how many pairs stood in groups, how many the
    tree left (boxed), and how many were compared further (fitted), by step.

    Components are exact, up to equal 64-bit names of shingles.  Nulls: a null text has an empty set and no links; so has a text
    without words.  A null id counts as larger than all others.  Repeated rows are one row with their number in
    ``times``.  An empty table gives an empty result.  Other columns are not read.

    Returns a row for each distinct (doc_id, text): its key k1, k2 (see rows.py), times, doc_id, n_shingles, component_id (the least doc_id of
    the group) and keeper (whether it is the group's first by doc_id; so are rows without a set).
    """
    spark = docs.sparkSession
    tables = Tables(spark, "jaccard")
    rows = once(docs, doc_id, text)
    schema = "doc_id long, k1 long, k2 long, times long, n long, lo long, hi long, head array<long>, counts array<int>"
    sets = tables.write(rows.mapInArrow(_sets, schema).withColumn("rid", F.monotonically_increasing_id()), "sets")
    classes = tables.write(sets.where("n > 0").groupBy("n", "lo", "hi").agg(F.min("rid").alias("class")), "classes")
    # Rows of a class but its first; mostly few, whereas a join by rid would move every head.
    copies = tables.write(sets.select("rid", "n", "lo", "hi").join(classes, ["n", "lo", "hi"]).where("rid <> class").select("rid"), "copies")
    heads = sets.where("n > 0").join(sent(copies), "rid", "left_anti")

    def compared(found: DataFrame, step: str) -> DataFrame:
        links = tables.write(found, step)
        if counted is not None:
            counted[step] = links.agg(*[F.sum(c).alias(c) for c in COUNTED]).first().asDict()
        return links.where("a is not null").select("a", "b")

    key = ("rid", "n", "counts", "k1", "k2")
    firsts = heads.select(*key, F.explode(F.slice("head", 1, FIRSTS)).alias("name"))
    centres = firsts.groupBy("name").agg(F.min(F.struct(*key)).alias("c"), F.count(F.lit(1)).alias("often")).where("often > 1")
    # Written, so that the join is of two plain exchanges, whose hot shingles Spark can split.
    centres = tables.write(centres, "centres")
    bound = F.aggregate(F.zip_with("counts", "c.counts", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    edges = firsts.join(centres, "name").where((F.col("rid") != F.col("c.rid")) & linked(bound, F.col("n"), F.col("c.n")))
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
    entries = heads.select("rid", F.explode("head").alias("name"))
    often = tables.write(entries.groupBy("name").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    shared = tables.write(labelled(entries.join(often, "name")), "shared")
    hottest = F.row_number().over(Window.partitionBy("rid").orderBy(F.col("often").desc(), "name"))
    led = shared.withColumn("place", hottest).join(sets.select("rid", "n"), "rid").where(F.col("place") > F.floor(F.col("n") / 16))
    met = _meetings(led.select("name", "rid", "label"), "name", BLOCK).groupBy("name", "kind", "lo", "hi").agg(F.sort_array(F.collect_set("rid")).alias("members"), F.max("many").alias("many"))
    # Shingles of one passage have the same documents; these are joined once.
    groups = met.groupBy(F.xxhash64("members").alias("grp")).agg(F.first("members").alias("members"), F.max("many").alias("many"))
    # Groups with one first document share a part, so that a part gets its documents once, not once a group; tiles of a hot shingle go their own ways.
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    first_of = F.when(F.col("many") > BLOCK, F.col("grp")).otherwise(F.col("members")[0])
    groups = tables.write(groups.select(F.pmod(F.xxhash64(first_of), F.lit(parts)).cast("int").alias("part"), "members"), "groups")
    needed = groups.select(F.col("part").alias("home"), F.explode("members").alias("rid")).distinct()
    lists = shared.groupBy("rid", "label").agg(F.collect_list("name").alias("names"))
    met_docs = needed.join(sets.select("rid", "counts", F.try_element_at("head", F.lit(-1)).alias("top")), "rid").join(lists, "rid")
    maybe = compared(groups.groupBy("part").cogroup(met_docs.groupBy("home")).applyInArrow(lambda g, d: _candidates(g, d), LINKS), "maybe")
    tables.drop(shared, groups, often)

    found = components(maybe)
    sized = labelled(heads.select("rid", "k1", "k2")).join(sent(found.select(F.col("node").alias("label"), "component")), "label")
    sized = tables.write(_meetings(sized, "component", TILE), "candidates")
    n_found = sized.count()
    texts = rows.select("k1", "k2", "text").join(sent(sized, n_found), ["k1", "k2"]).withColumn("tile", F.xxhash64("component", "kind", "lo", "hi"))
    # Small groups share a part; a large group's tiles are parts of their own.
    part = F.when(F.col("many") > TILE // 2, F.col("tile")).otherwise(F.pmod(F.xxhash64("component"), F.greatest(F.lit(64), F.lit(n_found // 256))))
    links = compared(texts.withColumn("part", part).select("part", "tile", "rid", "label", "text").groupBy("part").applyInArrow(lambda t: _verified(t), LINKS), "links")
    joined = tables.write(components(stars.unionByName(links)), "joined")
    tables.drop(sized, labels, copies)

    big = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    placed = (
        sets.select("doc_id", "k1", "k2", "times", "rid", "n", "lo", "hi").join(classes, ["n", "lo", "hi"], "left").join(joined, F.col("class") == F.col("node"), "left")
        .withColumn("grp", F.coalesce("component", "class")).drop("component", "node", "class")
    )
    least = placed.where("grp is not null").groupBy("grp").agg(F.min(F.struct(big.alias("id"), "k1", "k2")).alias("least"))
    done = placed.join(least, "grp", "left")
    own = F.when(F.col("least.id") == (1 << 63) - 1, F.col("doc_id")).otherwise(F.coalesce("least.id", "doc_id"))
    first = F.coalesce((F.col("least.k1") == F.col("k1")) & (F.col("least.k2") == F.col("k2")), F.lit(True))
    return done.select("k1", "k2", "times", "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), first.alias("keeper"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """near_rows(), a row per document: doc_id, n_shingles, component_id."""
    found = near_rows(docs, doc_id, text)
    return found.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the first row by doc_id of each group of near_rows(); all rows without words stay.

    Of rows equal in doc_id and text, the one whose other columns have the least hash stands for all.
    """
    found = near_rows(docs, doc_id, text).where("n_shingles > 0 and (not keeper or times > 1)")
    gone = Tables(docs.sparkSession, "gone").write(found.select("k1", "k2", "times", F.col("keeper").cast("long").alias("copies")), "gone")
    narrow = docs.select(*[F.col(f"`{c}`").cast({doc_id: "long", text: "string"}[c]).alias(c) if c in (doc_id, text) else F.col(f"`{c}`") for c in docs.columns])
    return repeated(narrow, gone, [doc_id, text], others=True)
