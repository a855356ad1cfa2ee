"""An inverted index of term weights in blocks with upper bounds, and exact top lists that read few of them."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.shared import Tables, written

#: Texts of a window, about: those of like size, as short texts have large weights and long ones small weights.
WINDOW = 1024
#: Windows that the rounds of a search read at most, by falling bound; the last round reads all that still can matter.
ROUNDS = (16, 256)
#: Steps of size, for a doubling of the terms of a text, that windows are made of.
STEPS = 4
#: Room for sums in another order and for scores rounded to nine places.
ROOM = 2e-9


#: Characters of a window's texts, about, which bound what a task holds.
WINDOW_CHARS = 16 << 20
#: Texts whose terms a task holds at a time.
SLICE = 128
PACKED = "key {}, terms array<struct<term: string, weight: double>>"
BLOCKS = "term string, window string, n long, most double, places array<int>, weights array<double>, keys array<{}>"
#: Characters that Python and Spark may lower or tell from words differently: all but Latin without the dotted capital I, and general punctuation.
ODD = r"[\u0130\u0250-\u1fff\u2070-\x{10ffff}]"
_WORD = re.compile(r"\w+")


def _cut(texts: DataFrame, key: str, text: str, *columns: str) -> DataFrame:
    """(key, text, words) and ``columns``: words, cut by Spark, of texts that tasks can't cut alike."""
    words = F.when(F.rlike(F.col(text), F.lit(ODD)), F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    return texts.select(*columns, F.col(key).alias("key"), F.col(text).alias("text"), words.alias("words"))


def _counted(texts, k1: float, b: float, mean: float):
    """(terms, weights) of each text of a table (text, words), one at a time; a null or empty text has none."""
    for i in range(0, texts.num_rows, SLICE):
        part = texts.slice(i, SLICE)
        for text, words in zip(part.column("text"), part.column("words"), strict=True):
            own = words.as_py() if words.is_valid else _WORD.findall((text.as_py() or "").lower().replace("_", " "))
            found = Counter(own)
            n = np.fromiter(found.values(), np.float64, len(found))
            yield list(found), n * (k1 + 1) / (n + k1 * (1 - b + b * len(own) / mean))


def packed(texts: DataFrame, key: str, text: str, k1: float = 1.2, b: float = 0.75, mean: float = 256.0) -> DataFrame:
    """(key, terms) of texts, a row each: their terms with the weights of retrieval.term_weights(), counted within the row and so without a shuffle.

    A null or empty text has no terms.
    """
    cut = _cut(texts, key, text)

    def count(batches):
        for whole in batches:
            for i in range(0, len(whole), SLICE):
                batch, terms, weights, cuts = whole.slice(i, SLICE), [], [], [0]
                for found, own in _counted(batch, k1, b, mean):
                    terms.extend(found)
                    weights.append(own)
                    cuts.append(len(terms))
                cells = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(np.concatenate(weights), pa.float64())], names=["term", "weight"])
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), cells)], names=["key", "terms"])

    return cut.mapInArrow(count, PACKED.format(cut.schema["key"].dataType.simpleString()))


def gathered(weights: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, terms) from a table (key, term, weight); null terms and weights are left out."""
    rows = weights.where("term is not null and weight is not null")
    return rows.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("term", F.col("weight").cast("double").alias("weight"))).alias("terms"))


def _placed(texts: DataFrame, size, most) -> DataFrame:
    """Rows (key, ...) with their window: by the step of their ``size``, and within a step of n rows by a hash of the key into n / most(step) windows."""
    sized = texts.where(size > 0).withColumn("step", F.floor(F.log2(size) * STEPS).cast("int"))
    # A row for each step: a few hundred at most, as a step is a share of a doubling.
    steps = {str(r.step): -(-r.n // most(r.step)) for r in sized.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.try_element_at(F.from_json(F.lit(json.dumps(steps)), "map<string, long>"), F.col("step").cast("string"))
    return sized.withColumn("window", F.concat_ws("-", "step", F.pmod(F.xxhash64("key"), F.coalesce(parts, F.lit(1))))).drop("step")


def _block(window, keys, counted) -> pa.Table:
    """The blocks of a window's texts, from each one's terms and weights; a last row without a term has the keys, by which places are counted."""
    terms, sizes, weights, held = [pa.array([], pa.string())], [], [np.empty(0)], []
    for found, own in counted:
        held.extend(found)
        sizes.append(len(found))
        weights.append(own)
        if len(sizes) % SLICE == 0:
            terms.append(pa.array(held, pa.string()))
            held = []
    named = pa.chunked_array([*terms, pa.array(held, pa.string())]).dictionary_encode().combine_chunks()
    ids, which = named.dictionary, named.indices.to_numpy()
    order = np.argsort(which, kind="stable")
    n, held = np.bincount(which, minlength=len(ids)), np.concatenate(weights)[order]
    places = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    cuts = np.concatenate([[0], np.cumsum(n)])
    most = np.maximum.reduceat(held, cuts[:-1]) if len(ids) else held
    # The row of the keys has no places.
    ends = pa.array(np.append(cuts, cuts[-1]), pa.int32())
    own_keys = pa.ListArray.from_arrays(pa.array([None] * len(ids) + [0, len(keys)], pa.int32()), keys)
    columns = [
        pa.concat_arrays([ids, pa.nulls(1, pa.string())]), pa.array([window] * (len(ids) + 1), pa.string()), pa.array(np.append(n, len(keys)), pa.int64()), pa.array(np.append(most, 0.0), pa.float64()),
        pa.ListArray.from_arrays(ends, pa.array(places)), pa.ListArray.from_arrays(ends, pa.array(held)), own_keys,
    ]
    return pa.table(columns, names=["term", "window", "n", "most", "places", "weights", "keys"])


def _blocks(placed: DataFrame, counted) -> DataFrame:
    def made(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return _block(table.column("window")[0].as_py(), table.column("key").chunk(0), counted(table))

    return placed.groupBy("window").applyInArrow(made, BLOCKS.format(placed.schema["key"].dataType.simpleString()))


def blocks(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(term, window, n, most, places, weights, keys) from (key, terms): a row for each term and window with its texts and their largest weight.

    A text's window goes by its number of terms, in steps, and within a step by a hash of the key, so that a window has about ``window``
    texts: blocks are bounded, also for a term that all texts have.  A task makes a window's blocks from its whole texts.  Texts stand
    in blocks by their place in their window's ``keys``, which are a row of their own, without a term; so a key is written once.
    """
    # Written, as the steps are counted first.
    placed = _placed(written(texts, "packed-terms"), F.size("terms"), lambda _: window)

    def counted(table):
        for i in range(0, table.num_rows, SLICE):
            for own in table.column("terms").slice(i, SLICE):
                terms = own.as_py()
                yield [t["term"] for t in terms], np.array([t["weight"] for t in terms], np.float64)

    return _blocks(placed.select("window", "key", "terms"), counted)


def inverted(texts: DataFrame, key: str, text: str, k1: float = 1.2, b: float = 0.75, mean: float = 256.0, window: int = WINDOW) -> DataFrame:
    """The blocks of texts with the weights of packed(), their windows by length: texts move once, to their window, whose task counts their terms."""
    per = lambda step: max(1, min(window, int(WINDOW_CHARS / 2 ** ((step + 1) / STEPS))))
    placed = _placed(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), F.char_length("text"), per)
    return _blocks(_cut(placed, "key", "text", "window"), lambda table: _counted(table, k1, b, mean))


def write(rows: DataFrame, path: str) -> None:
    """Blocks clustered and sorted by term: ranges split a term by windows, so that a search finds its files and row groups by their statistics."""
    spark = rows.sparkSession
    tables = Tables(spark, "blocks")
    # Written, as the ranges come from a sample: the blocks are made once.
    made = tables.write(rows, "blocks")
    made.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "term", "window").sortWithinPartitions("term", "window").write.parquet(path)
    tables.drop(made)


class Postings:
    """Blocks as tables of one or several segments, later ones in place of earlier ones.

    ``dead`` is (seq, key) of entries that are no more; seq is a segment's place in the list.
    """

    def __init__(self, tables: list[DataFrame], dead: DataFrame | None = None, key: str = "chunk_id"):
        self.key, self.dead = key, dead
        self.blocks = None
        for i, df in enumerate(tables):
            own = df.withColumn("seq", F.lit(i)).withColumn("window", F.concat_ws("/", "seq", "window"))
            self.blocks = own if self.blocks is None else self.blocks.unionByName(own)

    def entries(self) -> DataFrame:
        """All live (key, term, weight)."""
        rows = self._entries(self.blocks.where("term is not null")).join(self._keys(), ["window", "place"])
        return self._live(rows).select(F.col("key").alias(self.key), "term", "weight")

    @staticmethod
    def _entries(blocks: DataFrame, *columns: str) -> DataFrame:
        """(window, term, place, weight) of blocks, and ``columns`` of theirs."""
        return blocks.select("window", "term", *columns, F.explode(F.arrays_zip("places", "weights")).alias("e")).select("window", "term", *columns, F.col("e.places").alias("place"), F.col("e.weights").alias("weight"))

    def _keys(self) -> DataFrame:
        """(seq, window, place, key) of all texts."""
        return self.blocks.where("term is null").select("seq", "window", F.posexplode("keys").alias("place", "key"))

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows if self.dead is None else rows.join(self.dead, ["seq", "key"], "left_anti")

    def top_k(self, query: dict[str, float], k: int, kept: DataFrame | None = None, counted: dict | None = None) -> DataFrame:
        """(key, score) of the k largest dot products with the query's term weights, ties by key; of ``kept`` (key) only, if given.

        The bound of a window is the sum of the query's weights times its blocks' largest ones.  Windows are scored by falling bound, some at a time; once k
        texts are found, windows whose bound is below the k-th score hold nothing that counts, and their entries are never read.
        Only the query's terms (it is one text), k rows and the windows of a round go through the driver.  ``counted``
        is given the postings of the query's terms, the ones read, and the rounds.

        Negative query weights have no bound and are refused; a term that no text has counts for nothing.
        """
        if any(not w >= 0 for w in query.values()):
            raise ValueError("query weights are from 0")
        spark: SparkSession = self.blocks.sparkSession
        if not query:
            return self._keys().select(F.col("key").alias(self.key), F.lit(0.0).alias("score")).limit(0)
        weight = F.try_element_at(F.from_json(F.lit(json.dumps(query)), "map<string, double>"), F.col("term"))
        mine = self.blocks.where(F.col("term").isin(sorted(query))).withColumn("q", weight)
        bounds = mine.groupBy("window").agg(F.sum(F.col("q") * F.col("most")).alias("bound"), F.sum("n").alias("n"))

        def scored(some: Callable[[DataFrame], DataFrame]) -> DataFrame:
            """The best of some windows."""
            sums = self._entries(some(mine), "q").groupBy("window", "place").agg(F.sum(F.col("weight") * F.col("q")).alias("part"))
            rows = self._live(some(self._keys()).join(sums, ["window", "place"]))
            if kept is not None:
                rows = rows.join(kept.select(F.col(self.key).alias("key")), "key", "left_semi")
            return rows.groupBy("key").agg(F.round(F.sum("part"), 9).alias("score")).orderBy(F.desc("score"), "key").limit(k)

        kind = mine.schema["keys"].dataType.elementType
        best, least, read, done, rounds = [], None, [], 0, 0
        for size in ROUNDS:
            open_ = bounds if least is None else bounds.where(F.col("bound") >= least - ROOM)
            windows = open_.where(~F.col("window").isin(read)).orderBy(F.desc("bound"), "window").limit(size).collect()
            if not windows:
                break
            rounds += 1
            now = [w.window for w in windows]
            found = scored(lambda df: df.where(F.col("window").isin(now))).collect()  # noqa: B023
            best = sorted(best + [(r.key, r.score) for r in found], key=lambda x: (-x[1], x[0]))[:k]
            least = best[-1][1] if len(best) == k else None
            read, done = read + [w.window for w in windows], done + sum(w.n for w in windows)
        left = (bounds if least is None else bounds.where(F.col("bound") >= least - ROOM)).where(~F.col("window").isin(read))
        last, more = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        out = spark.createDataFrame(best, f"key {kind.simpleString()}, score double")
        if last:
            out = out.unionByName(scored(lambda df: df.join(left.select("window"), "window", "left_semi")))
        if counted is not None:
            counted |= {"postings": bounds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "read": done + more, "rounds": rounds + bool(last)}
        return out.orderBy(F.desc("score"), "key").limit(k).select(F.col("key").alias(self.key), "score")
