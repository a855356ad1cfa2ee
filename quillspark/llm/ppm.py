"""LM scoring: prediction by partial matching over bytes, with escapes and symbol exclusion."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batched, bucket_bits, joined, lowered, mixed, places, ranges, slices, span_names, table_slices, word_spans, written

#: Symbols are bytes plus 1; 0 stands before a text, END after it.
ORDER, BITS, END, SYMBOLS = 5, 9, 257, 258
BATCH_BYTES = 16 << 20
_END_TOKEN = np.uint64(0x5851F42D4C957F2D)


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (BITS * k)) - 1)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text its bytes and END, as (context, symbol) grams; and each text's place among these."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    total = offsets + np.arange(n + 1)
    shift = ORDER * (np.arange(n) + 1)
    out = np.zeros(int(total[-1]) + ORDER * n, np.uint64)
    out[np.arange(len(data)) + np.repeat(np.arange(n) + shift, sizes)] = data.astype(np.uint64) + np.uint64(1)
    out[total[1:] + shift - 1] = END
    gram = out.copy()
    for j in range(1, ORDER + 1):
        gram[j:] |= out[:-j] << np.uint64(BITS * j)
    # Shifting over the edge of a text meets only the zeros before the next.
    return gram[ranges(total[:-1] + shift, np.diff(total))], total


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    back, names = pd.factorize(keys)
    total = np.bincount(back, counts, len(names)).astype(np.int64)
    order = np.argsort(names)
    return names[order], total[order]


def _pairs(batches):
    total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for batch in batches:
        for _, _, data, offsets in slices(batch, "text"):
            data = lowered(data)
            gram, _ = symbols(data, offsets)
            total += np.bincount(((gram >> np.uint64(BITS)) & _mask(1)).astype(np.int64) * SYMBOLS + (gram & _mask(1)).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["pair", "n"])


class Trie:
    """Counts of the symbols after contexts of 0 to ORDER symbols: sorted (context, symbol) keys by order.

    Orders 0 and 1 come from the corpus' table of pairs; of the longer contexts, this holds
    those of the grams given, with all grams that share their last two symbols.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray):
        seen = counts > 0
        table = pairs.reshape(SYMBOLS, SYMBOLS)
        c, s = np.nonzero(table)
        zero = table.sum(axis=0)
        s0 = np.flatnonzero(zero)
        self.keys = {ORDER: grams[seen], 1: (c.astype(np.uint64) << np.uint64(BITS)) | s.astype(np.uint64), 0: s0.astype(np.uint64)}
        self.counts = {ORDER: counts[seen], 1: table[c, s], 0: zero[s0]}
        for k in range(ORDER - 1, 1, -1):
            self.keys[k], self.counts[k] = _summed(self.keys[k + 1] & _mask(k + 1), self.counts[k + 1])
        self.contexts, self.total, self.distinct, self.taken = {}, {}, {}, {}
        for k in range(ORDER + 1):
            context = self.keys[k] >> np.uint64(BITS)
            self.contexts[k], first = np.unique(context, return_index=True)
            self.total[k] = np.add.reduceat(self.counts[k], first) if len(first) else np.zeros(0, np.int64)
            self.distinct[k] = np.diff(np.append(first, len(context)))
            if k:
                # What the symbols seen after this context count in the next shorter one.
                at, _ = self.find(self.keys[k - 1], self.keys[k] & _mask(k))
                self.taken[k] = np.add.reduceat(self.counts[k - 1][at], first) if len(first) else np.zeros(0, np.int64)

    @staticmethod
    def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def price(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context.

        From the longest context down: a symbol seen counts c / (n + d), else the escape
        d / (n + d), with n occurrences of d symbols, those seen after a longer context left out.
        """
        out = np.zeros(len(grams))
        open_ = np.ones(len(grams), bool)
        less_n, less_d = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        for k in range(ORDER, -1, -1):
            at, known = self.find(self.contexts[k], (grams >> np.uint64(BITS)) & _mask(k))
            if not len(self.contexts[k]):
                continue
            n, d = self.total[k][at] - less_n, self.distinct[k][at] - less_d
            place, seen = self.find(self.keys[k], grams & _mask(k + 1))
            hit = open_ & known & seen
            out[hit] += np.log10(self.counts[k][place[hit]] / (n[hit] + d[hit]))
            open_ &= ~hit
            escape = open_ & known & (d > 0)
            out[escape] += np.log10(d[escape] / (n[escape] + d[escape]))
            less_n = np.where(known, self.taken[k][at], 0) if k else less_n
            less_d = np.where(known, self.distinct[k][at], 0) if k else less_d
        rest = END - (len(self.contexts[0]) and int(self.distinct[0][0]))
        out[open_] -= np.log10(max(1, rest))
        return out


def _train(table: pa.Table, i: int, j: int) -> np.ndarray:
    return ~np.asarray(table.column("held_out").slice(i, j - i))


def _ask(key: tuple[pa.Scalar, ...], table: pa.Table, bits: int) -> pa.Table:
    """The batch's distinct grams and words with their training counts, to the buckets of their last two context symbols and of their hash."""
    grams: list = [[], []]
    words: list = [[np.array([_END_TOKEN], np.uint64)], [np.zeros(1, np.int64)]]
    for i, j, data, offsets in table_slices(table):
        train = _train(table, i, j)
        data = lowered(data)
        s, e, place = word_spans(data, offsets)
        gram, at = symbols(data, offsets)
        for store, keys, cuts in ((grams, gram, at), (words, span_names(data, s, e), place)):
            k, c = _summed(keys, np.repeat(train, np.diff(cuts)))
            store[0].append(k)
            store[1].append(c)
        words[0].append(np.array([_END_TOKEN], np.uint64))
        words[1].append(np.array([train.sum()]))
    cols: list[list] = [[] for _ in range(5)]
    for kind, (keys, counts) in enumerate((grams, words)):
        keys, counts = _summed(np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(counts) if counts else np.zeros(0, np.int64))
        bucket = ((mixed(((keys >> np.uint64(BITS)) & _mask(2)) + np.uint64(1)) if kind == 0 else keys) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], counts[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1)).tolist()
        for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if x < y:
                for col, v in zip(cols, (kind, b, key[0].as_py(), keys[x:y].tobytes(), counts[x:y].tobytes()), strict=True):
                    col.append(v)
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "bucket", "batch", "keys", "counts"])


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table, pairs: np.ndarray) -> pa.Table:
    """Prices of the grams, or training counts of the words, that each batch asked for."""
    kind = key[0].as_py()
    keys, cuts = joined(table.column("keys"), np.uint64)
    counts, _ = joined(table.column("counts"), np.int64)
    names, back = np.unique(keys, return_inverse=True)
    total = np.bincount(back, counts, len(names)).astype(np.int64)
    values = (Trie(names, total, pairs).price(names) if kind == 0 else total.astype(float))[back]
    spans = list(zip(cuts, cuts[1:], strict=False))
    out = {"batch": table.column("batch").to_pylist(), "kind": [kind] * len(spans), "keys": table.column("keys").to_pylist(), "vals": [values[x:y].tobytes() for x, y in spans]}
    if kind:
        # What the bucket knows of all words together goes to a batch of its own.
        for col, v in zip(out.values(), (TOTALS, 2, b"", np.array([(total > 0).sum(), total.sum()], np.int64).tobytes()), strict=True):
            col.append(v)
    return pa.table([pa.array(c, t) for c, t in zip(out.values(), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=list(out))


def _score(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
    """The batch's rows, with the sum of log10(c + 1) as base; or the one row of totals: V as n_tokens, N as n_known."""
    if key[0].as_py() == TOTALS:
        v, n = joined(replies.column("vals"), np.int64)[0].reshape(-1, 2).sum(axis=0).tolist()
        return pa.table([pa.array([x], f.type) for x, f in zip((None, None, v, n, None, None), OUT, strict=True)], schema=OUT)
    told = []
    for kind in (0, 1):
        part = replies.filter(pa.compute.equal(replies.column("kind"), kind))
        keys, values = joined(part.column("keys"), np.uint64)[0], joined(part.column("vals"), np.float64)[0]
        told += [pd.Index(keys), values]
    grams, prices, words, counts = told
    end = counts[words.get_loc(_END_TOKEN)] if len(words) else 0.0
    parts = [OUT.empty_table()]
    for i, j, data, offsets in table_slices(table):
        data = lowered(data)
        s, e, place = word_spans(data, offsets)
        gram, at = symbols(data, offsets)
        score = np.add.reduceat(prices[places(grams, gram)], at[:-1])
        c = counts[places(words, span_names(data, s, e))]
        sums = lambda x: np.diff(np.append(0, np.cumsum(x))[place])
        n = j - i
        known = (sums((c > 0).astype(np.int64)) + int(end > 0)).astype(np.int64)
        cols = (table.column("doc_id").slice(i, n), table.column("held_out").slice(i, n), pa.array(np.diff(place) + 1), pa.array(known), pa.array(sums(np.log10(c + 1)) + np.log10(end + 1)), pa.array(score))
        parts.append(pa.table(list(cols), schema=OUT))
    return pa.concat_tables(parts)


#: The batch to which buckets send their totals.
TOTALS = -1
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """log10 probability of every whole text under a byte model of the training texts.

    Training texts are those whose crc32(doc_id as text) mod 7 is not 2.  What is modelled is the
    whole text's bytes in lower case (A-Z), white space and all, and an end.  The model is
    a trie of contexts of up to ORDER bytes of all training texts, priced with escapes and
    exclusion; every text is scored by the whole model.

    Texts travel once, in batches.  A batch asks for its distinct grams once; the buckets
    hold the trie by the last two bytes of context, add up the batches' training counts
    and answer with prices.  The number of buckets grows with the text.  Only the table of byte pairs (at most 258 x 258 counts) and the
    two totals of the base are on the driver.  Words for the base score go the same way, by 64-bit hash.

    Nulls: a null text counts as empty, a null id as training (not held out).  Repeated
    rows each count and are each scored.  An empty table gives an empty result; without training
    texts all symbols are equally likely.  Other columns are not read.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows, total = batched(docs, doc_id, text, batch_bytes)
    bits = bucket_bits(total)
    rows = rows.select("batch", "doc_id", "text", held.alias("held_out"))
    found = rows.where(~F.col("held_out")).select("text").mapInArrow(_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _ask(key, table, bits)

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _answer(key, table, pairs)

    asked = rows.groupBy("batch").applyInArrow(ask, "kind int, bucket int, batch int, keys binary, counts binary")
    told = asked.groupBy("kind", "bucket").applyInArrow(answer, "batch int, kind int, keys binary, vals binary")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    found = rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(lambda key, t, r: _score(key, t, r), out)
    # The rows without their texts are few bytes; the totals are read off them.
    found = written(found, "scores")
    totals = found.where("held_out is null").first()
    distinct, tokens = (totals.n_tokens, totals.n_known) if totals else (0, 0)
    base = F.col("base_score") - F.col("n_tokens") * F.lit(math.log10(tokens + distinct + 1))
    return found.where("held_out is not null").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
