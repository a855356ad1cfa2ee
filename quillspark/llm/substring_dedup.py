"""Substring dedup by recompression: equal word runs get consistent interior symbols."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import _powers, batched, bucket_bits, bucket_cuts, joined, mixed, ranges, span_names, table_slices, word_spans

WINDOW, LEVELS = 20, 4
BATCH_BYTES = 8 << 20
_RUN, _LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_FAR = (1 << 62) - 1


def recompress(names: np.ndarray, begin: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray, edges: tuple[np.ndarray, np.ndarray], level: int):
    """One round: name the runs of equal symbols, then the pairs of a left and a right symbol.

    A symbol is a name, the token where it begins and the tokens [first, last) that decide it: the
    same tokens elsewhere make the same symbol.  Sides are a hash of name and round, so all
    tasks agree on them.  ``edges`` are the first and end token of each document.
    """
    n = len(names)
    if not n:
        return names, begin, first, last, doc
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    doc_ = doc[at]
    opens = np.append(True, doc_[1:] != doc_[:-1])
    closes = np.append(doc_[1:] != doc_[:-1], True)
    # That a run ends is decided by its neighbours; at a document's edge by what no window inside holds.
    first = np.where(opens, edges[0][doc_] - 1, first[at - 1])
    last = np.where(closes, edges[1][doc_] + 1, last[np.minimum(at + size, n - 1)])
    names = np.where(size == 1, names[at], mixed(names[at] + size.astype(np.uint64) * _RUN))
    begin, doc, n = begin[at], doc_, len(at)
    left = (mixed(names + np.array([level + 1], np.uint64) * _LEFT) >> np.uint64(63)).astype(bool)
    pair = np.zeros(n, bool)
    pair[:-1] = left[:-1] & ~left[1:] & ~closes[:-1]
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    after = np.minimum(np.arange(n) + 1, n - 1)
    made = np.where(pair, mixed(names * _LEFT + names[after] * _RIGHT + np.uint64(level)), names)
    # A lone left symbol saw its right neighbour, a lone right symbol its left one.
    sees_right = np.where(closes, edges[1][doc] + 1, last[after])
    sees_left = np.where(opens, edges[0][doc] - 1, first[np.maximum(np.arange(n) - 1, 0)])
    first, last = np.where(left, first, sees_left), np.where(left, sees_right, last)
    stay = ~second
    return made[stay], begin[stay], first[stay], last[stay], doc[stay]


def anchors(words: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts of all windows, the anchor of each, the words [x, y) that decide it, and a hash of any words [i, j) by prefix sums.

    The anchor is, of the symbols that the window's own words decide, from the highest level that has any, the one of least
    name.  Equal windows have equal anchors at equal places.  What names an anchor are all the words that decide it,
    which are more than the symbol's own.
    """
    n_words = np.diff(place)
    starts = ranges(place[:-1], np.maximum(n_words - WINDOW + 1, 0))
    out, begin, end = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    up, down = _powers(len(words))
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)]))

    def hashed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return mixed((sums[y] - sums[x]) * down[x] + (y - x).astype(np.uint64) * _RUN)

    if not len(starts):
        return starts, out, begin, end, hashed
    doc = np.repeat(np.arange(len(n_words)), n_words)
    edges = (place[:-1], place[1:])
    token = np.arange(len(words))
    level = (words, token, token, token + 1, doc)
    levels = [level]
    for i in range(LEVELS):
        level = recompress(*level, edges, i)
        levels.append(level)
    open_ = np.arange(len(starts))
    for names, _, first, last, _ in reversed(levels):
        p = starts[open_]
        lo, hi = np.searchsorted(first, p), np.searchsorted(last, p + WINDOW, "right")
        has = hi > lo
        mine, a, b = open_[has], lo[has], hi[has]
        best, of = names[a], a.copy()
        for step in range(1, int((b - a).max(initial=0))):
            at = np.minimum(a + step, b - 1)
            less = names[at] < best
            best[less], of[less] = names[at[less]], at[less]
        begin[mine], end[mine] = first[of], last[of]
        out[mine] = hashed(begin[mine], end[mine])
        open_ = open_[~has]
        if not len(open_):
            break
    return starts, out, begin, end, hashed


def _ordered(table: pa.Table) -> pa.Table:
    """A batch's rows in the order in which windows start earlier."""
    order = [("missing", "ascending"), ("doc_id", "ascending"), ("rid", "ascending")]
    return table.append_column("missing", pa.compute.is_null(table.column("doc_id"))).sort_by(order)


class _Batch:
    """A batch's windows: row and start word of each, its anchor, where that stands, and what stands around it.

    A window's word sequence is its anchor between its two edges: the anchor's name is that of all words which decide it, so
    two windows that agree in it verify each other by the words left of it and right of it.
    """

    def __init__(self, table: pa.Table, named: bool):
        self.table = _ordered(table)
        rows, starts, found, names, stands, words_before = [], [], [], [], [], 0
        for i, j, data, offsets in table_slices(self.table):
            s, e, place = word_spans(data, offsets)
            words = span_names(data, s, e)
            p, a, x, y, hashed = anchors(words, place)
            stands.append(x + words_before)
            words_before += len(words)
            d = np.searchsorted(place, p, "right") - 1
            rows.append((d + i).astype(np.int32))
            starts.append((p - place[d]).astype(np.int32))
            found.append(a)
            if named:
                names.append(mixed(hashed(p, x) * _LEFT + hashed(y, p + WINDOW) * _RIGHT + (x - p).astype(np.uint64)))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.row, self.start, self.anchor = cat(rows, np.int32), cat(starts, np.int32), cat(found, np.uint64)
        self.name, self.stands = cat(names, np.uint64), cat(stands, np.int64)

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Windows whose anchor is shared."""
        return np.flatnonzero(pd.Index(shared).get_indexer(self.anchor) >= 0)


def _ask(key: tuple[pa.Scalar, ...], table: pa.Table, bits: int) -> pa.Table:
    """The batch's anchors, each once, to the anchors' buckets."""
    batch = _Batch(table, False)
    # Neighbouring windows have one anchor in common; what counts is at how many places it stands.
    a, x = batch.anchor, batch.stands
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (x[1:] != x[:-1]))[: len(a)])
    order = new[np.lexsort((x[new], a[new]))]
    a, x = a[order], x[order]
    names, counts = np.unique(a[np.append(True, (a[1:] != a[:-1]) | (x[1:] != x[:-1]))[: len(a)]], return_counts=True)
    cuts = bucket_cuts(names, bits).tolist()
    own = [(b, names[x:y].tobytes(), (counts[x:y] > 1).tobytes()) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if x < y]
    return pa.table({"bucket": pa.array([o[0] for o in own], pa.int32()), "batch": pa.array([key[0].as_py()] * len(own), pa.int32()), "names": pa.array([o[1] for o in own], pa.binary()), "many": pa.array([o[2] for o in own], pa.binary())})


def _shared(table: pa.Table) -> pa.Table:
    """To each batch, those of its names that occur at least twice."""
    names, cuts = joined(table.column("names"), np.uint64)
    many, _ = joined(table.column("many"), bool)
    every, back, counts = np.unique(names, return_inverse=True, return_counts=True)
    twice = counts > 1
    twice[back[many]] = True
    keep = twice[back]
    cells = [names[x:y][keep[x:y]].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
    return pa.table({"batch": table.column("batch"), "a": pa.array(cells, pa.binary())})


def _told(replies: pa.Table, column: str, dtype) -> np.ndarray:
    return joined(replies.column(column), dtype)[0]


def _claim(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table, bits: int) -> pa.Table:
    """The first window of each word sequence in the batch, of those with a shared anchor, to the anchors' buckets; and
    all windows with a shared anchor, as runs, to the batch itself, by a key of its own behind the buckets'."""
    cols: dict[str, list] = {k: [] for k in ("bucket", "batch", "name", "anchor", "doc_id", "rid", "start")}
    if len(table):
        batch = _Batch(table, True)
        mine = batch.candidates(_told(replies, "a", np.uint64))
        if len(mine):
            row, start = batch.row[mine], batch.start[mine]
            first = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, len(mine))).astype(np.int32)
            own = ((1 << bits) + key[0].as_py(), key[0].as_py(), b"", b"", row[at].tobytes(), start[at].tobytes(), size.tobytes())
            for col, v in zip(cols.values(), own, strict=True):
                col.append(v)
        _, first = np.unique(mixed(batch.name[mine] * np.uint64(3) + batch.anchor[mine]), return_index=True)
        mine = mine[np.sort(first)]
        bucket = (batch.anchor[mine] >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        mine, bucket = mine[order], bucket[order]
        ids = np.where(np.asarray(batch.table.column("missing")), _FAR, np.asarray(batch.table.column("doc_id").fill_null(0)))
        rids = np.asarray(batch.table.column("rid"))
        cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1)).tolist()
        for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if x < y:
                w = mine[x:y]
                row = batch.row[w]
                for k, v in zip(cols, (b, key[0].as_py(), batch.name[w].tobytes(), batch.anchor[w].tobytes(), ids[row].tobytes(), rids[row].tobytes(), batch.start[w].tobytes()), strict=True):
                    cols[k].append(v)
    return pa.table({k: pa.array(v, pa.int64() if k == "bucket" else pa.int32() if k == "batch" else pa.binary()) for k, v in cols.items()})


def _first(key: tuple[pa.Scalar, ...], table: pa.Table, bits: int) -> pa.Table:
    """To each batch, those of its claims that are the first of their word sequence; what a batch keeps for itself goes on as it is."""
    if key[0].as_py() >= 1 << bits:
        return pa.table({"batch": table.column("batch"), "a": table.column("doc_id"), "b": table.column("rid"), "c": table.column("start")})
    name, cuts = joined(table.column("name"), np.uint64)
    anchor, doc_id, rid, start = (joined(table.column(k), t)[0] for k, t in (("anchor", np.uint64), ("doc_id", np.int64), ("rid", np.int64), ("start", np.int32)))
    order = np.lexsort((start, rid, doc_id, anchor, name))
    n, a = name[order], anchor[order]
    new = np.append(True, (n[1:] != n[:-1]) | (a[1:] != a[:-1]))[: len(n)]
    won = np.zeros(len(name), bool)
    won[order[new]] = True
    spans = list(zip(cuts, cuts[1:], strict=False))
    return pa.table({
        "batch": table.column("batch"), "a": pa.array([rid[x:y][won[x:y]].tobytes() for x, y in spans], pa.binary()),
        "b": pa.array([start[x:y][won[x:y]].tobytes() for x, y in spans], pa.binary()), "c": pa.array([None] * len(spans), pa.binary()),
    })


def _remove(table: pa.Table, replies: pa.Table) -> pa.Table:
    """Remove the words of all windows with a shared anchor that aren't the first of their kind."""
    parts = [pa.table({"rid": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})]
    if not len(table):
        return parts[0]
    table = _ordered(table)
    own = replies.filter(pa.compute.is_valid(replies.column("c")))
    won = replies.filter(pa.compute.is_null(replies.column("c")))
    row, first, size = (_told(own, k, np.int32) for k in "abc")
    late_row, late_start = np.repeat(row, size), ranges(first.astype(np.int64), size.astype(np.int64))
    rid, start = _told(won, "a", np.int64), _told(won, "b", np.int32)
    rids = np.asarray(table.column("rid"))
    by_rid = np.argsort(rids)
    where = lambda r, s: r.astype(np.int64) << 32 | s
    late = ~np.isin(where(late_row, late_start), where(by_rid[np.searchsorted(rids, rid, sorter=by_rid)], start), assume_unique=True)
    late_row, late_start = late_row[late], late_start[late]
    for i, j, data, offsets in table_slices(table):
        s, e, place = word_spans(data, offsets)
        x, y = np.searchsorted(late_row, [i, j])
        p = place[late_row[x:y] - i] + late_start[x:y]
        cover = np.bincount(p, minlength=len(s) + 1)[: len(s) + 1] - np.bincount(p + WINDOW, minlength=len(s) + 1)[: len(s) + 1]
        keep = np.cumsum(cover[:-1]) == 0
        ks, ke = s[keep], e[keep]
        sizes = ke - ks + 1
        text = data[np.minimum(ranges(ks, sizes), len(data) - 1)] if len(ks) else np.zeros(0, np.uint8)
        ends = np.cumsum(sizes)
        text[ends - 1] = 32
        kept = np.append(0, np.cumsum(keep))[place]
        n, k = np.diff(place), np.diff(kept)
        # A text ends before the space behind its last word.
        solid = np.ones(len(text), bool)
        bytes_ = np.append(0, ends)[kept]
        solid[bytes_[1:][k > 0] - 1] = False
        text, bytes_ = text[solid], bytes_ - np.append(0, np.cumsum(k > 0))
        texts = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(bytes_.astype(np.int32)), pa.py_buffer(text)])
        own = table.slice(i, j - i)
        parts.append(pa.table({"rid": own.column("rid"), "doc_id": own.column("doc_id"), "n_words": pa.array(n), "n_removed": pa.array(n - k), "kept": texts}))
    return pa.concat_tables(parts)


def kept_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Remove every word covered by a window of 20 words whose word sequence also starts earlier.

    Texts travel once, in batches.  Rounds of recompression name runs and pairs of symbols, in each batch by itself: a
    name is a 64-bit hash of what it stands for, so names are global without a shuffle a round.  High-level symbols
    reveal repeats: every window is anchored by a symbol that its own words decide.  Each batch sends its anchors once to
    their buckets, which tell it those that stand elsewhere too.  They verify them, too: of the windows with such an
    anchor, each batch sends the first of each word sequence, named by the anchor, its place and
    the words on both sides of it (128 bits in all), and the buckets tell it which are the first of all.  All other windows with a shared
    anchor are repeats.  A batch sends a name once, so a passage of a third of all
    documents is no more to a bucket than one entry a batch.  The number of buckets grows with the text.

    Order: smaller doc_id first, null last, rows of one id in input order.  Nulls: a null
    text has no words.  Repeated rows: the first keeps its words.  An empty table gives an
    empty result.  Other columns are not read.

    Returns rid (the number of the input's row), doc_id, n_words, n_removed, kept (the words kept, joined by a space).
    """
    rows, total = batched(docs, doc_id, text, batch_bytes)
    bits = bucket_bits(total)
    rows = rows.select("batch", "rid", "doc_id", "text")
    by = lambda df: df.groupBy("batch")

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _ask(key, table, bits)

    def claim(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        return _claim(key, table, replies, bits)

    def first(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _first(key, table, bits)

    asked = by(rows).applyInArrow(ask, "bucket int, batch int, names binary, many binary")
    shared = asked.groupBy("bucket").applyInArrow(lambda t: _shared(t), "batch int, a binary")
    claims = by(rows).cogroup(by(shared)).applyInArrow(claim, "bucket long, batch int, name binary, anchor binary, doc_id binary, rid binary, start binary")
    told = claims.groupBy("bucket").applyInArrow(first, "batch int, a binary, b binary, c binary")
    return by(rows).cogroup(by(told)).applyInArrow(lambda t, r: _remove(t, r), "rid long, doc_id long, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Digests of ``kept_texts``: doc_id, n_words, n_removed, kept_sha256 (of the text kept)."""
    out = kept_texts(docs, doc_id, text, batch_bytes)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
