"""What the operators of this subpackage share: tables in the cluster's shared
folder, and word splitting over whole Arrow buffers."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.shared import Tables, written  # noqa: F401 - the operators take these from here

#: Bytes of text that the Arrow functions work on at a time (a longer text is worked on alone).
SLICE_BYTES = 1 << 20
#: Bytes of text whose messages a bucket takes, about.
BUCKET_BYTES, MOST_BITS = 8 << 20, 16
#: Bytes of a span beyond which it is named by a digest.
LONG = 1024
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
#: The C library's own, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return all_bytes[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system; workers live on between tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``most`` bytes of text: (first row, end row, bytes, offsets)."""
    data, offsets = text_buffers(batch.column(text))
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    release()


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each text's place among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    white = _WHITE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, white[:-1]
    after[-1], after[:-1] = True, white[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = True
    after[edges - 1] = True
    solid = ~white
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        m = max(n, SLICE_BYTES) + 1
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
        del _POWERS[:-2]
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal wherever the bytes are equal.

    A polynomial modulo 2^64: long words made for it collide, so it serves features that share buckets anyway; span_names() tells words apart."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of the byte spans: eight bytes at a time are mixed into a span's name, and its length; spans over LONG bytes go to BLAKE2."""
    left = ends - starts
    h = mixed(left.astype(np.uint64) + np.uint64(_BASE))
    # Every eight bytes that begin anywhere, without a copy.
    eight = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    rows, at, left = np.flatnonzero(left <= LONG), starts, left.copy()
    while len(rows := rows[left[rows] > 0]):
        part = eight[at[rows]]
        short = left[rows] < 8
        part[short] &= (np.uint64(1) << (left[rows][short] * 8).astype(np.uint64)) - np.uint64(1)
        h[rows] = mixed(h[rows] * np.uint64(_BASE) + mixed(part + np.uint64(0xD6E8FEB86659FD93)))
        at, left[rows] = at + 8, left[rows] - 8
    for i in np.flatnonzero(ends - starts > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of each range start .. start + length, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


def batched(docs: DataFrame, doc_id: str, text: str, batch_bytes: int) -> tuple[DataFrame, int]:
    """Deal rows to batches of about ``batch_bytes`` of text, by a hash of the row's place in the
    input (so that repeated ids are spread): (batch, rid, doc_id, text) and the bytes of all texts.

    Use the rows through one exchange by batch only: another scan may number them in another way."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    batches = max(1, -(-total // batch_bytes))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    return rows.withColumn("batch", F.pmod(F.xxhash64("rid"), F.lit(batches)).cast("int")), total


def bucket_bits(total: int, most: int = BUCKET_BYTES) -> int:
    """Bits of a hash that choose a bucket, so that a bucket has the messages of about ``most`` bytes of text.

    A batch sends a message to each bucket at most, so there are 2^MOST_BITS buckets at most; beyond that they grow."""
    return min(MOST_BITS, max(6, (-(-total // most) - 1).bit_length()))


def table_slices(table: pa.Table, text: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """slices() of a table, rows numbered through."""
    base = 0
    for batch in table.to_batches():
        for i, j, data, offsets in slices(batch, text):
            yield base + i, base + j, data, offsets
        base += len(batch)


def bucket_cuts(names: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket (top bits) of sorted names begins; one more entry for the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])


def places(index, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a pandas index that must hold them all."""
    at = index.get_indexer(keys)
    if (at < 0).any():
        raise LookupError(f"{(at < 0).sum()} of {len(at)} keys have no answer: the input was read in another order than before")
    return at


def joined(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Binary cells as one array, and each cell's place in it."""
    cells = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return (np.concatenate(cells) if cells else np.zeros(0, dtype)), np.concatenate([[0], np.cumsum([len(c) for c in cells], dtype=np.int64)]).astype(np.int64)
