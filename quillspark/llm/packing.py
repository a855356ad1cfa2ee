"""Packing: first-fit decreasing over a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import mixed, ranges, release, slices, text_buffers

LENGTH, END = 2048, 1
#: Documents of a group that is packed in one go.
GROUP_DOCS = 2048
#: Bytes of text of a group at most, on the average: long documents make more groups.
GROUP_BYTES = 64 << 20
#: Bytes of text whose ids are held at a time (a longer text is encoded alone).
ENCODE_BYTES = 2 << 20
#: Fixed value: where byte-level vocabularies split a text before they merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, grp long, row_id long"
OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, row_id long, sequence_id long, offset long"


class Tournament:
    """Room left in bins 0, 1, ...: every node holds the larger of its two, so the first bin with room is found by one descent."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put an item in the first bin with room; returns the bin and the room it had."""
        at, tree = 1, self.tree
        while at < self.leaves:
            at *= 2
            at += tree[at] < size
        had = tree[at]
        bin_ = at - self.leaves
        tree[at] = had - size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return bin_, had


def first_fit_decreasing(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; items by falling size, equal sizes in the given order."""
    tree, out = Tournament(len(sizes), room), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bin_, had = tree.place(sizes[i])
        out[i] = (bin_, room - had)
    return out


class Encoder:
    """A vocabulary file's ids of whole texts, as ``tokenizers`` gives them without special tokens added.

    For a plain byte-level vocabulary, its merges are run by ``tiktoken`` with the file's own ids as ranks, which gives the
    same ids several times as fast; texts that hold an added token's own text, and all texts of any other
    vocabulary, go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.added = [t["content"] for t in file.get("added_tokens") or []]
        self.fast = self._ranked(file)
        ids = file["model"]["vocab"].values() if self.fast else self.tokenizer.get_vocab().values()
        #: What ids travel as: 16 bits where all fit.
        self.travel = "<u2" if max([END, *ids, *(t["id"] for t in file.get("added_tokens") or [])]) < 1 << 16 else "<u4"
        # What was read to make the ranks is several times as large as they are.
        del file, ids
        release()

    @cached_property
    def tokenizer(self):
        """Read when a text first needs it: it takes about 27 MB of a worker, beside the ranks."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _ranked(file: dict):
        """The vocabulary as ranks, or None if it is more than merges of bytes by rank."""
        model, first = file["model"], file.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not plain or file.get("normalizer") or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"].get("".join(m), -1) for m in merges]
        if any(x >= y for x, y in zip(ids, ids[1:], strict=False)) or ids[:1] == [-1]:
            return None
        import tiktoken

        byte = {c: b for b, c in enumerate(_byte_characters())}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text)


def _byte_characters() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: itself where it is printed, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


_ENCODERS: dict[str, Encoder] = {}


def _cells(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids as binary cells that end at these bytes, without a copy."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])


def _pieces(batches, path: str, groups: int):
    encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
    task, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids_in, texts = batch.column("doc_id"), batch.column("text")
        for i, j, _, _ in slices(batch, "text", ENCODE_BYTES):
            found = [encoder.encode(t.as_py() or "") for t in texts.slice(i, j - i)]
            sizes = np.array([len(x) + 1 for x in found], np.int64)
            full = np.full(int(sizes.sum()), END, encoder.travel)
            at = 0
            for x in found:
                full[at : at + len(x)] = x
                at += len(x) + 1
            # The row's number, not its id, deals it to a group: repeated ids are spread.
            uid = (task << 34) + np.arange(row, row + j - i)
            row += j - i
            group = (mixed(uid.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
            parts = -(-sizes // LENGTH)
            of = np.repeat(np.arange(j - i), parts)
            start = ranges(np.zeros(len(parts), np.int64), parts) * LENGTH
            length = np.minimum(LENGTH, sizes[of] - start)
            # Pieces stand in the order of the ids, so their bytes are those of the ids as they are.
            held = _cells(full, np.append(0, np.cumsum(length * full.itemsize)))
            doc = ids_in.slice(i, j - i).take(pa.array(of))
            cols = [doc, pa.array(start), pa.array(length), held, *(pa.array(c[of]) for c in (sizes, group, uid))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids", "doc_tokens", "grp", "row_id"])


def _pack(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
    length, row, start = (np.asarray(pieces.column(k)) for k in ("length", "row_id", "start"))
    order = np.lexsort((start, row, -length))
    at = np.empty((len(order), 2), np.int64)
    at[order] = first_fit_decreasing(length[order].tolist(), LENGTH)
    data, ends = text_buffers(pieces.column("ids"))
    if len(data) == 2 * length.sum():
        data, ends = data.view("<u2").astype("<u4"), 2 * ends
    out = pieces.drop_columns(["grp"]).set_column(pieces.schema.get_field_index("ids"), "ids", _cells(data, ends))
    release()
    return out.append_column("sequence_id", pa.array((key[0].as_py() << 24) + at[:, 0])).append_column("offset", pa.array(at[:, 1]))


def packed(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pack all documents' ids into sequences of at most 2048.

    A document is its text's ids and then id 1.  It is cut into pieces of 2048 and one
    shorter piece.  Documents are dealt at random (by a hash of their row's place in the
    input) to groups of about ``group_docs``, or of 64 MB of text if that is less; in each
    group the pieces are packed first-fit decreasing.  Groups are independent, so tasks stay
    bounded whatever the input; a group pads about one sequence more than the whole would.

    Nulls: a null text counts as empty (one id), a null id is kept.  Repeated rows are
    packed one by one.  Equal lengths are packed in row order.  An empty table gives an
    empty result.  Other columns are not read.

    Returns per piece: doc_id, start, length, ids (32-bit little-endian numbers, one after
    the other), doc_tokens, row_id (of the input's row, so that copies of one id can be told
    apart), sequence_id, offset, and ids_crc32 of ids.  A sequence is its pieces' ids by offset.
    """
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text)))).first()
    groups = max(1, -(-n // group_docs), -(-(size or 0) // GROUP_BYTES))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = rows.mapInArrow(lambda it: _pieces(it, tokenizer_path, groups), PIECES)
    return pieces.groupBy("grp").applyInArrow(_pack, OUT).withColumn("ids_crc32", F.crc32("ids"))
