"""Quality classifier: naive Bayes log-count ratios under a linear hinge-loss model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.llm.common import lowered, mixed, slices, span_hashes, text_buffers, word_spans

#: Hashed n-gram indicators; bytes of the character n-grams.
BITS, GRAM = 18, 4
#: Labelled rows that the linear model is fitted on, at most (log-count ratios use all of them); passes over these.
FIT_ROWS, PASSES, COST = 6000, 12, 0.02
#: Bytes of text of these rows together, at most (the first of a class stays, whatever its length).
FIT_BYTES = 128 << 20
#: Labels sent to every task, at most; beyond it the labels are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
SCORE = "quality_score"


def indicators(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct features: hashed words, word pairs and byte 4-grams of the lower-cased whole text."""
    data = lowered(data)
    starts, ends, place = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    shift = np.uint64(64 - BITS)
    one = (words >> shift).astype(np.int32)
    two = (mixed(words[:-1] * np.uint64(3) + words[1:]) >> shift).astype(np.int32) if len(words) > 1 else np.zeros(0, np.int32)
    n = max(0, len(data) - GRAM + 1)
    grams = np.zeros(n, np.uint32)
    for i in range(GRAM):
        grams |= data[i : i + n].astype(np.uint32) << np.uint32(8 * i)
    grams = ((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    last, out = np.zeros(1 << BITS, np.int32), []
    for d in range(len(offsets) - 1):
        a, b = place[d], place[d + 1]
        mine = np.concatenate([one[a:b], two[a : max(a, b - 1)], grams[offsets[d] : max(offsets[d], offsets[d + 1] - GRAM + 1)]])
        # Distinct: of equal features, the one whose number was written last stays.
        at = np.arange(len(mine), dtype=np.int32)
        last[mine] = at
        out.append(mine[last[mine] == at])
    return out


def _counts(batches):
    total = np.zeros((2, 1 << BITS), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        y = batch.column("quality").to_numpy(zero_copy_only=False)
        for i, j, data, offsets in slices(batch, "text"):
            for label, f in zip(y[i:j].tolist(), indicators(data, offsets), strict=True):
                total[label, f] += 1
                rows[label] += 1
    f = np.flatnonzero(total.any(axis=0))
    if rows.any():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(f, -1), pa.int32()), pa.array(np.append(total[0, f], rows[0])), pa.array(np.append(total[1, f], rows[1]))], names=["f", "bad", "good"]
        )


def _features(batches):
    for batch in batches:
        y = batch.column("quality").to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for i, j, data, offsets in slices(batch, "text"):
            packed = [f.tobytes() for f in indicators(data, offsets)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(y[i:j], pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "quality", "f"])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, passes: int = PASSES, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum cost_i max(0, 1 - y_i (w x_i + b)) with x_i the ratios at the row's indicators, scaled to unit length."""
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    # The scaled values are made again at each visit: kept, they would take twice the room of the rows.
    norms = [np.sqrt((ratio[f] * ratio[f]).sum()) or 1.0 for f in rows]
    random = np.random.default_rng(seed)
    for _ in range(passes):
        for i in random.permutation(len(rows)).tolist():
            f = rows[i]
            x = ratio[f] / norms[i]
            gradient = y[i] * (w[f] @ x + bias) - 1
            q = x @ x + 1
            new = min(max(alpha[i] - gradient / q, 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def _fit(table: pa.Table, ratio: np.ndarray) -> pa.Table:
    order = pa.compute.sort_indices(table, [("doc_id", "ascending")]).to_numpy()
    views = []
    for chunk in table.column("f").chunks:
        data, offsets = text_buffers(chunk)
        views += [data[a:b].view(np.int32) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
    rows = [views[i] for i in order.tolist()]
    y = np.where(table.column("quality").to_numpy()[order] == 1, 1.0, -1.0)
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    # Each class weighs the same as a whole.
    cost = COST * len(y) * 0.5 / (np.where(y > 0, share[1], share[0]) * len(y)) * 100
    w, bias = dual_coordinate_descent(rows, y, ratio, cost)
    f = np.flatnonzero(w)
    return pa.table({"f": pa.array(np.append(f, -1), pa.int32()), "w": pa.array(np.append(w[f], bias))})


def _score(batches, text: str, ratio: np.ndarray, w: np.ndarray, bias: float, slope: float):
    product, square = (w * ratio), (ratio * ratio)
    for batch in batches:
        for i, j, data, offsets in slices(batch, text):
            margin = np.array([product[f].sum() / (np.sqrt(square[f].sum()) or 1.0) + bias for f in indicators(data, offsets)])
            score = 1 / (1 + np.exp(-slope * margin))
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, SCORE])


def with_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """Score every text for quality; learn from labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    Features are indicators of hashed words, word pairs and byte 4-grams of the whole
    text.  Their log-count ratios between the classes are taken over all labelled
    training rows; a linear model over the indicators times these ratios is fitted by dual
    coordinate descent on at most ``fit_rows`` distinct labelled training texts of ``fit_bytes`` together (up to half of each
    class, those with the least hash of id and text).  The score is the logistic of the margin, so
    0.5 is the separating plane.

    Nulls: a null text counts as empty and is scored by the bias; a null doc_id is scored,
    and counts as held out False.  Labels that are null or neither 0 nor 1 don't count, of several for one
    id the least does.  Repeated rows are each scored.  Unless both classes have labelled training documents, all
    scores are 1; labels of ids that ``docs`` lacks don't count.  An empty table gives an empty result.  Other columns are carried; one named
    like SCORE is replaced.

    Returns the columns of ``docs`` and SCORE.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fold = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("quality"))
    known = known.where(~fold("doc_id"))
    small = known.count() <= BROADCAST_LABELS
    learn = rows.join(F.broadcast(known) if small else known, "doc_id").select("doc_id", "text", "quality")
    counts = learn.mapInArrow(_counts, "f int, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # At most 2^BITS + 1 rows, whatever the input.
    got = counts.toArrow()
    bad, good = np.ones(1 << BITS), np.ones(1 << BITS)
    f = got.column("f").to_numpy()
    own = f >= 0
    bad[f[own]] += got.column("bad").to_numpy()[own]
    good[f[own]] += got.column("good").to_numpy()[own]
    n = {k: int(got.column(k).to_numpy()[~own].sum()) for k in ("bad", "good")}
    ratio = (np.log(good / (n["good"] + 2)) - np.log(bad / (n["bad"] + 2))).astype(np.float32).astype(float)
    w, bias = np.zeros(1 << BITS), 1e9
    if min(n.values()) > 0:
        keyed = learn.select("doc_id", "quality", F.xxhash64("text").alias("t"), F.octet_length("text").alias("size"))
        keys = []
        for y in (0, 1):
            some = keyed.where(F.col("quality") == y).distinct().orderBy(F.xxhash64("doc_id", "t"), "doc_id").limit(fit_rows // 2).collect()
            upto = np.cumsum([r["size"] or 0 for r in some])
            keys += [(r.doc_id, r.t) for i, r in enumerate(some) if not i or upto[i] <= fit_bytes // 2]
        # As an Arrow table, so that no task starts Python workers of another kind for it, which would stay beside the others.
        picked = spark.createDataFrame(pa.table({k: pa.array([x[i] for x in keys], pa.int64()) for i, k in enumerate(("doc_id", "t"))}), "doc_id long, t long")
        sample = learn.withColumn("t", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "t"])
        # Repeated rows are reduced in every task, before they travel.
        sample = sample.groupBy("doc_id", "t", "quality").agg(F.first("text").alias("text")).select("doc_id", "text", "quality").mapInArrow(_features, "doc_id long, quality int, f binary")
        model = sample.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda t: _fit(t, ratio), "f int, w double").toArrow()
        f, values = model.column("f").to_numpy(), model.column("w").to_numpy()
        w[f[f >= 0]] = values[f >= 0]
        bias = float(values[f < 0][0])
    plain = docs.drop(SCORE)
    schema = StructType([*plain.schema.fields, StructField(SCORE, DoubleType())])
    return plain.mapInArrow(lambda it: _score(it, text, ratio, w, bias, 4.0), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """with_quality() as doc_id, held_out, score, predicted (1 from a score of 0.5)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = labels.withColumnRenamed(doc_id, "doc_id")
    return with_quality(rows, labels, **options).select("doc_id", held.alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))


def of_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    return with_quality(docs, labels, **options).where(F.col(SCORE) >= 0.5).select(*docs.columns)
