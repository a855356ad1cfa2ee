import numpy as np
import pytest

from quillspark.operators import balls as B
from quillspark.operators import retrieval


def clustered(n, dim, groups, spread, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, dim))
    x = centres[rnd.integers(groups, size=n)] + spread * rnd.normal(size=(n, dim))
    x[: n // 3] = x[0]
    return np.round(x, 3)


def frame(spark, x, first=0):
    return spark.createDataFrame([(i + first, v.tolist()) for i, v in enumerate(x)], "chunk_id long, dense array<double>").repartition(5)


def scan(x, q, k, ids=None):
    """(id, score) of the k best, by rounded score and then id."""
    s = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (q / np.linalg.norm(q)), B.PLACES)
    ids = range(len(x)) if ids is None else ids
    return [(i, s[i]) for i in sorted(ids, key=lambda i: (-s[i], i))[:k]]


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.key, pytest.approx(r.score, abs=1e-9)))
        assert r.rank == len(out[r.query_id])
    return out


def test_equal_to_a_scan_and_skips_balls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 8)
    x = clustered(3000, 16, 40, 0.05, 1)
    index = B.Balls.write(frame(spark, x), f"{tmp_path}/b", ball_rows=40)
    assert index.near.n.sum() == len(x) and index.rows.count() == len(x)
    asked = x[::6]
    counted = {}
    got = by_query(index.top_k(frame(spark, asked), 7, query_id="chunk_id", query="dense", counted=counted))
    assert got == {i: scan(x, q, 7) for i, q in enumerate(asked)}
    assert counted["scan"] == len(x) * len(asked) and counted["products"] < 0.5 * counted["scan"], counted


def test_one_query_reads_few_balls(spark, tmp_path):
    x = clustered(4000, 8, 60, 0.03, 2)
    index = B.Balls.write(frame(spark, x), f"{tmp_path}/b", ball_rows=40)
    counted = {}
    got = by_query(index.top_k(frame(spark, x[-1:]), 10, query_id="chunk_id", query="dense", counted=counted))
    assert got == {0: scan(x, x[-1], 10)}
    assert counted["read"] < 0.2 * counted["balls"], counted


@pytest.mark.parametrize("seed", [3, 4])
def test_without_clusters_and_in_small_groups(spark, tmp_path, monkeypatch, seed):
    # Salts and homes of a few rows, so that balls and blocks are spread over groups.
    for name, value in {"SALT_BYTES": 4000, "HOME_BYTES": 1000, "BLOCK": 4, "TILE": 16}.items():
        monkeypatch.setattr(B, name, value)
    rnd = np.random.default_rng(seed)
    x = np.round(rnd.normal(size=(600, 12)), 2)
    x[100:300] = x[5]
    index = B.Balls.write(frame(spark, x), f"{tmp_path}/b", ball_rows=30)
    asked = np.vstack([x[5], -x[5], 3 * x[7], rnd.normal(size=(20, 12))])
    assert by_query(index.top_k(frame(spark, asked), 9, query_id="chunk_id", query="dense")) == {i: scan(x, q, 9) for i, q in enumerate(asked)}
    some = spark.createDataFrame([(i,) for i in range(0, 600, 11)], "id long")
    assert by_query(index.top_k(frame(spark, asked), 9, some, "chunk_id", "dense")) == {i: scan(x, q, 9, range(0, 600, 11)) for i, q in enumerate(asked)}
    # More than there are.
    assert by_query(index.top_k(frame(spark, asked[:2]), 700, query_id="chunk_id", query="dense")) == {i: scan(x, q, 700) for i, q in enumerate(asked[:2])}


def test_bounds_hold(spark, tmp_path):
    x = clustered(500, 6, 5, 0.4, 5)
    index = B.Balls.write(frame(spark, x), f"{tmp_path}/b", ball_rows=20)
    q = np.random.default_rng(6).normal(size=(30, 6))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    bounds = index.near.bounds(q)
    for r in index.rows.collect():
        v = np.array(r.v)
        assert (q @ (v / np.linalg.norm(v)) <= bounds[:, r.ball]).all()


def test_odd_vectors(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("b", [0.0, 2.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0, None]), ("f", [nan, 1.0]), ("g", [inf, 1.0]), (None, [1.0, 1.0]), ("h", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id string, dense array<double>").selectExpr("*", "1 as ball", "2 as v", "3 as key")
    index = B.Balls.write(df, f"{tmp_path}/o")
    asked = spark.createDataFrame([("q", [0.0, 1.0]), ("q", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), (None, [1.0, 0.0]), ("l", [1.0, 0.0, 0.0])], "query_id string, query array<double>")
    assert by_query(index.top_k(asked, 9)) == {"q": [("b", 1.0), ("b", 1.0), ("a", 0.0), ("h", 0.0)]}
    assert index.top_k(asked.limit(0), 3).count() == 0
    empty = B.Balls.write(df.where("false"), f"{tmp_path}/e")
    assert empty.top_k(asked, 3).collect() == []
    with pytest.raises(ValueError):
        B.Balls.write(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "chunk_id string, dense array<double>"), f"{tmp_path}/l")


def test_many_queries_go_through_balls(spark, monkeypatch):
    x = np.round(np.random.default_rng(8).normal(size=(60, 5)), 2)
    df, asked = frame(spark, x), frame(spark, x[:7]).toDF("query_id", "query")
    few = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.dense_top_k_each(df, asked, 4).collect()}
    monkeypatch.setattr(retrieval, "MOST_SENT", 3)
    assert {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.dense_top_k_each(df, asked, 4).collect()} == few
