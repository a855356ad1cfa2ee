import random

import pytest

from quillspark.operators import postings, retrieval


def plain(weights, query, k, kept=None):
    scores = {}
    for key, term, w in weights:
        if term in query and w is not None and (kept is None or key in kept):
            scores[key] = scores.get(key, 0.0) + w * query[term]
    return sorted(((i, round(s, 9)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]


def close(got, want):
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-9)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_lists_are_brute_force_and_skip_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(postings, "ROUNDS", (2, 4))
    rnd, weights = random.Random(seed), []
    for i in range(600):
        n = rnd.choice([2, 5, 20, 60])
        for t in sorted({min(int(rnd.expovariate(0.05)), 80) for _ in range(n)}):
            weights.append((f"c{i}", f"t{t}", round(rnd.choice([1.0, 1.0, 2.0]) * 8 / (4 + n), 3)))
    df = spark.createDataFrame([*weights, ("c1", None, 5.0), ("c2", "t1", None)], "chunk_id string, term string, weight double").repartition(3)
    index = postings.Postings([postings.blocks(postings.gathered(df), window=30).cache()])
    assert sorted(map(tuple, index.entries().collect())) == sorted(weights)
    saved = False
    for _ in range(4):
        query = {f"t{rnd.randrange(90)}": rnd.choice([0.5, 1.0, 2.2]) for _ in range(rnd.randint(1, 5))}
        counted = {}
        close([tuple(r) for r in index.top_k(query, 10, counted=counted).collect()], plain(weights, query, 10))
        assert counted["read"] <= counted["postings"] == sum(t in query for _, t, _ in weights)
        saved |= counted["read"] < counted["postings"] / 2
    assert saved
    some = {f"c{i}" for i in range(0, 600, 37)}
    close([tuple(r) for r in index.top_k(query, 10, spark.createDataFrame([(c,) for c in some], "chunk_id string")).collect()], plain(weights, query, 10, some))
    assert index.top_k({}, 5).collect() == [] == index.top_k({"none": 1.0}, 5).collect()
    with pytest.raises(ValueError):
        index.top_k({"t1": -1.0}, 5)


def test_later_segments_stand_for_earlier_ones(spark):
    schema = "chunk_id string, term string, weight double"
    old, new = [("a", "x", 3.0), ("b", "x", 2.0), ("c", "x", 1.0)], [("a", "x", 0.5)]
    dead = spark.createDataFrame([(0, "a")], "seq int, key string")
    index = postings.Postings([postings.blocks(postings.gathered(spark.createDataFrame(r, schema))) for r in (old, new)], dead)
    assert [tuple(r) for r in index.top_k({"x": 2.0}, 2).collect()] == [("b", 4.0), ("c", 2.0)]
    assert [tuple(r) for r in index.top_k({"x": 1.0}, 5).collect()] == [("b", 2.0), ("c", 1.0), ("a", 0.5)]
    empty = postings.Postings([postings.blocks(postings.gathered(spark.createDataFrame([], schema)))])
    assert empty.top_k({"x": 1.0}, 3).collect() == []


def test_clusters_are_pruned_by_term(spark, tmp_path):
    texts = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 997}, W{i % 9}" for j in range(1, 30))) for i in range(400)] + [(400, None), (401, ""), (402, "É é ß")], "doc_id int, text string")
    weights = retrieval.term_weights(texts, "doc_id", "text")
    rows = postings.packed(texts, "doc_id", "text")
    flat = rows.selectExpr("key as doc_id", "inline(terms)").select(*weights.columns)
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, weights.collect()))
    postings.write(postings.blocks(rows), str(tmp_path / "p"))
    index = postings.Postings([spark.read.parquet(str(tmp_path / "p"))], key="doc_id")
    plan = index.blocks.where("term in ('w3', 'w5')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "term" in plan.split("PushedFilters")[1][:80]
    asked = {"w3": 1.0, "w5": 0.5}
    want = retrieval.sparse_top_k(weights, spark.createDataFrame(list(asked.items()), "term string, weight double"), 20, "doc_id").collect()
    assert [tuple(r) for r in index.top_k(asked, 20).collect()] == [tuple(r) for r in want]


def test_words_are_cut_alike_by_tasks_and_spark(spark):
    whole = [chr(c) for c in [*range(1, 0x260), *range(0x2000, 0x2080)]]
    texts = [(i, f"A{c}B {c}") for i, c in enumerate(whole)] + [(9001, "İx ΣΑΣ 中文_١٢ ǅ"), (9002, None), (9003, ""), (9004, "__ -")]
    df = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    want = sorted(map(tuple, retrieval.term_weights(df, "doc_id", "text").collect()))
    assert sorted(map(tuple, postings.packed(df, "doc_id", "text").selectExpr("key", "inline(terms)").collect())) == want
    assert sorted(map(tuple, postings.Postings([postings.inverted(df, "doc_id", "text")], key="doc_id").entries().collect())) == want


def test_keys_are_written_once_and_windows_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "WINDOW_CHARS", 4000)
    # Texts of one length go by their number, longer ones by their characters.
    texts = spark.createDataFrame([(f"key-{i:030d}", f"{i % 89:02d} same words") for i in range(300)] + [(f"long-{i}", "many words " * 90 + str(i % 5)) for i in range(40)], "chunk_id string, text string")
    postings.write(postings.inverted(texts, "chunk_id", "text", window=50), str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(r.key for r in rows.selectExpr("explode(keys) as key").collect()) == sorted(r.chunk_id for r in texts.collect())
    windows = rows.where("term is null").collect()
    assert max(r.n for r in windows) < 100 and len([r for r in windows if r.n < 12]) > 5
    asked = {"same": 1.0, "many": 0.5, "3": 2.0, "07": 1.0}
    want = retrieval.sparse_top_k(retrieval.term_weights(texts, "chunk_id", "text"), spark.createDataFrame(list(asked.items()), "term string, weight double"), 30).collect()
    assert [tuple(r) for r in postings.Postings([rows]).top_k(asked, 30).collect()] == [tuple(r) for r in want]
