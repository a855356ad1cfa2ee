import random
import re

import numpy as np
import pytest

from quillspark.llm import common, odd_sketch, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)} if len(words) > 1 else {tuple(words)} if words else set()


def brute(rows):
    """Per distinct (doc_id, text): n_shingles, component_id."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common_ = {}
        for x in s:
            for j in by[x]:
                common_[j] = common_.get(j, 0) + 1
        for j, n in common_.items():
            if j < i and 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, float("inf")), float("inf") if d is None else d)
    return [(d, len(s), None if least[find(i)] == float("inf") else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_words_that_a_polynomial_takes_for_equal():
    a = b"a"
    for _ in range(12):
        a += a.translate(bytes.maketrans(b"ab", b"ba"))
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    for n in (1, 7, 8, 9, 512, 1024, 1025, 2048, 4096):
        data = np.frombuffer(a[:n] + b[:n] + a[:n], np.uint8)
        x, y, z = common.span_names(data, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n])).tolist()
        assert x == z != y
    rnd = random.Random(1)
    spans = [bytes(rnd.choices(b"ab\x00", k=rnd.randint(0, 20))) for _ in range(3000)]
    data, ends = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(s) for s in spans])
    names = common.span_names(data, np.append(0, ends[:-1]), ends).tolist()
    assert len(set(zip(names, spans, strict=True))) == len(set(names)) == len(set(spans))


def test_sketches_estimate_likeness():
    rnd = np.random.default_rng(3)
    for j in (0.5, 0.7, 0.8, 0.9, 0.97, 1.0):
        found, shared = [], 0
        for _ in range(60):
            both = rnd.integers(0, 1 << 63, round(600 * j), dtype=np.uint64)
            own = rnd.integers(0, 1 << 63, 600 - len(both), dtype=np.uint64)
            sets = [np.unique(np.concatenate([both, x])) for x in (own[::2], own[1::2])]
            signs = odd_sketch.samples(sets)
            x, y = odd_sketch.sketches(signs)
            found.append(odd_sketch.likeness(int(np.bitwise_count(x ^ y).sum())))
            shared += bool((odd_sketch.bands(signs)[0] == odd_sketch.bands(signs)[1]).any())
        assert abs(np.mean(found) - j) < 0.03 and np.std(found) < 0.06, j
        assert j < 0.8 or shared == 60
        assert j < 0.8 or min(found) > odd_sketch.LOW
    assert abs(odd_sketch.likeness(odd_sketch.MOST_ODD) - odd_sketch.LOW) < 0.01


def fixture(seed, n):
    rnd, rows = random.Random(seed), []
    base = [[f"w{rnd.randrange(150)}" for _ in range(rnd.choice([1, 2, 3, 12, 40, 120]))] for _ in range(n // 8)]
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, len(w) // 12])):
            w[rnd.randrange(len(w))] = rnd.choice(["X", "y", f"w{rnd.randrange(150)}"])
        rows.append((i if rnd.random() > 0.05 else None, rnd.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (None, None), (5, "Twice the id"), (5, "twice the ID"), (5, "other")]


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"BLOCK": 8, "TILE": 4, "STAR": 3}), (3, {"FIRSTS": 1, "BLOCK": 5, "TILE": 3})])
def test_components_are_brute_force(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(odd_sketch, name, value)
    rows = fixture(seed, 400)
    counted = {}
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows + rows[:30]], "doc_id long, text string, rid int, label string").repartition(5)
    got = odd_sketch.near_copies(docs, counted=counted).collect()
    want = brute(sorted(set(rows), key=str))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.times for r in got) == len(rows) + 30
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.component_id is not None)
    assert counted["maybe"]["boxed"] < counted["maybe"]["pairs"]
    groups = odd_sketch.near_groups(docs)
    assert groups.columns == ["doc_id", "n_shingles", "component_id", "kept"] and groups.count() == len(rows) + 30


def test_odd_tables(spark):
    assert odd_sketch.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (one,) = odd_sketch.near_copies(spark.createDataFrame([(None, "some text")], "doc_id long, text string")).collect()
    assert (one.component_id, one.kept, one.n_shingles) == (None, True, 1)
    long = " ".join(f"word{i % 70000}" for i in range(150000))
    got = {r.doc_id: r for r in odd_sketch.near_groups(spark.createDataFrame([(1, long), (2, long + " end"), (3, None), (4, "x" * 100000)], "doc_id long, text string")).collect()}
    assert (got[2].component_id, got[2].kept, got[3].n_shingles, got[4].n_shingles) == (1, False, 0, 1)


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op13_odd_sketch(spark, sf).collect())
    assert got == sorted(brute(rows))
