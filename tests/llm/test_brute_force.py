import hashlib
import heapq
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import common, cws, jaccard_rtree, mixing, nbsvm, packing, pii, ppm, queries, sharding, substring_dedup, topk
from quillspark.sources import shared

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Pseudonyms


def permuted(values, radices, label, key):
    key = hashlib.sha256(key.encode()).hexdigest()
    n, state = len(values), list(values)
    for i in range(pii.ROUNDS):
        left = i % 2 == 0
        half = state[: n // 2] if left else state[n // 2 :]
        noise = hashlib.sha512(f"{key}|{label}|{i}|{','.join(map(str, half))}".encode()).hexdigest()
        state = [(x + int(noise[4 * (j - n // 2 if left else j) :][:4], 16)) % radices[j] if (j >= n // 2) == left else x for j, x in enumerate(state)]
    return state


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10


def as_digits(kind, text, key):
    new = iter(permuted([int(c) for c in text], [10] * len(text), f"{kind}|{'.'.join(['10'] * len(text))}", key))
    return "".join(str(next(new)) for _ in text)


def in_layout(new, text):
    new = iter(new)
    return "".join(next(new) if c.isdigit() else c for c in text)


def plain_pseudonym(kind, text, key):
    if kind == "card":
        body = as_digits("card", re.sub(r"\D", "", text)[:-1], key)
        return in_layout(body + str(-luhn(body + "0") % 10), text)
    if kind == "phone":
        return "+1" + in_layout(as_digits("phone", re.sub(r"\D", "", text[2:]), key), text[2:])
    if kind == "ip":
        return ".".join(map(str, permuted(list(map(int, text.split("."))), [256] * 4, "ip|256.256.256.256", key)))
    if kind == "ssn":
        a, b, c = map(int, text.split("-"))
        a, b, c = permuted([a - (2 if a > 666 else 1), b - 1, c - 1], [898, 99, 9999], "ssn|898.99.9999", key)
        return f"{a + (1 if a < 665 else 2):03d}-{b + 1:02d}-{c + 1:04d}"
    day = (np.datetime64(text) - np.datetime64("1900-01-01")).astype(int)
    a, b = permuted([int(day) // 4297, int(day) % 4297], [17, 4297], "date|17.4297", key)
    return str(np.datetime64("1900-01-01") + a * 4297 + b)


def test_pseudonyms_are_brute_force(spark):
    rnd, docs, want = random.Random(5), [], {}
    for i in range(200):
        n = "".join(rnd.choice("0123456789") for _ in range(15))
        n += str(-luhn(n + "0") % 10)
        area = rnd.choice([a for a in range(1, 900) if a != 666])
        values = [
            ("card", n if i % 2 else f"{n[:4]} {n[4:8]} {n[8:12]} {n[12:]}"), ("ssn", f"{area:03d}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}"), ("ip", ".".join(str(rnd.randint(0, 255)) for _ in range(4))),
            ("date", str(np.datetime64("1900-01-01") + rnd.randrange(73049))), ("phone", f"+1 ({rnd.randint(0, 999):03d}) {rnd.randint(0, 999):03d}-{rnd.randint(0, 9999):04d}"),
        ]
        rnd.shuffle(values)
        docs.append((i, " and\n".join(v for _, v in values)))
        want[i] = " and\n".join(plain_pseudonym(k, v, "k") for k, v in values)
    docs += [(0, docs[0][1]), (None, docs[0][1]), (500, None), (501, ""), (502, "666-12-3456 and 000-12-3456, 900-12-3456, 2023-02-29, 256.1.1.1")]
    got = pii.pseudonymised(spark.createDataFrame(docs, "doc_id long, text string"), "k").collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is None or r.doc_id < 500:
            assert (r.text, r.n_replaced) == (want[r.doc_id or 0], 5)
    assert {r.doc_id: (r.text, r.n_replaced) for r in got if r.doc_id and r.doc_id >= 500} == {500: (None, 0), 501: ("", 0), 502: (docs[-1][1], 0)}
    again = pii.pseudonymised(spark.createDataFrame([(i, t) for i, t in want.items()], "doc_id long, text string"), "k")
    assert again.where("n_replaced <> 5").count() == 0  # What comes out is valid again.


def test_pseudonyms_of_long_texts_and_clashing_names(spark):
    text = "call 4111111111111111 now, word by word. " * 30000
    docs = spark.createDataFrame([(1, text, 7, "p", "f")], "doc_id long, text string, new_ int, `pairs_` string, FOUND_ string")
    got = pii.pseudonymised(docs, "k", count="new_").first()
    assert got.asDict() | {"text": 0} == {"doc_id": 1, "text": 0, "pairs_": "p", "FOUND_": "f", "new_": 30000} and len(got.text) == len(text) and "4111111111111111" not in got.text


# Shards


def test_shards_are_those_of_a_heap(spark):
    rnd = random.Random(2)
    texts = ["x" * rnd.randint(0, 400) + str(i) for i in range(300)]
    docs = [(i if i % 5 else None, rnd.choice(texts)) for i in range(900)] + [(7, None), (7, ""), (7, "")]
    got = sharding.lpt_shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 7).collect()
    groups = Counter()
    for _, t in docs:
        groups[t or ""] += len((t or "").encode()) + 1
    heap = [0] * 7
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert sorted(loads.values()) == sorted(heap) and len(got) == len(docs)


def test_runs_of_sizes_are_those_of_a_heap_of_groups():
    rnd = random.Random(4)
    for n_shards in (1, 2, 3, 8):
        for _ in range(60):
            sizes = {rnd.randint(1, 30) * rnd.choice([1, 1, 7]): rnd.choice([1, 2, 3, 40, 500]) for _ in range(rnd.randint(0, 6))}
            heap, want = [(0, s) for s in range(n_shards)], []
            for size in sorted(sizes, reverse=True):
                for i in range(sizes[size]):
                    load, s = heap[0]
                    want.append((size, s))
                    heapq.heapreplace(heap, (load + size, s))
            runs = list(sharding.lpt_runs(list(sizes.items()), n_shards))
            assert Counter((size, s) for size, first, end, s in runs for _ in range(first, end)) == Counter(want)
            for size, n in sizes.items():
                assert sorted(i for x, first, end, _ in runs if x == size for i in range(first, end)) == list(range(n))


def test_a_hundred_thousand_groups_are_scheduled_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 500)
    n = 100_000
    # Sizes from 21 to 60 and a few large groups, of which some are copies.
    text = F.concat(F.lpad("id", 20, "0"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 40).cast("int")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")).unionByName(spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), (F.col("id") % 5 * 1000).cast("int")).alias("text")))
    out = sharding.lpt_shards(docs).cache()
    groups = Counter(21 + i * 7919 % 40 for i in range(n)) + Counter({60: 0})
    heap = [0] * 8
    for size in sorted([*groups.elements(), *(60 * (1000 * k + 1) for k in range(5))], reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert sorted(r.n for r in out.groupBy("shard").agg(F.sum("size").alias("n")).collect()) == sorted(heap)
    assert out.groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() < 5
    assert all(r.n == r.most + 1 for r in out.groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("most")).collect())


# Quality


def test_descent_finds_the_least_loss():
    rnd = np.random.default_rng(3)
    rows = [np.unique(rnd.integers(0, 60, 12)).astype(np.int32) for _ in range(80)]
    y = np.where([(r < 25).sum() > (r >= 35).sum() for r in rows], 1.0, -1.0)
    y[:8] *= -1
    ratio, cost = rnd.normal(0, 1, 60), np.full(80, 0.5)

    def loss(w, b):
        margins = np.array([(w[r] * ratio[r]).sum() / np.sqrt((ratio[r] ** 2).sum()) + b for r in rows])
        return (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - y * margins)).sum()

    best = nbsvm.dual_coordinate_descent(rows, y, ratio, cost, passes=400)
    least = loss(*best)
    assert loss(*nbsvm.dual_coordinate_descent(rows, y, ratio, cost)) < 1.05 * least
    for scale in (1e-3, 1e-2, 0.1):
        for _ in range(30):
            assert loss(best[0] + rnd.normal(0, scale, 60), best[1] + rnd.normal(0, scale)) >= least - 1e-9


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op9_quality(spark, SF).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(labels) > 80 and sum(got[i].predicted == y for i, y in labels) / len(labels) > 0.9


def test_labels_beyond_the_documents(spark):
    docs = spark.createDataFrame([(i, f"good {i} text" if i % 2 else f"bad {i} junk", 5) for i in range(40)] + [(3, "good again", 5)] * 30, "doc_id long, text string, quality_score int").repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1) for i in range(1000, 1400)] + [(1, 0)], "doc_id long, quality int")
    assert nbsvm.quality_scores(docs, labels).count() == 70
    assert {r.score for r in nbsvm.quality_scores(docs, labels.where("doc_id >= 1000 or quality = 1")).collect()} == {1.0}
    assert nbsvm.quality_scores(docs, labels, fit_rows=2, fit_bytes=1).count() == 70
    kept = nbsvm.of_quality(docs, labels)
    assert kept.columns == docs.columns


# Fingerprints


def xx(*values):
    h = 42
    for kind, v in values:
        h = xxhash.xxh64(v if kind == "s" else struct.pack("<" + kind, v), h).intdigest()
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_fingerprint(text, samples):
    terms, best = Counter(WORD.findall(text)), [None] * samples
    for word, weight in terms.items():
        term = signed(xx(("s", word.encode())))
        for i in range(samples):
            one = xx(("q", term), ("i", i))
            two = xx(("q", signed(one)))
            unit = lambda h, at, n: ((h >> at & (1 << n) - 1) + 0.5) / (1 << n)
            r, c, b = -math.log(unit(one, 32, 32) * unit(one, 0, 32)), math.log(-math.log(unit(two, 42, 22) * unit(two, 20, 22))), unit(two, 0, 20)
            t = math.floor(math.log(weight) / r + b)
            a = int((c - r * (t - b + 1) + 128) * (1 << 30))
            name = min((term % (1 << 64) >> 20) + t * cws.STRIDE & cws.BLANK, cws.BLANK - 1)
            if best[i] is None or (a, name) < best[i]:
                best[i] = (a, name)
    return "".join(f"{cws.BLANK if x is None else x[1]:06x}" for x in best)


def likeness(a, b):
    cut = lambda s: [s[i : i + 6] for i in range(0, len(s), 6)]
    return sum(x == y for x, y in zip(cut(a), cut(b), strict=True)) / (len(a) // 6)


@pytest.mark.parametrize("bucket_rows", [3, 400])
def test_fingerprints_are_brute_force(spark, bucket_rows):
    rnd = random.Random(6)
    docs = [(i if i % 4 else None, " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(12)) for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    docs += [(100, "same text é　日 here"), (100, "same text é　日 here"), (100, "same text é　日 here"), (100, "other"), (101, None), (101, ""), (-5, " \n"), (7, "7 7 7 7")]
    got = cws.fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 20, bucket_rows=bucket_rows).collect()
    key = lambda i: -(1 << 63) if i is None else i
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in docs)
    # The order within one id is free; that each row is followed by the next one must hold for some order.
    by_id = defaultdict(list)
    for i, t in docs:
        by_id[key(i)].append(t or "")
    ids = sorted(by_id, reverse=True)
    for at, i in enumerate(ids):
        mine, after = by_id[i], by_id[ids[(at + 1) % len(ids)]]
        edits = defaultdict(list)
        for n, text in enumerate(mine):
            for other in mine[:n] + mine[n + 1 :] + after:
                cut = len(text) // 3
                edited = text[: len(text) - cut] + other[:cut]
                edits[len(text), hashlib.sha256(edited.encode()).hexdigest()].append((text, edited, other))
        for r in [r for r in got if key(r.doc_id) == i]:
            options = edits[r.n_chars, r.edited_sha256]
            assert options
            print_of = {(plain_fingerprint(t, 20), plain_fingerprint(e, 20)) for t, e, _ in options}
            assert (r.fingerprint, r.edited_fingerprint) in print_of
            assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint)
            assert r.near_next in {likeness(r.fingerprint, plain_fingerprint(o, 20)) for _, _, o in options}


def sample_parts(word, i):
    """The word's term and its sample i: term, r, ln c, b."""
    term = signed(xx(("s", word.encode())))
    one = xx(("q", term), ("i", i))
    two = xx(("q", signed(one)))
    unit = lambda h, at, n: ((h >> at & (1 << n) - 1) + 0.5) / (1 << n)
    return term, -math.log(unit(one, 32, 32) * unit(one, 0, 32)), math.log(-math.log(unit(two, 42, 22) * unit(two, 20, 22))), unit(two, 0, 20)


def test_few_terms_are_drawn_for_a_sample(spark):
    words = [f"w{i}" for i in range(400)]
    counted = spark.createDataFrame([(0, 1, 400, sample_parts(w, 0)[0], 1 + i % 2, i % 3) for i, w in enumerate(words)], "bucket int, n int, words int, term long, s long, z long")
    every = cws.drawn(counted, 16, cws.ANY)
    assert every.count() == 400 * 16 and cws.drawn(counted, 16).count() < 400 * 16 * 0.4
    near = Counter((r.term, r.k) for r in cws.drawn(counted, 16).collect())
    for i, w in enumerate(words):
        for k in range(16):
            term, r, c, b = sample_parts(w, k)
            least = min(c - r * (math.floor(math.log(x) / r + b) - b + 1) for x in (1 + i % 2, i % 3) if x)
            assert near[term, k] == 1 or math.exp(least) > cws.WITHIN / 400


@pytest.mark.parametrize("within", [0.01, 1.0, 5.0, cws.WITHIN, cws.ANY])
def test_terms_left_out_change_no_fingerprint(spark, within):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcde") + str(int(rnd.paretovariate(0.7)) % 50) for _ in range(rnd.choice([0, 1, 5, 90, 300]))) for _ in range(30)] + [" ", "a", "a a a a a a a a a", None, "  a"]
    got = {r.doc_id: r for r in cws.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 12, bucket_rows=8, within=within).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        text, other = t or "", texts[i - 1] or ""
        edited = text[: len(text) - len(text) // 3] + other[: len(text) // 3]
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (plain_fingerprint(text, 12), plain_fingerprint(edited, 12))
        assert got[i].near_next == likeness(got[i].fingerprint, plain_fingerprint(other, 12))


def test_texts_without_a_small_value_are_worked_on_with_all_terms(spark, monkeypatch):
    # A text chosen so that its sample 0 lies above the bound.
    far = [w for w in (f"w{i}" for i in range(400)) if math.exp(sample_parts(w, 0)[2] - sample_parts(w, 0)[1]) * 200 > 2 * cws.WITHIN][:200]
    assert len(far) == 200
    docs = [(i, " ".join(f"{i}x{j}" for j in range(100))) for i in range(30)]
    docs[17] = (17, " ".join(far))
    calls, sampled = [], cws._sampled

    def counting(placed, samples, within):
        calls.append((placed.select("bucket").distinct().count(), within))
        return sampled(placed, samples, within)

    monkeypatch.setattr(cws, "_sampled", counting)
    got = {r.doc_id: r for r in cws.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), 4, bucket_rows=6).collect()}
    assert calls[0][1] == cws.WITHIN and calls[1][1] == cws.ANY and calls[1][0] < calls[0][0]
    assert [got[i].fingerprint for i, _ in docs] == [plain_fingerprint(t, 4) for _, t in docs]


def test_likeness_estimates_generalised_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 250")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    ids, errors = sorted(text, reverse=True), []
    nxt = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    for r in cws.fingerprints(docs).collect():
        t, o = text[r.doc_id], text[nxt[r.doc_id]]
        a, b = Counter(WORD.findall(t)), Counter(WORD.findall(t[: len(t) - len(t) // 3] + o[: len(t) // 3]))
        both = sum((a | b).values())
        errors.append(r.near_edited - (sum((a & b).values()) / both if both else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08, (np.mean(errors), np.std(errors))


# Whatever way a table is split and read


def changing(monkeypatch, spark):
    """Each table that is written changes how the next ones are split."""
    write, n = shared.Tables.write, [0]

    def other(self, df, name):
        out = write(self, df, name)
        n[0] += 1
        spark.conf.set("spark.sql.files.minPartitionNum", str([1, 9, 4][n[0] % 3]))
        spark.conf.set("spark.sql.files.maxPartitionBytes", ["1k", "128m", "20k"][n[0] % 3])
        return out

    monkeypatch.setattr(shared.Tables, "write", other)


@pytest.fixture
def split_conf(spark):
    yield
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_results_do_not_depend_on_splits(spark, tmp_path, monkeypatch, split_conf):
    rnd = random.Random(8)
    base = [" ".join(f"w{rnd.randrange(60)}" for _ in range(40)) for _ in range(15)]
    rows = []
    for i in range(300):
        w = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(40)] = "x"
        rows.append((i if i % 7 else None, " ".join(w), f"s{i % 3}"))
    rows += rows[:40] + [rows[3]] * 30
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).write.option("parquet.block.size", "4096").parquet(path)
    read = lambda: spark.read.parquet(path)
    runs = (
        lambda: jaccard_rtree.near_groups(read()), lambda: jaccard_rtree.one_of_each(read()), lambda: mixing.mix(read()), lambda: mixing.mixed_sources(read()).select("doc_id", "source", "taken"),
        lambda: cws.fingerprints(read(), 8, bucket_rows=20), lambda: sharding.lpt_shards(read(), 4).groupBy("text_crc32").agg(F.max("shard")),
    )
    want = [Counter(map(tuple, f().collect())) for f in runs]
    changing(monkeypatch, spark)
    for f, w in zip(runs, want, strict=True):
        assert Counter(map(tuple, f().collect())) == w


# Odd rows


def test_long_texts(spark):
    rnd = random.Random(1)
    long = " ".join(f"word{rnd.randrange(200000)}" for _ in range(260000))
    assert len(long) > 2 * common.SLICE_BYTES
    docs = spark.createDataFrame([(1, long), (2, "short text"), (3, long), (4, None), (5, ""), (6, long + " more")], "doc_id long, text string")
    kept = {r.doc_id: r for r in substring_dedup.kept_texts(docs).collect()}
    assert kept[1].kept == long and (kept[3].n_removed, kept[3].kept, kept[6].kept) == (260000, "", "more") and kept[2].n_removed == 0
    scores = {r.doc_id: r for r in ppm.scored(docs).collect()}
    assert scores[1].n_tokens == 260001 and math.isfinite(scores[1].score) and scores[1].score == pytest.approx(scores[3].score) and scores[4].n_tokens == 1
    groups = {r.doc_id: r.component_id for r in jaccard_rtree.near_groups(docs).collect()}
    assert groups == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 1}
    pieces = packing.packed(docs.where("doc_id < 4"), queries.tokenizer_path()).collect()
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(queries.tokenizer_path()).encode(long, add_special_tokens=False).ids
    mine = sorted((r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in pieces if r.doc_id == 1)
    assert [x for _, p in mine for x in p] == [*ids, 1]


def test_encoder_gives_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own, tok, rnd = packing.Encoder(path), Tokenizer.from_file(path), random.Random(9)
    assert own.fast is not None
    signs = ["a", "Zz", "é", "ß", "日本", "ﬀ", "́", "‍", "😀", "1", "²", "٣", " ", "  ", "\t", "\n", "\r\n", " ", "　", " ", "'s", "'LL", "’s", ".", "--", "<|endoftext|>", "\x00", "�", "_"]
    for _ in range(400):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40)))
        assert own.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
    for text in ("a" * 70000, " " * 70000, "^" * 70000 + " ", "x " * 30000):
        assert own.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids
    import public_tokenizers

    lower = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert lower.fast is None and lower.encode("Some Text").tolist() == lower.tokenizer.encode("Some Text", add_special_tokens=False).ids


def test_encoder_reads_the_tokenizer_when_a_text_needs_it():
    # In a process of its own, as others here have loaded it.
    code = """
import sys
from quillspark.llm import packing, queries
own = packing.Encoder(queries.tokenizer_path())
assert len(own.encode("Some plain text.")) and own.travel == "<u2" and "tokenizers" not in sys.modules
from tokenizers import Tokenizer
vocab = Tokenizer.from_file(queries.tokenizer_path()).get_vocab()
assert max(vocab.values()) < 1 << 16
text = "Some " + own.added[0] + " text"
assert own.encode(text).tolist() == Tokenizer.from_file(queries.tokenizer_path()).encode(text, add_special_tokens=False).ids
"""
    import os
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def test_packing_is_first_fit_decreasing():
    rnd = random.Random(3)
    for n in (0, 1, 2, 50, 400):
        sizes = [rnd.choice([rnd.randint(1, 2048), 2048, 7]) for _ in range(n)]
        bins, want = [], {}
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            at = next((b for b, used in enumerate(bins) if used + sizes[i] <= 2048), len(bins))
            bins += [0] * (at == len(bins))
            want[i] = (at, bins[at])
            bins[at] += sizes[i]
        assert packing.first_fit_decreasing(sizes, 2048) == [want[i] for i in range(n)]
        assert n < 50 or sum(bins) / (2048 * len(bins)) > 0.9


def test_top_k_over_many_blocks_and_shards(spark, monkeypatch):
    for name, value in {"BLOCK_BYTES": 300, "SHARD_BYTES": 2000, "TILE_QUERIES": 3, "TILE_ROWS": 5, "FAN": 2}.items():
        monkeypatch.setattr(topk, name, value)
    rnd = random.Random(4)
    rows = [(rnd.choice([i, i, 0, 3]), [rnd.choice([-1.0, 0.5, 0.25, 0.0]) for _ in range(6 if i % 9 else 3)], i, "x") for i in range(160)] + [(None, [1.0] * 6, 1, "x"), (5, None, 1, "x")]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, tile string").repartition(4), every=4).collect()
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v]
    want = set()
    for q in {i for i, _ in fine if i % 4 == 0}:
        v = min(x for i, x in fine if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in fine if i != q and len(x) == len(v))[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want


def test_clashing_columns_stay(spark):
    extra = {c: f"{c}!" for c in ("rid", "copies", "copy", "k1", "k2", "times", "x", "part", "label", "Keeper", "n", "quality", "score", "u", "cell", "_found")}
    rows = [(i, f"some words of text number {i // 2} and more of them", "s", *extra.values()) for i in range(20)] + [(3, "same", "t", *extra.values())] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in extra)).repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    one = jaccard_rtree.one_of_each(docs)
    mixed = mixing.mix(docs)
    for df in (one, mixed, nbsvm.of_quality(docs, labels), pii.pseudonymised(docs, "k").drop("n_replaced")):
        assert df.columns == docs.columns and all(r[c] == v for r in df.collect() for c, v in extra.items())
    assert sorted(r.doc_id for r in one.collect()) == sorted([*range(0, 20, 2), 3])
    for df in (cws.fingerprints(docs, 4), ppm.scored(docs), packing.packed(docs, queries.tokenizer_path()), sharding.lpt_shards(docs), substring_dedup.without_repeats(docs), jaccard_rtree.near_groups(docs)):
        assert df.count() >= 23


def test_the_tree_leaves_out_what_cannot_link(spark):
    counted: dict = {}
    jaccard_rtree.near_rows(spark.read.parquet(f"{SF}/documents.parquet"), counted=counted).count()
    assert set(counted) == {"stars", "maybe", "links"} and counted["maybe"]["boxed"] < counted["maybe"]["pairs"]
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) for n in rnd.integers(5, 400, 90)]
    sets += [np.unique(np.concatenate([s[rnd.random(len(s)) < 0.9], rnd.integers(0, 1 << 63, len(s) // 12, dtype=np.uint64)])) for s in sets]
    points = np.array([jaccard_rtree.count_vector(s) for s in sets])
    left = {(min(i, j), max(i, j)) for a, b in jaccard_rtree.CountRTree(points).pairs() for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard_rtree._overlap(sets[i], sets[j])}
    assert linked and linked <= left and len(left) < len(sets) ** 2 / 8


def test_words_made_to_collide_are_told_apart(spark):
    a = "a"
    for _ in range(12):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    taught = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2)
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(taught, f"{rest} {a}"), (held, f"{rest} {b}")], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.without_repeats(docs).collect()} == {0}
    scored = {r.doc_id: r for r in ppm.scored(docs).collect()}
    assert scored[held].held_out and scored[held].n_known == scored[held].n_tokens - 1
    few = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_rtree.near_groups(few).collect()} == {1: 1, 2: 2, 3: 1}


def test_an_unasked_key_is_an_error():
    with pytest.raises(LookupError, match="1 of 2"):
        common.places(pd.Index(np.array([3, 5], np.uint64)), np.array([5, 7], np.uint64))


def test_a_key_of_any_characters_works_and_stands_in_no_plan(spark):
    docs = spark.createDataFrame([(1, "call 4111 1111 1111 1111 or 10.1.2.3")], "doc_id long, text string")
    key = "o'k|\\ \"secret\""
    out = pii.pseudonymised(docs, key)
    assert "secret" not in out._jdf.queryExecution().toString()
    row = out.first()
    assert row.n_replaced == 2
    assert row.text == f"call {plain_pseudonym('card', '4111 1111 1111 1111', key)} or {plain_pseudonym('ip', '10.1.2.3', key)}"
