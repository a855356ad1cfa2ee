import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from quillspark.llm import components, cws, jaccard_rtree, mixing, nbsvm, packing, pii, ppm, queries, sharding, substring_dedup, topk
from quillspark.llm.common import Tables

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, None), (900, ""), (901, "a b"), (901, "a b"), (902, None), (903, "x " * 3000)]


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), t or "")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string")


def some(seed, n=60):
    rnd, out = random.Random(seed), []
    for i in range(n):
        v = rnd.choice([["a"], ["a", "b"], ["a", "b", "c"], list("abcdefgh")])
        w = [rnd.choice(v) for _ in range(rnd.randint(0, 120))]
        if i and rnd.random() < 0.6:
            o = out[rnd.randrange(len(out))][1].split()
            a = rnd.randint(0, len(o))
            w[rnd.randint(0, len(w)) : 0] = o[a : a + rnd.randint(15, 60)]
        out.append((i if i % 9 else i // 18, " ".join(w) + "\n" * (i % 3)))
    return out + ODD


def rows(df, digits=5):
    return sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_substring_dedup_is_brute_force(spark):
    docs = some(3)
    seen, want = set(), []
    for i, w in sorted(((i, WORD.findall(t or "")) for i, t in docs), key=lambda x: (x[0] is None, x[0] or 0)):
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert rows(substring_dedup.without_repeats(frame(spark, docs), batch_bytes=2000)) == sorted(want, key=repr)


def test_substring_dedup_keeps_the_text(spark):
    first, second = [" ".join(f"é{k}{j}" for j in range(25)) for k in "ab"]
    docs = [(1, f"top  {first}\nend"), (2, f"new {second} mid {first} tail"), (2, first), (3, None), (4, ""), (None, f"{second} last")]
    got = substring_dedup.kept_texts(frame(spark, docs), batch_bytes=300).collect()
    assert len({r.rid for r in got}) == len(docs)
    want = [(1, 27, 0, f"top {first} end"), (2, 53, 25, f"new {second} mid tail"), (2, 25, 25, ""), (3, 0, 0, ""), (4, 0, 0, ""), (None, 26, 25, "last")]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == sorted(want, key=repr)


def test_ppm_is_brute_force(spark):
    docs = some(5, 25) + [(7002, "\x00 x\x00y  \n ÉaÿZ")]
    ctx, words, prep = [defaultdict(Counter) for _ in range(6)], Counter(), []
    for i, t in docs:
        w = [x.encode() for x in WORD.findall(lower(t))]
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        s = [0] * 5 + [b + 1 for b in lower(t).encode()] + [257]
        prep.append((i, held, [*w, "END"], s))
        if not held:
            words.update([*w, "END"])
            for p in range(5, len(s)):
                for k in range(6):
                    ctx[k][tuple(s[p - k : p])][s[p]] += 1
    n, v, want = sum(words.values()), len(words), []
    for i, held, w, s in prep:
        score = 0.0
        for p in range(5, len(s)):
            out: set = set()
            for k in range(5, -1, -1):
                c = ctx[k].get(tuple(s[p - k : p]))
                if not c:
                    continue
                m, d = sum(x for y, x in c.items() if y not in out), sum(y not in out for y in c)
                if s[p] in c:
                    score += math.log10(c[s[p]] / (m + d))
                    break
                score += math.log10(d / (m + d)) if d else 0
                out = set(c)
            else:
                score -= math.log10(max(1, 257 - len(ctx[0][()])))
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w)
        want.append((i, held, len(w), sum(words[x] > 0 for x in w), n, round(base, 5), round(score, 5)))
    assert rows(ppm.scored(frame(spark, docs), batch_bytes=20000)) == sorted(want, key=repr)


def components_of(docs):
    sets = []
    for _, t in docs:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), 1 << 62), 1 << 62 if d is None else d)
    return sorted(((d, len(sets[i]), d if not sets[i] or least[find(i)] == 1 << 62 else least[find(i)]) for i, (d, _) in enumerate(docs)), key=repr)


def test_jaccard_join_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_rtree, "TILE", 64)
    monkeypatch.setattr(jaccard_rtree, "BLOCK", 50)
    rnd, docs = random.Random(3), []
    for i in range(150):
        w = [f"w{j}" for j in range(60)]
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(60)] = f"x{rnd.randrange(5)}"
        docs.append((i, " ".join(w)))
    docs += [*ODD, (None, "a b"), (None, "q"), (1002, "A  B")]
    assert rows(jaccard_rtree.near_groups(frame(spark, docs))) == components_of(docs)


@pytest.mark.parametrize("part_links", [5, 1000])
def test_components_in_parts(spark, monkeypatch, part_links):
    monkeypatch.setattr(components, "PART_LINKS", part_links)
    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(12)] + [(rnd.randrange(20, 60), rnd.randrange(20, 60)) for _ in range(24)] + [(3, 3), (None, 4), (4, 5), (5, 4)]
    up = list(range(61))
    for a, b in [p for p in pairs if None not in p] * 61:
        up[a] = up[b] = min(up[a], up[b])
    want = {(x, up[x]) for p in pairs if None not in p and p[0] != p[1] for x in p}
    got = [tuple(r) for r in components.components(spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("name", ["op2_exact_top_k", "op4_mix_sources"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert rows(df.select(*want.columns)) == sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in want.fetchall()), key=repr)


def test_top_k_odd_vectors(spark):
    data = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, [float("nan"), 1.0]), (5, [0.1]), (6, [3.0e38, 3.0e38]), (None, [1.0, 1.0])]
    got = topk.exact_top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 6), (0, 2, 1)]
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    docs = [*some(9, 20), (77, "Ça va?  \n\n été 日本　x")]
    got = packing.packed(frame(spark, docs), path, group_docs=8).collect()
    tok, at = Tokenizer.from_file(path), defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for pieces in at.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= 2048
    want = Counter()
    for i, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[i, s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want


def test_packing_keeps_the_ids(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline

    path = queries.tokenizer_path()
    # Two copies of each id, as the mix makes them, and texts of no piece, one and many.
    docs = [*some(9, 20), *some(9, 20), (None, "x " * 5000), (78, "\u00c7a va?  \n\n")]
    got = corpus_pipeline.sequences(spark, frame(spark, docs), SF).collect()
    tok, sequences, texts = Tokenizer.from_file(path), defaultdict(dict), defaultdict(list)
    for r in got:
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id][r.offset] = ids
        texts[r.row_id, r.doc_id].append((r.start, ids))
    for s in sequences.values():
        assert len([x for o in sorted(s) for x in s[o]]) == max(o + len(s[o]) for o in s) <= 2048
    whole = Counter((d, tuple(x for _, ids in sorted(p) for x in ids)) for (_, d), p in texts.items())
    assert whole == Counter((i, (*tok.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in docs)


def test_shards_even_and_gapless(spark):
    docs = [*some(4), *[(2000 + i, f"t{i}") for i in range(200)]]
    got = sharding.lpt_shards(frame(spark, docs), n_shards=4).collect()
    by, of = defaultdict(list), defaultdict(set)
    for r in got:
        by[r.shard].append(r.slot)
        of[r.text_crc32].add(r.shard)
    assert len(got) == len(docs) and all(sorted(v) == list(range(len(v))) for v in by.values()) and all(len(v) == 1 for v in of.values())
    assert list(sharding.lpt_runs([(5, 1), (4, 1), (3, 2)], 2)) == [(5, 0, 1, 0), (4, 0, 1, 1), (3, 0, 1, 1), (3, 1, 2, 0)]


def test_pseudonyms(spark):
    docs = [(1, "card 4111111111111111 or 4111 1111 1111 1111, not 4111111111111112"), (2, "on 2024-02-29, 29.02.2024; not 2024-02-30"), (3, None), (4, ""), (5, "IBAN DE89370400440532013000"), (6, "clean 12 words")]
    got = {r.doc_id: r for r in pii.pseudonymised(frame(spark, docs), "k").collect()}
    digits = re.findall(r"\d[\d ]{14,}\d", got[1].text)
    assert got[1].n_replaced == 2 and digits[0] == digits[1].replace(" ", "") != "4111111111111111" and digits[2] == "4111111111111112"
    assert sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[0][::-1])) % 10 == 0
    y, m, d = re.search(r"(\d{4})-(\d\d)-(\d\d)", got[2].text).groups()
    assert f"{d}.{m}.{y}" in got[2].text and "2024-02-30" in got[2].text and "29.02.2024" not in got[2].text
    iban = got[5].text.split()[1]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert (got[3].text, got[4].text, got[6].text, got[6].n_replaced) == (None, "", "clean 12 words", 0)


def test_pseudonyms_side_by_side(spark):
    card, iban, short = "9807915762804495", "BE68539007547034", "NO9386011117947"
    texts = [
        (f"{card} 190.137.223.204", [card, "190.137.223.204"]), ("pay 4111 1111 1111 1111 123 now", ["4111 1111 1111 1111"]), (f"{iban} 2024", [iban]), (f"to {short} BIC, {card}", [short, card]),
        ("BE68 5390 0754 7034 2024-02-29", ["BE68 5390 0754 7034", "2024-02-29"]), ("no 123 4111 1111 1111 1111 12", ["4111 1111 1111 1111"]), (f"{card} 4111111111111111", [card, "4111111111111111"]), ("4111111111111112 123", []), ("a@b.de\n4111 1111 1111 1112 77", ["a@"]),
    ]
    got = {r.doc_id: r for r in pii.pseudonymised(frame(spark, [(i, t) for i, (t, _) in enumerate(texts)] + [(50, card), (51, iban)]), "k").collect()}
    for i, (t, gone) in enumerate(texts):
        assert got[i].n_replaced == len(gone) and len(got[i].text) >= len(t) - 12, (t, got[i].text)
        assert not any(g in got[i].text for g in gone), (t, got[i].text)
    assert got[0].text.split()[0] == got[6].text.split()[0] == got[50].text and got[2].text == got[51].text + " 2024"
    assert got[1].text.startswith("pay ") and got[1].text.endswith(" 123 now") and got[5].text.startswith("no 123 ") and got[5].text.endswith(" 12") and got[8].text.endswith("\n4111 1111 1111 1112 77")


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3):
        df = spark.range(10**n).selectExpr(f"transform(split(lpad(id, {n}, '0'), ''), x -> cast(x as bigint)) as all").selectExpr(f"slice(all, 1, {n}) as v")
        out = df.selectExpr(pii.permuted("v", f"array_repeat(10L, {n})", "'t'", "k") + " as p").distinct()
        assert out.count() == 10**n


def test_fingerprints(spark):
    docs = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(40))) for i in range(30)] + [(50, "same text here"), (51, "same text here"), (52, None), (53, "")]
    got = {r.doc_id: r for r in cws.fingerprints(frame(spark, docs)).collect()}
    text = {i: t or "" for i, t in docs}
    ids = sorted(text, reverse=True)
    assert len(got) == len(docs) and got[50].fingerprint == got[51].fingerprint and got[51].near_next == 1.0 and got[53].near_next == 1.0
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        m = len(text[a]) // 3
        edited = text[a][: len(text[a]) - m] + text[b][:m]
        assert got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_quality_learns(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice(["good", "fine", "text"] if i % 2 else ["junk", "spam", "###"]) for _ in range(20))) for i in range(200)] + ODD
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = nbsvm.quality_scores(frame(spark, docs), labels).collect()
    assert len(got) == len(docs) and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 200)


def test_targets_share_all(spark, tmp_path):
    sizes = {"a": 100, "b": 10, "c": 1000, "z\U0001f600": 0, "z\uffff": 300, None: 50}
    weights = dict(zip(["a", "b", "c", "z\uffff", "z\U0001f600", None], [5, 2, 1, 5, 2, 1], strict=True))
    total, tables = 1.5 * sum(sizes.values()), Tables(spark, "t")
    got = {r.source: r.target for r in mixing.targets(tables, spark.createDataFrame(list(sizes.items()), "source string, size long"), (5, 2, 1), 1.5, 2.0).collect()}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * n, mid * weights[s]) for s, n in sizes.items()) < total else (lo, mid)
    assert sum(got.values()) == pytest.approx(total)
    assert all(got[s] == pytest.approx(min(2 * n, lo * weights[s])) for s, n in sizes.items())


def test_inclusion_frequencies_are_the_wanted_ones(spark):
    # 300 sources of like documents: as many draws with one set of odds for each weight.
    sizes = [5 + 3 * i for i in range(30)]
    docs = [(s * 100 + i, "w " * n, f"s{s:04d}") for s in range(900) for i, n in enumerate(sizes)]
    got = mixing.mixed_sources(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)).collect()
    drawn, wanted, words, targets = defaultdict(list), {}, Counter(), {}
    for r in got:
        rest = r.target / r.source_size % 1
        if rest > 0:
            drawn[round(r.target), r.size].append(r.copies - int(r.target // r.source_size))
            wanted[round(r.target), r.size] = r.inclusion
        words[r.source] += r.taken
        targets[r.source] = r.target
    assert len(got) == len(docs) and len({round(p, 6) for p in wanted.values()}) >= len(sizes)
    for k, hits in drawn.items():
        assert len(hits) == 300 and abs(sum(hits) / 300 - wanted[k]) < 0.11, (k, sum(hits) / 300, wanted[k])
    for target, size in {(t, s) for t, s in drawn}:
        mine = [(wanted[target, n], n) for n in sizes]
        assert abs(sum(p * n for p, n in mine) + target // sum(sizes) * sum(sizes) - target) < 1
    assert all(abs(words[s] - t) <= max(sizes) / 2 for s, t in targets.items())
    assert max(wanted.values()) - min(wanted.values()) > 0.3


def test_mix_of_odd_rows(spark):
    rows_ = [(None, "a b c", None, 1, 2), (None, "a b c", None, 1, 2), (None, "a b c", None, 3, 4), (1, None, "s", 0, 0), (2, "", "s", 0, 0), (2, "", "s", 0, 0), *((i, "x y " * i, "s", i, i) for i in range(3, 40)), *((7, "same text here", "t", 0, 0) for _ in range(50))]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, source string, copies long, copy long").repartition(3)
    taken = mixing.mixed_sources(docs).collect()
    assert len(taken) == len(rows_) and all(0 <= r.taken <= 2 * r.size for r in taken)
    size = lambda t: len(WORD.findall(t or ""))
    for s in (None, "s", "t"):
        mine = [r for r in taken if r.source == s]
        assert {r.source_size for r in mine} == {sum(size(r[1]) for r in rows_ if r[2] == s)}
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2
    assert len({r.copies for r in taken if r.doc_id == 7}) == 2 or mine[0].target % mine[0].source_size == 0
    got = Counter(tuple(r) for r in mixing.mix(docs).collect())
    assert got == Counter(tuple(r) for r in mixing.mix(docs.repartition(7)).collect()) and set(got) <= set(rows_)
    assert sum(n * size(r[1]) for r, n in got.items()) == sum(r.taken for r in taken)


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    sources = none.selectExpr("doc_id", "text", "score as source")
    for df in (substring_dedup.without_repeats(none), ppm.scored(none), packing.packed(none, queries.tokenizer_path()), sharding.lpt_shards(none), jaccard_rtree.near_groups(none), nbsvm.quality_scores(none, labels), cws.fingerprints(none), pii.pseudonymised(none, "k"), mixing.mixed_sources(sources)):
        assert df.count() == 0
