import re
from collections import Counter, defaultdict
from itertools import permutations

from quillspark.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, good, toxic):
    """{(part, order, step): counts}, by applying the filters one after the other."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = defaultdict(list)
    for i, t, part in docs:
        t = t or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        rows[part or ""].append((i, fails))
    out, shares = {}, Counter()
    for part, all_rows in rows.items():
        for order in map("".join, permutations("ABCDE")):
            left = all_rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                before, left = left, [r for r in left if not r[1][f]]
                shares[part, f] += len(gone)
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in all_rows)
                redundant = sum(r[1][f] for r in all_rows) - len(gone)
                assert len(before) == len(gone) + len(left)
                out[part, order, step] = [len(left), len(gone), redundant, only, sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_is_brute_force(spark):
    many = " ".join(f"w{i}" for i in range(205))
    texts = [many, many + " #", many.replace("w", "W"), "few words", "FEW Words $", "same " * 210, "Été  x\x85y", "", " \t\n\x0b", None, many + "\x0b\x0cend", "x " * 40000, "a b " * 199 + "c"]
    langs = ["en", "de", None, ""]
    docs = [(i if i % 11 else None, texts[i * 7 % len(texts)], langs[i % 4]) for i in range(160)]
    docs += [docs[5]] * 3 + [(5, "another text of id 5", "en"), (5, many, "fr")]
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 160, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, n int").repartition(5)
    got = filter_audit.filter_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r[:3]): tuple(r[3:]) for r in got.collect()} == brute(docs, good, toxic)


def test_no_documents_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(spark.createDataFrame([], "doc_id long, text string, lang string"), none).collect() == []
    rows = filter_audit.filter_audit(spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string"), none).collect()
    assert len(rows) == 600 and {(r.good_lost, r.toxic_lost) for r in rows} == {(0, 0)} and {r.shapley for r in rows if r.filter_order[r.step - 1] == "A"} == {120}
