import random
import re
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import mixing, nbsvm, pii, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rnd, out = random.Random(12), []
    for i in range(160):
        good = i % 3 != 0
        words = [rnd.choice(["good", "fine", "text", "and"] if good else ["junk", "spam", "###"]) + str(rnd.randrange(30)) for _ in range(40)]
        if i % 10 == 5:
            words[3] = "4111111111111111"
        out.append([i, " ".join(words), "en", f"s{i % 4}"])
    for i in range(160, 200):
        words = out[i - 160][1].split()
        words[rnd.randrange(40)] = "changed"
        out.append([i, " ".join(words) if i % 2 else out[i - 160][1], None, None])
    out += [[300, None, "en", "s0"], [301, "", "en", "s0"], [302, "", "en", "s1"], [None, "good1 fine2", "en", "s1"], out[1], out[1]]
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


def components(docs):
    sets = []
    for r in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group(0).lower(), r.text or ""))
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(docs))], sets


def test_stages_are_plain_python(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame(rows(), COLUMNS).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(160)] + [(9999, 1)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    docs, stages = spark.read.parquet(f"{sf}/documents.parquet"), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "pseudonyms", "mixture", "sequences"]

    def step(name, df):
        out = stages[name](spark, df, sf)
        if name != "sequences":
            assert out.columns == df.columns and out.dtypes == df.dtypes
        out.write.parquet(f"{sf}/{name}")
        return spark.read.parquet(f"{sf}/{name}")

    good = step("quality", docs)
    scores = {(r.doc_id, r.text): r.quality_score for r in nbsvm.with_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert Counter(map(tuple, good.collect())) == Counter(tuple(r) for r in docs.collect() if scores[r.doc_id, r.text] >= 0.5)
    assert 100 <= good.count() < len(rows()) - 40

    one, before = step("near_duplicates", good), good.collect()
    group, sets = components(before)
    least: dict = {}
    for g, r in zip(group, before, strict=True):
        least[g] = min(least.get(g, 1 << 62), 1 << 62 if r.doc_id is None else r.doc_id)
    want = Counter({tuple(r) for g, r, s in zip(group, before, sets, strict=True) if s and (1 << 62 if r.doc_id is None else r.doc_id) == least[g]}) + Counter(tuple(r) for r, s in zip(before, sets, strict=True) if not s)
    assert Counter(map(tuple, one.collect())) == want and len(want) < len(before)

    private = step("pseudonyms", one)
    plain = {r.doc_id: r.text for r in pii.pseudonymised(one, queries.pseudonym_key(spark)).collect()}
    assert all(r.text == plain[r.doc_id] and r.n_chars == (None if r.text is None else len(r.text)) for r in private.collect()) and private.count() == one.count()
    assert not any("4111111111111111" in (r.text or "") for r in private.collect()) and any("4111111111111111" in (r.text or "") for r in one.collect())

    mixed = step("mixture", private)
    taken = Counter()
    for r in mixing.mixed_sources(private).collect():
        taken[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +taken

    tok, texts, sequences = Tokenizer.from_file(queries.tokenizer_path()), defaultdict(list), defaultdict(int)
    for r in step("sequences", mixed).collect():
        texts[r.row_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences[r.sequence_id] += r.length
    whole = Counter(tuple(x for _, p in sorted(parts) for x in p) for parts in texts.values())
    assert whole == Counter((*tok.encode(r.text or "", add_special_tokens=False).ids, 1) for r in mixed.collect()) and max(sequences.values()) <= 2048

    run = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in run.collect()) == Counter((r.doc_id, r.start, r.ids_crc32) for r in spark.read.parquet(f"{sf}/sequences").collect())


def test_an_empty_table_goes_through(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_workers_get_bounded_batches(spark, tmp_path):
    import pyarrow as pa

    docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat(concat('word', id, ' '), 1000) text", "'en' lang", "'s' source", "0L n_chars")
    stages = dict(corpus_pipeline.STAGES)
    before = spark.conf.get(corpus_pipeline._BATCHES, None)
    try:
        spark.conf.unset(corpus_pipeline._BATCHES)
        stages["sequences"](spark, docs, str(tmp_path))
        sizes = docs.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"size": [b.nbytes]}) for b in it), "size long")
        sizes = [r.size for r in sizes.collect()]
        # 24 MB of texts; the row that fills a batch is its last one.
        assert sum(sizes) > 20 << 20 and max(sizes) < (4 << 20) + (64 << 10)
        # A limit of the caller's stays, and a result doesn't depend on it.
        want = {(r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in stages["sequences"](spark, docs.where("doc_id < 50"), str(tmp_path)).collect()}
        spark.conf.set(corpus_pipeline._BATCHES, "1000")
        got = stages["sequences"](spark, docs.where("doc_id < 50"), str(tmp_path))
        assert spark.conf.get(corpus_pipeline._BATCHES) == "1000" and {(r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in got.collect()} == want
    finally:
        spark.conf.unset(corpus_pipeline._BATCHES) if before is None else spark.conf.set(corpus_pipeline._BATCHES, before)
