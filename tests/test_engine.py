import hashlib
import math
import random
import re
import uuid
from collections import Counter
from urllib.parse import quote

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import adjacency, graph, links, manifest, retrieval
from quillspark.plans import queries as plans

SF = "/root/testdata/sf0.001"


def _value(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = plans.queries()[name](spark, SF)
    want = con.sql(plans.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert df.count() > 0 and sorted((tuple(_value(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(_value(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_sparse_weights_of_all_languages(spark, tmp_path):
    docs = [(1, "the cat, the dog", "en"), (2, "l'été ÉTÉ à Paris", "fr"), (3, "über Über straße 12", "de"), (4, "niño niña", "es"), (5, "no language", None), (6, "", "fr"), (7, None, "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t, _ in docs:
        if words := re.findall(r"[^\W_]+", (t or "").lower()):
            tf = Counter(words)
            want[i] = (len(tf), round(sum(n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words) / 256)) for n in tf.values()), 4))
    assert {r.doc_id: (r.terms, r.weight) for r in plans.queries()["sparse_weights"](spark, str(tmp_path)).collect()} == want


def test_notes_stay_where_numbers_have_gaps(spark, tmp_path):
    docs = [(i, f"text {i}", "en", "src0") for i in (0, 1, 5, 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = plans.queries()
    assert sorted(r.note_id for r in run["note_ids"](spark, str(tmp_path)).collect()) == [f"src0/en-{i}" for i in (0, 1, 5, 9)]
    assert {r.tag: r.n for r in run["top_tags"](spark, str(tmp_path)).collect()} == {"en": 4, "t0": 1, "t1": 1, "t2": 1, "t5": 1}
    # (7 i + 1) % 4 and (13 i + 5) % 4 of 0, 1, 5 and 9: 1, 0, 0, 0 and 1, 2, 2, 2.
    got = sorted((r.note_id, r.target_raw, r.target_note_id) for r in run["resolved_links"](spark, str(tmp_path)).collect() if r.target_note_id)
    assert got == [("src0/en-0", "EN-1", "src0/en-1"), ("src0/en-0", "src0/en-1", "src0/en-1"), *((f"src0/en-{i}", "src0/en-0", "src0/en-0") for i in (1, 5, 9))]


def test_manifest_and_fusion_of_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "n_chars").collect()
    got = {(r.note_id, r.change) for r in plans.queries()["manifest_diff"](spark, SF).collect()}
    want = {(i, "added" if i % 10 == 0 else "modified" if i % 7 == 0 else "unchanged") for i in (r.doc_id for r in docs)}
    assert got == want | {(-r.doc_id - 1, "deleted") for r in docs if r.doc_id % 10 == 0}
    score, best = Counter(), {}
    for key in (lambda r: r.n_chars, lambda r: int(hashlib.md5((r.text or "").encode()).hexdigest()[:8], 16)):
        for n, r in enumerate(sorted(docs, key=lambda r: (-key(r), r.doc_id))[:50], 1):
            score[r.doc_id] += 1 / (60 + n)
            best[r.doc_id] = min(n, best.get(r.doc_id, n))
    fused = plans.queries()["fused_ranks"](spark, SF).collect()
    assert {r.chunk_id: r.best for r in fused} == best and all(abs(r.score - score[r.chunk_id]) < 1e-8 for r in fused)


def test_links_and_tags(spark):
    body = "see [[a]] [[b|x]] [[c#h]] [[d#^q]] ![[e]] ![[p.png]] [t](r/n.md) [u](http://x.org) `[[no]]` #one\n```\n[[no]] #no\n```\n#two/x #one"
    notes = spark.createDataFrame([("n", body)], "note_id string, body string")
    got = [(r.kind, r.target_raw, r.alias, r.heading, r.block_id) for r in links.extract_links(notes).orderBy("line", "class", "pos").collect()]
    assert got == [("link", "a", None, None, None), ("link", "b", "x", None, None), ("link", "c", None, "h", None), ("link", "d", None, None, "q"), ("embed", "e", None, None, None), ("link", "r/n.md", None, None, None)]
    assert notes.select(T.inline_tags(F.col("body"))).first()[0] == ["one", "two/x"]


def test_resolution_order(spark):
    notes = spark.createDataFrame([("x/Dup", []), ("y/z/Dup", ["Other"]), ("Exact", [])], "note_id string, aliases array<string>")
    raw = spark.createDataFrame([("Exact",), ("dup",), ("other",), ("none",)], "target_raw string")
    got = {r.target_raw: r.target_note_id for r in links.resolve_links(raw, notes).collect()}
    assert got == {"Exact": "Exact", "dup": "x/Dup", "other": "y/z/Dup", "none": None}


def test_link_forms(spark):
    body = "[[a#]] [[b|]] [[c#^]] [[ d # h | x ]] [[e#^ q ]]\n\t```\n[[no]] #no\n\t```\n\u3000~~~\n[[no]]\n~~~ end\n[[f]] [[g.png]] ![[N v1.2]] [x](http://y/z.md) [y](a.md#h) ![i](j.md) [[ ]]"
    notes = spark.createDataFrame([("n", body), ("empty", ""), ("null", None)], "note_id string, body string")
    got = [(r.target_raw, r.heading, r.block_id, r.alias) for r in links.extract_links(notes).orderBy("line", "class", "pos").collect()]
    assert got == [("c", "^", None, None), ("d", "h", None, "x"), ("e", None, "q", None), ("f", None, None, None), ("g.png", None, None, None), ("http://y/z.md", None, None, None)]


def test_lines_outside_fences_are_a_fold(spark):
    rnd, texts = random.Random(4), []
    for _ in range(60):
        texts.append("\n".join(rnd.choice(["a", "", " b", "```", "~~~", "  ```py", "\t~~~", "x ```", "````"]) for _ in range(rnd.randint(0, 14))))

    def free(text):
        mark, out = None, []
        for line in text.splitlines():
            head = line.strip()[:3]
            if mark is None and head in ("```", "~~~"):
                mark = head
            elif mark is None:
                out.append(line)
            elif head == mark:
                mark = None
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.outside_fences(F.col("t")).alias("x"))
    assert {r.i: r.x for r in df.collect()} == {i: free(t) for i, t in enumerate(texts)}
    long = spark.createDataFrame([("\n".join(["```", "x", "```", "y"] * 5000),)], "t string")
    assert long.select(F.size(T.outside_fences(F.col("t")))).first()[0] == 5000


def test_manifest_with_null_hashes(spark):
    a = spark.createDataFrame([("same", None), ("new", None), ("set", "h"), ("eq", "h")], "note_id string, content_hash string")
    b = spark.createDataFrame([("same", None), ("gone", None), ("set", None), ("eq", "h")], "note_id string, content_hash string")
    assert {r.note_id: r.change for r in manifest.diff(a, b).collect()} == {"same": "unchanged", "new": "added", "gone": "deleted", "set": "modified", "eq": "unchanged"}


def queue_expand(nodes, edges, seeds, max_depth, max_nodes, decay, hub):
    degree = Counter(x for a, b in edges for x in (a, b))
    near = lambda x: [b for a, b in edges if a == x] + [a for a, b in edges if b == x]
    visited, queue, out = set(seeds), [(s, 1.0, 0) for s in seeds], []
    while queue and len(out) < max_nodes:
        x, score, depth = queue.pop(0)
        if depth and not nodes[x]:
            out.append((x, round(score * decay**depth / math.log2(2 + degree[x]), 9), depth))
        if depth < max_depth and not (depth and degree[x] > hub):
            for y in near(x):
                if y not in visited:
                    visited.add(y)
                    queue.append((y, score, depth + 1))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_expand_is_a_queue(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    nodes = {f"n{i}": rnd.random() < 0.2 for i in range(40)}
    edges = list(dict.fromkeys((rnd.choice(list(nodes)), rnd.choice(list(nodes))) for _ in range(70)))
    seeds = [f"n{i}" for i in rnd.sample(range(40), 12)]
    monkeypatch.setattr(adjacency, "PIECE", 3)
    monkeypatch.setattr(adjacency, "BUCKET", 9)
    monkeypatch.setattr(adjacency, "NAMED", 5 * (seed % 2))
    store = adjacency.Adjacency.write(
        spark.createDataFrame(list(nodes.items()), "id string, ghost boolean"), spark.createDataFrame([(a, b, "link", 1, i) for i, (a, b) in enumerate(edges)], "src string, dst string, kind string, count long, seq int")
    )
    df = store.expand(spark.createDataFrame([(s, 1.0, i) for i, s in enumerate(seeds)], "id string, score double, pos int"), 3, 9 + 10 * (seed % 2), 0.5, 4)
    assert store.buckets == 5 and store.rows.groupBy("id").count().agg(F.max("count")).first()[0] > 1
    for x in seeds[:3]:
        assert [r.other for r in store.neighbors(x).collect()] == [b for a, b in edges if a == x] + [a for a, b in edges if b == x]
    assert [(r.id, round(r.score, 9), r.depth) for r in df.orderBy("place").collect()] == queue_expand(nodes, edges, seeds, 3, 9 + 10 * (seed % 2), 0.5, 4)


def test_a_walk_reads_the_buckets_of_its_front(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adjacency, "BUCKET", 50)
    nodes = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("id"), F.lit(False).alias("ghost"))
    edges = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), (F.col("id") * 7 + 1) % 2000).alias("dst"), F.lit("link").alias("kind"), F.lit(1).alias("count"), F.col("id").cast("int").alias("seq"))
    store = adjacency.Adjacency.write(nodes, edges, str(tmp_path / "graph"))
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "graph").rglob("*.parquet"))
    before = size()
    seeds = spark.createDataFrame([("n5", 1.0, 0)], "id string, score double, pos int")
    assert {r.id for r in store.expand(seeds, max_depth=2).collect()} == {"n36", "n253"} | {f"n{i}" for i in range(2000) if (7 * i + 1) % 2000 == 5} | {f"n{i}" for i in range(2000) if (7 * ((7 * i + 1) % 2000) + 1) % 2000 == 5}
    assert size() == before and store.buckets == 41
    plan = store.of(seeds, "id", "links")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:60] and plan.count("Scan parquet") == 1
    assert len(store.of(seeds, "id").inputFiles()) <= 41
    again = adjacency.Adjacency(spark, str(tmp_path / "graph"), store.buckets)
    assert [r.other for r in again.neighbors("n5").collect()] == [r.other for r in store.neighbors("n5").collect()]


def test_context_of_one_list_and_of_many(spark):
    rows = [(q, i, t) for q in range(3) for i, t in enumerate([[5, 0, 3, 9], [20, 1, 1], [0, 0, 2, 2, 7]][q])]
    ranked = spark.createDataFrame(rows, "q int, rank int, token_estimate long")
    want = {0: [5, 0, 3], 1: [20], 2: [0, 0, 2, 2]}
    assert {q: [r.token_estimate for r in retrieval.context(ranked.where(F.col("q") == q), 8).orderBy("rank").collect()] for q in want} == want
    many = retrieval.context(ranked, 8, by=("q",)).orderBy("q", "rank").collect()
    assert [(r.q, r.token_estimate, r.key) for r in many] == [(q, t, f"S{i}") for q, ts in want.items() for i, t in enumerate(ts, 1)]


def test_footer_and_unknown_keys(spark):
    known = spark.createDataFrame([(1, "S2", "b c/é~*.md", 3, 4), (1, "S10", "a.md", 1, 2)], "id int, key string, path string, start_line int, end_line int")
    answers = spark.createDataFrame([(1, "[S2] [S9] [S10] [S2]")], "id int, answer string")
    assert [r.key for r in retrieval.unknown_citations(answers, known.select("id", "key"), T.citation_keys).collect()] == ["S9"]
    want = "\n".join(f"[{k}] {p}:L{a}-L{b} (obsidian://open?vault=my%20vault&file={quote(p)})" for k, p, a, b in (("S10", "a.md", 1, 2), ("S2", "b c/é~*.md", 3, 4)))
    assert retrieval.sources_footer(retrieval.validated_citations(answers, known, T.citation_keys), "my vault").first().footer == want


def test_expand_caps_and_decays(spark):
    edges = spark.createDataFrame([("hub", f"n{i}", "link", 1, i) for i in range(9)] + [("n0", "hub", "link", 1, 20)], "src string, dst string, kind string, count long, seq int")
    nodes = spark.createDataFrame([("hub", False)] + [(f"n{i}", False) for i in range(9)], "id string, ghost boolean")
    seeds = spark.createDataFrame([("hub", 1.0, 0)], "id string, score double, pos int")
    got = adjacency.Adjacency.write(nodes, edges).expand(seeds, max_depth=10, max_nodes=5).collect()
    assert [r.id for r in got] == ["n0", "n1", "n2", "n3", "n4"] and abs(got[0].score - 0.25) < 1e-9


def test_uuid_fusion_citations(spark):
    space = uuid.UUID(T.NAMESPACE)
    df = spark.createDataFrame([("é/x:1",), ("b",)], "n string")
    assert [r[0] for r in df.select(T.uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(space, n)) for n in ("é/x:1", "b")]
    lists = spark.createDataFrame([(0, "z", 3.0), (0, "a", 2.0), (1, "a", 1.0)], "list_no int, chunk_id string, score double")
    assert [r.chunk_id for r in retrieval.rank_fusion(lists).collect()] == ["a", "z"]
    answers = spark.createDataFrame([(1, "[S1] [S3] [S1] [S99]")], "id int, answer string")
    known = spark.createDataFrame([(1, "S1"), (1, "S3")], "id int, key string")
    assert [r.key for r in retrieval.validated_citations(answers, known, T.citation_keys).orderBy("pos").collect()] == ["S1", "S3"]


@pytest.mark.parametrize("name", ["queries", "markdown"])
def test_graphs_read_texts_once(spark, name):
    """Nodes and edges come from written links and from names; no text is read for them again."""
    from quillspark.plans import markdown, queries

    for df in {"queries": queries, "markdown": markdown}[name]._graph(spark, "/root/testdata/sf0.001"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "text" not in plan and "body" not in plan


def test_links_are_read_in_one_pass(spark):
    notes = spark.createDataFrame([("a", "[[x]] `[[no]]` [m](y.md) ![[p.png]] ![[q]]\r\n```\n[[no]]\n```\x85plain [[z|w]]"), ("b", None), ("c", "")], "note_id string, body string")
    found = links.extract_links(notes)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.note_id, r.line, r["class"], r.pos, r.kind, r.target_raw, r.alias) for r in found.collect())
    assert got == [("a", 0, 0, 0, "link", "x", None), ("a", 0, 0, 2, "embed", "q", None), ("a", 0, 1, 0, "link", "y.md", None), ("a", 2, 0, 0, "link", "z", "w")]


def test_statistics_make_chunks_once(spark):
    from quillspark.plans import markdown

    out = markdown.corpus_stats(spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    from quillspark.operators import stats

    none = spark.createDataFrame([], "token_estimate long")
    notes, nodes, edges = spark.createDataFrame([], "tags array<string>, folder string"), spark.createDataFrame([], "id string, ghost boolean"), spark.createDataFrame([], "src string, dst string")
    assert sorted(map(tuple, stats.corpus(notes, none, nodes, edges).collect())) == [("count", "chunks", 0.0), ("count", "notes", 0.0)]
