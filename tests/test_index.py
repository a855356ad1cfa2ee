import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from quillspark.operators import index as I
from quillspark.operators import retrieval
from quillspark.operators.chunks import numbered, pieces
from quillspark.operators.index import NoteIndex
from quillspark.plans.agent import Tools
from quillspark.sources.commits import Conflict, Log


def notes_of(spark, rows):
    return spark.createDataFrame([(i, i + ".md", i, t, f"h{t}") for i, t in rows.items()], "note_id string, path string, title string, body string, content_hash string")


def state(index):
    """Of a version: texts by note, hashes, and the notes of each term."""
    chunks = index.read("chunks").collect()
    of = {c.chunk_id: c.note_id for c in chunks}
    terms = {}
    for r in index.read("terms").collect():
        terms.setdefault(r.term, set()).add(of[r.chunk_id])
    return {c.note_id: c.text for c in chunks}, {r.note_id: r.content_hash for r in index.read("manifest").collect()}, terms


def written(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_random_edits_equal_a_new_index(spark, tmp_path):
    rnd = random.Random(2)
    index, rows, most = NoteIndex(spark, str(tmp_path / "index"), fan=3), {}, 0
    for step in range(9):
        for _ in range(rnd.choice([1, 2, 12])):
            rows[f"n{rnd.randrange(20)}"] = f"text {rnd.randrange(50)} of step{step}"
        for gone in rnd.sample(sorted(rows), min(len(rows) - 1, rnd.choice([0, 1, 3]))):
            del rows[gone]
        index.refresh(notes_of(spark, rows))
        most = max(most, len(index.segments()))
        if step % 3 == 2:
            texts, hashes, terms = state(index)
            assert texts == rows and hashes == {i: f"h{t}" for i, t in rows.items()}
            assert terms == {w: {i for i, t in rows.items() if w in t.split() or w == i} for w in {w for i, t in rows.items() for w in [*t.split(), i]}}
            found = I.search(index.read("chunks"), index.postings(), "step7 text 5", candidate_k=100, rerank_n=100, final_k=100).collect()
            assert {r.note_id for r in found} == set(rows)
    assert 1 < most <= 6
    assert index.refresh(notes_of(spark, rows)) == {"unchanged": len(rows)}
    before = index.version()
    assert index.refresh(notes_of(spark, rows)) == {"unchanged": len(rows)} and index.version() == before


def test_writes_follow_the_changes(spark, tmp_path):
    rnd = random.Random(1)
    rows = {f"n{i}": " ".join(f"w{rnd.randrange(5000)}" for _ in range(60)) for i in range(1500)}
    index = NoteIndex(spark, str(tmp_path / "index"))
    index.refresh(notes_of(spark, rows))
    first = written(tmp_path)
    for i in range(0, 1500, 150):
        rows[f"n{i}"] += " more"
    del rows["n7"]
    assert index.refresh(notes_of(spark, rows)) == {"modified": 10, "deleted": 1, "unchanged": 1489}
    assert 0 < written(tmp_path) - first < first / 8
    assert [s["notes"] for s in index.segments()] == [1500, 11] and index.read("chunks").count() == 1499
    assert {(r.note_id, r.change) for r in index.changes().collect()} == {(f"n{i}", "modified") for i in range(0, 1500, 150)} | {("n7", "deleted")}


def test_all_may_go(spark, tmp_path):
    index = NoteIndex(spark, str(tmp_path / "index"))
    index.refresh(notes_of(spark, {"a": "x", "b": "y"}))
    index.refresh(notes_of(spark, {}))
    assert all(index.read(t).count() == 0 for t in ("chunks", "terms", "manifest")) and index.read("chunks", 1).count() == 2
    index.refresh(notes_of(spark, {"a": "again"}))
    assert [r.text for r in index.read("chunks").collect()] == ["again"]


def test_full_refresh_may_leave_deleted_notes(spark, tmp_path):
    index = NoteIndex(spark, str(tmp_path / "index"))
    index.refresh(notes_of(spark, {"a": "x", "b": "y"}))
    assert index.refresh(notes_of(spark, {"a": "x"}), full=True, purge_stale=False) == {"deleted": 1, "unchanged": 1}
    assert {r.note_id for r in index.read("chunks").collect()} == {"a", "b"} and {r.note_id for r in index.read("manifest").collect()} == {"a"}
    assert index.refresh(notes_of(spark, {"a": "x"}), full=True) == {"unchanged": 1}


def test_one_of_two_writers_wins(spark, tmp_path):
    log, won, lost = Log(spark, f"file://{tmp_path}/log"), [], []

    def attempt(i):
        try:
            log.commit(1, {"n": i})
            won.append(i)
        except Conflict:
            lost.append(i)

    threads = [threading.Thread(target=attempt, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 7 and log.read(1)["n"] == won[0] and log.versions() == [1]
    # A refresh that began before another one's commit changes nothing.
    index = NoteIndex(spark, str(tmp_path / "index"))
    index.refresh(notes_of(spark, {"a": "x"}))
    late = NoteIndex(spark, str(tmp_path / "index"))
    real = late.log.commit
    late.log.commit = lambda *a: (index.refresh(notes_of(spark, {"a": "y"})), real(*a))
    with pytest.raises(Conflict):
        late.refresh(notes_of(spark, {"a": "z"}))
    assert state(index)[0] == {"a": "y"} and index.version() == 2


def test_a_run_that_is_cut_off_changes_nothing(spark, tmp_path):
    root = tmp_path / "index"
    index = NoteIndex(spark, str(root))
    index.refresh(notes_of(spark, {"a": "x", "b": "y"}))
    want = state(index)
    for point in ("_keep", "_write", "_check_dimension"):
        broken = NoteIndex(spark, str(root))
        calls, whole = [], getattr(broken, point)

        def cut(*a, whole=whole, calls=calls, **b):
            calls.append(whole(*a, **b))
            raise OSError("gone")

        setattr(broken, point, cut)
        with pytest.raises(OSError, match="gone"):
            broken.refresh(notes_of(spark, {"a": "changed"}))
        assert calls and state(index) == want and index.version() == 1
    # A commit that was cut off within its file counts for nothing, and is taken away in time.
    (root / "log" / "000000000002.json").write_text('{"segments": [')
    assert index.version() == 1 and state(index) == want
    with pytest.raises(Conflict):
        index.refresh(notes_of(spark, {"a": "changed"}))
    index.log.patience = -1
    index.refresh(notes_of(spark, {"a": "changed"}))
    assert state(index)[0] == {"a": "changed"} and index.version() == 2
    n = len(os.listdir(root / "segments"))
    index.vacuum(1)
    assert len(os.listdir(root / "segments")) == n
    index.vacuum(1, older=0)
    assert set(os.listdir(root / "segments")) == {s["id"] for s in index.segments()} and state(index)[0] == {"a": "changed"} and index.versions() == [2]


def test_vectors_have_one_length(spark, tmp_path):
    wrong = NoteIndex(spark, str(tmp_path / "wrong"), lambda df: df.selectExpr("*", "array_repeat(1F, length(note_id)) as dense"))
    with pytest.raises(ValueError, match="lengths"):
        wrong.refresh(notes_of(spark, {"a": "x", "bb": "y"}))
    wrong.refresh(notes_of(spark, {"a": "x"}))
    with pytest.raises(ValueError, match="lengths"):
        wrong.refresh(notes_of(spark, {"a": "x", "bb": "y"}))
    assert wrong.version() == 1


def test_names_of_chunks():
    parts = numbered(pieces("# a/b\none\n# a\n## b\ntwo\n# a/b\nthree", least=0), False)
    assert [(p, "/".join(x.path), n) for p, x, n in parts] == [(i, "a/b" if i != 1 or len(parts) == 3 else "a", n) for i, (_, _, n) in enumerate(parts)] or len(parts) == 4
    once = numbered([x for _, x, _ in parts], True)
    names = [("/".join(x.path), n) for _, x, n in once]
    assert len(names) == len(set(names)) and len(names) < len(parts)
    assert once[[n for n, x in enumerate(names) if x == ("a/b", 0)][0]][1].path == ("a", "b")


def test_settings_reach_the_search(spark, tmp_path):
    index = NoteIndex(spark, str(tmp_path / "index"))
    rows = {f"n{i:02d}": "red fox " * (1 + i % 3) + f"w{i} " * i for i in range(12)}
    index.refresh(notes_of(spark, rows))
    asked = lambda **given: [(r.note_id, r.score) for r in Tools(notes_of(spark, rows), index.read("chunks"), index.postings(), **given).search_vault("red fox w7").orderBy("rank").collect()]
    usual = asked()
    assert len(usual) == 8 and len(asked(final_k=3)) == 3 and len(asked(rerank_n=2)) == 2 and len(asked(candidate_k=4)) == 4
    backwards = asked(scorer=lambda query, text: -F.char_length(text).cast("double"))
    assert backwards != usual and backwards[0][1] < 0
    two = spark.createDataFrame([(0, "a", 9.0), (1, "b", 9.0), (1, "a", 5.0)], "list_no int, chunk_id string, score double")
    assert retrieval.rank_fusion(two, k=60).first().score != retrieval.rank_fusion(two, k=1).first().score
    terms = spark.createDataFrame([("red", 1.0)], "term string, weight double")
    assert I.hybrid_search(index.read("chunks"), index.postings(), terms, None, k=5).first().score == pytest.approx(1 / 6)
