import json
import uuid

from quillspark.functions import frontmatter as fm
from quillspark.functions.text import NAMESPACE
from quillspark.operators import chunks as C
from quillspark.operators.index import NoteIndex, search
from quillspark.sources.events import events, reply_text
from quillspark.sources.vault import load_notes


def test_sections_follow_headings_outside_fences():
    got = [(s.path, s.first, s.last) for s in C.sections("pre\n# A\n### B\nx\n### C ##\n```\n# no\n~~~\n```\n### D\n#tag")]
    assert got == [((), 1, 1), (("A",), 2, 2), (("A", "B"), 3, 4), (("A", "B", "C"), 5, 9), (("A", "B", "D"), 10, 11)]
    assert C.sections("") == [] and [s.path for s in C.sections("no heading")] == [()]


def test_small_sections_go_to_their_next_sibling():
    parts = C.sections("# A\n## a\nx\n### deep\ny\n## b\nz\n# B\nlast")
    got = [(s.path, s.first, s.text) for s in C.merged(parts, 4)]
    assert got == [(("A", "a", "deep"), 4, "### deep\ny"), (("A", "b"), 2, "## a\nx\n\n## b\nz"), (("B",), 1, "# A\n\n# B\nlast")]


def test_large_sections_are_split_with_overlap():
    got = C.pieces("# H\n\n" + "word " * 1000, 100, 0, 10)
    assert len(got) > 1 and all(len(p.text.split()) <= 110 for p in got) and got[1].text.startswith("# H\n\nword ") and got[2].text.startswith("word " * 9 + "word\n\n")
    assert [p.text for p in C.pieces("a b c. d e! f g h i j k l", 5, 0, 0)] == ["a b c. d e!", "f g h i j", "k l"]
    code = "```\n" + "\n".join(f"l{i}" for i in range(6)) + "\n```\nafter"
    assert [p.text for p in C.pieces(code, 8, 0, 0)] == [code.rsplit("\n", 1)[0], "after"]


def test_headers():
    assert fm.split_header("---\ntags: [a, 1]\n---\n\n body \n") == ({"tags": ["a", 1]}, "body")
    assert fm.split_header("---\na: [\n---\nx") == ({}, "---\na: [\n---\nx")
    assert fm.split_header(" text ") == ({}, "text") and fm.split_header("---\nopen") == ({}, "---\nopen")
    assert fm.header_tags("#a, #b,,a") == ["a", "#b"] and fm.header_tags(["#x", 1]) == ["x", "1"] and fm.header_tags(3) == []
    assert fm.header_aliases("a, b") == ["a, b"] and fm.header_aliases([" a", "a"]) == ["a"]
    assert [str(fm.header_date(v)) for v in ("2024-01-02", "no", None, [1])] == ["2024-01-02 00:00:00", "None", "None", "None"]


def test_notes_of_a_folder_to_chunks_and_search(spark, tmp_path):
    vault = tmp_path / "vault"
    (vault / "x").mkdir(parents=True)
    (vault / "a.md").write_text("---\ntags: t1, t2\naliases: [Al]\ncreated: 2024-05-06\n---\n# One\nred fox runs #in\n")
    (vault / "x" / "b.md").write_text("blue whale")
    (vault / "x" / "empty.md").write_text("")
    notes = load_notes(spark, str(vault))
    got = {r.note_id: r for r in notes.collect()}
    assert got["a"].tags == ["t1", "t2", "in"] and got["a"].aliases == ["Al"] and str(got["a"].created) == "2024-05-06 00:00:00" and got["x/empty"].tags == []
    index = NoteIndex(spark, str(tmp_path / "index"))
    assert index.version() == 0 and index.refresh(notes) == {"added": 3}
    chunks = {r.note_id: r for r in index.read("chunks").collect()}
    assert set(chunks) == {"a", "x/b"} and chunks["a"].chunk_id == str(uuid.uuid5(uuid.UUID(NAMESPACE), "a::One::0"))
    assert chunks["a"].embedding_text == "a > One\n# One\nred fox runs #in" and chunks["x/b"].folder == "x"
    (vault / "a.md").unlink()
    (vault / "x" / "b.md").write_text("green whale")
    assert index.refresh(load_notes(spark, str(vault))) == {"deleted": 1, "modified": 1, "unchanged": 1}
    assert [r.text for r in index.read("chunks").collect()] == ["green whale"]
    found = search(index.read("chunks"), index.read("terms"), "green things").collect()
    assert [(r.note_id, r["rank"], r.score) for r in found] == [("x/b", 1, 0.5)]
    assert index.refresh(load_notes(spark, str(vault)), full=True) == {"unchanged": 2} and index.version() == 3


def test_events(spark):
    lines = [
        json.dumps({"message": {"content": "he"}}),
        json.dumps({"message": {"content": "y", "tool_calls": [{"id": "c1", "function": {"name": "f", "arguments": {"q": "x"}}}, {"function": {"name": "g"}}]}, "done": True, "eval_count": 3}),
        "not json", None, "{}",
    ]
    got = events(spark.createDataFrame(list(enumerate(lines)), "seq int, line string"))
    rows = got.orderBy("seq", "pos").collect()
    assert [(r.seq, r.kind) for r in rows] == [(0, "text"), (1, "text"), (1, "tool_call"), (1, "tool_call"), (1, "stop")]
    assert rows[2].call_id == "c1" and json.loads(rows[2].arguments) == {"q": "x"} and rows[3].call_id.startswith("call_") and rows[3].arguments == "{}"
    assert (rows[4].reason, rows[4].prompt_tokens, rows[4].completion_tokens) == ("stop", 0, 3)
    assert reply_text(got).first().text == "hey"
