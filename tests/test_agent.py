import json

import pytest

from quillspark import streaming
from quillspark.cli import main
from quillspark.operators.adjacency import Adjacency
from quillspark.operators.index import NoteIndex
from quillspark.plans.agent import SYSTEM, Session, Tools, arguments, filters
from quillspark.plans.engine import Engine, ModelUnreachable, Settings, http_model, reply_events
from quillspark.sources.vault import load_notes, walk_report


def _vault(tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "fox.md").write_text("# Fox\nthe red fox runs, see [[whale]]")
    (vault / "whale.md").write_text("# Whale\nthe blue whale swims")
    return vault


def test_tool_loop_and_sources(spark, tmp_path):
    notes = load_notes(spark, str(_vault(tmp_path)))
    index = NoteIndex(spark, str(tmp_path / "index"))
    index.refresh(notes)
    tools = Tools(notes, index.read("chunks"), index.postings(), Adjacency.write(*Engine(spark, Settings()).graph(notes)))
    call = lambda name, **a: {"kind": "tool_call", "name": name, "arguments": json.dumps(a)}
    script = [
        [call("search_vault", query="red fox", filters={"tags": [], "folder": ""}), call("nothing")],
        [call("expand_graph", query="whale", note_ids=["fox", "fox"], depth="1"), call("read_note", note_id="gone"), call("expand_graph", query="x", note_ids="fox", depth=1)],
        [{"kind": "text", "text": "It runs [S1], "}, {"kind": "text", "text": "it swims [S2] [S1] [S9]."}],
    ]
    asked, said, seen = [], [], []

    def model(messages, specs):
        asked.append(len(specs))
        said[:] = [m["content"] for m in messages if m["role"] == "tool"]
        assert messages[0] == {"role": "system", "content": SYSTEM}
        return script[len(asked) - 1]

    chat = Session(model, tools)
    assert chat.ask("what runs?", seen.append) == "It runs [S1], it swims [S2] [S1] [S9]." == "".join(seen)
    assert said[0].startswith("[S1] fox > Fox\n# Fox") and said[1] == "Error: unknown tool 'nothing'"
    assert "whale > Whale" in said[2] and said[3] == "Error: 'read_note' failed: no note gone" and said[4] == "Error: 'expand_graph' failed: note_ids: not of type array"
    assert [m["role"] for m in chat.messages] == ["user", "assistant"]
    assert chat.footer("v").split("\n")[0] == "[S1] fox.md:L1-L2 (obsidian://open?vault=v&file=fox.md)"
    assert [(s["key"], s["path"]) for s in chat.last_sources] == [("S1", "fox.md"), ("S2", "whale.md")]
    assert asked == [3, 3, 3]
    chat.clear()
    assert chat.messages == [] and chat.last_sources == []


def test_rounds_are_bounded(spark, tmp_path):
    notes = load_notes(spark, str(_vault(tmp_path)))
    tools = Tools(notes, None, None)
    seen, said = [], []

    def model(messages, specs):
        seen.append(bool(specs))
        said[:] = [m["content"] for m in messages if m["role"] == "tool"]
        return [{"kind": "tool_call", "name": "read_note", "arguments": {"note_id": "fox"}}] if specs else [{"kind": "text", "text": "done"}]

    chat = Session(model, tools, rounds=2)
    assert chat.ask("?") == "done" and seen == [True, True, False]
    assert said == ["# fox\n\n# Fox\nthe red fox runs, see [[whale]]"] * 2


def test_command_line(spark, tmp_path, capsys):
    vault = str(_vault(tmp_path))
    assert main(["index", vault, "--data", str(tmp_path / "index")], spark) == 0
    assert main(["stats", vault], spark) == 0
    assert main(["graph-info", vault], spark) == 0
    assert main(["graph-info", vault, "--note", "whale"], spark) == 0
    assert main(["graph-info", vault, "--note", "gone"], spark) == 1
    assert main(["graph-info", vault + "/none"], spark) == 1
    assert "{'added': 2}" in capsys.readouterr().out
    reply = [[{"kind": "tool_call", "name": "search_vault", "arguments": {"query": "red fox"}}], [{"kind": "text", "text": "a fox [S1]"}]]
    assert main(["chat", vault, "--data", str(tmp_path / "index")], spark, lambda *_: reply.pop(0), ["what?", "", "/sources", "/clear", "/sources", "/exit", "never"]) == 0
    out = capsys.readouterr().out
    assert "a fox [S1]\n[S1] fox.md:L1-L2 (" in out and out.strip().endswith("no sources")


def test_arguments_and_filters():
    assert arguments("search_vault", '{"query": "q", "filters": " ", "more": 1}') == {"query": "q"} == arguments("search_vault", {"query": "q", "filters": {}})
    for bad in ({}, {"query": 1}, {"query": "q", "filters": {"tags": "t"}}, [1]):
        with pytest.raises(ValueError):
            arguments("search_vault", bad)
    got = filters(arguments("search_vault", {"query": "q", "filters": {"folder": "", "tags": [], "created_after": "2024-01-02", "created_before": "2024-02-03T04:05:06"}})["filters"])
    assert got["folder"] == "" and got["tags"] is None and (str(got["after"]), str(got["before"])) == ("2024-01-02 00:00:00", "2024-02-03 04:05:06")


def test_settings_and_model(monkeypatch):
    monkeypatch.setenv("QUILLSPARK_FINAL_K", "3")
    monkeypatch.setenv("QUILLSPARK_EXCLUDE_GLOBS", '["x/*"]')
    assert (Settings.read(rrf_k=7).final_k, Settings.read(rrf_k=7).rrf_k, Settings.read().exclude_globs, Settings.read(final_k=5).final_k) == (3, 7, ("x/*",), 5)
    with pytest.raises(ModelUnreachable):
        list(http_model("http://127.0.0.1:9", "m", 5)([], []))
    line = {"message": {"content": "a", "tool_calls": [{"function": {"name": "f"}}]}, "done": True, "eval_count": 2}
    assert [e["kind"] for e in reply_events(line, 4)] == ["text", "tool_call", "stop"] and list(reply_events({}, 0)) == []


def test_index_follows_its_folder(spark, tmp_path):
    vault = _vault(tmp_path)
    engine = Engine(spark, Settings(vault_path=str(vault), data_dir=str(tmp_path / "index")))
    for text in (None, "# Fox\nnow a grey fox"):
        if text:
            (vault / "fox2.md").write_text(text)
        streaming.follow(engine, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert engine.index().version() == 2 and {r.note_id for r in engine.index().read("chunks").collect()} == {"fox", "fox2", "whale"}
    assert all(len(r.dense) == 64 for r in engine.index().read("chunks").collect())


def test_vault_problems_are_reported(spark, tmp_path):
    (tmp_path / "v" / "_x" / ".hidden").mkdir(parents=True)
    for name, data in {"a.md": b"\xff bad", "_x/b.md": b"fine", "_x/c.md.icloud": b"", "_x/.hidden/d.md": b"no", "e.txt": b"no", "_x/.f.md": b"no"}.items():
        (tmp_path / "v" / name).write_bytes(data)
    assert sorted((r.path, r.problem) for r in walk_report(spark, str(tmp_path / "v")).collect()) == [("_x/c.md.icloud", "placeholder"), ("a.md", "replaced bytes")]
    assert sorted(r.note_id for r in load_notes(spark, str(tmp_path / "v")).collect()) == ["_x/b", "a"]
