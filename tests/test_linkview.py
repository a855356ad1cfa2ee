import random

import pytest

from quillspark.operators import graph, linkview, links
from quillspark.operators.linkview import LinkView
from quillspark.sources.commits import Conflict

SCHEMA = "note_id string, body string, aliases array<string>, content_hash string"


def notes_of(spark, rows):
    return spark.createDataFrame([(i, body, aliases, f"{body}|{aliases}") for i, (body, aliases) in rows.items()], SCHEMA)


def of(df):
    return sorted((tuple(r[c] for c in ("note_id", "line", "class", "pos", "kind", "target_raw", "heading", "alias", "target_note_id", "resolved")) for r in df.collect()), key=str)


def whole(spark, rows):
    notes = notes_of(spark, rows)
    return links.resolve_links(links.extract_links(notes), notes)


def test_random_edits_equal_a_full_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linkview, "MOST", 4)
    rnd, rows, view = random.Random(3), {}, LinkView(spark, str(tmp_path / "links"))
    ids = [f"{d}{n}" for d in ("", "x/", "long/er/") for n in ("a", "B", "c d", "e")]
    targets = [*ids, "b", "A", "C D", "E", "aka1", "AKA2", "nobody"]

    def note():
        body = "\n".join(rnd.choice([f"see [[{rnd.choice(targets)}#h|text]]", f"![[{rnd.choice(targets)}]] [[{rnd.choice(targets)}]]", "plain", f"[x]({rnd.choice(targets).replace(' ', '')}.md)"]) for _ in range(rnd.randint(0, 4)))
        return body, rnd.choice([[], [], ["aka1"], ["Aka2", "aka1"]])

    for step in range(7):
        for i in rnd.sample(ids, 5 if step == 0 else rnd.choice([1, 2, 3])):
            rows[i] = note()
        if step and rnd.random() < 0.7:
            old = rnd.choice(sorted(rows))
            body = rows.pop(old)
            if rnd.random() < 0.6:
                rows[rnd.choice(ids)] = body
        view.refresh(notes_of(spark, rows))
        assert of(view.resolved()) == of(whole(spark, rows)), step
    assert len(view.segments()) < 7
    nodes, edges = graph.build(notes_of(spark, rows), view.resolved())
    want = graph.build(notes_of(spark, rows), whole(spark, rows))
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, want[0].collect())) and sorted(map(str, edges.collect())) == sorted(map(str, want[1].collect()))


def test_only_links_that_name_a_changed_note_are_resolved_again(spark, tmp_path):
    rows = {f"n{i}": (f"[[n{(i * 7) % 200}]] [[soon]]" if i % 10 == 0 else f"[[n{(i * 7) % 200}]]", []) for i in range(200)}
    view, counted = LinkView(spark, str(tmp_path / "links")), {}
    assert view.refresh(notes_of(spark, rows), counted) == 1 and counted == {"notes": 200, "links": 220}
    assert view.refresh(notes_of(spark, rows)) == 1
    rows["n3"] = ("[[n4]] and [[n5]]", [])
    view.refresh(notes_of(spark, rows), counted := {})
    assert counted == {"notes": 1, "links": 2}
    rows["deep/soon"] = ("", ["n4"])
    view.refresh(notes_of(spark, rows), counted := {})
    # The twenty links to it; links to n4 that its alias could mean are looked at again, and stay.
    near = sum(t == "n4" for b, _ in rows.values() for t in __import__("re").findall(r"\[\[(.*?)\]\]", b))
    assert counted == {"notes": 1, "links": 20 + near}
    assert {r.target_note_id for r in view.resolved().where("target_raw = 'soon'").collect()} == {"deep/soon"}
    assert {r.target_note_id for r in view.resolved().where("target_raw = 'n4'").collect()} == {"n4"}
    del rows["n4"]
    view.refresh(notes_of(spark, rows), counted := {})
    assert counted["notes"] == 0 and {r.target_note_id for r in view.resolved().where("target_raw = 'n4'").collect()} == {"deep/soon"}
    assert of(view.resolved()) == of(whole(spark, rows))


def test_odd_notes_and_writers(spark, tmp_path):
    view = LinkView(spark, str(tmp_path / "links"))
    assert view.resolved() is None and view.refresh(notes_of(spark, {})) == 1 and view.resolved().count() == 0
    view.refresh(spark.createDataFrame([("a", None, None, None), ("b", "[[A]]", None, "h")], SCHEMA))
    assert [(r.target_raw, r.target_note_id) for r in view.resolved().collect()] == [("A", "a")]
    late = LinkView(spark, str(tmp_path / "links"))
    real = late.log.commit
    late.log.commit = lambda *a: (view.refresh(notes_of(spark, {"b": ("[[c]]", [])})), real(*a))
    with pytest.raises(Conflict):
        late.refresh(notes_of(spark, {"b": ("[[d]]", [])}))
    assert [(r.target_raw, r.resolved) for r in view.resolved().collect()] == [("c", False)]
