"""A bounded tool loop over the index: the driver asks a model, each tool call is a Spark job."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import citation_keys
from quillspark.operators import index as I
from quillspark.operators import retrieval
from quillspark.operators.adjacency import Adjacency
from quillspark.operators.postings import Postings

#: What a model is: (messages, tools or none) to events, dicts of kind text, tool_call or stop.
Model = Callable[[list[dict], list[dict]], Iterable[dict]]
SYSTEM = (
    "You answer questions about a collection of notes. Look notes up with search_vault before you say what is in them, and leave filters out "
    "unless you need one. expand_graph finds notes linked with those you know; read_note gives a note in full. Mark what you take from a "
    "passage with its key, such as [S1], and use no key that you weren't given. When a tool fails, call it again with better arguments."
)
_TEXT, _WHOLE = {"type": "string"}, {"type": "integer"}
_FILTERS = {"type": "object", "properties": {"tags": {"type": "array", "items": _TEXT}, "folder": _TEXT, "created_after": _TEXT, "created_before": _TEXT}}
#: The tools' names and arguments.
TOOLS = {
    "search_vault": ("Find the passages of the notes that answer a query best; filters are optional.", {"query": _TEXT, "filters": _FILTERS}, ["query"]),
    "expand_graph": ("Follow links from notes that were found to related ones; the query says what is still asked.", {"query": _TEXT, "note_ids": {"type": "array", "items": _TEXT}, "depth": _WHOLE}, ["query", "note_ids", "depth"]),
    "read_note": ("Give one note in full by its note_id.", {"note_id": _TEXT}, ["note_id"]),
}


def checked(value, schema: dict, name: str):
    """``value`` if it is what ``schema`` says, with whole numbers in text read; else an error that says where it isn't."""
    kind = schema["type"]
    if kind == "string" and isinstance(value, str):
        return value
    if kind == "integer" and not isinstance(value, bool):
        if isinstance(value, int) or (isinstance(value, float) and value.is_integer()) or (isinstance(value, str) and value.strip().lstrip("+-").isdigit()):
            return int(value)
    if kind == "array" and isinstance(value, (list, tuple)):
        return [checked(x, schema["items"], f"{name}.{i}") for i, x in enumerate(value)]
    if kind == "object" and isinstance(value, dict):
        return {k: checked(v, schema["properties"][k], f"{name}.{k}") for k, v in value.items() if k in schema["properties"] and v is not None}
    raise ValueError(f"{name}: not of type {kind}")


def arguments(tool: str, given) -> dict:
    """A call's arguments by its tool's schema.  Filters that are blank, empty or null are none; names that the tool doesn't know are left out."""
    given = json.loads(given) if isinstance(given, str) else given
    if not isinstance(given, dict):
        raise ValueError("arguments: not of type object")
    _, properties, required = TOOLS[tool]
    if "filters" in given and (given["filters"] in (None, {}) or (isinstance(given["filters"], str) and not given["filters"].strip())):
        given = {k: v for k, v in given.items() if k != "filters"}
    if missing := [k for k in required if k not in given]:
        raise ValueError(f"{', '.join(missing)}: missing")
    return {k: checked(v, properties[k], k) for k, v in given.items() if k in properties}


def filters(given: dict) -> dict:
    """Filters as retrieval.filtered() takes them: an empty folder is the root, no tags don't filter, dates are ISO."""
    when = lambda k: dt.datetime.fromisoformat(given[k]).replace(tzinfo=None) if k in given else None
    return {"tags": given.get("tags") or None, "folder": given.get("folder"), "after": when("created_after"), "before": when("created_before")}


@dataclass
class Tools:
    """The tools over one version of the index: name, what it takes, and its function."""

    notes: DataFrame
    chunks: DataFrame
    terms: DataFrame | Postings
    links: Adjacency | None = None
    vector: Callable[[str], list[float]] | None = None
    max_nodes: int = 20
    decay: float = 0.5
    hub: int = 50
    candidate_k: int = 50
    rrf_k: int = 60
    rerank_n: int = 30
    final_k: int = 8
    scorer: I.Scorer = retrieval.overlap_score

    def specs(self) -> list[dict]:
        return [{"type": "function", "function": {"name": n, "description": d, "parameters": {"type": "object", "properties": p, "required": r}}} for n, (d, p, r) in TOOLS.items()]

    def run(self, name: str, given) -> DataFrame | str:
        return getattr(self, name)(**arguments(name, given))

    def search_vault(self, query: str, filters: dict | None = None) -> DataFrame:
        near = self.vector(query) if self.vector else None
        return I.search(self.chunks, self.terms, query, near, self.rerank_n, self.final_k, self.candidate_k, self.rrf_k, self.scorer, **_filters(filters or {}))

    def expand_graph(self, query: str, note_ids: list[str], depth: int) -> DataFrame:
        """The chunks of the notes around these, by the reranker; candidates stand in order of chunk_id."""
        ids = list(dict.fromkeys(note_ids))
        seeds = self.notes.sparkSession.createDataFrame([(x, 1.0, i) for i, x in enumerate(ids)], "id string, score double, pos int")
        around = self.links.expand(seeds, depth, self.max_nodes, self.decay, self.hub).select(F.col("id").alias("note_id"))
        return I.with_scores(retrieval.by_notes(self.chunks, around).withColumn("rank", F.col("chunk_id")), query, self.rerank_n, self.final_k, self.scorer)

    def read_note(self, note_id: str) -> str:
        row = self.notes.where(F.col("note_id") == note_id).select("note_id", "body").first()
        if row is None:
            raise LookupError(f"no note {note_id}")
        return f"# {row.note_id}\n\n{row.body}"


_filters = filters


@dataclass
class Session:
    """A chat: the messages so far, and the sources of the last answer."""

    model: Model
    tools: Tools
    rounds: int = 4
    budget: int = 2000
    system: str = SYSTEM
    messages: list[dict] = field(default_factory=list)
    last_sources: list[dict] = field(default_factory=list)

    def clear(self) -> None:
        self.messages, self.last_sources = [], []

    def ask(self, question: str, on_text: Callable[[str], None] | None = None) -> str:
        """Answer with at most ``rounds`` rounds of tools, then one reply without tools; keeps the sources it cites.

        The system message stands before all others.  ``on_text`` is given each piece of text as it comes, in every round.  What is
        kept of a turn is its question and answer.
        """
        self.messages.append({"role": "user", "content": question})
        turn = ([{"role": "system", "content": self.system}] if self.system else []) + self.messages
        known: dict[str, dict] = {}
        for left in range(self.rounds, -1, -1):
            parts, calls = [], []
            for e in self.model(turn, self.tools.specs() if left else []):
                if e["kind"] == "text":
                    parts.append(e["text"])
                    if on_text:
                        on_text(e["text"])
                elif e["kind"] == "tool_call" and left:
                    calls.append(e)
            if not calls:
                break
            turn.append({"role": "assistant", "content": "".join(parts), "tool_calls": [{"function": {"name": c["name"], "arguments": c["arguments"]}} for c in calls]})
            for c in calls:
                turn.append({"role": "tool", "content": self._run(c, known), "tool_call_id": c.get("call_id")})
        text = "".join(parts)
        self.messages.append({"role": "assistant", "content": text})
        self.last_sources = self._cited(text, known)
        return text

    def _run(self, call: dict, known: dict[str, dict]) -> str:
        """A tool's text; an unknown tool or a failing one gives the error as text."""
        if call["name"] not in TOOLS:
            return f"Error: unknown tool '{call['name']}'"
        try:
            out = self.tools.run(call["name"], call["arguments"])
            if isinstance(out, str):
                return out
            rows = retrieval.context(out, self.budget, start=len(known) + 1).orderBy("rank").collect()
        except Exception as e:  # noqa: BLE001 - the model is told, whatever it was
            return f"Error: '{call['name']}' failed: {e}"
        parts = []
        for r in rows:
            known[r.key] = {"key": r.key, "chunk_id": r.chunk_id, "path": r.path, "start_line": r.start_line, "end_line": r.end_line}
            parts.append(f"[{r.key}] {' > '.join([r.note_id, *r.header_path])}\n{r.text}")
        return "\n\n".join(parts)

    def _cited(self, text: str, known: dict[str, dict]) -> list[dict]:
        if not known:
            return []
        spark = self.tools.notes.sparkSession
        keys = spark.createDataFrame([(text,)], "a string").select(citation_keys(F.col("a"))).first()[0]
        return [known[k] for k in dict.fromkeys(keys) if k in known]

    def footer(self, vault: str) -> str:
        """The sources of the last answer as text; '' for none."""
        if not self.last_sources:
            return ""
        spark = self.tools.notes.sparkSession
        rows = spark.createDataFrame([(0, s["key"], s["path"], s["start_line"], s["end_line"]) for s in self.last_sources], "id int, key string, path string, start_line int, end_line int")
        return retrieval.sources_footer(rows, vault).first().footer
