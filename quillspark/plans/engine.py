"""The engine put together: settings, and the parts that a user may replace."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import graph, links, retrieval
from quillspark.operators.adjacency import Adjacency
from quillspark.operators.index import NoteIndex, Scorer
from quillspark.operators.linkview import LinkView
from quillspark.plans.agent import Model, Session, Tools
from quillspark.sources.vault import load_notes

PREFIX = "QUILLSPARK_"


@dataclass(frozen=True)
class Settings:
    """Fixed values are the defaults.  A value given goes before an environment variable, which is the name in capitals after PREFIX."""

    vault_path: str = ""
    data_dir: str = ".quillspark"
    exclude_globs: tuple[str, ...] = ("trash/**",)
    chunk_max_tokens: int = 512
    chunk_min_tokens: int = 64
    chunk_overlap: int = 64
    candidate_k: int = 50
    rrf_k: int = 60
    rerank_n: int = 30
    final_k: int = 8
    graph_max_nodes: int = 20
    graph_decay: float = 0.5
    graph_hub: int = 50
    llm_url: str = "http://localhost:11434"
    llm_model: str = ""
    llm_max_tokens: int = 1024
    rounds: int = 4
    context_tokens: int = 2000

    @classmethod
    def read(cls, **given) -> Settings:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found = {n: os.environ[PREFIX + n.upper()] for n in kinds if PREFIX + n.upper() in os.environ}
        turned = {n: tuple(json.loads(v)) if kinds[n] is tuple else kinds[n](v) for n, v in found.items()}
        return cls(**turned | {k: v for k, v in given.items() if v is not None})


class ModelUnreachable(RuntimeError):
    """No answer from the model's address."""


def http_model(url: str, model: str, max_tokens: int) -> Model:
    """A model behind a local chat address that answers a line of JSON at a time."""

    def ask(messages: list[dict], tools: list[dict]) -> Iterable[dict]:
        body = {"model": model, "messages": messages, "stream": True, "options": {"num_predict": max_tokens}} | ({"tools": tools} if tools else {})
        request = urllib.request.Request(f"{url.rstrip('/')}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request) as reply:
                for n, line in enumerate(reply):
                    if line.strip():
                        yield from reply_events(json.loads(line), n)
        except urllib.error.HTTPError:
            raise
        except OSError as e:
            raise ModelUnreachable(f"no model at {url}: {e}") from e

    return ask


def reply_events(line: dict, n: int) -> Iterable[dict]:
    """A reply line's events: text, tool calls, stop, as sources.events has them for tables."""
    message = line.get("message") or {}
    if message.get("content"):
        yield {"kind": "text", "text": message["content"]}
    for i, call in enumerate(message.get("tool_calls") or []):
        f = call.get("function") or {}
        yield {"kind": "tool_call", "call_id": call.get("id") or f"call_{n}_{i}", "name": f.get("name", ""), "arguments": f.get("arguments") or {}}
    if line.get("done"):
        yield {"kind": "stop", "reason": line.get("done_reason", "stop"), "prompt_tokens": line.get("prompt_eval_count", 0), "completion_tokens": line.get("eval_count", 0)}


DIMENSIONS = 64


def hashed_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A vector without a model: each word adds 1 or -1 at a place that its hash names.  For tests and offline use; it knows no meanings."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.crc32(w.cast("binary")))
    sign = lambda h: F.when(F.bitwise_and(h, F.lit(1 << 31)) != 0, F.lit(1.0)).otherwise(F.lit(-1.0)) if hasattr(F, "bitwise_and") else F.when(h.bitwiseAND(1 << 31) != 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    one = lambda d: F.aggregate(F.filter(hashes, lambda h: h % dimensions == d), F.lit(0.0), lambda s, h: s + sign(h))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: one(d).cast("float"))


def hashed_embed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("dense", hashed_vector(F.col("embedding_text")))


@dataclass
class Engine:
    """One vault with its index.  ``embed``, ``vector``, ``model`` and ``scorer`` (the reranker) are the replaceable parts; by default hashed vectors, the model of the settings, and
    the share of the query's words."""

    spark: SparkSession
    settings: Settings
    embed: Callable[[DataFrame], DataFrame] | None = hashed_embed
    vector: Callable[[str], list[float]] | None = None
    model: Model | None = None
    scorer: Scorer = retrieval.overlap_score
    _notes: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self):
        if self.vector is None and self.embed is hashed_embed:
            self.vector = lambda q: list(self.spark.createDataFrame([(q,)], "q string").select(hashed_vector(F.col("q"))).first()[0])
        if self.model is None and self.settings.llm_model:
            self.model = http_model(self.settings.llm_url, self.settings.llm_model, self.settings.llm_max_tokens)

    def notes(self) -> DataFrame:
        if not os.path.isdir(self.settings.vault_path) and "://" not in self.settings.vault_path:
            raise FileNotFoundError(f"no folder {self.settings.vault_path!r}")
        return load_notes(self.spark, self.settings.vault_path, self.settings.exclude_globs)

    def graph(self, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
        return graph.build(notes, links.resolve_links(links.extract_links(notes), notes))

    def adjacency(self, notes: DataFrame) -> Adjacency:
        """The stored graph, from links kept beside the index: only those that changed notes touch are read and resolved again."""
        view = LinkView(self.spark, f"{self.settings.data_dir}/links")
        view.refresh(notes)
        return Adjacency.write(*graph.build(notes, view.resolved()))

    def index(self) -> NoteIndex:
        return NoteIndex(self.spark, self.settings.data_dir, self.embed)

    def refresh(self, full: bool = False, progress: Callable[[str, int, int], None] | None = None) -> dict[str, int]:
        s = self.settings
        return self.index().refresh(self.notes(), full, True, s.chunk_max_tokens, s.chunk_min_tokens, s.chunk_overlap, progress)

    def session(self) -> Session:
        if self.model is None:
            raise ValueError("no model: set llm_model or give one")
        index, notes, s = self.index(), self.notes(), self.settings
        if not index.version():
            raise LookupError("no index yet: run index first")
        tools = Tools(notes, index.read("chunks"), index.postings(), self.adjacency(notes), self.vector, s.graph_max_nodes, s.graph_decay, s.graph_hub, s.candidate_k, s.rrf_k, s.rerank_n, s.final_k, self.scorer)
        return Session(self.model, tools, s.rounds, s.context_tokens)
