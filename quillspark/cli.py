"""Command line: index, stats, graph-info and chat over a folder of notes."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import chunks, graph, stats
from quillspark.plans.agent import Session
from quillspark.plans.engine import Engine, ModelUnreachable, Settings
from quillspark.sources.vault import walk_report


def show_stats(engine: Engine) -> None:
    notes = engine.notes()
    for r in stats.corpus(notes, chunks.chunk_notes(notes), *engine.graph(notes)).orderBy("section", F.desc("value"), "item").collect():
        print(f"{r.section:<12}{r.value:>12.1f}  {r.item or '(root)'}")


def show_graph(engine: Engine, note: str | None, hub: int, most: int = 10) -> int:
    """The whole graph, or one note's report; a note that is not in it gives 1."""
    nodes, edges = engine.graph(engine.notes())
    if note is None:
        for name, df in {"notes": nodes.where("not ghost"), "orphans": graph.orphans(nodes, edges), "unresolved": graph.ghosts(nodes)}.items():
            n = df.count()
            print(f"{name} {n}", *([] if name == "notes" or not n else [r.id for r in df.orderBy("id").limit(most).collect()]))
        for r in graph.hubs(nodes, edges, hub, most).collect():
            print(f"hub {r.id} {r.degree}")
        return 0
    row = graph.report(nodes, edges, hub).where(F.col("id") == note).first()
    if row is None:
        print(f"no note {note}", file=sys.stderr)
        return 1
    print(f"degree {row.degree}, hub {row.is_hub}, unresolved {row.ghost}, neighbours {row.neighbors}")
    for r in graph.neighbors(edges, note).orderBy("other").collect():
        print(f"- {r.other}")
    return 0


def chat(session: Session, vault: str, lines: Iterable[str]) -> None:
    """Questions, or /sources, /clear and /exit, a line each; an answer is printed as it comes.  An interrupt ends the answer, not the chat."""
    for line in map(str.strip, lines):
        if line == "/exit":
            return
        if line == "/clear":
            session.clear()
        elif line == "/sources":
            print(session.footer(vault) or "no sources")
        elif line:
            try:
                session.ask(line, lambda text: print(text, end="", flush=True))
                print()
            except KeyboardInterrupt:
                print("\n(stopped)")
            except ModelUnreachable as e:
                print(e, file=sys.stderr)


def main(args: list[str] | None = None, spark: SparkSession | None = None, model=None, lines: Iterable[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark")
    parser.add_argument("command", choices=("index", "stats", "graph-info", "chat"))
    parser.add_argument("vault", nargs="?", help="folder of notes")
    parser.add_argument("--data", help="folder of the index")
    parser.add_argument("--full", action="store_true", help="chunk all notes again")
    parser.add_argument("--note", help="graph-info: this note only")
    parser.add_argument("--hub", type=int, help="links of a hub, at least one more")
    parser.add_argument("--debug", action="store_true", help="show where an error came from")
    given = parser.parse_args(args)
    settings = Settings.read(vault_path=given.vault, data_dir=given.data, graph_hub=given.hub)
    try:
        engine = Engine(spark or SparkSession.builder.appName("quillspark").getOrCreate(), settings, model=model)
        if given.command == "index":
            engine.notes()
            for r in walk_report(engine.spark, settings.vault_path if "://" in settings.vault_path else os.path.abspath(settings.vault_path), settings.exclude_globs).collect():
                print(f"{r.problem}: {r.path}", file=sys.stderr)
            print(engine.refresh(given.full, lambda stage, n, of: print(f"{n}/{of} {stage}", file=sys.stderr)))
        elif given.command == "stats":
            show_stats(engine)
        elif given.command == "chat":
            chat(engine.session(), os.path.basename(settings.vault_path.rstrip("/")), sys.stdin if lines is None else lines)
        else:
            return show_graph(engine, given.note, settings.graph_hub)
    except (FileNotFoundError, LookupError, ValueError, ModelUnreachable) as e:
        if given.debug:
            raise
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
