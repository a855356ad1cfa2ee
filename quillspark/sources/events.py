"""Model replies, one JSON document a line, as events: text, tool calls, stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CALL = "struct<id:string,function:struct<name:string,arguments:string>>"
_LINE = f"struct<message:struct<content:string,tool_calls:array<{_CALL}>>,done:boolean,done_reason:string,prompt_eval_count:bigint,eval_count:bigint>"
_EVENT = "struct<kind:string,text:string,call_id:string,name:string,arguments:string,reason:string,prompt_tokens:bigint,completion_tokens:bigint>"


def _event(kind: str, **fields: Column) -> Column:
    names = [part.split(":")[0] for part in _EVENT[len("struct<") : -1].split(",")]
    given = {"kind": F.lit(kind)} | fields
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in names]).cast(_EVENT)


def line_events(line: Column, key: Column) -> Column:
    """Array of a line's events in the order text, calls, stop; a line that isn't JSON has none.

    A call without an id gets one made of ``key`` and its place, the same each time the plan is run.
    """
    row = F.from_json(line, _LINE)
    none = F.array().cast(f"array<{_EVENT}>")
    text = F.coalesce(row["message"]["content"], F.lit(""))
    calls = F.coalesce(row["message"]["tool_calls"], F.array().cast(f"array<{_CALL}>"))

    def call(x: Column, i: Column) -> Column:
        made = F.concat(F.lit("call_"), F.substring(F.sha2(F.concat_ws("|", key.cast("string"), i.cast("string")), 256), 1, 12))
        given = F.when(x["id"] != "", x["id"])
        return _event("tool_call", call_id=F.coalesce(given, made), name=F.coalesce(x["function"]["name"], F.lit("")), arguments=F.coalesce(x["function"]["arguments"], F.lit("{}")))

    zero = F.lit(0).cast("long")
    stop = _event("stop", reason=F.coalesce(row["done_reason"], F.lit("stop")), prompt_tokens=F.coalesce(row["prompt_eval_count"], zero), completion_tokens=F.coalesce(row["eval_count"], zero))
    return F.concat(F.when(text != "", F.array(_event("text", text=text))).otherwise(none), F.transform(calls, call), F.when(F.coalesce(row["done"], F.lit(False)), F.array(stop)).otherwise(none))


def events(lines: DataFrame, seq: str = "seq", line: str = "line") -> DataFrame:
    """Rows (seq, line) as events, in order of (seq, pos)."""
    return lines.select(seq, F.posexplode(line_events(F.col(line), F.col(seq))).alias("pos", "event")).select(seq, "pos", "event.*")


def _joined(seq: str):
    parts = F.sort_array(F.collect_list(F.when(F.col("kind") == "text", F.struct(seq, "pos", "text"))))
    return F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text")


def reply_text(found: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: the text events' texts joined in order (for one reply, not for a corpus of them)."""
    return found.agg(_joined(seq))


def reply_texts(found: DataFrame, reply: str, seq: str = "seq") -> DataFrame:
    """(reply, text): a row a reply that has text."""
    return found.where("kind = 'text'").groupBy(reply).agg(_joined(seq))
