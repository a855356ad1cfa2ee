"""Note headers: the YAML block before a note's text, and its tags, aliases and date."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import DataFrame

try:
    import yaml
except ImportError:  # Only notes that have a header need it.
    yaml = None

_RULE = re.compile(r"^-{3,}\s*$", re.MULTILINE)
FIELDS = "fm_tags array<string>, aliases array<string>, created timestamp_ntz, body string"


def split_header(raw: str) -> tuple[dict, str]:
    """The header's values and the stripped text after it.

    No header, or one that isn't closed or isn't a mapping, gives no values.  A header that isn't
    YAML is kept: the raw text comes back as it is.
    """
    text = raw.strip()
    opening = _RULE.match(text)
    closing = opening and _RULE.search(text, opening.end())
    if not closing:
        return {}, text
    if yaml is None:
        raise ModuleNotFoundError("notes with a header need PyYAML")
    try:
        values = yaml.safe_load(text[opening.end() : closing.start()])
    except yaml.YAMLError:
        return {}, raw
    return values if isinstance(values, dict) else {}, text[closing.end() :].strip()


def _distinct(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v.strip() for v in values if v.strip()))


def header_tags(value) -> list[str]:
    """A list, or text parted by commas; leading number signs go before white space does."""
    parts = value.split(",") if isinstance(value, str) else map(str, value) if isinstance(value, list) else ()
    return _distinct([p.lstrip("#") for p in parts])


def header_aliases(value) -> list[str]:
    """A list, or one text (commas don't part it)."""
    return _distinct([value] if isinstance(value, str) else list(map(str, value)) if isinstance(value, list) else [])


def header_date(value) -> dt.datetime | None:
    """A day is its midnight; what can't be read as a date is null, and a zone is turned to UTC and dropped."""
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    if value is None or isinstance(value, (list, dict)):
        return None
    try:
        when = pd.to_datetime(value, errors="coerce")
    except (TypeError, ValueError):
        return None
    if not isinstance(when, pd.Timestamp) or pd.isna(when):
        return None
    return (when.tz_convert("UTC").tz_localize(None) if when.tzinfo else when).to_pydatetime()


def with_header(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Replace text column ``raw`` by fm_tags, aliases, created and body (Arrow batches; YAML has no JVM function).

    A null text counts as empty.  Other columns stay, unless they have one of these names.
    """
    kept = [f for f in rows.schema.fields if f.name not in (raw, "fm_tags", "aliases", "created", "body")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [FIELDS])
    names = [f.name for f in kept]

    def parse(batches):
        for pdf in batches:
            split = [split_header(t) if isinstance(t, str) else ({}, "") for t in pdf[raw]]
            out = pdf[names].copy()
            out["fm_tags"] = [header_tags(v.get("tags")) for v, _ in split]
            out["aliases"] = [header_aliases(v.get("aliases")) for v, _ in split]
            out["created"] = pd.Series([header_date(v.get("created")) for v, _ in split], index=out.index, dtype="datetime64[us]")
            out["body"] = [b for _, b in split]
            yield out

    return rows.mapInPandas(parse, schema)
