"""Links between notes: extraction and three-step resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import MARKDOWN, WIKI, basename, outside_fences, stripped, without_code


def extract_links(notes: DataFrame) -> DataFrame:
    """(note_id, line, class, pos, kind, target_raw, heading, block_id, alias) of all links outside code, in order.

    Wiki links of a line come before its markdown links, which have no alias.  Embeds of files other than notes are left out.
    """
    # Bodies are cut into lines once, and of these only the ones that can hold a link become rows.
    told = F.transform(outside_fences(F.col("body")), lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    rows = notes.select("note_id", F.explode(F.filter(told, lambda x: F.contains(x["text"], F.lit("[[")) | F.contains(x["text"], F.lit("](")))).alias("x"))
    rows = rows.select("note_id", "x.line", without_code(F.col("x.text")).alias("text"))
    found = lambda form, group, kind: F.transform(F.regexp_extract_all("text", F.lit(form), F.lit(group)), lambda m, i: F.struct(F.lit(kind).alias("class"), i.alias("pos"), m.alias("m")))
    links = rows.select("note_id", "line", F.explode(F.concat(found(WIKI, 0, 0), found(MARKDOWN, 1, 1))).alias("x")).select("note_id", "line", "x.*")
    wiki = F.col("class") == 0
    part = lambda g: F.regexp_extract("m", WIKI, g)
    given = lambda g: F.when(wiki & (part(g) != ""), stripped(part(g)))
    links = links.select(
        "note_id", "line", "class", "pos", F.when(wiki & (part(1) == "!"), "embed").otherwise("link").alias("kind"), F.when(wiki, stripped(part(2))).otherwise(F.col("m")).alias("target_raw"),
        F.when(part(3) == "", given(4)).alias("heading"), F.when(part(3) != "", given(4)).alias("block_id"), given(5).alias("alias"),
    )
    foreign = (F.col("kind") == "embed") & F.col("target_raw").rlike(r"\.[A-Za-z0-9]+$") & ~F.lower("target_raw").endswith(".md")
    return links.where((F.col("class") == 1) | ~foreign & (F.col("target_raw") != ""))


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Add target_note_id and resolved: by id, else by name, else by alias (both without case); of several the shortest, then least."""
    first = F.min(F.struct(F.char_length("note_id"), "note_id"))["note_id"]
    ids = notes.select(F.col("note_id").alias("exact"))
    names = notes.groupBy(F.lower(basename(F.col("note_id"))).alias("name")).agg(first.alias("by_name"))
    aliases = notes.select("note_id", F.explode("aliases").alias("a")).groupBy(F.lower("a").alias("aka")).agg(first.alias("by_alias"))
    key = F.lower("target_raw")
    out = links.join(ids, F.col("target_raw") == F.col("exact"), "left").join(names, key == F.col("name"), "left").join(aliases, key == F.col("aka"), "left")
    target = F.coalesce("exact", "by_name", "by_alias")
    return out.withColumn("target_note_id", target).withColumn("resolved", F.col("target_note_id").isNotNull()).drop("exact", "name", "by_name", "aka", "by_alias")
