"""Column expressions over note texts: words, lines, tags, links, citations, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as in splitting on any white space, line ends, and what links, tags and ids look like.
WHITE = r"(?U)[\s\x1c-\x1f]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: All of them but the plain one.
ODD_END = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WIKI = r"(!?)\[\[([^\]|#]+?)(?:#(\^?)([^\]|]+))?(?:\|([^\]]+))?\]\]"
MARKDOWN = r"(?U)(?<!!)\[[^\]]*\]\(([^\s)]+\.md)\)"
INLINE_TAG = r"(?U)(?<!\S)#([A-Za-z0-9_/-]+)"
CODE_SPAN = "`[^`]*`"
FENCE = r"(?U)^[\s\x1c-\x1f]*(```|~~~)"
NAMESPACE = "b52d14a73f8954679512c3d5508b486d"


def tokens(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, WHITE), lambda x: x != "")), F.lit(0)).cast("long")


def folder(note_id: Column) -> Column:
    """All before the last slash, '' at the root."""
    return F.when(F.contains(note_id, F.lit("/")), F.regexp_replace(note_id, "/[^/]*$", "")).otherwise(F.lit(""))


def basename(note_id: Column) -> Column:
    return F.substring_index(note_id, "/", -1)


def _once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, as the only element of an array."""
    return F.get(F.transform(F.array(value), body), 0)


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty one doesn't count.  Texts with plain ends only are cut without a pattern."""
    parts = F.when(F.rlike(text, F.lit(ODD_END)), F.split(text, LINE_END)).otherwise(F.split(text, "\n"))
    return _once(parts, lambda p: F.when(F.try_element_at(p, F.lit(-1)) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def outside_fences(text: Column) -> Column:
    """The lines that are neither in a fenced block nor fences; a fence is closed by its own marker only.

    Only lines that begin with a marker are folded, to one character of state each; the lines between them are sliced out,
    so the work is linear in the lines.  A text that holds no marker is all free.
    """
    marked = lambda x: F.contains(x, F.lit("```")) | F.contains(x, F.lit("~~~"))
    given = F.struct(lines(text).alias("lines"))
    marks = lambda g: F.filter(F.transform(g["lines"], lambda x, i: F.struct(F.when(marked(x), F.substring(F.regexp_extract(x, FENCE, 1), 1, 1)).otherwise("").alias("mark"), i.alias("at"))), lambda m: m["mark"] != "")

    def step(state: Column, m: Column) -> Column:
        now = F.substring(state, -1, 1)
        return F.concat(state, F.when(now == "0", m["mark"]).when(now == m["mark"], F.lit("0")).otherwise(now))

    def free(g: Column, found: Column, states: Column) -> Column:
        # Segment j lies before marker j; the last one ends with the text.
        n = F.size(found)
        begin = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.coalesce(F.get(found, j - 1)["at"], F.lit(0)) + 1)
        end = lambda j: F.when(j == n, F.size(g["lines"])).otherwise(F.coalesce(F.get(found, j)["at"], F.lit(0)))
        part = lambda j: F.when(F.substr(states, j + 1, F.lit(1)) == "0", F.slice(g["lines"], begin(j) + 1, end(j) - begin(j)))
        return F.flatten(F.filter(F.transform(F.sequence(F.lit(0), n), part), lambda x: x.isNotNull()))

    # Each step is worked out once.
    folded = _once(given, lambda g: _once(marks(g), lambda found: _once(F.aggregate(found, F.lit("0"), step), lambda states: free(g, found, states))))
    return F.when(marked(text), folded).otherwise(lines(text))


def without_code(line: Column) -> Column:
    return F.regexp_replace(line, CODE_SPAN, " ")


def inline_tags(text: Column) -> Column:
    """Tags outside code, each once, in order."""
    found = F.transform(outside_fences(text), lambda x: F.regexp_extract_all(without_code(x), F.lit(INLINE_TAG), F.lit(1)))
    return F.array_distinct(F.flatten(found))


def citation_keys(answer: Column) -> Column:
    """All [S1]-like keys in order, repeats kept."""
    return F.regexp_extract_all(answer, F.lit(r"\[(S\d+)\]"), F.lit(1))


def quoted(text: Column) -> Column:
    """Percent-encoding that leaves slashes and unreserved characters."""
    out = F.url_encode(text)
    for a, b in ((r"\+", "%20"), ("%2F", "/"), ("%7E", "~"), (r"\*", "%2A")):
        out = F.regexp_replace(out, a, b)
    return out


def uuid5(name: Column) -> Column:
    """Name-based id of version 5 in the chunk namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    kind = F.substring(F.lit("89ab"), 1, 4)
    variant = F.substr(kind, (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
