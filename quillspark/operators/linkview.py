"""Resolved links kept up to date: what a new, edited, renamed or deleted note changes, and nothing else, is resolved again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import basename
from quillspark.operators import links as L
from quillspark.operators import manifest
from quillspark.operators.segments import Segments

#: The ways in which a link names a note, in the order in which they count.
EXACT, NAME, ALIAS = 0, 1, 2
#: Segments after which all become one, if the later ones have a part of 1 / SHARE of the links.
MOST, SHARE = 8, 4
LINK = ("note_id", "line", "class", "pos")


def names_of(notes: DataFrame) -> DataFrame:
    """(note_id, way, key): what links can call a note by, from (note_id, aliases)."""
    note = F.col("note_id")
    own = notes.select("note_id", F.explode(F.array(F.struct(F.lit(EXACT).alias("way"), note.alias("key")), F.struct(F.lit(NAME).alias("way"), F.lower(basename(note)).alias("key")))).alias("x"))
    given = notes.select("note_id", F.explode("aliases").alias("a")).select("note_id", F.struct(F.lit(ALIAS).alias("way"), F.lower("a").alias("key")).alias("x"))
    return own.unionByName(given).select("note_id", "x.*").where("key is not null").distinct()


def calls(links: DataFrame) -> DataFrame:
    """The links once for each way in which they may name a note: columns way and key."""
    raw = F.col("target_raw")
    ways = [F.struct(F.lit(w).alias("way"), k.alias("key")) for w, k in ((EXACT, raw), (NAME, F.lower(raw)), (ALIAS, F.lower(raw)))]
    return links.withColumn("x", F.explode(F.array(*ways))).select("*", "x.way", "x.key").drop("x")


def resolved(links: DataFrame, names: DataFrame) -> DataFrame:
    """``links`` with target_note_id, by the first way that names a note; of several notes the one of the shortest, then least id.

    Only the names that the links call are gathered, and each of them is one row before it meets its links.
    """
    called = calls(links)
    needed = names.join(called.select("way", "key").distinct(), ["way", "key"], "left_semi")
    best = needed.groupBy("way", "key").agg(F.min(F.struct(F.char_length("note_id").alias("size"), "note_id")).alias("best"))
    found = called.join(best, ["way", "key"]).groupBy(*LINK).agg(F.min_by("best.note_id", "way").alias("target_note_id"))
    return links.join(found, list(LINK), "left")


class LinkView(Segments):
    """The resolved links of a folder of notes, as segments of what changed (see Segments): tables notes, names and links.

    A refresh extracts the links of changed notes only.  Names that notes lost or gained are looked up among all links' targets, and the links
    that use one are resolved again, whichever notes they stand in; these go into the new segment as patches, the last of which counts.
    A note's edit that changes no name of it touches no link but its own.
    """

    def refresh(self, notes: DataFrame, counted: dict | None = None) -> int:
        """Bring the view up to ``notes`` (note_id, body, aliases, content_hash); its version.

        ``counted`` is given the notes whose links were extracted, and the links resolved.  A null body has no links, null aliases are none.
        Conflict is raised if another refresh has committed meanwhile.
        """
        at = self.version()
        held, own = self.segments(at), {"id": uuid.uuid4().hex, "tables": {}}
        out = f"{self.root}/segments/{own['id']}"
        changes = manifest.diff(notes.select("note_id", "content_hash"), self._manifest(held)).where("change <> 'unchanged'")
        changes = self._keep(changes, f"{out}/changes")
        if at and changes.isEmpty():
            self._delete(out)
            return at
        fresh = changes.where("change <> 'deleted'").select("note_id")
        taken = self._keep(notes.select("note_id", "body", "aliases", "content_hash").join(fresh, "note_id", "left_semi"), f"{out}/taken")
        rows = changes.select("note_id", F.lit(True).alias("covers")).join(taken.select("note_id", "content_hash", F.lit(True).alias("here")), "note_id", "left")
        own["notes"] = self._write(own, "notes", rows.select("note_id", "content_hash", F.coalesce("here", F.lit(False)).alias("listed"), "covers")).count()
        names = self._write(own, "names", names_of(taken))
        mine = L.extract_links(taken)
        if held:
            before = self._live(held, "names").drop("seq")
            lost = before.join(changes.select("note_id"), "note_id", "left_semi")
            key = ["note_id", "way", "key"]
            # Names that came or went; a note that keeps its names changes no other note's links.
            moved = self._keep(lost.join(names, key, "left_anti").unionByName(names.join(lost, key, "left_anti")).select("way", "key").distinct(), f"{out}/moved")
            others = self._links(held).join(changes.select("note_id"), "note_id", "left_anti").drop("target_note_id")
            hit = calls(others).join(moved, ["way", "key"], "left_semi").select(*LINK).distinct()
            mine = mine.unionByName(others.join(hit, list(LINK), "left_semi"))
            names = before.join(changes.select("note_id"), "note_id", "left_anti").unionByName(names)
        mine = self._keep(mine, f"{out}/unresolved")
        own["links"] = self._write(own, "links", resolved(mine, names)).count()
        if counted is not None:
            counted |= {"notes": taken.count(), "links": own["links"]}
        for name in ("changes", "taken", "unresolved", "moved"):
            self._delete(f"{out}/{name}")
        self.log.commit(at + 1, {"segments": [*held, own]})
        return self.compact()

    def _links(self, segments: list[dict]) -> DataFrame:
        """The links of all notes, each as it was last resolved."""
        rows = self._live(segments, "links")
        if len(segments) == 1:
            return rows.drop("seq")
        last = rows.groupBy(*LINK).agg(F.max("seq").alias("last"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
        stale = last.select(*[F.col(c).alias(f"of_{c}") for c in LINK], "last")
        same = [F.col(c) == F.col(f"of_{c}") for c in LINK]
        return rows.join(stale, [*same, F.col("seq") < F.col("last")], "left_anti").drop("seq")

    def compact(self) -> int:
        """One segment of all, once there are many and the later ones are no small part; the version."""
        at = self.version()
        held = self.segments(at)
        if len(held) < MOST or SHARE * sum(s["links"] for s in held[1:]) < held[0]["links"] and len(held) < 8 * MOST:
            return at
        own = {"id": uuid.uuid4().hex, "tables": {}}
        listed = self._manifest(held).select("note_id", "content_hash", F.lit(True).alias("listed"), F.lit(True).alias("covers"))
        own["notes"] = self._write(own, "notes", listed).count()
        self._write(own, "names", self._live(held, "names").drop("seq"))
        own["links"] = self._write(own, "links", self._links(held)).count()
        self.log.commit(at + 1, {"segments": [own]})
        return at + 1

    def resolved(self, version: int | None = None) -> DataFrame | None:
        """The links as links.resolve_links() gives them; None where there is no version yet."""
        segments = self.segments(version)
        return self._links(segments).withColumn("resolved", F.col("target_note_id").isNotNull()) if segments else None
