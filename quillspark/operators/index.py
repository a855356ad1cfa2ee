"""The index of notes: segments of what changed, one after the other, and search over them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import chunks as C
from quillspark.operators import manifest, retrieval
from quillspark.operators.postings import Postings, blocks, gathered, inverted, write
from quillspark.operators.segments import Segments
from quillspark.sources.commits import Conflict


class NoteIndex(Segments):
    """Immutable segments under ``root``/segments, and a log of commits under ``root``/log that says which of them make a version.

    A refresh writes one segment with what changed: table notes (note_id, content_hash, listed, covers), a row for each note that it
    brings or deletes; chunks; and postings, the inverted index of its chunks.  A note's rows are those of the last segment that
    ``covers`` it, which is found at reading, so a deletion is a row of notes.  A version counts once its commit is made, which is one file that one writer only can create: of two
    refreshes at a time one fails, and a run that is cut off leaves a folder that nothing points to.  Readers keep the version they opened.

    Segments are compacted by size: where the last ``fan`` or more have at most a tier's notes (a power of ``fan``), they become one, so there are about fan * log(notes) segments and a row is written
    about log(notes) times, however many refreshes there are.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[DataFrame], DataFrame] | None = None, fan: int = 4):
        """``embed`` adds column dense to rows with column embedding_text; without it there are no vectors."""
        super().__init__(spark, root)
        self.embed, self.fan = embed, fan

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """Table chunks, terms (chunk_id, term, weight), or manifest (note_id, content_hash) of a version; None where there is none yet."""
        segments = self.segments(version)
        if not segments:
            return None
        if table == "manifest":
            return self._manifest(segments)
        return self.postings(version).entries() if table == "terms" else self._live(segments, table).drop("seq")

    def postings(self, version: int | None = None) -> Postings | None:
        """The inverted index of a version, over those of its segments."""
        segments = self.segments(version)
        return self._postings(segments) if segments else None

    def _postings(self, segments: list[dict]) -> Postings:
        dead = None
        if len(segments) > 1:
            last = self._owners(segments).withColumnRenamed("note_id", "of")
            # Written over and deleted notes are few beside the index; their chunks' ids are all that is read of it.
            rows = self._union(segments, "chunks").select("seq", "note_id", F.col("chunk_id").alias("key"))
            dead = rows.join(last, (F.col("note_id") == F.col("of")) & (F.col("seq") < F.col("last")), "left_semi").select("seq", "key")
        return Postings([self._table(s, "postings") for s in segments], dead)

    def refresh(self, notes: DataFrame, full: bool = False, purge_stale: bool = True, most: int = 512, least: int = 64, overlap: int = 64, progress: Callable[[str, int, int], None] | None = None) -> dict[str, int]:
        """Bring the index up to ``notes`` (note_id, title, body, content_hash, ...): notes by change.

        Only notes that are new or whose hash changed are chunked, and deleted ones lose their chunks; what is written
        is in proportion to these; where nothing changed, there is no new version.  ``full`` chunks all notes again; then chunks of deleted notes linger unless ``purge_stale``.  Texts of changed notes are read
        once more and kept with the hash of that reading, so that a note edited meanwhile is found changed the next time, and a note
        that has gone meanwhile is left out.  ``progress`` is told (stage, done, of all).

        Conflict is raised if another refresh has committed meanwhile; this one has then changed nothing.
        """
        tell = progress or (lambda *_: None)
        at = self.version()
        held = self.segments(at)
        own = {"id": uuid.uuid4().hex, "tables": {}}
        out = f"{self.root}/segments/{own['id']}"
        before = self._manifest(held)
        before_n = sum(s["listed"] for s in held[-1:])
        # With full, notes that haven't changed are taken as well.
        changes = manifest.diff(notes.select("note_id", "content_hash"), before)
        changes = self._keep(changes if full else changes.where("change <> 'unchanged'"), f"{out}/changes")
        told = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        if same := before_n - told.get("modified", 0) - told.get("deleted", 0):
            told["unchanged"] = same
        if at and not told.keys() - {"unchanged"} and not full:
            self._delete(out)
            return told
        tell("changes", 1, 4)
        fresh = changes.where("change <> 'deleted'")
        taken = self._keep(notes.join(fresh.select("note_id"), "note_id", "left_semi"), f"{out}/taken")
        tell("taken", 2, 4)
        new = C.chunk_notes(taken, most, least, overlap, once=True)
        new = new.withColumn("embedding_text", C.embedding_text(F.col("title"), F.col("header_path"), F.col("text")))
        covers = F.lit(True) if purge_stale or not full else F.col("change") != "deleted"
        rows = changes.select("note_id", covers.alias("covers")).join(taken.select("note_id", "content_hash", F.lit(True).alias("here")), "note_id", "left")
        own["notes"] = self._write(own, "notes", rows.select("note_id", "content_hash", F.coalesce("here", F.lit(False)).alias("listed"), "covers")).count()
        new = self._write(own, "chunks", self.embed(new) if self.embed else new)
        self._check_dimension(new, held)
        tell("chunks", 3, 4)
        self._write(own, "postings", inverted(new, "chunk_id", "embedding_text"), write)
        self._delete(f"{out}/taken")
        arrived = self._table(own, "notes").where("listed").count()
        own["listed"] = before_n - told.get("modified", 0) - told.get("deleted", 0) - (told.get("unchanged", 0) if full else 0) + arrived
        self.log.commit(at + 1, {"segments": [*held, own], "change": own["id"]})
        tell("postings", 4, 4)
        self.compact()
        return told

    def changes(self, version: int | None = None) -> DataFrame:
        """(note_id, change) that the refresh of a version found; notes that didn't change are left out, but by a full one."""
        v = self.version() if version is None else version
        while (body := self.log.read(v)) and "change" not in body:
            v -= 1
        return self.spark.read.schema("note_id string, change string").parquet(f"{self.root}/segments/{body['change']}/changes")

    def compact(self) -> bool:
        """Make one segment of the last ones where their sizes ask for it; whether it did.  A commit of its own, which says the same as the one before.

        Another writer's commit meanwhile goes before: then nothing is compacted until the next time.
        """
        at = self.version()
        segments = self.segments(at)
        tiers = [int(math.log(max(1, s["notes"]), self.fan) + 1e-9) for s in segments]
        for tier in sorted(set(tiers)):
            first = len(tiers)
            while first and tiers[first - 1] <= tier:
                first -= 1
            if len(tiers) - first >= self.fan:
                break
        else:
            return False
        run = segments[first:]
        own = {"id": uuid.uuid4().hex, "tables": {}, "listed": run[-1]["listed"]}
        notes = self._union(run, "notes").groupBy("note_id").agg(F.max_by(F.struct("listed", "content_hash"), "seq").alias("x"), F.bool_or("covers").alias("covers")).select("note_id", "x.content_hash", "x.listed", "covers")
        # Where there is nothing older, deletions have done their work.
        own["notes"] = self._write(own, "notes", notes if first else notes.where("listed")).count()
        self._write(own, "chunks", self._live(run, "chunks").drop("seq"))
        self._write(own, "postings", blocks(gathered(self._postings(run).entries())), write)
        try:
            self.log.commit(at + 1, {"segments": [*segments[:first], own]})
        except Conflict:
            self._delete(f"{self.root}/segments/{own['id']}")
            return False
        return True

    def _check_dimension(self, new: DataFrame, held: list[dict]) -> None:
        """All vectors of an index have one length."""
        if "dense" not in new.columns:
            return
        sizes = {r[0] for r in new.select(F.size("dense")).distinct().limit(2).collect()}
        for s in held:
            if any(f["name"] == "dense" for f in s["tables"]["chunks"]["fields"]) and (first := self._table(s, "chunks").where("dense is not null").select(F.size("dense")).first()):
                sizes.add(first[0])
                break
        if len(sizes) > 1:
            raise ValueError(f"vectors of lengths {sorted(sizes)}; index again with full=True in a new folder")

def hybrid_search(chunks: DataFrame, terms: DataFrame | Postings, query_terms: DataFrame, query_vector: list[float] | None, candidate_k: int = 50, k: int = 60, **filters) -> DataFrame:
    """Dense and sparse top lists under one filter, fused by rank: (chunk_id, score, best, source).

    ``query_terms`` is (term, weight); without a query vector the sparse list stands alone.  ``terms`` are the postings, or a table (chunk_id, term, weight), which
    is scanned for the query's terms; only texts that have one are held against the filter.
    """
    kept = retrieval.filtered(chunks, **filters)
    some = None if kept is chunks else kept.select("chunk_id")
    if isinstance(terms, Postings):
        sparse = terms.top_k({r.term: r.weight for r in query_terms.collect()}, candidate_k, some)
    else:
        found = terms.join(query_terms.select("term"), "term", "left_semi")
        sparse = retrieval.sparse_top_k(found if some is None else found.join(some, "chunk_id", "left_semi"), query_terms, candidate_k)
    lists = sparse.withColumn("list_no", F.lit(1))
    if query_vector is not None:
        lists = retrieval.dense_top_k(kept, query_vector, candidate_k).withColumn("list_no", F.lit(0)).unionByName(lists)
    return retrieval.rank_fusion(lists, "chunk_id", k, candidate_k)


#: A reranker: a column of scores from a query and a column of texts.
Scorer = Callable[[str, Column], Column]


def search(
    chunks: DataFrame, terms: DataFrame | Postings, query: str, query_vector: list[float] | None = None, rerank_n: int = 30, final_k: int = 8, candidate_k: int = 50, rrf_k: int = 60, scorer: Scorer = retrieval.overlap_score, **filters
) -> DataFrame:
    """Hybrid search, then the reranker's best chunks with their text: chunk columns, score, rank."""
    spark = chunks.sparkSession
    asked = retrieval.term_weights(spark.createDataFrame([("q", query)], "id string, text string"), "id", "text").select("term", "weight")
    fused = hybrid_search(chunks, terms, asked, query_vector, candidate_k, rrf_k, **filters).limit(rerank_n)
    ranked = fused.select("chunk_id", F.struct((-F.col("score")).alias("s"), "best", "chunk_id").alias("rank"))
    return with_scores(chunks.join(F.broadcast(ranked), "chunk_id"), query, rerank_n, final_k, scorer)


def with_scores(candidates: DataFrame, query: str, rerank_n: int = 30, final_k: int = 8, scorer: Scorer = retrieval.overlap_score) -> DataFrame:
    """The reranker over candidates with a column ``rank``, its places from 1 in column ``rank``."""
    best = retrieval.rerank(candidates, scorer(query, F.col("text")), rerank_n, final_k)
    place = F.struct((-F.col("score")).alias("s"), "rank")
    rows = best.withColumn("all", F.lit(0)).groupBy("all").agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), F.struct(*best.columns).alias("x")))).alias("rows"))
    return rows.select(F.posexplode("rows").alias("i", "row")).select("row.x.*", "i").withColumn("rank", F.col("i") + 1).drop("i")
