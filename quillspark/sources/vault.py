"""Notes as tables: a folder of markdown files, or the documents table dressed as notes."""

from __future__ import annotations

import fnmatch
import os

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.frontmatter import with_header
from quillspark.functions.text import basename, folder, inline_tags, tokens



def is_note(path: str, exclude: tuple[str, ...] = ("trash/**",)) -> bool:
    """Whether a relative path is a note's: no dot file or folder, no excluded glob ('*' crosses slashes)."""
    parts = path.split("/")
    return path.endswith(".md") and not any(p.startswith(".") for p in parts) and not any(fnmatch.fnmatchcase(path, g) for g in exclude)


def _found(root: str, folders, exclude: tuple[str, ...], deep: bool):
    """(path, placeholder) of the notes in folders, and below them if ``deep``; a placeholder stands for a file that isn't there yet."""
    fs, base = pafs.FileSystem.from_uri(root)
    base = base.rstrip("/")
    for folder in folders:
        for info in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"), recursive=deep)):
            path = info.path[len(base) + 1 :]
            if info.type == pafs.FileType.File and not any(p.startswith(".") for p in path.split("/")[:-1]):
                if path.endswith(".md.icloud"):
                    yield path, True
                elif is_note(path, exclude):
                    yield path, False


def note_paths(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("trash/**",)) -> DataFrame:
    """(path, placeholder) of the notes under a folder of any file system that pyarrow opens; tasks list the folders below the first."""
    fs, base = pafs.FileSystem.from_uri(root)
    top = [i.path.rsplit("/", 1)[-1] for i in fs.get_file_info(pafs.FileSelector(base)) if i.type == pafs.FileType.Directory]
    folders = [("", False)] + [(f, True) for f in sorted(top) if not f.startswith(".")]

    def listed(batches):
        for batch in batches:
            for folder, deep in zip(batch.column("folder").to_pylist(), batch.column("deep").to_pylist(), strict=True):
                rows = list(_found(root, [folder], exclude, deep))
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), (pa.string(), pa.bool_()), strict=True)], names=["path", "placeholder"])

    return spark.createDataFrame(folders, "folder string, deep boolean").repartition(len(folders), "folder").mapInArrow(listed, "path string, placeholder boolean")


def read_texts(paths: DataFrame, root: str) -> DataFrame:
    """(path, raw, replaced): the files' texts, read by the tasks one by one; bad bytes become U+FFFD, and ``replaced`` tells that there is one."""

    def read(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                    raw = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([raw]), pa.array(["\ufffd" in raw])], names=["path", "raw", "replaced"])

    tasks = paths.sparkSession.sparkContext.defaultParallelism
    return paths.select("path").repartition(tasks, F.xxhash64("path")).mapInArrow(read, "path string, raw string, replaced boolean")


def walk_report(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("trash/**",)) -> DataFrame:
    """(path, problem): placeholders that were skipped, and notes some of whose bytes were replaced."""
    paths = note_paths(spark, root, exclude)
    skipped = paths.where("placeholder").select("path", F.lit("placeholder").alias("problem"))
    return skipped.unionByName(read_texts(paths.where("not placeholder"), root).where("replaced").select("path", F.lit("replaced bytes").alias("problem")))


def load_notes(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("trash/**",)) -> DataFrame:
    """Notes of a folder, listed and read by the tasks; see ``walk_report`` for what was skipped or replaced."""
    root = root if "://" in root else os.path.abspath(root)
    files = read_texts(note_paths(spark, root, exclude).where("not placeholder"), root).drop("replaced")
    return as_notes(files)


def as_notes(files: DataFrame) -> DataFrame:
    """Texts (path, raw) as notes."""
    rows = with_header(files).withColumn("note_id", F.regexp_replace("path", r"\.md$", ""))
    body, tags = F.col("body"), F.array_distinct(F.concat("fm_tags", inline_tags(F.col("body"))))
    return rows.select(
        "note_id", "path", basename(F.col("note_id")).alias("title"), "body", F.sha2(body.cast("binary"), 256).alias("content_hash"), tags.alias("tags"),
        "aliases", "created", folder(F.col("note_id")).alias("folder"), tokens(body).alias("token_estimate"),
    )


def document_names(docs: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, note_id, title, aliases) of document_notes(), which need neither texts nor links; and ``columns`` of the documents."""
    return docs.select("doc_id", *columns, F.concat("source", F.lit("/"), "lang", F.lit("-"), "doc_id").alias("note_id"), F.concat("lang", F.lit("-"), "doc_id").alias("title"), F.array().cast("array<string>").alias("aliases"))


def document_notes(docs: DataFrame) -> DataFrame:
    """Documents as notes: id by source, language and number; a first line links an exact id, an upper-case name and a missing note.

    A link whose document isn't there, as numbers have gaps, is left out; the note stays.  The links are found between numbers and names;
    texts move once, to their links."""
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    name, ident = F.concat("lang", F.lit("-"), "doc_id"), F.concat("source", F.lit("/"), "lang", F.lit("-"), "doc_id")
    known = docs.select(F.col("doc_id").alias("of"), ident.alias("id"), F.upper(name).alias("upper_name"))
    ends = docs.select("doc_id").distinct().crossJoin(F.broadcast(n)).select("doc_id", ((F.col("doc_id") * 7 + 1) % F.col("n_docs")).alias("a"), ((F.col("doc_id") * 13 + 5) % F.col("n_docs")).alias("b"))
    ends = ends.join(known.select(F.col("of").alias("a"), F.col("id").alias("id_a")), "a", "left").join(known.select(F.col("of").alias("b"), F.col("upper_name").alias("name_b")), "b", "left")
    rows = docs.join(ends.select("doc_id", "id_a", "name_b"), "doc_id", "left").withColumns({"id": ident, "name": name})
    links = [F.concat(F.lit("[["), x, F.lit("]]")) for x in ("id_a", "name_b", F.concat(F.lit("missing-"), F.col("doc_id") % 17))]
    first = F.concat(F.concat_ws(" ", *links), F.lit("\n"))
    return rows.select(
        "doc_id", F.col("id").alias("note_id"), F.col("name").alias("title"), F.concat(first, F.coalesce("text", F.lit(""))).alias("body"), F.array("lang", F.concat(F.lit("t"), F.col("doc_id") % 7)).alias("tags"),
        F.array().cast("array<string>").alias("aliases"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 365).cast("int")).alias("created"), folder(F.col("id")).alias("folder"), tokens(F.col("text")).alias("token_estimate"),
    )
