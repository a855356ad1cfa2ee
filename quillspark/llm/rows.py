"""Rows by content: keys that don't depend on how a table is read, and repeated rows taken once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, VariantType

from quillspark.llm.common import written

#: Rows sent to every task, at most; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or what of name_, name__, ... is no column of ``df`` (names don't differ by case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _plain(kind: DataType) -> bool:
    return not isinstance(kind, (MapType, VariantType)) and "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def row_key(df: DataFrame, columns: list[str] | None = None) -> tuple[Column, Column]:
    """128 bits that rows have in common when they are equal in ``columns`` (all of them by default)."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    cells = [named(f.name) if _plain(f.dataType) else F.to_json(F.struct(named(f.name))) for f in fields]
    # Nulls are skipped by the hash; where they stand is hashed besides.
    nulls = F.concat(*[F.when(named(f.name).isNull(), F.lit("1")).otherwise(F.lit("0")) for f in fields])
    return F.xxhash64(nulls, *cells), F.xxhash64(F.lit(1), nulls, *cells)


def sent(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table for the small side of a join: sent to every task if it is small enough, by its counted rows."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def once(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each distinct (doc_id, text) once: doc_id, text, its key k1, k2, and times, the rows that it stands for.

    Only rows that occur again are gathered, and these are reduced in every task before they travel.
    """
    rows = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    k1, k2 = row_key(rows)
    rows = rows.withColumn("k1", k1).withColumn("k2", k2)
    again = written(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "again")
    n = again.count()
    if not n:
        return rows.withColumn("times", F.lit(1).cast("long"))
    single = rows.join(sent(again.select("k1", "k2"), n), ["k1", "k2"], "left_anti").withColumn("times", F.lit(1).cast("long"))
    several = rows.join(sent(again, n), ["k1", "k2"]).groupBy("k1", "k2", "times").agg(F.first(F.struct("doc_id", "text")).alias("x"))
    return single.select("doc_id", "text", "k1", "k2", "times").unionByName(several.select("x.doc_id", "x.text", "k1", "k2", "times"))


def repeated(docs: DataFrame, copies: DataFrame, columns: list[str] | None = None, others: bool = False) -> DataFrame:
    """``docs`` with the rows of each key of ``columns`` as often as ``copies`` (k1, k2, times, copies) says for all of them.

    ``times`` is how many rows of ``docs`` have the key; ``others``: rows of other keys stay as they are, else they go.  Of
    several rows of one key, the one with the least hash stands for all.
    """
    names = docs.columns
    a, b = fresh(docs, "k1"), fresh(docs, "k2")
    k1, k2 = row_key(docs, columns)
    whole = row_key(docs)[0]
    keyed = docs.withColumn(a, k1).withColumn(b, k2)
    copies = copies.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("times").alias(fresh(docs, "times")), F.col("copies").alias(fresh(docs, "copies")))
    times, many = copies.columns[2:]
    n_all, n_several = copies.agg(F.count(F.lit(1)), F.count_if(named(times) > 1)).first()
    as_often = lambda df: df.where(named(many) > 0).withColumn(many, F.explode(F.sequence(F.lit(1), named(many).cast("int")))).select(*map(named, names))
    one = copies.where(named(times) == 1)
    if others:
        out = keyed.join(sent(copies.select(a, b), n_all), [a, b], "left_anti").select(*map(named, names))
        one = one.where(named(many) > 0)
        if not one.isEmpty():
            out = out.unionByName(as_often(keyed.join(sent(one), [a, b])))
    else:
        out = as_often(keyed.join(sent(one, n_all), [a, b]))
    several = copies.where((named(times) > 1) & (named(many) > 0))
    if n_several:
        x = fresh(docs, "x")
        gathered = keyed.withColumn(times, whole).join(sent(several.drop(times), n_several), [a, b])
        gathered = gathered.groupBy(a, b, many).agg(F.min_by(F.struct(*map(named, names)), named(times)).alias(x))
        out = out.unionByName(gathered.where(named(many) > 0).withColumn(many, F.explode(F.sequence(F.lit(1), named(many).cast("int")))).select(*[named(x)[c].alias(c) for c in names]))
    return out
