"""Operation logs as DataFrames: ops (seq, op, doc_id, terms), seq dense from 1, op "add" or "delete".

State is last writer wins for every document, so replay is one aggregation, and replaying a suffix
twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import WIDTH, numbered, running

OPS = "seq long, op string, doc_id long, terms array<string>"


def replay(ops: DataFrame) -> DataFrame:
    """doc_id, terms of the documents that are live after all ops."""
    last = ops.groupBy("doc_id").agg(F.max_by(F.struct("op", "terms"), "seq").alias("last"))
    return last.where("last.op = 'add'").select("doc_id", F.coalesce("last.terms", F.array().cast("array<string>")).alias("terms"))


def prefix(ops: DataFrame, applied: int) -> DataFrame:
    return ops.where(F.col("seq") <= applied)


def suffix(ops: DataFrame, applied: int) -> DataFrame:
    return ops.where(F.col("seq") > applied)


def merge(state: DataFrame, ops: DataFrame) -> DataFrame:
    """A state (doc_id, terms) with ops applied to it."""
    touched = ops.select("doc_id").distinct()
    return state.join(touched, "doc_id", "left_anti").select("doc_id", "terms").unionByName(replay(ops))


def compacted(state: DataFrame) -> DataFrame:
    """The shortest log with this state: one add per document, by id."""
    placed = numbered(state.select("doc_id", "terms"), "doc_id", max(1, state.count()), "seq")
    return placed.select("seq", F.lit("add").alias("op"), "doc_id", "terms")


def _marks(doc_id: Column, terms: Column) -> tuple[Column, Column]:
    """Two hashes of 60 bits of a document; the order of its terms does not matter, and other terms give other texts."""
    told = F.transform(F.array_sort(F.coalesce(terms, F.array().cast("array<string>"))), lambda t: F.concat(F.char_length(t).cast("string"), F.lit(":"), t))
    made = F.md5(F.concat(doc_id.cast("string"), F.lit(" "), F.array_join(told, "")).cast("binary"))
    return tuple(F.conv(F.substring(made, start, 15), 16, 10).cast("long") for start in (1, 16))


def digest(state: DataFrame) -> DataFrame:
    """One row n_docs, mark, mark2: equal for equal states, whatever the order of rows and terms.

    Unequal states of equal size agree by chance once in 2^120.
    """
    mark, mark2 = _marks(F.col("doc_id"), F.col("terms"))
    zero = F.lit(0).cast("long")
    return state.select(mark.alias("m"), mark2.alias("m2")).agg(F.count("*").alias("n_docs"), F.coalesce(F.bit_xor("m"), zero).alias("mark"), F.coalesce(F.bit_xor("m2"), zero).alias("mark2"))


def _marked(ops: DataFrame) -> DataFrame:
    """seq, doc_id, now: what each op's document adds to a digest, nothing if it is deleted."""
    zero, live = F.lit(0).cast("long"), F.col("op") == "add"
    mark, mark2 = _marks(F.col("doc_id"), F.col("terms"))
    return ops.select("seq", "doc_id", F.struct(live.cast("long").alias("n"), F.when(live, mark).otherwise(zero).alias("m"), F.when(live, mark2).otherwise(zero).alias("m2")).alias("now"))


def digests_by_prefix(ops: DataFrame, n: int | None = None, width: int = WIDTH) -> DataFrame:
    """seq, n_docs, mark, mark2: the digest after every op, without replaying any prefix.

    Each op swaps its document's former hashes for its new ones, so the digests are running sums of the
    changes. The log is cut into stretches of ``width`` records: a document's former op is looked for within
    the stretch, and its first op of a stretch takes over from its last one before; so neither the log nor a document
    with many ops is gathered in one task. ``n`` is the log's length, if known.
    """
    return _digests(_marked(ops), ops.count() if n is None else n, width)


def _digests(marks: DataFrame, n: int, width: int = WIDTH) -> DataFrame:
    zero = F.lit(0).cast("long")
    marked = marks.withColumn("part", F.expr(f"(seq - 1) div {width}"))
    inside = Window.partitionBy("part", "doc_id").orderBy("seq")
    former = marked.withColumn("former", F.lag("now").over(inside)).withColumn("first", F.row_number().over(inside) == 1)
    lasts = marked.groupBy("part", "doc_id").agg(F.max_by("now", "seq").alias("last"))
    carried = lasts.select(F.col("part").alias("p"), F.col("doc_id").alias("d"), F.lag("last").over(Window.partitionBy("doc_id").orderBy("part")).alias("carried")).where("carried IS NOT NULL")
    known = former.join(carried, F.col("first") & (F.col("part") == F.col("p")) & (F.col("doc_id") == F.col("d")), "left")
    before = lambda f: F.coalesce(F.when(F.col("first"), F.col(f"carried.{f}")).otherwise(F.col(f"former.{f}")), zero)
    changed = known.select(
        "seq", (F.col("seq") - 1).alias("place"), (F.col("now.n") - before("n")).alias("n_docs"), F.col("now.m").bitwiseXOR(before("m")).alias("mark"), F.col("now.m2").bitwiseXOR(before("m2")).alias("mark2"),
    )
    return running(changed, "place", max(n, 1), ["n_docs"], ["mark", "mark2"], width=width).select("seq", "n_docs", "mark", "mark2")


def infer_applied(ops: DataFrame, state: DataFrame, max_scan: int | None = None) -> int | None:
    """The longest prefix of the log that gives ``state``; None if there is none. Longer logs than ``max_scan`` are refused.

    The log is read and hashed once: the passes over it use the stored hashes, some 40 bytes a record.
    """
    marks = _marked(ops).persist()
    try:
        return _applied_by(marks, state, max_scan)
    finally:
        marks.unpersist()


def _applied_by(marks: DataFrame, state: DataFrame, max_scan: int | None) -> int | None:
    n = marks.count()
    if max_scan is not None and n > max_scan:
        raise ValueError(f"the log has {n} records, more than {max_scan}")
    goal = digest(state).first()
    if not goal["n_docs"] and not n:
        return 0
    equal = [F.col(c) == goal[c] for c in ("n_docs", "mark", "mark2")]
    hit = _digests(marks, n).where(equal[0] & equal[1] & equal[2]).agg(F.max("seq")).first()[0]
    return hit if hit is not None else 0 if not goal["n_docs"] else None


def same_state(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row n_docs_a, n_docs_b, valid."""
    x, y = (digest(s).select(F.col("n_docs").alias(f"n_docs_{name}"), F.struct("mark", "mark2").alias(name)) for s, name in ((a, "a"), (b, "b")))
    return x.join(y).select("n_docs_a", "n_docs_b", ((F.col("n_docs_a") == F.col("n_docs_b")) & (F.col("a") == F.col("b"))).alias("valid"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, doc_id, terms of what only one state has; terms sorted."""
    norm = lambda x: x.select("doc_id", F.array_sort("terms").alias("terms"))
    only = lambda x, y, side: norm(x).exceptAll(norm(y)).select(F.lit(side).alias("side"), "doc_id", "terms")
    return only(a, b, "a").unionByName(only(b, a, "b"))
