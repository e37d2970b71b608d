"""Exact deduplication in two Bloom passes, with DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space became one space; a
null text counts as empty.

Pass one hashes every normalised text to a slot of a wide single-hash Bloom filter (SLOTS slots a
row) and finds the slots that were set more than once. Only slot numbers move. Pass two folds these
slots to a bit filter of bounded size and sends it to every task: a row whose bit is clear shares its
hash with no other row and passes straight through; only the others shuffle, are grouped by the whole
SHA-256 digest and get their group's smallest id. A fuller filter lets more rows shuffle; it never
changes the result.

Defined cases: ids that are null sort last (a group with no id at all keeps its rows). Rows that
repeat the smallest id of their group are that document again, and all count as kept in the
decisions; ``deduplicated`` returns one of them. Columns besides id and text are carried by
``deduplicated`` and ignored by ``decisions``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Store, bit_filter, lookup, maybe_in, power_of_two

#: Slots of the first filter for each row: one row in so many shuffles without need.
SLOTS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _repeated(signatures: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """The filter of slots that more than one row set, and the slot of a row with column ``__digest``."""
    slot = F.expr(f"pmod(xxhash64(__digest), {power_of_two(max(n, 1) * SLOTS)}L)")
    twice = signatures.groupBy(slot.alias("slot")).count().where("count > 1")
    return bit_filter(twice), slot


def _groups(suspects: DataFrame, id_col: str) -> DataFrame:
    return suspects.groupBy("__digest").agg(F.min(id_col).alias("keep_id"), F.count("*").alias("group_size"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    store = Store(docs.sparkSession, "exact-dedup")
    signed = store.put(docs.select(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("__digest")), "signatures")
    n = signed.count()
    words, slot = _repeated(signed, n)
    words = store.put(words.coalesce(1), "filter")
    flagged = maybe_in(signed, words, slot, "__suspect")
    single = flagged.where("not __suspect").select("id", "__digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    suspects = flagged.where("__suspect").select("id", "__digest")
    groups = store.put(_groups(suspects, "id"), "groups")
    found = lookup(suspects, groups, ["__digest"], "group_size", n)
    return single.unionByName(found.select(*single.columns)).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; straight-through rows never shuffle.

    In a group without any id, one of its rows stays.
    """
    store = Store(docs.sparkSession, "exact-dedup")
    signed = store.put(docs.select(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("__digest")), "signatures")
    words, slot = _repeated(signed, signed.count())
    words = store.put(words.coalesce(1), "filter")
    groups = store.put(_groups(maybe_in(signed, words, slot, "__suspect").where("__suspect"), "id"), "groups")
    # the row travels as one column, so that none of its names can clash
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("__digest"))
    whole = maybe_in(row, words, slot, "__suspect")
    single = whole.where("not __suspect").select("row.*")
    keep = groups.select("__digest", "keep_id")
    chosen = whole.where("__suspect").join(
        keep, (whole["__digest"] == keep["__digest"]) & whole["id"].eqNullSafe(keep["keep_id"]), "left_semi"
    )
    return single.unionByName(chosen.dropDuplicates(["__digest", "id"]).select("row.*"))
