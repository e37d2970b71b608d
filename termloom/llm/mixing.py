"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words (runs of anything but ASCII white space). Sources in code
point order, null last, weigh ``weights`` in turn and share the words of all documents by weight; no
target exceeds ``cap`` times its source's size, and what is left over is shared again by weight.

Entropy balancing looks for document rates that meet every source's token constraint
sum(rate * size) = target and otherwise stay as near 1 as they can (least relative entropy, rates at
most ``cap``). The dual is convex with one multiplier for each source, and its solution tilts the rates
exponentially: rate = min(cap, exp(lambda * size / mean size)). Newton iterations, held within a
bracket, find the multipliers; each is one distributed sum over (source, size, documents) cells. Sums
are decimals, so reruns agree to the last bit.

Rates become whole copies by systematic rounding: a source's documents stand in order of falling size,
and each takes as many copies as the running sum of rates passes whole numbers. A source then misses
its target by about half its longest document at most, and no document gets more than ``cap`` copies.
Rates are fixed-point numbers, so neither partitions nor reruns change the result.

Defined cases: a null text has size 0 and takes nothing; a null source is a source; a source without
words has target 0. Rows that repeat an id count each for itself. Ids that are null sort first among
equals. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, lookup

WEIGHTS = (1, 2, 3)
CAP = 3
#: Fixed point of the rates.
UNIT = 1 << 24
#: Newton iterations at most; about ten are used. What is left then is solved by halving its bracket.
NEWTON, HALVINGS = 24, 64
#: Relative error at which a constraint counts as met.
CLOSE = 1e-10

_SOURCE = ["no_source", "src"]


def _sized(docs: DataFrame) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), words.alias("size"), F.xxhash64("text").alias("mark"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``no_source, src, source_size`` with the column ``target``."""
    turn = F.row_number().over(Window.orderBy(*_SOURCE)) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(turn, F.lit(len(weights))) + 1))
    # sources are capped from the smallest size for its weight on; the level is what a weight of 1 gets then
    order = Window.orderBy(F.col("source_size") / F.col("weight"), *_SOURCE)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ranked = weighed.withColumn("level", left / F.sum("weight").over(after))
    fits = F.when(cap * F.col("source_size") >= F.col("level") * F.col("weight"), F.col("level"))
    level = F.max(fits).over(everything)
    return ranked.withColumn("target", F.least(cap * F.col("source_size").cast("double"), F.col("weight") * F.coalesce(level, F.lit(0.0)))).drop("weight", "level")


def _tilted(cap: int) -> str:
    return f"least({float(cap)}D, exp(lambda * size / mean))"


def multipliers(cells: DataFrame, goals: DataFrame, store: Store, cap: int = CAP) -> DataFrame:
    """The dual's solution: ``goals`` with lambda. Stored tables; cells: source, size, n; goals: source, target, source_size, mean, least.

    What Newton iterations leave open is halved until its multiplier is known to the last bits of a double.
    """
    start = goals.withColumn("lambda", F.lit(0.0)).withColumn("met", F.expr("target <= 0"))
    # all rates are 1 at 0, so the multiplier lies between 0 and where every document has one bound
    start = start.withColumn("lo", F.expr("CASE WHEN target > 0 AND target < source_size THEN ln(target / source_size) * mean / least * 1.001 ELSE 0D END"))
    now = store.put(start.withColumn("hi", F.expr(f"CASE WHEN target > source_size THEN ln({cap}D) * mean / least * 1.001 ELSE 0D END")), "multipliers")
    for turn in range(NEWTON + HALVINGS):
        rate = F.expr(_tilted(cap))
        tried = cells.join(now.where("not met").select(*_SOURCE, "lambda", "mean"), _SOURCE).withColumn("rate", rate)
        sums = tried.groupBy(*_SOURCE).agg(
            F.sum(F.expr("cast(n * size * rate as decimal(38, 9))")).cast("double").alias("got"),
            F.sum(F.expr(f"cast(CASE WHEN rate < {cap} THEN n * size * rate * size / mean ELSE 0 END as decimal(38, 9))")).cast("double").alias("slope"),
        )
        step = now.join(sums, _SOURCE, "left").select(
            *[c for c in now.columns if c not in ("lambda", "met", "lo", "hi")],
            F.col("lambda").alias("old"), "got", "slope",
            F.expr("CASE WHEN got < target THEN lambda ELSE lo END").alias("lo"),
            F.expr("CASE WHEN got > target THEN lambda ELSE hi END").alias("hi"),
            F.expr(f"met OR abs(got - target) <= {CLOSE} * target OR hi - lo <= 1e-13 * abs(lambda)").alias("met"),
        )
        newton = F.expr("CASE WHEN slope > 0 THEN old - (got - target) / slope END")
        inside = F.when(F.lit(turn < NEWTON) & (newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        after = step.withColumn("lambda", F.when(F.col("met"), F.col("old")).otherwise(inside)).select(*now.columns)
        after, seen = store.put_seen(after, "multipliers", left=F.count(F.expr("nullif(met, true)")))
        store.drop(now)
        now = after
        if not seen["left"]:
            break
    return store.usual(now)


def _decided(docs: DataFrame, store: Store, weights: tuple[int, ...], cap: int) -> DataFrame:
    """doc_id, mark, source, size, source_size, target, copies of every row."""
    sized = store.put(_sized(docs), "sizes")
    n = sized.count()
    cells, seen = store.put_seen(sized.groupBy(*_SOURCE, "size").agg(F.count("*").alias("n")), "cells", rows=F.count("*"))
    cells = store.small(cells, seen["rows"])
    of_source = cells.groupBy(*_SOURCE).agg(
        F.sum(F.expr("n * size")).alias("source_size"), F.sum("n").alias("docs"),
        F.greatest(F.lit(1e-9), F.sum(F.expr("n * size")) / F.sum("n")).alias("mean"), F.coalesce(F.min(F.expr("nullif(size, 0)")), F.lit(1)).alias("least"),
    )
    solved = multipliers(cells, store.put(targets(of_source, weights, cap), "targets"), store, cap)
    rate = F.expr(f"CASE WHEN size > 0 THEN cast(round({_tilted(cap)} * {UNIT}) as long) ELSE 0L END")
    rated = lookup(sized, solved, _SOURCE, "docs", n).select("doc_id", "mark", *_SOURCE, "size", "source_size", "target", rate.alias("rate"), F.xxhash64("doc_id", "mark").alias("h"))
    ranged = rated.repartitionByRange(*_SOURCE, F.desc("size"), "h", "doc_id").withColumn("part", F.spark_partition_id())
    ranged = store.put(ranged, "ranged")
    # running sums: within a partition, and over the partitions before it
    each = ranged.groupBy(*_SOURCE, "part").agg(F.sum("rate").alias("sum"))
    earlier = Window.partitionBy(*_SOURCE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(*_SOURCE, "part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*_SOURCE, "part").orderBy(F.desc("size"), "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("to", F.sum("rate").over(within)).join(offsets, [*_SOURCE, "part"])
    whole = F.expr(f"(offset + to + {UNIT // 2}) div {UNIT} - (offset + to - rate + {UNIT // 2}) div {UNIT}")
    return placed.select("doc_id", "mark", *_SOURCE, "size", "source_size", "target", F.least(whole, F.lit(cap)).alias("copies"))


def decisions(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken."""
    out = _decided(docs, Store(docs.sparkSession, "mixing"), weights, cap)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns."""
    store = Store(docs.sparkSession, "mix")
    made = _decided(docs, store, weights, cap)
    ids, named = ["__id", "__mark", "__none", "__src"], ["doc_id", "mark", *_SOURCE]
    total = made.groupBy(*named).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0")
    total = store.put(total.select(*[F.col(a).alias(b) for a, b in zip(named, ids)], "__copies", "__rows"), "copies")
    rows = docs.withColumn("__hash", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(total["__id"]) & (rows["__hash"] == total["__mark"]) & (F.coalesce(rows["source"], F.lit("")) == total["__src"]) & (rows["source"].isNull() == total["__none"])
    joined = rows.join(total, same)
    once = joined.where("__rows = 1")
    # rows that are alike in id, text and source share their copies
    alike = joined.where("__rows > 1").dropDuplicates(ids)
    return once.unionByName(alike).withColumn("__copy", F.explode(F.expr("sequence(1L, __copies)"))).select(*docs.columns)
