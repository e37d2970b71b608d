"""Prefix sums over a table, without a window that holds all of it.

Rows are cut into stretches of WIDTH places; each stretch is summed up in a window of its own, the
totals of stretches are summed up in the same way, and every row adds what all stretches before its own
come to. Each level is WIDTH times smaller than the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16


def running(rows: DataFrame, place: str, n: int, sums: list[str], xors: list[str] = (), order: list[str] = (), width: int = WIDTH, inclusive: bool = True) -> DataFrame:
    """``rows`` with each column of ``sums`` and ``xors`` (longs) replaced by its total up to this row.

    ``place`` (0 to n - 1) tells the stretch; rows of one place are told apart by ``order``. Without
    ``inclusive``, totals are those before the row.
    """
    both = [*sums, *xors]
    stretch = f"{place}_"  # a name of its own on each level
    total = lambda c: F.sum(c) if c in sums else F.bit_xor(c)
    frame = Window.partitionBy(stretch).orderBy(place, *order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = F.lit(0).cast("long")
    cut = rows.withColumn(stretch, F.expr(f"{place} div {width}"))
    within = cut.select(*[c for c in cut.columns if c not in both], *(F.coalesce(total(c).over(frame), zero).alias(c) for c in both))
    if n <= width:
        return within.drop(stretch)
    totals = cut.groupBy(stretch).agg(*(total(c).alias(f"{c}_") for c in both))
    before = running(totals, stretch, -(-n // width), [f"{c}_" for c in sums], [f"{c}_" for c in xors], width=width, inclusive=False)
    known = before.select(F.col(stretch).alias("__key"), *(F.col(f"{c}_").alias(f"__{c}") for c in both))
    added = lambda c: (F.col(c) + F.col(f"__{c}") if c in sums else F.col(c).bitwiseXOR(F.col(f"__{c}"))).alias(c)
    return within.join(known, F.col(stretch) == F.col("__key")).select(*[F.col(c) for c in within.columns if c not in both and c != stretch], *map(added, both))


def _bounds(keys: DataFrame, key: str, n: int, width: int) -> list:
    """Where ranges of about ``width`` of the ``n`` keys begin, without the first; one number a range."""
    ranges = -(-n // width)
    if ranges < 2:
        return []
    return sorted(set(keys.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0]))


def _range_of(key: Column, bounds: list) -> Column:
    """How many bounds are not above the key, found by halves."""
    if not bounds:
        return F.lit(0).cast("long")
    table = F.from_json(F.lit(f"[{','.join(map(str, bounds))}]"), "array<bigint>")
    found = F.lit(0)
    for step in (1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)):
        found = F.get(F.transform(F.array(found), _halved(table, key, step)), F.lit(0))
    return found.cast("long")


def _halved(table: Column, key: Column, step: int):
    return lambda at: F.when(F.get(table, at + (step - 1)) <= key, at + step).otherwise(at)


def numbered(rows: DataFrame, key: str, n: int, name: str = "number", width: int = WIDTH) -> DataFrame:
    """``rows`` with their number in order of the column ``key`` (longs without repetition), from 1.

    Ranges come from stated bounds, not from a sample that each job takes anew, so a task that runs again
    gives the same numbers.
    """
    bounds = _bounds(rows.select(key), key, n, width)
    cut = rows.withColumn("__range", _range_of(F.col(key), bounds))
    placed = cut.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(key)))
    if not bounds:
        return placed.withColumn(name, F.col("__at").cast("long")).drop("__range", "__at")
    counts = running(cut.groupBy("__range").agg(F.count("*").alias("__before")), "__range", len(bounds) + 1, ["__before"], inclusive=False).withColumnRenamed("__range", "__r")
    return placed.join(counts, F.col("__range") == F.col("__r")).withColumn(name, F.col("__before") + F.col("__at")).drop("__range", "__r", "__at", "__before")
