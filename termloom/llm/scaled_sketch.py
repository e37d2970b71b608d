"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame functions only.

A text's shingles are its runs of WIDTH words (ASCII white space parts them, A-Z is lower-cased), each
hashed by MD5; a text of fewer words is one shingle. The sketch keeps every hash below a fixed fraction
of all hash values (1/8: those whose first hex digit is 0 or 1). The threshold is the same for every text, so
sketches grow with their texts, unions of sketches are sketches of unions, and the share of a small
document's hashes that a large one has estimates how much of it the large one contains. A text none of
whose shingles is below the threshold keeps its smallest hash alone, so short texts have a
fingerprint too; a union with anything below the threshold drops such hashes.

``edited`` holds every document against a changed copy of itself, whose last quarter is replaced by the
beginning of the next document in order of id. Documents are dealt to ranges of ids once, with their
sketches; each range also gets the first rows of the next one.

Defined cases: a null text is empty; a text without words has an empty sketch, whose fingerprint is the
empty string. Two empty sketches are alike (1), an empty and another are not (0); an empty text is wholly
contained in any. Rows that repeat an id stay rows of their own, next to each other, in order of their
text's hash. A row without an id has no place in the order and is its own next document. Texts of any
length are read whole. Columns besides id and text are ignored, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

#: Words of a shingle.
WIDTH = 5
#: The sketch keeps hashes below this in hex: one in 8.
THRESHOLD = "2"
#: Hex digits of a hash in a sketch (64 bits).
DIGITS = 16
#: Documents of a range of ids, and the most ranges; their bounds are all that comes to the driver.
RANGE_ROWS, MOST_RANGES = 4_000, 32_768

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    # a text of single bytes has no other capital letters than A-Z
    folded = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(folded, SPACE), "")


def _hashes(found: Column, width: int) -> Column:
    """The hashes of all shingles of an array of words, in order of place."""
    one = lambda i: F.substring(F.md5(F.array_join(F.slice(found, i, width), " ").cast("binary")), 1, DIGITS)
    return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(found) - (width - 1), F.lit(1))), one))


def _below(hashes: Column) -> Column:
    """A sketch of hashes: the distinct ones below the threshold, in order, or else the smallest."""
    below = F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < THRESHOLD)))
    alone = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
    return _let(below, lambda kept: F.when(F.size(kept) > 0, kept).otherwise(alone))


def sketch(text: Column, width: int = WIDTH) -> Column:
    """The sketch of a text that is not null: an array of hex strings."""
    return _let(words(text), lambda found: _let(_hashes(found, width), _below))


def fingerprint(sketched: Column) -> Column:
    """A sketch as one string."""
    return F.array_join(sketched, "")


def union(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return _below(F.array_union(a, b))


def merged(sketches: DataFrame, key: str, sketched: str = "sketch") -> DataFrame:
    """``key, hash``: the sketch of every key's rows together, one row a hash, so that no group is gathered."""
    found = sketches.select(key, F.explode(sketched).alias("hash")).distinct()
    below = F.col("hash") < THRESHOLD
    least = found.groupBy(key).agg(F.min("hash").alias("least")).withColumnRenamed(key, "__key")
    alone = least.where(F.col("least") >= THRESHOLD).select(F.col("__key").alias(key), F.col("least").alias("hash"))
    return found.where(below).unionByName(alone)


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two sketched texts."""
    return _let(_shared(a, b), lambda both: F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of the first text's shingles that the second has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(_shared(a, b) / F.greatest(F.size(a), F.lit(1)))


def _bounds(ids: DataFrame, rows: int) -> list[int]:
    """The smallest ids of ranges of about equal size, at most MOST_RANGES."""
    n = min(MOST_RANGES, max(1, -(-rows // RANGE_ROWS)))
    if n == 1:
        return [ids.agg(F.min("id")).first()[0]]
    cuts = ids.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10 * n).alias("cuts")).first().cuts
    at = ids.withColumn("bucket", _bucket(F.col("id"), sorted(set(cuts))))
    return sorted(r.low for r in at.groupBy("bucket").agg(F.min("id").alias("low")).collect())


def _table(numbers: list[int]) -> Column:
    return F.from_json(F.lit(f"[{','.join(map(str, numbers))}]"), "array<bigint>")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """The last place in ``bounds`` (ascending) of a bound that is not above the key, or -1: a search by halves."""
    steps = max(1, len(bounds).bit_length())
    table = _table(bounds)
    found = F.lit(-1)
    for step in (1 << k for k in range(steps - 1, -1, -1)):
        found = _let(found, _stepper(table, key, step))
    return found


def _stepper(table: Column, key: Column, step: int):
    return lambda at: F.when(F.get(table, at + step) <= key, at + step).otherwise(at)


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_edited, contained_next."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.where("id IS NOT NULL").select("id")
    n = ids.count()
    # text and sketch travel as one column, so that looking at the next row does not carry them twice
    sketched = rows.withColumn("sketch", sketch(F.col("text"), width)).select("id", F.struct("text", "sketch").alias("row"), F.xxhash64("text").alias("mark"))
    lone = sketched.where("id IS NULL").select("id", "row", F.col("row").alias("next"))
    if n:
        bounds = _bounds(ids, n)
        # the first rows of a range also stand at the end of the one before; those of the first, at the end of the last
        firsts = F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(bounds))).alias("bucket"), F.lit(True).alias("guest")))
        placed = sketched.where("id IS NOT NULL").withColumn("bucket", _bucket(F.col("id"), bounds))
        is_first = F.get(_table(bounds), F.col("bucket")) == F.col("id")
        dealt = placed.withColumn("at", F.explode(F.when(is_first, firsts).otherwise(F.slice(firsts, 1, 1)))).select("at.*", "id", "row", "mark")
        order = Window.partitionBy("bucket").orderBy("guest", "id", "mark")
        followed = dealt.withColumn("next", F.lead("row").over(order)).where("not guest")
        every = followed.select("id", "row", "next").unionByName(lone)
    else:
        every = lone
    every = every.select("id", "row.text", "row.sketch", "next")
    length = F.char_length("text")
    cut = F.floor(length / 4).cast("int")
    changed = F.concat(F.substr(F.col("text"), F.lit(1), length - cut), F.when(cut > 0, F.substr(F.col("next.text"), F.lit(1), cut)).otherwise(F.lit("")))
    made = every.select("id", length.cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), changed.alias("changed"))
    made = made.withColumn("changed_sketch", sketch(F.col("changed"), width))
    return made.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("changed_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("changed_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("changed_sketch")).alias("contained_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("contained_next"),
    )
