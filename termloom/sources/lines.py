"""Line corpora: text files read in parallel, lines numbered from 0.

A file is read in splits. Lines end at \\n, a \\r before it goes with it, and a last line end starts no new line. A
line's number is its place in its split plus the lines of all earlier splits, of which there is one count a
split; so no file has to fit into one row or one task. A corpus can be a folder: its files follow one another by path,
so that several tasks can write it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, whitespace_tokens
from ..operators.scan import running
from .files import Folder

#: Splits whose counts are broadcast: 64 bytes or so each, besides the path.
MOST_SPLITS = 50_000


def scanned(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line, file, start, at: lines with their split and their place in the task, which grows by 1 from line to line."""
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return rows.select(
        F.regexp_replace("value", r"\r\z", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")
    )


def _splits(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def _with_offsets(rows: DataFrame, offsets: DataFrame, few: bool) -> DataFrame:
    known = offsets.select(F.col("file").alias("__f"), F.col("start").alias("__s"), "first", "before")
    joined = rows.join(F.broadcast(known) if few else known, (F.col("file") == F.col("__f")) & (F.col("start") == F.col("__s")))
    return joined.select((F.col("before") + F.col("at") - F.col("first")).alias("pos"), "line", "file")


def _few(spark: SparkSession, folder: Folder, name: str) -> bool:
    """Whether the counts of all splits may be broadcast."""
    size, files = folder.size(name)
    of_split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return files + size // of_split + spark.sparkContext.defaultParallelism <= MOST_SPLITS


def _before(rows: DataFrame, order: str, *within: str) -> DataFrame:
    """``rows`` with ``before``, the sum of ``n`` over the rows that precede them."""
    frame = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("n").over(frame), F.lit(0)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos, line of a file, or of a folder's files as one sequence, in order of their paths."""
    rows = scanned(spark, path)
    splits = _splits(rows)
    files = _before(splits.groupBy("file").agg(F.sum("n").alias("n")), "file").select("file", F.col("before").alias("earlier"))
    inside = _before(splits, "start", "file")
    offsets = inside.join(files, "file").select("file", "start", "first", (F.col("before") + F.col("earlier")).alias("before"))
    return _with_offsets(rows, offsets, _few(spark, Folder(spark, path), "")).select("pos", "line")


def read_parts(spark: SparkSession, folder: Folder, name: str, parts: list[str] | None, last: int) -> DataFrame:
    """pos, line of numbered parts below ``name`` as one sequence; ``parts`` names some of them, ``last`` is the greatest number that counts.

    A part is a file ``<number>.json`` or a folder of that name whose files follow one another by name.
    """
    paths = folder.path(name) if parts is None else [folder.path(f"{name}/{p}") for p in parts]
    rows = scanned(spark, paths)
    number = F.regexp_extract("file", r"/(\d+)\.json(?:/[^/]*)?\z", 1).cast("long")
    splits = _splits(rows).select("file", "start", "first", F.col("n").alias("before"), number.alias("part")).where(F.col("part") <= last)
    offsets = running(splits, "part", last + 1, ["before"], order=["file", "start"], inclusive=False)
    return _with_offsets(rows, offsets, parts is not None and len(parts) < MOST_SPLITS or _few(spark, folder, name)).select("pos", "line")


def read_corpus(spark: SparkSession, path: str, tokenizer: Tokenizer = whitespace_tokens) -> DataFrame:
    """doc_id (line number), terms; blank lines are empty documents."""
    return read_lines(spark, path).select(F.col("pos").alias("doc_id"), tokenizer(F.col("line")).alias("terms"))
