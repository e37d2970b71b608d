"""What several operators share: stored tables, bounded filters, hot keys, links."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the contracts, as a regex class.
SPACE = r"[\x20\x09-\x0D]+"
#: A bit filter that is broadcast has at most so many blocks of so many 64-bit words: 8 MB, whatever the input's size.
FILTER_BLOCKS, BLOCK_WORDS = 1 << 14, 64
#: Rows of a table that needs no adaptive execution, and of one of its tasks.
SMALL, SMALL_TASK = 1 << 20, 1 << 17
#: A key is hot if it holds more than 1 / HOT of the rows; so at most HOT keys are.
HOT = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="termloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return f"file://{path}"


#: Rows and bytes of an Arrow batch: texts may be long, and a worker's memory must not depend on it.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


#: Folders of this process's stores.
_ROOTS: list[str] = []


class Store:
    """Tables that a job writes to the shared folder so that lost executors cost no recomputation.

    Results may read them, so they stay until ``release`` is called or, in the operators, ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet and returns the written table."""
        path = self.path(name)
        df.write.parquet(path)
        return self._read(df.sparkSession, path, df)

    def _read(self, session: SparkSession, path: str, like: DataFrame) -> DataFrame:
        out = session.read.schema(like.schema).parquet(path)
        out._stored_at = path
        return out

    def small(self, table: DataFrame, rows: int) -> DataFrame:
        """The stored table for rounds of many little jobs: if it has at most SMALL rows, in a session without adaptive execution and broadcasts.

        Both keep threads of the driver for a minute for every exchange, and there is nothing to split, to
        coalesce or to spare where all of a table is a few tasks.
        """
        if rows > SMALL:
            return table
        session = self.spark.newSession()
        session.conf.set("spark.sql.adaptive.enabled", "false")
        session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        session.conf.set("spark.sql.shuffle.partitions", str(1 + rows // SMALL_TASK))
        return self._read(session, table._stored_at, table)

    def usual(self, table: DataFrame) -> DataFrame:
        """The stored table in the store's own session."""
        return self._read(self.spark, table._stored_at, table)

    def put_seen(self, df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
        """As ``put``, and the aggregates ``sums`` of the rows, taken while they are written."""
        seen = Observation()
        return self.put(df.observe(seen, *(c.alias(n) for n, c in sums.items())), name), seen.get

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no returned plan reads any more."""
        for t in tables:
            self.delete(t._stored_at)

    def delete(self, path: str) -> None:
        _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Deletes all that operators of this process stored; results that were not written elsewhere are gone then."""
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_ROWS and BATCH_BYTES, unless the session asks for less."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def _place(slot: str) -> tuple[str, str, str]:
    """SQL for the block, the word in it and the bit in that word of a slot number."""
    return f"pmod({slot} div {64 * BLOCK_WORDS}, {FILTER_BLOCKS}L)", f"cast(pmod({slot} div 64, {BLOCK_WORDS}) as int)", f"shiftleft(1L, cast(pmod({slot}, 64) as int))"


def bit_filter(slots: DataFrame, slot: str = "slot") -> DataFrame:
    """Slot numbers as a bit filter: ``block, words`` with BLOCK_WORDS longs a row, at most FILTER_BLOCKS rows for any input."""
    block, at, bit = _place(slot)
    words = slots.groupBy(F.expr(block).alias("block"), F.expr(at).alias("at")).agg(F.bit_or(F.expr(bit)).alias("bits"))
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m"))
    return held.select("block", F.expr(f"transform(sequence(0, {BLOCK_WORDS - 1}), i -> coalesce(m[i], 0L))").alias("words"))


def maybe_in(df: DataFrame, words: DataFrame, slot: Column, flag: str) -> DataFrame:
    """Adds the boolean ``flag``: whether the filter has the slot's bit. False is certain, true is not.

    The blocks are broadcast: ``bit_filter`` bounds them, however large the input.
    """
    named = words.select(F.col("block").alias("__block"), F.col("words").alias("__words"))
    block, at, bit = _place("__slot")
    joined = df.withColumn("__slot", slot).join(F.broadcast(named), F.expr(block) == F.col("__block"), "left")
    hit = F.expr(f"coalesce(get(__words, {at}), 0L) & {bit}") != 0
    # without the outer coalesce Spark infers a filter that computes the slot once more
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__slot", "__block", "__words")


def lookup(rows: DataFrame, groups: DataFrame, key: list[str], size: str, n: int, how: str = "inner") -> DataFrame:
    """Joins ``rows`` with one-row-per-key ``groups``, whose column ``size`` counts the key's rows.

    Keys with more than n / HOT of the ``n`` rows (so at most HOT of them) are broadcast and their
    rows stay where they are; the rest is a shuffled join with no key above that share.
    """
    hot = F.col(size) * HOT > F.lit(int(n))
    few = F.broadcast(groups.where(hot))
    rest = rows.join(F.broadcast(groups.where(hot).select(*key)), key, "left_anti")
    return rows.join(few, key, "inner").unionByName(rest.join(groups.where(~hot), key, how))


def components(edges: DataFrame, store: Store) -> DataFrame:
    """Connected components of ``a, b`` (longs): ``node, root`` with the smallest node as root.

    Large-star and small-star rounds: each writes its edges, until a round changes nothing. Only sums come
    to the driver. A hub's edges are one key of the joins; adaptive execution splits such a key's rows.
    """
    now, seen = store.put_seen(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows=F.count("*"))
    now, state = store.small(now, seen["rows"]), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after, seen = store.put_seen(small, "stars", rows=F.count("*"), xor=F.bit_xor(F.xxhash64("a", "b")), sum=F.sum(F.hash("a", "b").cast("long")))
        store.drop(now)
        now = after
        if seen == state:
            break
        state = seen
    now = store.usual(now)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def split_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows where it is 2 are held out. Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(split_of(doc_id) == 2, F.lit(False))


def may_train(doc_id: Column) -> Column:
    """Rows that a model may learn from; rows without an id are not among them."""
    return F.coalesce(split_of(doc_id) != 2, F.lit(False))
