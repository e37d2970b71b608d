"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: vectors of length one, less the sample's mean, are projected on their leading components and
turned by iterative quantisation (Gong and Lazebnik, 2011), so that the signs lose as little as can
be; mean, projection and rotation are fitted on SAMPLE vectors, those with the smallest hash of the
id. The search radius is fitted there too: it is the Hamming distance within which sample queries
find all but MISSED of their true neighbours (in the whole table neighbours are nearer still).

Search: every vector is indexed. Shards of at most SHARD_ROWS vectors, dealt by a hash of the id, each
split their codes into SUBSTRINGS and keep one index for each. A code within radius r of the query is
within r / SUBSTRINGS of it in one substring at least, so probing the directory of each index for such
keys retrieves every code within r; the whole code then decides, and the floats of what is left are
ranked by their exact cosine in double precision. If a shard holds fewer than k codes within r, the
radius grows there until it has k or all. Queries visit the shards in batches, and the k best of all
shards are the result.

Defined cases: vectors that are null, zero, hold a null or a number that is not finite, are of another
length than most, or have no id take no part. Rows with a query's own id count as the query, and of
several rows with one id one (by a hash of the vector) is indexed. Equal scores go to the
smaller id. Columns besides id and vector are ignored, whatever their names. An empty table gives an empty
result. The number of cores never changes a result. The session's Arrow batches are held to the library's
limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Vectors that projection, rotation and radius are fitted on, at most.
SAMPLE = 4096
SAMPLE_QUERIES = 256
#: Share of true neighbours in the sample that may lie outside the radius.
MISSED = 0.01
BITS = 64
SUBSTRINGS = 4
#: Vectors of a shard, on average: a 32nd of the table, but at least and at most these.
LEAST_ROWS, SHARD_ROWS = 4096, 65_536
QUERY_EVERY = 50
NEIGHBOURS = 5


@dataclass
class Coder:
    """Turns vectors to codes of up to 64 bits."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        bits = ((unit - self.mean) @ self.turn) > 0
        wide = np.zeros((len(unit), BITS), dtype=np.uint8)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1).view(np.uint64).ravel()


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, k: int = NEIGHBOURS, missed: float = MISSED, rounds: int = 40) -> Coder:
    """Projection, rotation and radius from sample vectors (rows)."""
    unit = unit_rows(sample)
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, _, parts = np.linalg.svd(centred, full_matrices=False)
    down = parts[: min(BITS, len(parts))].T
    flat = centred @ down
    turn = np.linalg.qr(np.random.default_rng(8).normal(size=(flat.shape[1],) * 2))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (left @ right).T
    coder = Coder(mean, down @ turn, BITS)
    codes, asked = coder.codes(unit), np.arange(min(SAMPLE_QUERIES, len(unit)))
    near = unit[asked] @ unit.T
    near[asked, asked] = -np.inf
    if len(unit) > k:
        best = np.argpartition(-near, k, axis=1)[:, :k]
        far = np.bitwise_count(codes[asked, None] ^ codes[best])
        coder.radius = int(np.quantile(far, 1 - missed, method="higher"))
    return coder


class Shard:
    """The substring indexes of one shard."""

    def __init__(self, coder: Coder, ids: np.ndarray, vectors: np.ndarray):
        ids, first = np.unique(ids, return_index=True)
        vectors = vectors[first]
        self.coder, self.ids, self.vectors = coder, ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.codes = coder.codes(vectors / self.norms[:, None])
        # for each substring: its distinct keys, how many rows have each, and these rows side by side
        self.tables = []
        for keys in self._substrings(self.codes):
            order = np.argsort(keys, kind="stable")
            values, sizes = np.unique(keys[order], return_counts=True)
            self.tables.append((values, sizes, order))

    @staticmethod
    def _substrings(codes: np.ndarray) -> list[np.ndarray]:
        width = BITS // SUBSTRINGS
        return [(codes >> np.uint64(width * j)) & np.uint64((1 << width) - 1) for j in range(SUBSTRINGS)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose code is within ``radius`` of ``code`` (one element)."""
        found = np.zeros(len(self.codes), dtype=bool)
        for (values, sizes, order), own in zip(self.tables, self._substrings(code)):
            hit = np.bitwise_count(values ^ own[0]) <= radius // SUBSTRINGS
            found[order[np.repeat(hit, sizes)]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code[0]) <= radius]

    def nearest(self, query_id: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the ``k`` best rows found for the query."""
        norm = np.sqrt((vector * vector).sum())
        code, radius = self.coder.codes((vector / norm)[None, :]), self.coder.radius
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != query_id]
            if len(rows) >= k or radius >= BITS:
                break
            radius = min(BITS, radius + SUBSTRINGS)
        score = (self.vectors[rows] * vector).sum(axis=1) / (self.norms[rows] * norm)
        if len(rows) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            kept = score >= least
            rows, score = rows[kept], score[kept]
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[order]], score[order]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    finite = F.expr(f"NOT exists({vec_col}, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists({vec_col}, x -> x <> 0)")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (usual["d"] if usual else 0))


def search(vectors: DataFrame, queries: str = f"id % {QUERY_EVERY} = 0", k: int = NEIGHBOURS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest rows to each row that ``queries`` (SQL on id) picks."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = _valid(vectors, id_col, vec_col)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["vector"].combine_chunks()
    schema = "query_id long, vec_id long, score double"
    if not len(sample):
        found = spark.createDataFrame([], schema)
    else:
        sent = spark.sparkContext.broadcast(fit(_matrix(sample), k))
        # by the rows alone, so that neither cores nor partitions change the result
        n = rows.count()
        shards = -(-n // min(SHARD_ROWS, max(LEAST_ROWS, n // 32)))
        own = rows.select(F.expr(f"pmod(xxhash64(id), {shards}L)").alias("shard"), F.lit(0).alias("asks"), "id", "vector")
        asked = rows.where(queries).select(F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), F.lit(1).alias("asks"), "id", "vector")
        units = own.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "id", F.xxhash64("vector"))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ids, parts, index = None, [], [], None
            for b in batches:
                shard, asks = b.column(0).to_numpy(), b.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), b.num_rows]
                for s, e in zip(cuts, cuts[1:]):
                    if e == s:
                        continue
                    if shard[s] != at:
                        at, ids, parts, index = shard[s], [], [], None
                    own_ids, own_rows = b.column(2).slice(s, e - s).to_numpy(), _matrix(b.column(3).slice(s, e - s))
                    if not asks[s]:
                        ids.append(own_ids)
                        parts.append(own_rows)
                        continue
                    if index is None and ids:
                        index = Shard(sent.value, np.concatenate(ids), np.concatenate(parts))
                        ids, parts = [], []
                    if index is None:
                        continue
                    got = [index.nearest(i, v, k) for i, v in zip(own_ids, own_rows)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(own_ids, [len(x) for x, _ in got])), pa.array(np.concatenate([x for x, _ in got])), pa.array(np.concatenate([y for _, y in got]))],
                        ["query_id", "vec_id", "score"],
                    )

        found = units.mapInArrow(visit, schema)
    # a query whose row is repeated finds the same neighbours again
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
