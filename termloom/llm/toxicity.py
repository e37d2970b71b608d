"""Toxicity by nearest labelled examples: exact cosine of weighed TF-IDF in a block-max inverted index.

Features are a text's words (runs of letters, lower-cased). All those in the examples are the vocabulary, and
all weigh something: (1 + ln tf) * idf, times how much the word's presence says about the label, its
log-likelihood ratio. Without that factor the nearest examples are those of the same subject and language, whatever their
label, and votes tell little (figures in the README).

Examples stand in blocks of BLOCK, like by like. For each feature an inverted list holds the examples
that have it, block by block, with the largest weight in each block. A block's bound is the sum of the
query's weights times the block's maxima. The FIRST blocks by bound are summed up from their part of
the lists; of the others only those whose bound reaches the k-th best cosine by then, the rest of every list
is skipped. So the neighbours are exactly the k nearest; equals are all of one similarity, and the smaller id
goes first.

The k nearest vote with their cosine as weight, held towards the examples' share of label 1 by PRIOR
votes; a logistic curve fitted to the examples' own leave-one-out votes turns votes to scores. A document
that is an example has no vote on itself. All that voted are the evidence.

Learned from at most ``per_label`` examples of each label, those with the smallest hash of the id. In votes,
shares and calibration each example counts for as many as its label has for every one drawn.
Whole texts are used for learning and scoring.

Defined cases: texts without a vocabulary feature (null and empty ones among them) score what votes at
the examples' share for such texts come to; without any examples every score is 0. Ids that are null,
and labels without a document, are not learned from. If an example's label is given twice, 1 holds; if its
id has several texts, the smallest is learned from, once. Rows that repeat are scored each for itself. Columns
besides id and text are ignored, whatever their names. An empty table gives an empty result. The
session's Arrow batches are held to the library's limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, may_train, small_batches

#: Examples of each label at most.
PER_LABEL = 2000
NEIGHBOURS = 15
BLOCK = 64
PRIOR = 0.5
#: Blocks that are summed up before any is skipped.
FIRST = 6
THRESHOLD = 0.3

#: The least that a word's presence says: one that both labels have alike still weighs something.
LEAST = 1e-6

#: What stands between words: runs of anything but letters and numbers other than digits.
_GAP = r"[^\p{L}\p{Nl}\p{No}]+"


def _counted(texts: pa.Array, bases: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words in whole texts, a batch at a time.

    Numbers of the texts, in order, numbers of the words in ``bases`` (None: in all those found), how often
    each is there, and the bases.
    """
    pieces = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _GAP)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    coded = pieces.flatten().dictionary_encode()
    words = coded.dictionary
    if bases is None:
        bases = words.filter(pc.greater(pc.utf8_length(words), 0))
    number = pc.fill_null(pc.index_in(words, value_set=bases), -1).to_numpy(zero_copy_only=False)
    at = number[coded.indices.to_numpy(zero_copy_only=False)]
    key, n = np.unique((of * len(bases) + at)[at >= 0], return_counts=True)
    of, base = np.divmod(key, max(1, len(bases)))
    return of, base, n, bases


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its size says, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _telling(with_0: np.ndarray, with_1: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """What words in with_0 of n0 and with_1 of n1 texts say: their log-likelihood ratio; all alike, if there is one label only."""
    def part(k: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(p), 0) + np.where(n - k > 0, (n - k) * np.log1p(-p), 0)

    if not n0 or not n1:
        return np.ones(len(with_0))
    p = (with_0 + with_1) / (n0 + n1)
    ratio = 2 * (part(with_0, n0, with_0 / n0) + part(with_1, n1, with_1 / n1) - part(with_0, n0, p) - part(with_1, n1, p))
    return np.maximum(LEAST, np.round(ratio, 6))


class Neighbours:
    """Labelled examples, their block-max index and the calibration of votes.

    features, counts: the examples' features (numbers in ``vocabulary``) and how often each is there, one
    example after the other; cuts: where each begins, and the end.
    """

    def __init__(self, ids: list[int], features: np.ndarray, counts: np.ndarray, cuts: np.ndarray, labels: list[int], vocabulary: list[str], k: int = NEIGHBOURS, stands_for: tuple[float, float] = (1.0, 1.0)):
        self.k, self.vocabulary, n = k, vocabulary, len(ids)
        y = np.array(labels, dtype=np.float64)
        # labelled texts that each example stands for, on average one
        each = np.where(y > 0, stands_for[1], stands_for[0])
        each = each / each.mean() if n else each
        of = np.repeat(np.arange(n), np.diff(cuts))
        df = np.bincount(features, minlength=len(vocabulary)).astype(np.float64)
        with_1 = np.bincount(features, y[of], len(vocabulary))
        self.weight_of = (np.log((1 + n) / (1 + df)) + 1) * _telling(df - with_1, with_1, n - y.sum(), y.sum())
        w = (1 + np.log(counts.astype(np.float64))) * self.weight_of[features]
        features, w, of = features[w > 0], w[w > 0], of[w > 0]
        w = w / np.sqrt(np.bincount(of, w * w, n))[of]
        sizes = np.bincount(of, minlength=n)
        bare = sizes == 0
        # of texts without any feature: their own share of label 1
        self.share = float((each * y).mean()) if n else 0.0
        self.bare = float(((each * y)[bare].sum() + PRIOR * self.share) / (each[bare].sum() + PRIOR)) if n else 0.0
        # rows are examples that are alike side by side: in order of their label and strongest feature
        strongest = np.zeros(n, dtype=np.int64)
        last = np.lexsort((-features, w, of))[np.cumsum(sizes)[~bare] - 1]
        strongest[of[last]] = features[last]
        given = np.array(ids, dtype=np.int64)
        rows = np.lexsort((given, strongest, y))
        rows = rows[~bare[rows]]
        self.ids, self.labels, self.each = given[rows], y[rows], each[rows]
        self.row_of = {i: r for r, i in enumerate(self.ids.tolist())}
        where = _ranges((np.cumsum(sizes) - sizes)[rows], sizes[rows])
        feature, weight, sizes = features[where], w[where], sizes[rows]
        self._index(feature, weight, sizes)
        self.curve, self.read = (1.0, 0.0), None
        if 0 < self.labels.sum() < len(rows):
            self._calibrate(feature, weight, sizes)

    def _index(self, feature: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> None:
        n, v = len(self.ids), len(self.vocabulary)
        self.blocks = max(1, -(-n // BLOCK))
        order = np.argsort(feature, kind="stable")
        # the examples' weights, feature by feature and block by block
        self.rows = np.repeat(np.arange(n), sizes)[order]
        self.weights = weight[order]
        key = feature[order] * self.blocks + self.rows // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        # of each feature's blocks: number, where its rows start, how many they are, and the largest weight
        self.block_of, self.starts, self.sizes = key[first] % self.blocks, first, np.diff(np.append(first, len(key)))
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else np.empty(0)
        self.lists = np.searchsorted(key[first], np.arange(v + 1) * self.blocks)

    def vector(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and weights, of length one."""
        w = (1 + np.log(counts)) * self.weight_of[features]
        at, w = features[w > 0], w[w > 0]
        return at, w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples that share a feature; the row ``without`` is left out."""
        lengths = self.lists[at + 1] - self.lists[at]
        parts, x = _ranges(self.lists[at], lengths), np.repeat(w, lengths)
        block = self.block_of[parts]
        bound = np.bincount(block, x * self.most[parts], self.blocks)
        order = np.argsort(-bound, kind="stable")
        rows, scores, least = np.empty(0, np.int64), np.empty(0), 0.0
        for some in (order[:FIRST], order[FIRST:]):
            some = some[(bound[some] > 0) & (bound[some] >= least - 1e-9)]
            if not len(some):
                break
            asked = np.zeros(self.blocks, dtype=bool)
            asked[some] = True
            mine = np.flatnonzero(asked[block])
            sizes = self.sizes[parts[mine]]
            where = _ranges(self.starts[parts[mine]], sizes)
            got = np.bincount(self.rows[where], np.repeat(x[mine], sizes) * self.weights[where], len(self.ids))
            if without >= 0:
                got[without] = 0
            found = np.flatnonzero(got > max(0.0, least - 1e-9))
            rows, scores = np.concatenate((rows, found)), np.concatenate((scores, got[found]))
            if len(rows) > k:
                best = np.lexsort((self.ids[rows], -np.round(scores, 12)))[:k]
                rows, scores = rows[best], scores[best]
            if len(rows) == k:
                least = scores.min()
        return rows, scores

    def reader(self) -> "Reader":
        """The worker's own reader; its tasks share it."""
        if self.read is None:
            self.read = Reader(self)
        return self.read

    def _votes(self, rows: np.ndarray, scores: np.ndarray) -> float:
        scores = scores * self.each[rows]
        p = ((scores * self.labels[rows]).sum() + PRIOR * self.share) / (scores.sum() + PRIOR)
        return float(np.log(p / (1 - p))) if 0 < p < 1 else 20.0 * (1 if p >= 1 else -1)

    def _calibrate(self, feature: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> None:
        cuts = np.cumsum(sizes)[:-1]
        own = zip(np.split(feature, cuts), np.split(weight, cuts))
        x = np.array([self._votes(*self.nearest(at, w, self.k, without=i)) for i, (at, w) in enumerate(own)])
        y, u, at = self.labels, self.each, np.array(self.curve)
        x = np.stack((x, np.ones(len(x))), axis=1)
        # the curve that changes nothing is where it is held to
        loss = lambda c: (u * (np.logaddexp(0, x @ c) - y * (x @ c))).sum() + 0.05 * ((c - (1, 0)) ** 2).sum()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
            g = x.T @ (u * (p - y)) + 0.1 * (at - (1, 0))
            step = np.linalg.solve((x * (u * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), g)
            size = 1.0
            while size > 1e-6 and loss(at - size * step) > loss(at):
                size /= 2
            at = at - size * step
            if np.abs(size * step).max() < 1e-9:
                break
        if at[0] > 0 and np.isfinite(at).all():
            self.curve = (float(at[0]), float(at[1]))

    def score(self, features: np.ndarray, counts: np.ndarray, own_id: int | None = None) -> tuple[float, list[tuple[int, float, int]]]:
        """Score, and as evidence the examples that voted, the nearest first: id, cosine, label."""
        at, w = self.vector(features, counts)
        if not len(at) or not len(self.ids):
            return self.bare, []
        rows, scores = self.nearest(at, w, self.k, self.row_of.get(own_id, -1))
        z = self.curve[0] * self._votes(rows, scores) + self.curve[1]
        order = np.lexsort((self.ids[rows], -np.round(scores, 12)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), [(int(self.ids[rows[i]]), float(min(1.0, scores[i])), int(self.labels[rows[i]])) for i in order]


class Reader:
    """Counts the vocabulary's words in whole texts."""

    def __init__(self, model: Neighbours):
        self.words = pa.array(model.vocabulary, pa.string())

    def __call__(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the numbers of its words, and how often each is there."""
        of, words, n, _ = _counted(texts, self.words)
        cuts = np.searchsorted(of, np.arange(1, len(texts)))
        return list(zip(np.split(words, cuts), np.split(n, cuts)))


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, k: int = NEIGHBOURS) -> Neighbours:
    """The model from the labelled training rows.

    The driver gets at most 2 * ``per_label`` examples with the counts of all their features.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & may_train(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = []
    for label in (0, 1):
        chosen += known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect()
    if not chosen:
        return Neighbours([], np.empty(0, np.int64), np.empty(0), np.zeros(1, np.int64), [], [], k)
    picked = spark.createDataFrame([tuple(r) for r in chosen], known.schema)
    # bounded by per_label, whatever the input: one text for each id
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # each text by itself: its features are all it has
            for i in range(b.num_rows):
                _, base, n, bases = _counted(b.column(1).slice(i, 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([bases.take(pa.array(base))], pa.list_(pa.string())), pa.array([n], pa.list_(pa.int64()))], ["doc_id", "names", "counts"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(count, f"doc_id {kind}, names array<string>, counts array<long>").toArrow()
    rows = rows.sort_by("doc_id").combine_chunks()
    label = {r["doc_id"]: r["toxic"] for r in chosen}
    ids = rows["doc_id"].to_pylist()
    names = rows["names"].combine_chunks()
    cuts = names.offsets.to_numpy() - names.offsets[0].as_py()
    coded = names.flatten().dictionary_encode()
    counts = rows["counts"].combine_chunks().flatten().to_numpy()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    stands_for = tuple(totals.get(x, 0) / max(1, min(per_label, totals.get(x, 0))) for x in (0, 1))
    features = rank[coded.indices.to_numpy()] if len(order) else np.empty(0, np.int64)
    return Neighbours(ids, features, counts, cuts, [label[i] for i in ids], coded.dictionary.take(pa.array(order)).to_pylist(), k, stands_for)


def score(docs: DataFrame, model: Neighbours, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence (id, cosine and label of all that voted)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        read = known.reader()
        for b in batches:
            if not b.num_rows:
                continue
            said = [known.score(*found, i) for i, found in zip(b.column(0).to_pylist(), read(b.column(1)))]
            voters = list(zip(*chain.from_iterable(e for _, e in said))) or [(), (), ()]
            votes = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(voters, (pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "cosine", "toxic"])
            evidence = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(e) for _, e in said)]), pa.int32()), votes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in said], pa.float64()), evidence], ["doc_id", "score", "evidence"])

    made = given.mapInArrow(judge, f"doc_id {kind}, score double, evidence array<struct<doc_id: long, cosine: double, toxic: long>>")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def judge(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    return score(docs, learn(docs, labels, per_label))
