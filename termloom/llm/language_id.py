"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A text's profile is its TOP most frequent letter n-grams (one to three letters, case folded, every
run of other characters one gap) in order of falling frequency. A language's profile is the same over
its training texts. The distance to a language sums, over the document's n-grams, how far out of
place each one is in the language's profile; an n-gram that is not there counts TOP places. The
nearest language wins, ties going to the first name.

Learned from at most ``per_language`` training texts of each language, those with the smallest hash of
the id; whole texts are used for training and for prediction.

Defined cases: a null text, or one without a letter, gives ``und`` and score 0; so does every text if
nothing could be learned. Texts with letters always get a learned language; of languages at equal
distance the first name, with score 0. Ids that are null are never trained on. Rows that repeat an id
count each for itself, in training too. Columns besides id, text and lang are ignored, whatever their
names; ``recognised`` carries them along. An empty table gives an empty result. The session's
Arrow batches are held to the library's limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import held_out, may_train, small_batches

#: N-grams in a profile.
TOP = 300
#: Training texts of each language at most.
PER_LANGUAGE = 1000
UNKNOWN = "und"
DRAWS = 1 << 30
_GUESS = StructType().add("lang_pred", StringType()).add("score", DoubleType())

_GAP = 0x20
_LETTERS: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Whether each code point of the basic plane is a letter; made once in a worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)
    return _LETTERS


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a text's n-grams of one to three letters, and how often each occurs."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _letter_table()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        letter[i] = chr(points[i]).isalpha()
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points[~letter] = _GAP
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    line = np.concatenate(([_GAP], points[keep], [_GAP]))
    if line[-2] == _GAP:
        line = line[:-1]
    two = line[:-1] << 21 | line[1:]
    three = (two[:-1] << 21 | line[2:])[line[1:-1] != _GAP]
    return np.unique(np.concatenate((line[line != _GAP], two, three)), return_counts=True)


def profile(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The ``top`` most frequent codes, the most frequent first; ties by code."""
    return codes[np.lexsort((codes, -counts))[:top]]


class Profiles:
    """The rank of every profiled n-gram in every language; small enough to go with each task."""

    def __init__(self, ranked: dict[str, list[int]], top: int = TOP):
        self.names, self.top = sorted(ranked), top
        self.codes = np.array(sorted({c for codes in ranked.values() for c in codes}), dtype=np.int64)
        # one row more for n-grams that no language has
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), top, dtype=np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, np.array(ranked[name], dtype=np.int64)), k] = np.arange(len(ranked[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and how clearly it is nearer than the next: 0 (a tie) to 1."""
        own = profile(*grams(text), self.top)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != own] = len(self.codes)
        there = self.ranks[at]
        out = np.where(there == self.top, self.top, np.abs(there - np.arange(len(own))[:, None])).sum(axis=0)
        order = np.argsort(out, kind="stable")
        if len(order) == 1:
            return self.names[0], float(1 - out[0] / (self.top * len(own)))
        near, far = out[order[0]], out[order[1]]
        return self.names[order[0]], float((far - near) / max(1, far))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, top: int = TOP) -> Profiles:
    """Profiles from the training rows of ``docs`` (doc_id, text, lang).

    The driver gets at most ``per_language`` ids and ``top`` n-grams for each language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    able = docs.where(F.col("lang").isNotNull() & may_train(F.col("doc_id")))
    # a hash cut at twice the wanted number for each language first, so that the ranking moves few rows
    drawn = able.select("doc_id", "lang", F.expr(f"pmod(xxhash64(doc_id), {DRAWS}L)").alias("draw"))
    totals = drawn.groupBy("lang").agg(F.count("*").alias("total"))  # a row per language, as in the profiles
    some = drawn.join(F.broadcast(totals), "lang").where(F.col("draw").cast("double") * F.col("total") <= 2.0 * per_language * DRAWS)
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    chosen = some.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    ids = [r[0] for r in chosen.select("doc_id").distinct().collect()]
    picked = spark.createDataFrame([(i,) for i in ids], able.select("doc_id").schema)
    texts = able.join(F.broadcast(picked), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {}
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(name, []).append(grams(text))
            for name, parts in found.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(sums)], ["lang", "code", "n"])

    counted = texts.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked: dict[str, list[int]] = {}
    for r in counted.withColumn("k", F.row_number().over(best)).where(F.col("k") <= top).orderBy("lang", "k").collect():
        ranked.setdefault(r["lang"], []).append(r["code"])
    return Profiles(ranked, top)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), ``lang_pred`` and ``score`` of the column ``text``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    at_text = docs.columns.index("text")
    given = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.column(0).slice(at, 512)
                said = [model.predict(t.as_py()) for t in part.field(at_text)]
                yield pa.RecordBatch.from_arrays([part, pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], ["row", "lang_pred", "score"])

    return given.mapInArrow(guess, StructType([*given.schema.fields, *_GUESS.fields]))


def recognised(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns."""
    return predict(docs, profiles).where(F.col("lang_pred") != UNKNOWN).select("row.*")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    said = predict(docs.select("doc_id", "text"), learn(docs, per_language))
    return said.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
