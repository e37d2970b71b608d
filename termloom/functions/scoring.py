"""Ranking formulas as column expressions, and their settings.

Every formula is one function of columns, so that a change of definition is one edit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores are rounded to so many decimals before they are compared: the order in which a cluster adds
#: floating-point numbers must not decide between equal documents.
DIGITS = 6


@dataclass(frozen=True)
class Bm25:
    """BM25. ``delta`` is added to the saturated term frequency of every matching term."""

    k1: float = 1.2
    b: float = 0.75
    delta: float = 0.0

    @classmethod
    def lower_bounded(cls, delta: float = 0.5, k1: float = 1.2, b: float = 0.75) -> Bm25:
        """BM25L in its simplified form."""
        return cls(k1, b, delta)

    @classmethod
    def plus(cls, delta: float = 1.0, k1: float = 1.2, b: float = 0.75) -> Bm25:
        """BM25+."""
        return cls(k1, b, delta)


@dataclass(frozen=True)
class TfIdf:
    """TF-IDF: term frequency "linear" or "log", inverse document frequency "standard" or "smoothed"."""

    tf: str = "log"
    idf: str = "standard"

    def __post_init__(self):
        if self.tf not in ("linear", "log") or self.idf not in ("standard", "smoothed"):
            raise ValueError(f"no such TF-IDF: {self}")

    @classmethod
    def linear(cls) -> TfIdf:
        return cls("linear", "standard")

    @classmethod
    def smoothed(cls) -> TfIdf:
        return cls("log", "smoothed")


@dataclass(frozen=True)
class JelinekMercer:
    """Document and corpus models mixed; ``weight`` is the corpus model's share."""

    weight: float = 0.5

    @classmethod
    def of(cls, weight: float) -> JelinekMercer:
        """With the weight held to 0..1."""
        return cls(min(1.0, max(0.0, weight)))


@dataclass(frozen=True)
class Dirichlet:
    """The corpus model as a prior worth ``mu`` tokens."""

    mu: float = 1000.0

    @classmethod
    def of(cls, mu: float) -> Dirichlet:
        """With mu held to 0 and above."""
        return cls(max(0.0, mu))


def idf_smoothed(n_docs: Column, df: Column) -> Column:
    """ln(1 + (N - df + 1/2) / (df + 1/2)), positive for any df; BM25's own."""
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def idf_standard(n_docs: Column, df: Column) -> Column:
    """ln(N / df), 0 for a term in every document."""
    return F.when(df > 0, F.log(n_docs.cast("double") / df)).otherwise(F.lit(0.0))


def tf_linear(tf: Column) -> Column:
    return tf.cast("double")


def tf_log(tf: Column) -> Column:
    return F.when(tf > 0, 1 + F.log(tf.cast("double"))).otherwise(F.lit(0.0))


def bm25_term(tf: Column, doc_len: Column, avg_len: Column, p: Bm25) -> Column:
    """The saturated, length-normalised term frequency with delta; 0 if documents have no length."""
    norm = p.k1 * (1 - p.b + p.b * F.try_divide(doc_len.cast("double"), avg_len))
    return F.coalesce(F.try_divide(tf * (p.k1 + 1), tf + norm) + p.delta, F.lit(0.0))


def tfidf_term(tf: Column, n_docs: Column, df: Column, p: TfIdf) -> Column:
    weight = idf_standard(n_docs, df) if p.idf == "standard" else idf_smoothed(n_docs, df)
    return (tf_linear(tf) if p.tf == "linear" else tf_log(tf)) * weight


def corpus_probability(cf: Column, total: Column) -> Column:
    """A term's share of all tokens; 0 if unseen or if there are no tokens."""
    return F.coalesce(F.try_divide(F.coalesce(cf, F.lit(0)).cast("double"), total.cast("double")), F.lit(0.0))


def smoothed_probability(tf: Column, doc_len: Column, p_corpus: Column, p: JelinekMercer | Dirichlet) -> Column:
    if isinstance(p, JelinekMercer):
        own = F.coalesce(F.try_divide(tf.cast("double"), doc_len.cast("double")), F.lit(0.0))
        return (1 - p.weight) * own + p.weight * p_corpus
    return F.coalesce(F.try_divide(tf + p.mu * p_corpus, doc_len + F.lit(p.mu)), F.lit(0.0))


def log_or_zero(p: Column) -> Column:
    """ln p; a probability of 0 contributes nothing."""
    return F.when(p > 0, F.log(p)).otherwise(F.lit(0.0))


def finite(score: Column) -> Column:
    return ~F.isnan(score) & (F.abs(score) < float("inf"))
