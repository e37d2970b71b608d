"""Expansion of unknown query terms by the similarity of their character n-grams.

Vocabulary and query terms meet in an equi-join on n-grams: no pair that shares nothing is ever made. A pair of
similarity t shares at least a t-th part of the term's n-grams, so it shares one of all but so many of them; only a
term's rarest n-grams are looked up, sizes that cannot reach t are left out, and what is left is compared in
full. A stored vocabulary is sorted by n-gram, so a lookup reads its own row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidFuzzyConfigError
from ..functions.text import char_grams
from .index import LexicalIndex
from .retrieve import as_queries, retrieve


@dataclass(frozen=True)
class FuzzyConfig:
    """``max_gram_df`` leaves out n-grams of more terms than that; None keeps expansion exact."""

    k: int = 3
    max_expansions: int = 8
    min_jaccard: float = 0.25
    max_gram_df: int | None = None


class FuzzyVocabulary:
    """term, gram, n_grams of every live term with at least one n-gram."""

    def __init__(self, grams: DataFrame, k: int):
        self.grams, self.k = grams, k

    @classmethod
    def of_terms(cls, terms: DataFrame, k: int = 3) -> FuzzyVocabulary:
        return cls(_grams(terms.select("term").distinct(), k), k)

    @classmethod
    def of_index(cls, index: LexicalIndex, k: int = 3) -> FuzzyVocabulary:
        return cls(_grams(index.terms(), k), k)

    def save(self, path: str) -> None:
        """Writes the vocabulary by n-gram."""
        self.grams.repartitionByRange("gram").sortWithinPartitions("gram", "term").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, k: int = 3) -> FuzzyVocabulary:
        return cls(spark.read.schema("term string, n_grams int, gram string").parquet(path), k)


def _grams(terms: DataFrame, k: int) -> DataFrame:
    if k < 1:
        raise InvalidFuzzyConfigError("n-grams need at least one character")
    # the outer array is a generator's, so that n-grams are made once a term and not for each of their uses
    made = terms.select("term", F.explode(F.array(char_grams(F.col("term"), k))).alias("grams")).withColumn("n_grams", F.size("grams"))
    return made.select("term", "n_grams", F.explode("grams").alias("gram"))


def overlaps(terms: DataFrame, vocabulary: FuzzyVocabulary, max_gram_df: int | None = None) -> DataFrame:
    """term, candidate, jaccard of all other vocabulary terms that share an n-gram with a term."""
    asked = _grams(terms.select("term").distinct(), vocabulary.k).withColumnRenamed("n_grams", "n_asked")
    known = vocabulary.grams.select(F.col("term").alias("candidate"), "gram", "n_grams")
    if max_gram_df is not None:
        frequent = known.groupBy("gram").count().where(F.col("count") > max_gram_df).select("gram")
        asked = asked.join(frequent, "gram", "left_anti")
    shared = known.join(asked, "gram").where(F.col("candidate") != F.col("term")).groupBy("term", "candidate").agg(F.count("*").alias("both"), F.first("n_asked").alias("n_asked"), F.first("n_grams").alias("n_grams"))
    return shared.select("term", "candidate", (F.col("both") / (F.col("n_asked") + F.col("n_grams") - F.col("both"))).alias("jaccard"))


def _pairs(terms: DataFrame, vocabulary: FuzzyVocabulary, min_jaccard: float) -> DataFrame:
    """term, candidate that may have that similarity: they share one of the term's rarest n-grams, and their sizes allow it."""
    asked = _grams(terms.select("term").distinct(), vocabulary.k).withColumnRenamed("n_grams", "n_asked")
    counted = vocabulary.grams.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("term").orderBy("df", "gram")
    # a hair less than the product, so that rounding never asks for one n-gram too many
    needed = F.ceil(F.col("n_asked") * min_jaccard - 1e-9)
    some = asked.join(counted, "gram").withColumn("place", F.row_number().over(rarest)).withColumn("seen", F.count("*").over(Window.partitionBy("term")))
    # n-grams that no candidate has are the rarest of all: they take places as well
    unseen = F.col("n_asked") - F.col("seen")
    kept = some.where(F.col("place") + unseen <= F.col("n_asked") - needed + 1).select("term", "gram", "n_asked")
    known = vocabulary.grams.select(F.col("term").alias("candidate"), "gram", "n_grams")
    fits = (F.col("n_grams") >= F.col("n_asked") * min_jaccard - 1e-9) & (F.col("n_grams") * min_jaccard - 1e-9 <= F.col("n_asked"))
    return known.join(kept, "gram").where(fits & (F.col("candidate") != F.col("term"))).select("term", "candidate").distinct()


def similar(terms: DataFrame, vocabulary: FuzzyVocabulary, min_jaccard: float) -> DataFrame:
    """term, candidate, jaccard of all other vocabulary terms of at least that similarity (above 0)."""
    a, b = char_grams(F.col("term"), vocabulary.k), char_grams(F.col("candidate"), vocabulary.k)
    sized = _pairs(terms, vocabulary, min_jaccard).select("term", "candidate", F.size(F.array_intersect(a, b)).alias("both"), F.size(a).alias("n_asked"), F.size(b).alias("n_grams"))
    return sized.select("term", "candidate", (F.col("both") / (F.col("n_asked") + F.col("n_grams") - F.col("both"))).alias("jaccard")).where(F.col("jaccard") >= min_jaccard)


def expand_terms(terms: DataFrame, vocabulary: FuzzyVocabulary, config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """term, rank, candidate, jaccard: the most similar known terms of each term, whether known itself or not."""
    if config.max_gram_df is None and config.min_jaccard > 0:
        near = similar(terms, vocabulary, config.min_jaccard)
    else:
        near = overlaps(terms, vocabulary, config.max_gram_df).where(F.col("jaccard") >= config.min_jaccard)
    order = Window.partitionBy("term").orderBy(F.desc("jaccard"), F.asc("candidate"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.max_expansions).select("term", "rank", "candidate", "jaccard")


def unknown_terms(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """The query terms that no live document has."""
    return queries.select("term").distinct().join(index.term_stats(queries), "term", "left_anti")


def expand_queries(index: LexicalIndex, vocabulary: FuzzyVocabulary, queries: DataFrame, config: FuzzyConfig = FuzzyConfig(), unknown: DataFrame | None = None) -> DataFrame:
    """query_id, qpos, term: each query's terms in order without repetition, then those its unknown terms expand to.

    ``unknown`` (term) are the unknown terms of the queries, where the caller has looked already. Settings
    are only looked at if a term is unknown.
    """
    unknown = unknown_terms(index, queries) if unknown is None else unknown
    if config.k < 1 and unknown.take(1):
        raise InvalidFuzzyConfigError("n-grams need at least one character")
    more = expand_terms(unknown, vocabulary, config)
    first = queries.select("query_id", F.lit(0).alias("later"), "qpos", F.lit(0).alias("rank"), "term")
    then = queries.join(more, "term").select("query_id", F.lit(1).alias("later"), "qpos", "rank", F.col("candidate").alias("term"))
    place = F.min(F.struct("later", "qpos", "rank")).alias("place")
    kept = first.unionByName(then).groupBy("query_id", "term").agg(place)
    order = Window.partitionBy("query_id").orderBy("place")
    return kept.select("query_id", (F.row_number().over(order) - 1).alias("qpos"), "term")


def fuzzy_retrieve(index: LexicalIndex, vocabulary: FuzzyVocabulary, query: list[str] | dict[int, list[str]] | DataFrame, k: int = 10, config: FuzzyConfig = FuzzyConfig(), spark: SparkSession | None = None, **how) -> DataFrame:
    """Top k of the expanded queries; expanded terms count in full.

    The driver's own queries come back to it expanded (at most ``max_expansions`` terms for each of theirs), so the
    expansion runs once and its terms are pushed into the scan.
    """
    spark = spark or index.doc_stats().sparkSession
    queries = as_queries(spark, query)
    if isinstance(query, DataFrame):
        return retrieve(index, expand_queries(index, vocabulary, queries, config), k, spark=spark, **how)
    # the driver's own terms: those that are unknown become literals, as the others are
    unknown = [F.lit(r.term) for r in unknown_terms(index, queries).collect()]
    few = spark.range(1).select(F.explode(F.array(*unknown)).alias("term")) if unknown else spark.createDataFrame([], "term string")
    expanded = expand_queries(index, vocabulary, queries, config, few)
    lists: dict[int, list[str]] = {}
    for r in expanded.orderBy("query_id", "qpos").collect():
        lists.setdefault(r.query_id, []).append(r.term)
    return retrieve(index, lists[0] if isinstance(query, list) and lists else lists, k, spark=spark, **how)
