"""Ranked retrieval: candidates, scores of given documents and top k, for one query or many.

A query is a bag of terms in which repetition counts. Queries arrive as lists from the driver, or as a
DataFrame (query_id, qpos, term). Hits are (query_id, rank, doc_id, score), the best first, ties by
doc_id. Query terms join the postings and partial sums per (query, document) follow. Terms of a driver's
own queries are literals: they are pushed into the scan, and no term becomes a shuffle key. A large table of
queries is joined by term; adaptive execution splits the terms that many documents have. Top k per query
is a window with a group limit, pushed below the shuffle.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import EmptyIndexError, EmptyQueryError
from ..functions.scoring import (
    DIGITS, Bm25, Dirichlet, JelinekMercer, TfIdf, bm25_term, corpus_probability, finite, idf_smoothed, log_or_zero, smoothed_probability, tfidf_term,
)
from .index import LexicalIndex

HITS = "query_id long, rank int, doc_id long, score double"
QUERIES = "query_id long, qpos int, term string"

Params = Bm25 | TfIdf | JelinekMercer | Dirichlet

#: A query whose terms have more postings than this share of the documents is planned as a scan of all.
MAX_SHARE = 0.5
#: Terms that are pushed into a scan as literals.
MOST_LITERALS = 2_000
#: Pairs of a query and a document that one task of a batch scores at most, about.
PAIRS = 1 << 20
#: Terms of a batch's queries that are broadcast, some 100 bytes each; those of larger batches are joined by term.
MOST_BROADCAST = 1_000_000
#: A term with more postings than this, and than a 1024th of the documents, is joined in parts of about so many.
HOT_POSTINGS = 100_000


class Retriever(Protocol):
    """Anything that ranks documents for queries."""

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame: ...


def as_queries(spark: SparkSession, query: list[str] | dict[int, list[str]] | DataFrame) -> DataFrame:
    """One list of terms (query 0), lists by query id, or a DataFrame; null terms are dropped."""
    if isinstance(query, DataFrame):
        return query.select(F.col("query_id").cast("long").alias("query_id"), F.col("qpos").cast("int").alias("qpos"), "term").where(F.col("term").isNotNull())
    lists = query if isinstance(query, dict) else {0: query}
    if any(not terms for terms in lists.values()) or not lists:
        raise EmptyQueryError("a query has no terms")
    # as literals: they are the driver's own, and the optimiser can count them
    rows = [F.struct(F.lit(q).cast("long").alias("query_id"), F.lit(i).alias("qpos"), F.lit(t).alias("term")) for q, terms in lists.items() for i, t in enumerate(terms) if t is not None]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*rows)))) if rows else spark.createDataFrame([], QUERIES)


def _checked(index: LexicalIndex, spark: SparkSession, query: list[str] | dict | DataFrame, k: int) -> DataFrame | None:
    """The queries, or None if no hits are wanted. An empty query is told before an empty index."""
    queries = as_queries(spark, query)
    if isinstance(query, DataFrame) and not queries.take(1):
        raise EmptyQueryError("there are no query terms")
    if not index.scalars().n_docs:
        raise EmptyIndexError("the index has no documents")
    return queries if k > 0 else None


def _bags(queries: DataFrame) -> DataFrame:
    """query_id, term, m: how often each query has each term."""
    return queries.groupBy("query_id", "term").agg(F.count("*").alias("m"))


def plan_candidates(index: LexicalIndex, queries: DataFrame, max_share: float = MAX_SHARE) -> DataFrame:
    """query_id, n_postings, plan of every query: "postings", or "scan_all" if its terms have more postings than that share of all documents.

    Document frequencies tell how many postings a query would read, without reading them.
    """
    terms = queries.select("query_id", "term").distinct()
    read = terms.join(index.term_stats(queries).select("term", "df"), "term", "left").groupBy("query_id").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"))
    return read.withColumn("plan", F.when(F.col("n_postings") > F.lit(max_share * index.scalars().n_docs), "scan_all").otherwise("postings"))


def candidates(index: LexicalIndex, queries: DataFrame, max_share: float | None = None) -> DataFrame:
    """query_id, doc_id of every document with at least one of a query's terms.

    With ``max_share``, queries that ``plan_candidates`` finds too broad get all live documents instead, without a look at
    their postings. The result has no order of rows; ``orderBy("query_id", "doc_id")`` gives ids ascending.
    """
    if max_share is None:
        return index.postings(queries).join(queries.select("query_id", "term").distinct(), "term").select("query_id", "doc_id").distinct()
    broad, narrow = _by_plan(index, queries, max_share)
    return candidates(index, narrow).unionByName(broad.select("query_id").distinct().crossJoin(index.document_ids()))


def _by_plan(index: LexicalIndex, queries: DataFrame, max_share: float) -> tuple[DataFrame, DataFrame]:
    """The queries that scan all documents, and the others."""
    scanning = plan_candidates(index, queries, max_share).where("plan = 'scan_all'").select("query_id")
    return queries.join(scanning, "query_id", "left_semi"), queries.join(scanning, "query_id", "left_anti")


def _weighted(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """query_id, term, m, df, cf of the queries' terms; df and cf 0 for unseen ones."""
    bags = _bags(queries)
    stats = index.term_stats(queries) if index._term_stats is not None or index._only is not None else index.counted(queries).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    zero = F.lit(0).cast("long")
    return bags.join(stats, "term", "left").select("query_id", "term", "m", F.coalesce("df", zero).alias("df"), F.coalesce("cf", zero).alias("cf"))


def _term_score(index: LexicalIndex, p: Bm25 | TfIdf) -> Column:
    s = index.scalars()
    n, avg = F.lit(s.n_docs), F.lit(s.avg_doc_len)
    if isinstance(p, Bm25):
        return idf_smoothed(n, F.col("df")) * bm25_term(F.col("tf"), F.col("doc_len"), avg, p)
    return tfidf_term(F.col("tf"), n, F.col("df"), p)


def _dealt(index: LexicalIndex, queries: DataFrame) -> int:
    """To how many tasks a batch deals the documents, so that each has about PAIRS pairs; 0 if one will do or if its terms are too many to broadcast.

    No document is paired with more queries than there are, so the bound holds whatever the terms.
    """
    if index._only is not None:
        return 0
    asked = queries.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("terms")).first()
    parts = -(-index.scalars().n_docs * asked["queries"] // PAIRS)
    return parts if parts > 1 and asked["terms"] <= MOST_BROADCAST else 0


def _matched(index: LexicalIndex, queries: DataFrame, weighted: DataFrame) -> DataFrame:
    """Postings with the queries' terms (``weighted``).

    In a batch, documents are dealt to tasks by their number and that of the queries, and the terms go to all
    tasks: what a task adds up stays bounded, and only postings shuffle, not pairs. The driver's own terms go to the
    postings too, which stay where they are: else all postings of a term would meet in one task.

    In a stored index, terms with very many postings are cut into parts by document, and only their rows of
    ``weighted`` are repeated for each part. How many postings a term has is known before any is read, and
    at most 1024 terms for every term of an average document are that frequent.
    """
    if dealt := _dealt(index, queries):
        tasks = max(dealt, index.doc_stats().sparkSession.sparkContext.defaultParallelism)
        return index.counted(queries).repartition(tasks, "doc_id").join(F.broadcast(weighted), "term")
    postings = index.postings(queries)
    if index._only is not None:
        return postings.join(F.broadcast(weighted), "term")
    if index._term_stats is None:
        return postings.join(weighted, "term")
    cut = max(HOT_POSTINGS, index.scalars().n_docs // 1024)
    parts = F.ceil(F.col("df") / F.lit(cut)).cast("int")
    hot = index.term_stats(queries).where(F.col("df") > cut).select("term", parts.alias("parts"))
    dealt = postings.join(F.broadcast(hot), "term", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    return dealt.join(weighted.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))), ["term", "part"])


def _vector_scores(index: LexicalIndex, queries: DataFrame, p: Bm25 | TfIdf) -> DataFrame:
    """query_id, doc_id, score of BM25 or TF-IDF; documents without a contribution are left out."""
    joined = _matched(index, queries, _weighted(index, queries))
    scored = joined.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("m") * _term_score(index, p)), DIGITS).alias("score"))
    return scored.where((F.col("score") > 0) & finite(F.col("score")))


def _language_scores(index: LexicalIndex, queries: DataFrame, p: JelinekMercer | Dirichlet, mode: str, k: int | None = None) -> DataFrame:
    """query_id, doc_id, score of query likelihood; with ``k``, what the k best of each query are among.

    A document's score is what it would have without any of the terms, which depends on its length only,
    plus what the terms it has add. So no grid of terms and documents is made.
    """
    s = index.scalars()
    terms = _weighted(index, queries).withColumn("pc", corpus_probability(F.col("cf"), F.lit(s.total_len)))
    zero = F.lit(0).cast("long")
    if isinstance(p, JelinekMercer):
        lone = F.when(F.lit(p.weight) * F.col("pc") > 0, F.log(F.lit(p.weight) * F.col("pc"))).otherwise(F.lit(0.0))
        base = terms.groupBy("query_id").agg(F.sum(F.col("m") * lone).alias("fixed"), F.lit(0.0).alias("counted"))
        alone = F.col("fixed")
    else:
        seen = F.lit(p.mu) * F.col("pc") > 0
        lone = F.when(seen, F.log(F.lit(p.mu) * F.col("pc"))).otherwise(F.lit(0.0))
        base = terms.groupBy("query_id").agg(F.sum(F.col("m") * lone).alias("fixed"), F.sum(F.when(seen, F.col("m")).otherwise(zero)).cast("double").alias("counted"))
        alone = F.col("fixed") - F.when(F.col("counted") > 0, F.col("counted") * F.log(F.col("doc_len") + F.lit(p.mu))).otherwise(F.lit(0.0))
    having = log_or_zero(smoothed_probability(F.col("tf"), F.col("doc_len"), F.col("pc"), p))
    lacking = log_or_zero(smoothed_probability(zero, F.col("doc_len"), F.col("pc"), p))
    matched = _matched(index, queries, terms).groupBy("query_id", "doc_id").agg(F.first("doc_len").alias("doc_len"), F.sum(F.col("m") * (having - lacking)).alias("more"))
    final = F.round(alone + F.col("more"), DIGITS) + F.lit(0.0)
    of_matched = matched.join(F.broadcast(base) if _dealt(index, queries) else base, "query_id").select("query_id", "doc_id", final.alias("score"))
    # all documents stand for queries that no document matches, or for every query
    everyone = base if mode == "scan_all" else base.join(terms.where("df > 0").select("query_id").distinct(), "query_id", "left_anti")
    documents = index.doc_stats()
    if mode == "matching" and k is not None:
        # no document has any of the terms, so all score alike and the k smallest ids are the best
        documents = F.broadcast(documents.orderBy("doc_id").limit(k))
    spread = everyone.join(documents, F.lit(True))
    if mode == "scan_all":
        spread = spread.join(matched.select("query_id", "doc_id", "more"), ["query_id", "doc_id"], "left")
        return spread.select("query_id", "doc_id", (F.round(alone + F.coalesce("more", F.lit(0.0)), DIGITS) + F.lit(0.0)).alias("score")).where(finite(F.col("score")))
    rest = spread.select("query_id", "doc_id", (F.round(alone, DIGITS) + F.lit(0.0)).alias("score"))
    return of_matched.unionByName(rest).where(finite(F.col("score")))


def scores(index: LexicalIndex, queries: DataFrame, params: Params = Bm25(), candidate_mode: str = "matching", k: int | None = None) -> DataFrame:
    """query_id, doc_id, score of all candidates; with ``k``, at least those that the k best of each query are among.

    The candidates are the matching documents ("matching"), all ("scan_all") or what ``plan_candidates`` says ("planned").
    """
    if candidate_mode not in ("matching", "scan_all", "planned"):
        raise ValueError(f"no such candidate mode: {candidate_mode}")
    if isinstance(params, Bm25 | TfIdf):  # documents without a match score nothing, whatever the plan
        return _vector_scores(index, queries, params)
    if candidate_mode == "planned":
        broad, narrow = _by_plan(index, queries, MAX_SHARE)
        return _language_scores(index, broad, params, "scan_all", k).unionByName(_language_scores(index, narrow, params, "matching", k))
    return _language_scores(index, queries, params, candidate_mode, k)


def score_documents(index: LexicalIndex, queries: DataFrame, ids: DataFrame, params: Params = Bm25()) -> DataFrame:
    """query_id, doc_id, score of the given documents (doc_id), 0 where nothing matches."""
    some = ids.select("doc_id").distinct()
    narrowed = LexicalIndex(postings=index.postings(queries).join(some, "doc_id", "left_semi"), doc_stats=index.doc_stats(), term_stats=index.term_stats(queries))
    narrowed._scalars = index.scalars()
    if isinstance(params, Bm25 | TfIdf):
        found = scores(narrowed, queries, params)
        grid = some.crossJoin(queries.select("query_id").distinct())
        return grid.join(found, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return scores(narrowed, queries, params, "scan_all").join(some, "doc_id", "left_semi").select("query_id", "doc_id", "score")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query: query_id, rank, doc_id, score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def retrieve(index: LexicalIndex, query: list[str] | dict[int, list[str]] | DataFrame, k: int = 10, params: Params = Bm25(), candidate_mode: str = "matching", spark: SparkSession | None = None) -> DataFrame:
    """The k best documents of each query."""
    spark = spark or index.doc_stats().sparkSession
    queries = _checked(index, spark, query, k)
    if queries is None:
        return spark.createDataFrame([], HITS)
    if not isinstance(query, DataFrame):
        asked = {t for terms in (query.values() if isinstance(query, dict) else [query]) for t in terms if t is not None}
        index = index.restricted(list(asked)) if len(asked) <= MOST_LITERALS else index
    scored = scores(index, queries, params, candidate_mode, k)
    if isinstance(query, list):  # one query: a plain top k, without a shuffle by query
        best = scored.orderBy(F.desc("score"), F.asc("doc_id")).limit(k)
        return top_k(best, k)
    return top_k(scored, k)


class IndexRetriever:
    """A ``Retriever`` over one index with fixed parameters."""

    def __init__(self, index: LexicalIndex, params: Params = Bm25(), candidate_mode: str = "matching"):
        self.index, self.params, self.candidate_mode = index, params, candidate_mode

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieve(self.index, queries, k, self.params, self.candidate_mode)
