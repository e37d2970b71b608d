"""The inverted index as DataFrames.

docs         doc_id, terms             what an index is built from
postings     term, doc_id, tf, doc_len one row per term and live document
doc_stats    doc_id, doc_len           one row per live document, empty ones included
term_stats   term, df, cf
corpus_stats n_docs, total_len, avg_doc_len

The document's length rides along in postings, so that scoring needs no join on documents. Asking for
the postings of some terms restricts the tokens before they are grouped, so a query over raw documents
shuffles its own terms only. Where ids are unique, a row's terms are counted within the row (``counted``), so that
postings need no shuffle at all; where they are not, rows of one id are grouped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, whitespace_tokens

POSTINGS = "term string, doc_id long, tf long, doc_len long"
DOC_STATS = "doc_id long, doc_len long"
TERM_STATS = "term string, df long, cf long"


def tokenised(table: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Tokenizer = whitespace_tokens) -> DataFrame:
    """doc_id, terms of a table of texts."""
    return table.select(F.col(id_col).cast("long").alias("doc_id"), tokenizer(F.col(text_col)).alias("terms"))


def _array_length(terms: Column) -> Column:
    return F.coalesce(F.size(terms), F.lit(0)).cast("long")


def _once(docs: DataFrame) -> DataFrame:
    """``docs`` with terms that are made once a row: the optimiser copies an expression into all its uses, but not through a generator."""
    return docs.select("doc_id", F.explode(F.array("terms")).alias("terms"))


def _row_counts(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf, doc_len of each row by itself: the starts of equal terms in its sorted array tell how many there are."""
    whole = docs.select("doc_id", F.explode(F.array(F.sort_array(F.coalesce("terms", F.array().cast("array<string>"))))).alias("s")).where(F.size("s") > 0)
    new = lambda i: (i == 0) | ~F.get("s", i).eqNullSafe(F.get("s", i - 1))
    cut = whole.select("doc_id", "s", F.explode(F.array(F.filter(F.sequence(F.lit(0), F.size("s") - 1), new))).alias("b"))
    tf = lambda at, k: (F.coalesce(F.get("b", k + 1), F.size("s")) - at).cast("long")
    found = cut.select("doc_id", F.size("s").cast("long").alias("doc_len"), F.inline(F.transform("b", lambda at, k: F.struct(F.get("s", at).alias("term"), tf(at, k).alias("tf")))))
    return found.select("term", "doc_id", "tf", "doc_len")


@dataclass(frozen=True)
class CorpusStats:
    n_docs: int
    total_len: int
    avg_doc_len: float


class LexicalIndex:
    """An index over documents (built as it is asked) or over stored postings."""

    def __init__(self, *, docs: DataFrame | None = None, postings: DataFrame | None = None, doc_stats: DataFrame | None = None, term_stats: DataFrame | None = None):
        self._docs, self._postings, self._doc_stats, self._term_stats = docs, postings, doc_stats, term_stats
        self._scalars: CorpusStats | None = None
        self._only: list[str] | None = None
        self._unique: bool | None = None

    # -- making one

    @classmethod
    def empty(cls, spark: SparkSession) -> LexicalIndex:
        return cls.from_postings(spark.createDataFrame([], "term string, doc_id long, tf long"), spark.createDataFrame([], DOC_STATS))

    @classmethod
    def build(cls, docs: DataFrame, unique: bool | None = None) -> LexicalIndex:
        """From (doc_id, terms); a null array is an empty document. Ids are unique: see ``upsert`` for changes.

        ``unique`` says whether that is known; ``counted`` looks, if it is not told.
        """
        out = cls(docs=docs)
        out._unique = unique
        return out

    @classmethod
    def from_postings(cls, postings: DataFrame, doc_stats: DataFrame | None = None) -> LexicalIndex:
        """From (term, doc_id, tf) and, if there are empty documents, all documents' lengths."""
        if doc_stats is None:
            doc_stats = postings.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))
        if "doc_len" not in postings.columns:
            postings = postings.join(doc_stats, "doc_id")
        return cls(postings=postings.select("term", "doc_id", "tf", "doc_len"), doc_stats=doc_stats)

    def restricted(self, terms: list[str]) -> LexicalIndex:
        """The same index for someone who asks for these terms only: they are literals, so scans of stored tables skip all other row groups."""
        out = LexicalIndex(docs=self._docs, postings=self._postings, doc_stats=self._doc_stats, term_stats=self._term_stats)
        out._scalars, out._only = self.scalars(), sorted(set(terms))
        return out

    # -- tables

    def _of_terms(self, table: DataFrame) -> DataFrame:
        return table if self._only is None else table.where(F.col("term").isin(self._only))

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """term, doc_id, tf, doc_len; of the ``terms`` (term) only, if given."""
        wanted = None if terms is None or self._only is not None else terms.select("term").distinct()
        if self._postings is not None:
            held = self._of_terms(self._postings)
            return held if wanted is None else held.join(wanted, "term", "left_semi")
        measured = _once(self._docs).withColumn("doc_len", _array_length(F.col("terms")))
        tokens = self._of_terms(measured.select("doc_id", "doc_len", F.explode("terms").alias("term")))
        if wanted is not None:
            tokens = tokens.join(wanted, "term", "left_semi")
        return tokens.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))

    def counted(self, terms: DataFrame | None = None) -> DataFrame:
        """``postings``, counted row by row without a shuffle if they are made of documents with unique ids, which are looked at once."""
        if self._docs is None or self._only is not None:
            return self.postings(terms)
        if self._unique is None:
            self._unique = not self._docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").take(1)
        if not self._unique:
            return self.postings(terms)
        found = _row_counts(self._docs)
        return found if terms is None else found.join(terms.select("term").distinct(), "term", "left_semi")

    def doc_stats(self) -> DataFrame:
        if self._doc_stats is not None:
            return self._doc_stats
        return self._docs.select("doc_id", _array_length(F.col("terms")).alias("doc_len"))

    def term_stats(self, terms: DataFrame | None = None) -> DataFrame:
        """term, df, cf of terms in live documents."""
        if self._term_stats is not None:
            held = self._of_terms(self._term_stats)
            return held if terms is None or self._only is not None else held.join(terms.select("term").distinct(), "term", "left_semi")
        return self.postings(terms).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def corpus_stats(self) -> DataFrame:
        """One row: n_docs, total_len, avg_doc_len (0 without documents)."""
        return self.doc_stats().agg(
            F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_doc_len")
        )

    def scalars(self) -> CorpusStats:
        """The corpus statistics on the driver; one row, read once for an index."""
        if self._scalars is None:
            self._scalars = CorpusStats(*self.corpus_stats().first())
        return self._scalars

    # -- lookups

    def document_ids(self) -> DataFrame:
        return self.doc_stats().select("doc_id")

    def terms(self) -> DataFrame:
        """term of all live documents; over raw documents only terms shuffle, not postings."""
        if self._docs is not None:
            return self._of_terms(_once(self._docs).select(F.explode("terms").alias("term"))).distinct()
        return self.term_stats().select("term")

    def postings_list(self, term: str) -> DataFrame:
        """doc_id, tf of one term."""
        return self.postings().where(F.col("term") == term).select("doc_id", "tf")

    def term_frequency(self, pairs: DataFrame) -> DataFrame:
        """tf of every (doc_id, term) pair, 0 where the document lacks the term."""
        found = self.postings(pairs).select("term", "doc_id", "tf")
        return pairs.join(found, ["doc_id", "term"], "left").withColumn("tf", F.coalesce("tf", F.lit(0)))

    def document_frequency(self, terms: DataFrame) -> DataFrame:
        return terms.join(self.term_stats(terms).select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))

    def document_length(self, ids: DataFrame) -> DataFrame:
        """Length of every id, 0 for ids that are not there."""
        return ids.join(self.doc_stats(), "doc_id", "left").withColumn("doc_len", F.coalesce("doc_len", F.lit(0)))

    # -- changes: a new index, the old one stays

    def upsert(self, docs: DataFrame) -> LexicalIndex:
        """With ``docs`` (doc_id, terms) added or put in place of those with the same ids."""
        fresh = LexicalIndex.build(docs)
        kept = self.delete(docs)
        return LexicalIndex(
            postings=kept.postings().unionByName(fresh.postings()), doc_stats=kept.doc_stats().unionByName(fresh.doc_stats())
        )

    def delete(self, ids: DataFrame) -> LexicalIndex:
        """Without the documents ``ids`` (doc_id)."""
        gone = ids.select("doc_id").distinct()
        return LexicalIndex(postings=self.postings().join(gone, "doc_id", "left_anti"), doc_stats=self.doc_stats().join(gone, "doc_id", "left_anti"))

    def contains(self, ids: DataFrame) -> DataFrame:
        """The ids among ``ids`` that are live."""
        return ids.select("doc_id").distinct().join(self.doc_stats(), "doc_id", "left_semi")

    def bag(self) -> DataFrame:
        """doc_id, terms rebuilt from the postings; order within a document is lost."""
        repeated = self.postings().groupBy("doc_id").agg(F.flatten(F.collect_list(F.array_repeat(F.col("term"), F.col("tf").cast("int")))).alias("terms"))
        return self.doc_stats().select("doc_id").join(repeated, "doc_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
