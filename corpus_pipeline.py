"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All stages but the last return the columns of documents.

1. language_id drops documents without a recognisable language (no text, or no letter in it), also where no
   row has a language to learn from.
2. exact_dedup keeps one document of equal texts.
3. ngram_join keeps one document of each component of near copies: texts that have at least NEAR_PERCENT %
   of their shingles of NEAR_WIDTH words in common (op7 has settings of its own).
4. mix takes documents as often as balancing the sources asks for.
5. pack cuts what is left into sequences: one row per piece.

Defined cases: null and empty texts go in the first stage, texts of any length are read whole. Of equal texts the
smallest id stays, a null id only where no other is there; rows that repeat it are one document. Null sources are a
source of their own. Columns besides doc_id, text, lang and source are carried along, whatever their names, up to the
last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import exact_dedup, language_id, mixing, ngram_join, packing
from termloom.llm.common import Store

#: What near copies are: words of a shingle, and the least Jaccard similarity in %.
NEAR_WIDTH = 5
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language_id.learn(docs)
    if not profiles.names:  # nothing tells languages apart: whatever has a letter stays
        profiles = language_id.Profiles({"any": [0]})
    return language_id.recognised(docs, profiles)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_component(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Profiles, Newton iterations and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
