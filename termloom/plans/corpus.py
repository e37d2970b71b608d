"""What the registered queries run over: tables, queries and op logs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import whitespace_tokens
from ..operators.index import LexicalIndex, tokenised

#: Queries of the catalog.
QUERY = ["the", "of", "and", "de"]
REPEATED = ["the", "the", "of", "der"]
UNSEEN = ["qqzzxx", "zzqqxx"]
#: Unknown spellings near frequent terms.
MISSPELT = ["thoution", "withe", "fromm", "the"]
#: Terms of few documents.
NARROW = ["Den", "Than"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"))


def index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    return LexicalIndex.build(docs(spark, sf_dir))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, qpos, term of all benchmark items."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.posexplode(whitespace_tokens(F.col("text"))).alias("qpos", "term"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An op log of the events: errors delete the user's document, anything else puts one in its place."""
    e = table(spark, sf_dir, "events")
    adds = F.col("event_type") != "error"
    terms = F.when(adds, whitespace_tokens(F.concat_ws(" ", "event_type", "props")))
    return e.select((F.col("event_id") + 1).alias("seq"), F.when(adds, "add").otherwise("delete").alias("op"), F.col("user_id").alias("doc_id"), terms.alias("terms"))
