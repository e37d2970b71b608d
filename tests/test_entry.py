"""The registered queries against their SQL on the given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from termloom.plans import catalog

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not there")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(rows):
    norm = lambda x: round(x, 5) + 0.0 if isinstance(x, float) and math.isfinite(x) else x
    return sorted(repr(tuple(map(norm, r))) for r in rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", ["bm25_score_all_docs", "tfidf_score_all_docs", "term_frequency_all_docs", "document_length_all_docs"])
def test_every_document_is_looked_up(spark, name):
    ids = {r.doc_id for r in catalog.docs(spark, SF).select("doc_id").collect()}
    assert {r.doc_id for r in catalog.queries()[name](spark, SF).collect()} == ids


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sql, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sql.sql(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)
