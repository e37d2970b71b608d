"""The corpus pipeline, stage by stage, against plain versions; the SQL of exact deduplication."""

import os
import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from termloom.llm import language_id, mixing, packing, queries

SF = "/root/testdata/sf0.001"


def documents(rng):
    words = {"en": ["the", "house", "with", "window", "thing", "north"], "de": ["und", "haus", "mit", "fenster", "ding", "nord"]}
    rows = []
    for k in range(60):
        lang = ("en", "de")[k % 2]
        text = " ".join(rng.choice(words[lang]) + str(rng.randrange(9)) * (rng.random() < 0.3) for _ in range(rng.randrange(30, 120)))
        rows.append((k, text, lang, f"s{k % 3}", len(text)))
    rows += [(100 + k, rows[k][1].replace(" ", "  "), rows[k][2], "s0", 1) for k in range(10)]
    rows += [(200 + k, rows[20 + k][1] + " end", rows[20 + k][2], "s1", 1) for k in range(5)]
    rows += [(300, None, "en", "s0", 0), (301, "12 34", "de", None, 5), (302, "", None, "s2", 0)]
    rng.shuffle(rows)
    return rows


def test_stages(spark, tmp_path):
    rows = documents(random.Random(3))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf_dir = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{sf_dir}/documents.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}")
        ids[name] = Counter(r.doc_id for r in docs.collect())
    assert set(ids["language_id"]) == {r[0] for r in rows} - {300, 301, 302}
    assert set(ids["exact_dedup"]) == set(ids["language_id"]) - set(range(100, 110))
    assert set(ids["ngram_join"]) == set(ids["exact_dedup"]) - set(range(200, 205)) and set(ids["ngram_join"].values()) == {1}
    deduplicated = spark.read.schema(schema).parquet(f"{tmp_path}/ngram_join")
    assert ids["mix"] == Counter({r.doc_id: r.copies for r in mixing.decisions(deduplicated).collect() if r.copies})
    tokens = Counter()
    for r in before.collect():
        tokens[r.doc_id] += len(packing.word_ids(packing.tokenizer_path()).whole(r.text)) // 4 + 1
    packed = Counter()
    for r in docs.collect():
        packed[r.doc_id] += r.length
    assert packed == tokens
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_texts_stay_if_no_language_is_known(spark):
    rows = [(1, "the house", None), (2, "ß", None), (3, None, None), (4, "12 34", None), (5, "", None), (6, "\u4e2d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {1, 2, 6}


def test_stages_on_an_empty_table_and_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score string, suspect string, row string, maybe string"
    rows = [(1, "the house with " * 9, "en", "a", 1, "p", "q", "r", "s", "t"), (2, "the  house with " * 9, "en", None, 1, "P", "Q", "R", "S", "T"), (3, None, "de", "a", 0, *"vwxyz"), (4, "word " * 30_000, "en", "a", 1, *"klmno")]
    for k, given in enumerate(([], rows)):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{k}-{name}")
        assert {tuple(r) for r in docs.collect()} <= set(given) and {r.doc_id for r in docs.collect()} <= {1, 4}
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0) == bool(given)


def test_near_copies_near_the_border(spark):
    """Copies on both sides of 80 % of 5-word shingles, against brute force."""
    rng, texts = random.Random(5), []
    for k, changed in enumerate([1, 2, 2, 2, 3, 3]):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        other = list(words)
        for at in rng.sample(range(5, 95), changed):
            other[at] = f"x{rng.randrange(5000)}"
        texts += [" ".join(words), " ".join(other)]
    for more in (40, 44, 48, 49, 50, 60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200 + more)]
        texts += [" ".join(words[:200]), " ".join(words)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[a] if r == root[b] else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == sorted({min(i for i in range(len(texts)) if root[i] == r) for r in root})
    assert {1, 3, 15} & set(kept) != {1, 3, 15} and len(texts) // 2 < len(kept) < len(texts)


def test_near_copies_go_by_row(spark):
    """Rows of one id and rows without an id, against brute force: links are a row's own."""
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(2, a), (5, f"{a} more"), (5, b), (7, c), (None, f"{c} more"), (None, d), (None, f"{d} more"), (None, d), (9, e), (9, f"{e} more"), (9, e.replace("w", "W")), (None, None), (3, ""), (3, ""), (4, f"{b} x y")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, mark string").repartition(4)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    near = lambda t: next((n for n, x in enumerate((a, b, c, d, e)) if t and t.lower().startswith(x)), None)
    groups = Counter(near(t) for _, t in kept)
    assert groups == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, None: 3}  # one of each component; rows without words all stay
    assert {near(t): i for i, t in kept if near(t) is not None} == {0: 2, 1: 4, 2: 7, 3: None, 4: 9}
    assert (2, a) in kept and (7, c) in kept and not any(i is None and near(t) == 2 for i, t in kept)


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not there")
def test_exact_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.op9_exact_dedup(spark, SF)
    columns = ", ".join(sorted(df.columns))
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(con.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op9_exact_dedup']})").fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not there")
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in said) >= 0.95 * len(said)
