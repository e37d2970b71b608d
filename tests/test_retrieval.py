import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import termloom.operators.retrieve
from termloom.errors import EmptyIndexError, EmptyQueryError, InvalidFuzzyConfigError
from termloom.functions.scoring import Bm25, Dirichlet, JelinekMercer, TfIdf
from termloom.operators import fuzzy
from termloom.operators.index import LexicalIndex, tokenised
from termloom.operators.retrieve import IndexRetriever, as_queries, candidates, plan_candidates, retrieve, score_documents
from termloom.sources import snapshot

DOCS = "doc_id long, terms array<string>"


def index_of(spark, docs):
    return LexicalIndex.build(spark.createDataFrame(docs, DOCS))


def hits(df):
    return [(r.doc_id, r.score) for r in df.orderBy("query_id", "rank").collect()]


def same(got, want):
    return [d for d, _ in got] == [d for d, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)


def brute(docs, query, p, scan_all=False):
    """Scores one document at a time from the formulas."""
    n, total = len(docs), sum(len(t) for _, t in docs)
    avg = total / n
    df, cf = Counter(), Counter()
    for _, t in docs:
        df.update(set(t))
        cf.update(t)
    out = []
    for i, terms in docs:
        tf, s = Counter(terms), 0.0
        if isinstance(p, Bm25 | TfIdf):
            for q in query:
                if not tf[q]:
                    continue
                if isinstance(p, Bm25):
                    idf = math.log(1 + (n - df[q] + 0.5) / (df[q] + 0.5))
                    s += idf * (tf[q] * (p.k1 + 1) / (tf[q] + p.k1 * (1 - p.b + p.b * len(terms) / avg)) + p.delta)
                else:
                    idf = math.log(n / df[q]) if p.idf == "standard" else math.log(1 + (n - df[q] + 0.5) / (df[q] + 0.5))
                    s += (tf[q] if p.tf == "linear" else 1 + math.log(tf[q])) * idf
            if round(s, 6) > 0:
                out.append((i, round(s, 6)))
            continue
        if not scan_all and not any(tf[q] for q in query) and any(df[q] for q in query):
            continue
        for q in query:
            pc = cf[q] / total if total else 0.0
            if isinstance(p, JelinekMercer):
                pr = (1 - p.weight) * (tf[q] / len(terms) if terms else 0) + p.weight * pc
            else:
                pr = (tf[q] + p.mu * pc) / (len(terms) + p.mu) if len(terms) + p.mu else 0.0
            s += math.log(pr) if pr > 0 else 0.0
        out.append((i, round(s, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


PARAMS = [Bm25(), Bm25.lower_bounded(), Bm25.plus(), Bm25(2.0, 0.0), TfIdf(), TfIdf.linear(), TfIdf.smoothed(), TfIdf("linear", "smoothed"), JelinekMercer(), JelinekMercer.of(0.0), JelinekMercer.of(9.0), Dirichlet(), Dirichlet.of(-4.0), Dirichlet.of(3.0)]


@pytest.mark.parametrize("params", PARAMS, ids=str)
def test_scores_match_brute_force(spark, params):
    rng = random.Random(5)
    docs = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 9))]) for i in range(25)]
    for query in (["a"], ["a", "a", "c", "zz"], ["b", "h", "g"]):
        want = brute(docs, query, params)[:7]
        got = hits(retrieve(index_of(spark, docs), query, 7, params, spark=spark))
        assert [d for d, _ in got] == [d for d, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.lists(st.sampled_from("abc"), max_size=5), min_size=1, max_size=6), query=st.lists(st.sampled_from("abcd"), min_size=1, max_size=4))
def test_any_small_corpus(spark, data, query):
    docs = list(enumerate(data))
    if not any(data):
        assert hits(retrieve(index_of(spark, docs), query, 5, spark=spark)) == []
        return
    assert same(hits(retrieve(index_of(spark, docs), query, 20, spark=spark)), brute(docs, query, Bm25()))


def test_scan_all_ranks_every_document(spark):
    docs = [(1, ["a", "b"]), (2, ["c"]), (3, [])]
    assert same(hits(retrieve(index_of(spark, docs), ["a"], 10, Dirichlet.of(10), "scan_all", spark)), brute(docs, ["a"], Dirichlet.of(10), True))
    assert [d for d, _ in hits(retrieve(index_of(spark, docs), ["a"], 10, Dirichlet.of(10), spark=spark))] == [1]
    with pytest.raises(ValueError):
        retrieve(index_of(spark, docs), ["a"], 10, Dirichlet(), "some", spark)


def test_ties_go_to_the_smaller_id_also_at_the_boundary(spark):
    assert [d for d, _ in hits(retrieve(index_of(spark, [(2, ["a", "x"]), (1, ["a", "x"])]), ["a"], spark=spark))] == [1, 2]
    docs = [(1, ["a", "x", "y"]), (2, ["a", "x", "y"]), (3, ["a", "a", "a"]), (4, ["z"])]
    assert [d for d, _ in hits(retrieve(index_of(spark, docs), ["a"], 2, spark=spark))] == [3, 1]
    assert [d for d, _ in hits(retrieve(index_of(spark, [(2, ["a", "b"]), (1, ["a", "b"])]), ["a"], 10, Dirichlet(), spark=spark))] == [1, 2]


def test_ubiquitous_and_unseen_terms(spark):
    i = index_of(spark, [(1, ["a"]), (2, ["a", "b"])])
    assert hits(retrieve(i, ["a"], 10, TfIdf(), spark=spark)) == []
    assert len(hits(retrieve(i, ["a"], 10, Bm25(), spark=spark))) == 2
    assert hits(retrieve(i, ["zz"], 10, Bm25(), spark=spark)) == []
    assert hits(retrieve(i, ["zz"], 10, Dirichlet(), spark=spark)) == [(1, 0.0), (2, 0.0)]


def test_guards_come_in_order(spark):
    full, none = index_of(spark, [(1, ["a"])]), LexicalIndex.empty(spark)
    with pytest.raises(EmptyQueryError):
        retrieve(none, [], 0, spark=spark)
    with pytest.raises(EmptyIndexError):
        retrieve(none, ["a"], 0, spark=spark)
    assert hits(retrieve(full, ["a"], 0, spark=spark)) == []
    assert hits(retrieve(index_of(spark, [(1, []), (2, None)]), ["a"], spark=spark)) == []


def test_batch_equals_single_queries(spark):
    docs = [(i, list(t)) for i, t in enumerate(["abca", "bcd", "aad", "dd", ""])]
    i = index_of(spark, docs)
    batch = retrieve(i, {7: ["a", "d"], 9: ["b"]}, 2, spark=spark).collect()
    for q, terms in ((7, ["a", "d"]), (9, ["b"])):
        assert [(r.doc_id, r.score) for r in sorted(batch, key=lambda r: r["rank"]) if r.query_id == q] == hits(retrieve(i, terms, 2, spark=spark))
    asked = spark.createDataFrame([(7, 0, "a"), (7, 1, "d"), (9, 0, "b"), (9, 1, None)], "query_id long, qpos int, term string")
    assert sorted(map(tuple, IndexRetriever(i).retrieve(asked, 2).collect())) == sorted(map(tuple, batch))


def test_rows_and_partitions_do_not_matter(spark):
    docs = [(i, [c for c in "abcabc"[: i % 6 + 1]]) for i in range(40)]
    one = hits(retrieve(LexicalIndex.build(spark.createDataFrame(docs, DOCS).coalesce(1)), ["a", "c"], spark=spark))
    random.Random(1).shuffle(docs)
    assert hits(retrieve(LexicalIndex.build(spark.createDataFrame(docs, DOCS).repartition(7)), ["a", "c"], spark=spark)) == one


def test_index_lookups_and_changes(spark):
    i = index_of(spark, [(1, ["a", "b", "a"]), (2, ["b"]), (3, [])])
    assert sorted(map(tuple, i.postings_list("a").collect())) == [(1, 2)]
    assert i.scalars().n_docs == 3 and i.scalars().total_len == 4
    assert sorted(map(tuple, i.term_stats().collect())) == [("a", 1, 2), ("b", 2, 2)]
    pairs = spark.createDataFrame([(1, "a"), (2, "a"), (9, "b")], "doc_id long, term string")
    assert sorted(map(tuple, i.term_frequency(pairs).collect())) == [(1, "a", 2), (2, "a", 0), (9, "b", 0)]
    assert sorted(r[0] for r in i.document_ids().collect()) == [1, 2, 3]
    queries = as_queries(spark, ["a", "b"])
    assert sorted(r.doc_id for r in candidates(i, queries).collect()) == [1, 2]
    changed = i.upsert(spark.createDataFrame([(2, ["c"]), (4, ["a"])], DOCS)).delete(spark.createDataFrame([(1,), (8,)], "doc_id long"))
    assert sorted(map(tuple, changed.doc_stats().collect())) == [(2, 1), (3, 0), (4, 1)]
    assert sorted(map(tuple, changed.term_stats().collect())) == [("a", 1, 1), ("c", 1, 1)]
    assert sorted(r[0] for r in i.contains(spark.createDataFrame([(1,), (8,)], "doc_id long")).collect()) == [1]
    again = LexicalIndex.from_postings(i.postings().select("term", "doc_id", "tf"), i.doc_stats())
    assert hits(retrieve(again, ["a", "b"], spark=spark)) == hits(retrieve(i, ["a", "b"], spark=spark))
    scored = score_documents(i, queries, spark.createDataFrame([(1,), (3,)], "doc_id long"))
    assert {r.doc_id: r.score > 0 for r in scored.collect()} == {1: True, 3: False}
    assert sorted((r.doc_id, sorted(r.terms)) for r in i.bag().collect()) == [(1, ["a", "a", "b"]), (2, ["b"]), (3, [])]


def test_fuzzy_expansion(spark):
    i = index_of(spark, [(1, ["color", "theory"]), (2, ["colour", "theatre", "ab", "日本語文"])])
    v = fuzzy.FuzzyVocabulary.of_index(i)
    assert {r.term for r in v.grams.collect()} == {"color", "theory", "colour", "theatre", "日本語文"}
    terms = spark.createDataFrame([("colr",), ("colout",), ("ab",), ("color",)], "term string")
    got = {(r.term, r.candidate): r.jaccard for r in fuzzy.expand_terms(terms, v, fuzzy.FuzzyConfig(min_jaccard=0.2)).collect()}
    assert got[("colr", "color")] == pytest.approx(1 / 4)
    assert got[("colout", "colour")] == pytest.approx(3 / 5) and got[("colout", "color")] == pytest.approx(2 / 5)
    assert got[("color", "colour")] == pytest.approx(0.4) and not any(t == "ab" for t, _ in got)
    wide = fuzzy.expand_queries(i, v, as_queries(spark, ["theory", "colout", "theory"]))
    assert [r.term for r in wide.orderBy("qpos").collect()] == ["theory", "colout", "colour", "color"]
    assert [d for d, _ in hits(fuzzy.fuzzy_retrieve(i, v, ["colout"], spark=spark))] == [1, 2]


def test_fuzzy_settings_matter_only_for_unknown_terms(spark):
    i = index_of(spark, [(1, ["color"])])
    v = fuzzy.FuzzyVocabulary.of_index(i)
    assert fuzzy.expand_queries(i, v, as_queries(spark, ["color"]), fuzzy.FuzzyConfig(k=0)).count() == 1
    with pytest.raises(InvalidFuzzyConfigError):
        fuzzy.expand_queries(i, v, as_queries(spark, ["colr"]), fuzzy.FuzzyConfig(k=0))
    with pytest.raises(InvalidFuzzyConfigError):
        fuzzy.FuzzyVocabulary.of_index(i, 0)


def stored(spark, tmp_path, n=400):
    rng = random.Random(12)
    words = [f"w{i:04d}" for i in range(2000)]
    docs = spark.createDataFrame([(i, ["the"] * (1 + i % 3) + rng.choices(words, k=25)) for i in range(n)], DOCS)
    snapshot.save(LexicalIndex.build(docs), spark, f"file://{tmp_path}/saved")
    return snapshot.load(spark, f"file://{tmp_path}/saved"), LexicalIndex.build(docs)


def rows_read(df):
    """Rows that the plan's scans put out, after ``df`` was collected."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_stored_index_is_read_by_term(spark, tmp_path):
    """A query's terms are literals of the scan: other files' row groups are not read, in the base nor in a delta."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, small as they are
    try:
        kept, _ = stored(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = rows_read(kept.postings())
    some = kept.restricted(["w0007", "w0011"]).postings()
    assert 0 < rows_read(some) < every / 2 and some.count() < 30
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [w0007,w0011])]" in plan(some)
    snapshot.change(spark, f"file://{tmp_path}/saved", spark.createDataFrame([(3, ["w0007"]), (9000, ["w0007", "x"])], DOCS))
    changed = snapshot.load(spark, f"file://{tmp_path}/saved")
    assert plan(changed.restricted(["w0007"]).postings()).count("EqualTo(term,w0007)") >= 2
    hits = {r.doc_id for r in retrieve(changed, ["w0007"], 1000, spark=spark).collect()}
    assert hits == {r.doc_id for r in changed.postings().where("term = 'w0007'").collect()} and {3, 9000} <= hits


def test_frequent_terms_are_joined_in_parts(spark, tmp_path, monkeypatch):
    """Batches over a stored index give the same hits, whatever the parts; a term in all documents is cut evenly."""
    kept, plain = stored(spark, tmp_path)
    queries = spark.createDataFrame([(q, i, t) for q in range(30) for i, t in enumerate(["the", f"w{q:04d}", "the", "nowhere"])], "query_id long, qpos int, term string")
    for params in (Bm25(), Dirichlet(), JelinekMercer()):
        want = sorted(map(tuple, retrieve(plain, queries, 5, params, spark=spark).collect()))
        for most in (100_000, 40):
            monkeypatch.setattr(termloom.operators.retrieve, "HOT_POSTINGS", most)
            assert sorted(map(tuple, retrieve(kept, queries, 5, params, spark=spark).collect())) == want
    dealt = termloom.operators.retrieve._matched(kept, queries, termloom.operators.retrieve._weighted(kept, queries)).where("term = 'the'").groupBy("part").count().collect()
    sizes = sorted(r["count"] for r in dealt)
    assert len(sizes) == 10 and sizes[-1] < 2 * sizes[5]


def test_candidate_plans(spark):
    docs = spark.createDataFrame([(i, ["common", f"u{i}"]) for i in range(10)], DOCS)
    index = LexicalIndex.build(docs)
    queries = as_queries(spark, {0: ["common"], 1: ["u3", "u4"], 2: ["nowhere"], 3: ["common", "u1"]})
    plans = {r.query_id: (r.n_postings, r.plan) for r in plan_candidates(index, queries).collect()}
    assert plans == {0: (10, "scan_all"), 1: (2, "postings"), 2: (0, "postings"), 3: (11, "scan_all")}
    exact = sorted(map(tuple, candidates(index, queries).collect()))
    planned = [tuple(r) for r in candidates(index, queries, 0.5).orderBy("query_id", "doc_id").collect()]
    assert planned == exact == [*((0, i) for i in range(10)), (1, 3), (1, 4), *((3, i) for i in range(10))]
    # the plan shows in query likelihood only: documents without a match are ranked if the query scans all
    wide = retrieve(index, {0: ["common"], 1: ["u3"]}, 20, Dirichlet(), "planned", spark)
    assert sorted(r.query_id for r in wide.collect()) == [0] * 10 + [1]


def test_fallback_reads_the_smallest_ids_only(spark):
    index = LexicalIndex.build(spark.createDataFrame([(i, ["a"] * (i % 7)) for i in range(50)], DOCS))
    queries = spark.createDataFrame([(q, 0, f"none{q}") for q in range(20)] + [(77, 0, "a")], "query_id long, qpos int, term string")
    df = retrieve(index, queries, 3, Dirichlet(), spark=spark)
    hits = sorted(map(tuple, df.collect()))
    assert [h for h in hits if h[0] < 20] == [(q, n + 1, n, 0.0) for q in range(20) for n in range(3)] and len(hits) == 63


def test_similar_terms_equal_all_overlaps(spark):
    """The rarest n-grams find every pair of that similarity."""
    rng = random.Random(17)
    words = {"".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(250)}
    vocabulary = fuzzy.FuzzyVocabulary.of_terms(spark.createDataFrame([(w,) for w in words], "term string"), 2)
    asked = spark.createDataFrame([("".join(rng.choices("abcde", k=rng.randrange(1, 9))),) for _ in range(60)], "term string")
    every = fuzzy.overlaps(asked, vocabulary)
    for least in (0.1, 0.25, 0.5, 0.75, 1.0):
        want = {tuple(r) for r in every.where(f"jaccard >= {least}").collect()}
        assert {tuple(r) for r in fuzzy.similar(asked, vocabulary, least).collect()} == want


def test_documents_are_tokenised_once(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, " c\tb ")], "doc_id long, text string").repartition(2)
    index = LexicalIndex.build(tokenised(texts))
    for table in (index.postings(), index.terms()):
        assert table._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted(map(tuple, index.postings().collect())) == [("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 4, 1, 2), ("c", 4, 1, 2)]
    assert sorted(r.term for r in index.terms().collect()) == ["a", "b", "c"]


def test_large_batches_are_dealt_by_document(spark, monkeypatch):
    rows = [(n, [f"t{n % 7}", "the", f"t{n % 3}", "the"][: n % 5]) for n in range(60)]
    index = lambda: LexicalIndex.build(spark.createDataFrame(rows, "doc_id long, terms array<string>"))
    asked = spark.createDataFrame([(q, i, t) for q in range(5) for i, t in enumerate(["the", f"t{q}", "t1", "zz"])], "query_id long, qpos int, term string")
    found = lambda p: [tuple(r) for r in retrieve(index(), asked, 4, p, spark=spark).orderBy("query_id", "rank").collect()]
    every = (Bm25(), TfIdf(), Dirichlet())
    plain = [found(p) for p in every]
    monkeypatch.setattr(termloom.operators.retrieve, "PAIRS", 20)
    assert [found(p) for p in every] == plain
    scored = termloom.operators.retrieve.scores(index(), asked)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in scored and "hashpartitioning(query_id" not in scored.split("hashpartitioning(doc_id")[0]


def test_rows_are_counted_without_a_shuffle_if_ids_are_unique(spark):
    rows = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["b", None, None, "c"])]
    once = LexicalIndex.build(spark.createDataFrame(rows, "doc_id long, terms array<string>"))
    twice = LexicalIndex.build(spark.createDataFrame([*rows, (1, ["b", "a", "c"])], "doc_id long, terms array<string>"))
    told = lambda df: sorted(map(repr, df.select("term", "doc_id", "tf", "doc_len").collect()))
    assert told(once.counted()) == told(once.postings()) and told(twice.counted()) == told(twice.postings())
    assert "Exchange" not in once.counted()._jdf.queryExecution().executedPlan().toString()
