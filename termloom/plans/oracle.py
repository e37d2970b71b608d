"""The catalog's queries in SQL, for comparison on another engine."""

from __future__ import annotations

from .corpus import MISSPELT, NARROW, QUERY, REPEATED, UNSEEN

#: Tokens, postings and statistics of the documents.
BASE = r"""
    tok AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\s+')) AS term FROM documents),
    token AS (SELECT doc_id, term FROM tok WHERE term <> ''),
    lens AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS doc_len FROM token GROUP BY doc_id),
    dl AS (SELECT d.doc_id, coalesce(l.doc_len, 0) AS doc_len FROM documents d LEFT JOIN lens l ON d.doc_id = l.doc_id),
    post AS (SELECT term, doc_id, CAST(count(*) AS BIGINT) AS tf FROM token GROUP BY term, doc_id),
    ts AS (SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term),
    cs AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(doc_len) AS BIGINT) AS total_len, avg(doc_len) AS avg_doc_len FROM dl)
"""
OPS = r"""
    ev AS (
        SELECT event_id + 1 AS seq, user_id AS doc_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS op,
               concat_ws(' ', event_type, props) AS body
        FROM events
    )
"""


def with_base(rest: str) -> str:
    return f"WITH {BASE}, {rest}"


def values(*queries: list[str]) -> str:
    """A CTE q(query_id, term, m) of queries, numbered from 0."""
    rows = ", ".join(f"(CAST({n} AS BIGINT), '{t}', {terms.count(t)})" for n, terms in enumerate(queries) for t in dict.fromkeys(terms))
    return f"q(query_id, term, m) AS (VALUES {rows})"


BENCH = r"""
    bt AS (SELECT item_id, unnest(string_split_regex(text, '\s+')) AS term FROM benchmark),
    q AS (SELECT item_id AS query_id, term, count(*) AS m FROM bt WHERE term <> '' GROUP BY ALL)
"""

TOP = """
    ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s)
    SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= {k}
"""


def bm25_cte(q: str, k1: float = 1.2, b: float = 0.75, delta: float = 0.0) -> str:
    return f"""{q}, s AS (
        SELECT query_id, doc_id, round(sum(m * ln(1 + (n_docs - df + 0.5) / (df + 0.5))
            * (tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * doc_len / avg_doc_len)) + {delta})), 6) AS score
        FROM q JOIN post USING (term) JOIN ts USING (term) JOIN dl USING (doc_id), cs GROUP BY query_id, doc_id HAVING score > 0)"""


def bm25(q: str, k: int = 10, **p) -> str:
    return with_base(f"{bm25_cte(q, **p)}, {TOP.format(k=k)}")


TF = {"linear": "tf", "log": "(1 + ln(tf))"}
IDF = {"standard": "ln(CAST(n_docs AS DOUBLE) / df)", "smoothed": "ln(1 + (n_docs - df + 0.5) / (df + 0.5))"}


def tfidf_cte(q: str, tf: str = "log", idf: str = "standard") -> str:
    return f"""{q}, s AS (
        SELECT query_id, doc_id, round(sum(m * {TF[tf]} * {IDF[idf]}), 6) AS score
        FROM q JOIN post USING (term) JOIN ts USING (term), cs GROUP BY query_id, doc_id HAVING score > 0)"""


def tfidf(q: str, k: int = 10, **p) -> str:
    return with_base(f"{tfidf_cte(q, **p)}, {TOP.format(k=k)}")


def likelihood(q: str, formula: str, mode: str = "matching", k: int = 10) -> str:
    """``formula`` of tf, doc_len and pc; every candidate is scored on every query term."""
    matching, scanning = "SELECT DISTINCT query_id, doc_id FROM q JOIN post USING (term)", "SELECT DISTINCT query_id, doc_id FROM q, dl"
    cands = {"matching": matching, "scan_all": scanning, "planned": f"SELECT query_id, doc_id FROM ({matching}) UNION SELECT query_id, doc_id FROM plan, dl WHERE plan = 'scan_all'"}[mode]
    return with_base(f"""{q}, {PLAN}, cand AS ({cands}),
        p AS (SELECT cand.query_id, cand.doc_id, q.m, coalesce(post.tf, 0) AS tf, doc_len, coalesce(cf, 0) / CAST(total_len AS DOUBLE) AS pc
              FROM cand JOIN q ON cand.query_id = q.query_id JOIN dl ON dl.doc_id = cand.doc_id
              LEFT JOIN post ON post.doc_id = cand.doc_id AND post.term = q.term LEFT JOIN ts ON ts.term = q.term, cs),
        f AS (SELECT query_id, doc_id, m, {formula} AS p FROM p),
        s AS (SELECT query_id, doc_id, round(sum(m * CASE WHEN p > 0 THEN ln(p) ELSE 0 END), 6) + 0.0 AS score FROM f GROUP BY query_id, doc_id),
        {TOP.format(k=k)}""")


PLAN = """plan AS (
        SELECT query_id, CAST(coalesce(sum(df), 0) AS BIGINT) AS n_postings, CASE WHEN coalesce(sum(df), 0) > 0.5 * any_value(n_docs) THEN 'scan_all' ELSE 'postings' END AS plan
        FROM (SELECT DISTINCT query_id, term FROM q) LEFT JOIN ts USING (term), cs GROUP BY query_id)"""


def jm(weight: float) -> str:
    return f"((1 - {weight}) * tf / CAST(doc_len AS DOUBLE) + {weight} * pc)"


def dirichlet(mu: float) -> str:
    return f"((tf + {mu} * pc) / (doc_len + {mu}))"


def grams(source: str) -> str:
    return f"SELECT DISTINCT term, substring(term, CAST(i AS BIGINT), 3) AS gram FROM (SELECT term, unnest(generate_series(1, length(term) - 2)) AS i FROM {source} WHERE length(term) >= 3)"


def fuzzy_cte(terms: list[str]) -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""asked(qpos, term) AS (VALUES {rows}),
        vg AS ({grams('ts')}), vn AS (SELECT term, count(*) AS n FROM vg GROUP BY term),
        ag AS ({grams('asked')}), an AS (SELECT term, count(*) AS n FROM ag GROUP BY term),
        ov AS (SELECT ag.term, vg.term AS candidate, count(*) AS n_both FROM ag JOIN vg USING (gram) WHERE ag.term <> vg.term GROUP BY ALL),
        jac AS (SELECT ov.term, candidate, n_both / CAST(an.n + vn.n - n_both AS DOUBLE) AS jaccard FROM ov JOIN an ON an.term = ov.term JOIN vn ON vn.term = ov.candidate),
        near AS (SELECT term, candidate, jaccard, CAST(row_number() OVER (PARTITION BY term ORDER BY jaccard DESC, candidate) AS INTEGER) AS rank FROM jac WHERE jaccard >= 0.25)"""


EXPANDED = """
    oov AS (SELECT qpos, term FROM asked WHERE term NOT IN (SELECT term FROM ts)),
    wide AS (
        SELECT 0 AS later, qpos, 0 AS rank, term FROM asked
        UNION ALL SELECT 1, oov.qpos, near.rank, candidate FROM oov JOIN near ON near.term = oov.term WHERE near.rank <= 8),
    once AS (SELECT term, min((later, qpos, rank)) AS place FROM wide GROUP BY term)
"""

LIVE = """
    last AS (SELECT doc_id, arg_max(op, seq) AS op, arg_max(body, seq) AS body FROM {ops} GROUP BY doc_id),
    live AS (SELECT doc_id, body FROM last WHERE op = 'add'),
    terms AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(string_split_regex(body, '\\s+')) AS term FROM live) WHERE term <> ''),
    state AS (SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS terms, CAST(count(*) AS BIGINT) AS doc_len FROM terms GROUP BY doc_id)
"""


def log(rest: str, ops: str = "ev") -> str:
    return f"WITH {OPS}, {LIVE.format(ops=ops)} {rest}"


def told(**rows: str) -> str:
    """what, outcome: SQL values as text."""
    return " UNION ALL ".join(f"SELECT '{what}' AS what, CAST({value} AS VARCHAR) AS outcome FROM n" for what, value in rows.items())


#: A document's hash of 120 bits, and the digests of all prefixes of the log; n has the number of records.
DIGESTS = r"""
    n AS (SELECT CAST(count(*) AS BIGINT) AS n, max(doc_id) AS last FROM ev),
    told AS (SELECT seq, doc_id, op, md5(doc_id || ' ' || array_to_string(list_transform(list_sort(list_filter(string_split_regex(coalesce(body, ''), '\s+'), lambda x: x <> '')), lambda t: length(t) || ':' || t), '')) AS h FROM ev),
    marked AS (SELECT seq, doc_id, CASE WHEN op = 'add' THEN 1 ELSE 0 END AS k, CASE WHEN op = 'add' THEN CAST('0x' || substr(h, 1, 15) AS BIGINT) ELSE 0 END AS a, CASE WHEN op = 'add' THEN CAST('0x' || substr(h, 16, 15) AS BIGINT) ELSE 0 END AS b FROM told),
    swapped AS (SELECT seq, k - coalesce(lag(k) OVER w, 0) AS k, xor(a, coalesce(lag(a) OVER w, 0)) AS a, xor(b, coalesce(lag(b) OVER w, 0)) AS b FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
    digest AS (SELECT seq, CAST(sum(k) OVER w AS BIGINT) AS n_docs, bit_xor(a) OVER w AS mark, bit_xor(b) OVER w AS mark2 FROM swapped WINDOW w AS (ORDER BY seq))
"""


def largest_prefix(applied: int) -> str:
    """The largest prefix with the digest of the first ``applied`` records."""
    return f"(SELECT max(d.seq) FROM digest d JOIN digest g ON (d.n_docs, d.mark, d.mark2) = (g.n_docs, g.mark, g.mark2) WHERE g.seq = least({applied}, (SELECT n FROM n)))"


STATE = log("SELECT doc_id, terms, doc_len FROM state")

SQL = {
    "tokenize_docs": with_base("x AS (SELECT 1) SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, min(term) AS first_term, max(term) AS last_term FROM token GROUP BY doc_id"),
    "token_counts": with_base("x AS (SELECT 1) SELECT doc_id, doc_len FROM dl"),
    "line_corpus_scan": """
        WITH one AS (SELECT string_agg(text, chr(10) ORDER BY doc_id) AS body FROM documents),
        l AS (SELECT string_split(body, chr(10)) AS ls FROM one),
        n AS (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l)
        SELECT CAST(pos AS BIGINT) AS doc_id, CAST(len(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_terms FROM n
    """,
    "postings_build": with_base("x AS (SELECT 1) SELECT term, doc_id, tf FROM post"),
    "postings_list_term": with_base("x AS (SELECT 1) SELECT doc_id, tf FROM post WHERE term = 'the'"),
    "doc_stats": with_base("x AS (SELECT 1) SELECT doc_id, doc_len FROM dl"),
    "corpus_stats": with_base("x AS (SELECT 1) SELECT n_docs, total_len, round(avg_doc_len, 6) AS avg_doc_len FROM cs"),
    "term_stats": with_base("x AS (SELECT 1) SELECT term, df, cf FROM ts"),
    "term_frequency_lookup": with_base(f"{values(QUERY)} SELECT d.doc_id, q.term, coalesce(tf, 0) AS tf FROM documents d CROSS JOIN q LEFT JOIN post ON post.doc_id = d.doc_id AND post.term = q.term"),
    "term_frequency_all_docs": with_base(f"{values(QUERY)} SELECT d.doc_id, q.term, coalesce(tf, 0) AS tf FROM documents d CROSS JOIN q LEFT JOIN post ON post.doc_id = d.doc_id AND post.term = q.term"),
    "document_frequency_lookup": with_base(f"{values(QUERY + UNSEEN)} SELECT q.term, coalesce(df, 0) AS df FROM q LEFT JOIN ts USING (term)"),
    "document_length_lookup": with_base("i AS (SELECT doc_id FROM dl UNION SELECT doc_id + 1 FROM dl) SELECT i.doc_id, coalesce(doc_len, 0) AS doc_len FROM i LEFT JOIN dl USING (doc_id)"),
    "document_length_all_docs": with_base("x AS (SELECT 1) SELECT d.doc_id, coalesce(doc_len, 0) AS doc_len FROM documents d LEFT JOIN dl USING (doc_id)"),
    "document_ids": "SELECT doc_id FROM documents",
    "vocabulary": with_base("x AS (SELECT 1) SELECT term FROM ts"),
    "idf_bm25": with_base("x AS (SELECT 1) SELECT term, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM ts, cs"),
    "idf_standard": with_base("x AS (SELECT 1) SELECT term, round(ln(CAST(n_docs AS DOUBLE) / df), 6) AS idf FROM ts, cs"),
    "idf_smoothed": with_base("x AS (SELECT 1) SELECT term, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM ts, cs"),
    "tf_linear": with_base("x AS (SELECT 1) SELECT term, doc_id, CAST(tf AS DOUBLE) AS weight FROM post"),
    "tf_log": with_base("x AS (SELECT 1) SELECT term, doc_id, round(1 + ln(tf), 6) AS weight FROM post"),
    "candidates_any_term": with_base(f"{values(QUERY)} SELECT DISTINCT query_id, doc_id FROM q JOIN post USING (term)"),
    "candidates_scan_all": "SELECT CAST(0 AS BIGINT) AS query_id, doc_id FROM documents",
    "bm25_top10": bm25(values(QUERY)),
    "bm25l_top10": bm25(values(QUERY), delta=0.5),
    "bm25l_delta_top10": bm25(values(QUERY), delta=0.8),
    "bm25plus_top10": bm25(values(QUERY), delta=1.0),
    "bm25plus_delta_top10": bm25(values(QUERY), delta=1.7),
    "bm25_custom_k1_b": bm25(values(QUERY), k1=2.0, b=0.3),
    "bm25_dup_terms": bm25(values(REPEATED)),
    "bm25_unseen_terms": bm25(values(UNSEEN)),
    "bm25_score_docs": with_base(f"{bm25_cte(values(QUERY))} SELECT CAST(0 AS BIGINT) AS query_id, d.doc_id, coalesce(score, 0.0) AS score FROM documents d LEFT JOIN s USING (doc_id)"),
    "bm25_score_all_docs": with_base(f"{bm25_cte(values(QUERY))} SELECT CAST(0 AS BIGINT) AS query_id, d.doc_id, coalesce(score, 0.0) AS score FROM documents d LEFT JOIN s USING (doc_id)"),
    "bm25_batch_benchmark": bm25(BENCH),
    "tfidf_default": tfidf(values(QUERY)),
    "tfidf_linear": tfidf(values(QUERY), tf="linear"),
    "tfidf_smoothed": tfidf(values(QUERY), idf="smoothed"),
    "tfidf_linear_smoothed": tfidf(values(QUERY), tf="linear", idf="smoothed"),
    "tfidf_batch_benchmark": tfidf(BENCH),
    "tfidf_score_docs": with_base(f"{tfidf_cte(values(QUERY))} SELECT CAST(0 AS BIGINT) AS query_id, d.doc_id, coalesce(score, 0.0) AS score FROM documents d LEFT JOIN s USING (doc_id)"),
    "tfidf_score_all_docs": with_base(f"{tfidf_cte(values(QUERY))} SELECT CAST(0 AS BIGINT) AS query_id, d.doc_id, coalesce(score, 0.0) AS score FROM documents d LEFT JOIN s USING (doc_id)"),
    "ql_dirichlet": likelihood(values(QUERY), dirichlet(1000.0)),
    "ql_dirichlet_mu": likelihood(values(QUERY), dirichlet(250.0)),
    "ql_jm": likelihood(values(QUERY), jm(0.5)),
    "ql_jm_lambda": likelihood(values(REPEATED), jm(0.2)),
    "ql_dirichlet_scan_all": likelihood(values(QUERY), dirichlet(1000.0), "scan_all", 50),
    "ql_jm_boundary": likelihood(values(QUERY), jm(0.0)),
    "ql_fallback_all_docs": likelihood(values(UNSEEN), dirichlet(1000.0), "scan_all"),
    "ql_batch_benchmark": likelihood(BENCH, dirichlet(1000.0)),
    "kgrams_vocab": with_base(f"x AS (SELECT 1) {grams('ts')}"),
    "gram_overlap_jaccard": with_base(f"{fuzzy_cte(MISSPELT)} SELECT term, candidate, round(jaccard, 6) AS jaccard FROM jac"),
    "fuzzy_expand_term": with_base(f"{fuzzy_cte(MISSPELT)} SELECT term, rank, candidate, round(jaccard, 6) AS jaccard FROM near WHERE rank <= 8"),
    "fuzzy_expand_query": with_base(f"{fuzzy_cte(MISSPELT)}, {EXPANDED} SELECT CAST(0 AS BIGINT) AS query_id, CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS qpos, term FROM once"),
    "fuzzy_bm25": with_base(f"{fuzzy_cte(MISSPELT)}, {EXPANDED}, " + bm25_cte("q AS (SELECT CAST(0 AS BIGINT) AS query_id, term, 1 AS m FROM once)") + f", {TOP.format(k=10)}"),
    "log_replay_state": STATE,
    "log_state_prefix": log("SELECT doc_id, terms, doc_len FROM state", "(SELECT * FROM ev WHERE seq <= 5000)"),
    "log_state_suffix_merge": STATE,
    "log_compact": log("SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS seq, 'add' AS op, doc_id, terms FROM state"),
    "log_status": f"WITH {OPS} SELECT CAST(count(*) AS BIGINT) AS records, CAST(least(count(*), 4000) AS BIGINT) AS applied, CAST(greatest(count(*) - 4000, 0) AS BIGINT) AS pending FROM ev",
    "log_validate": log("SELECT CAST(count(*) AS BIGINT) AS n_docs_a, CAST(count(*) AS BIGINT) AS n_docs_b, true AS valid FROM live"),
    "log_digest_by_prefix": f"""
        WITH {OPS}, x AS (SELECT seq, CASE WHEN op = 'add' THEN 1 ELSE 0 END - coalesce(lag(CASE WHEN op = 'add' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq), 0) AS d FROM ev)
        SELECT seq, CAST(sum(d) OVER (ORDER BY seq) AS BIGINT) AS n_docs FROM x
    """,
    "log_search_bm25": None,
    "upsert_documents": with_base("x AS (SELECT 1) SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 3 ELSE doc_len END AS doc_len FROM dl"),
    "delete_documents": with_base("g AS (SELECT term, doc_id FROM post WHERE doc_id % 10 <> 3) SELECT term, CAST(count(*) AS BIGINT) AS df FROM g GROUP BY term"),
    "log_torn_tail_best_effort": f"WITH {OPS} SELECT seq, op, doc_id FROM ev WHERE seq < 7000",
    "stream_ops_replay": STATE,
    "snapshot_roundtrip": with_base("x AS (SELECT 1) SELECT term, doc_id, tf FROM post"),
}
SQL["log_search_bm25"] = rf"""
    WITH {OPS}, {LIVE.format(ops="ev")},
    post AS (SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY ALL), dl AS (SELECT doc_id, doc_len FROM state),
    ts AS (SELECT term, count(*) AS df FROM post GROUP BY term), cs AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_doc_len FROM dl),
    {bm25_cte(values(['click', 'view']))}, {TOP.format(k=10)}
"""
#: What a log's states come to without a hash of one engine: the offset found again.
SQL["log_infer_applied"] = f"WITH {OPS} SELECT CAST(least(5000, count(*)) AS BIGINT) AS at_least, true AS same_state FROM ev"
BOTH = values(QUERY, NARROW)
LINED = """lined AS (
    SELECT CAST(pos AS BIGINT) AS doc_id, line AS text FROM (
        SELECT unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT string_split(string_agg(text, chr(10) ORDER BY doc_id), chr(10)) AS ls FROM documents)))"""
TERMS = r"array_to_string(list_sort(list_filter(string_split_regex(body, '\s+'), lambda x: x <> '')), ' ')"
SQL |= {
    "candidates_scan_all": with_base(f"{values(QUERY)}, {PLAN} SELECT DISTINCT query_id, doc_id FROM plan, dl WHERE plan = 'scan_all' UNION SELECT query_id, doc_id FROM q JOIN post USING (term)"),
    "candidates_planned": with_base(f"{BOTH}, {PLAN} SELECT DISTINCT query_id, doc_id FROM plan, dl WHERE plan = 'scan_all' UNION SELECT query_id, doc_id FROM q JOIN post USING (term)"),
    "candidate_plans": with_base(f"{BOTH}, {PLAN} SELECT query_id, n_postings, plan FROM plan"),
    "ql_planned": likelihood(BOTH, dirichlet(1000.0), "planned", 20),
    "fuzzy_stored_vocabulary": SQL["fuzzy_expand_term"],
    "guards": "WITH n AS (SELECT count(*) AS n FROM documents) " + told(
        empty_query="'EmptyQueryError'", empty_both="'EmptyQueryError'", empty_index="'EmptyIndexError'", empty_index_k0="'EmptyIndexError'", k0="0", k3="3", grams="'InvalidFuzzyConfigError'", documents="n"),
    "index_from_postings": with_base("x AS (SELECT 1) SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, max(doc_len) AS doc_len FROM post JOIN dl USING (doc_id) GROUP BY doc_id"),
    "saved_index_search": f"WITH {LINED}, " + bm25(values(QUERY)).replace("FROM documents", "FROM lined").removeprefix("WITH "),
    "snapshot_change": with_base("""
        p AS (SELECT term, doc_id, tf, doc_len FROM post JOIN dl USING (doc_id) WHERE doc_id % 10 NOT IN (3, 7)
              UNION ALL SELECT unnest(['a', 'b']), doc_id, unnest([2, 1]), 3 FROM dl WHERE doc_id % 10 = 3)
        SELECT term, doc_id, CAST(tf AS BIGINT) AS tf, CAST(doc_len AS BIGINT) AS doc_len, (SELECT CAST(count(*) AS BIGINT) FROM dl WHERE doc_id % 10 <> 7) AS n_docs FROM p"""),
    "log_status_files": f"""WITH {OPS}, n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM ev)
        SELECT 'new' AS at, false AS checkpoint, false AS meta, false AS log, CAST(0 AS BIGINT) AS records, CAST(0 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS pending
        UNION ALL SELECT 'pending', true, true, true, n, least(n, 4000), greatest(n - 4000, 0) FROM n""",
    "log_append": f"""WITH {OPS}, n AS (SELECT CAST(count(*) AS BIGINT) AS n, max(doc_id) AS last FROM ev)
        SELECT seq, op, doc_id, CASE WHEN op = 'add' THEN {TERMS} END AS terms FROM ev
        UNION ALL SELECT n + 1, 'add', last, 'more one record' FROM n UNION ALL SELECT n + 2, 'delete', last, NULL FROM n""",
    "log_add_delete_state": log("SELECT doc_id, terms, doc_len FROM state", """(SELECT seq, doc_id, op, body FROM ev
        UNION ALL SELECT count(*) + 1, max(doc_id) + 1, 'add', 'one more  record' FROM ev UNION ALL SELECT count(*) + 2, max(doc_id), 'delete', NULL FROM ev)"""),
    "log_compact_files": log("SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS seq, 'add' AS op, doc_id, terms, true AS valid FROM state"),
    "log_prune_validate": log("SELECT doc_id, terms, doc_len, true AS valid FROM state"),
    "log_checkpoint_reset": log("SELECT doc_id, terms, doc_len, (SELECT CAST(count(*) AS BIGINT) FROM ev) AS applied, CAST(0 AS BIGINT) AS left_in_log, true AS valid FROM state",
        "(SELECT seq, doc_id, op, body FROM ev UNION ALL SELECT count(*) + 1, 0, 'delete', NULL FROM ev)"),
    "log_doctor": f"WITH {OPS}, {DIGESTS} " + told(status="'LogStateError'", dry="'LogStateError'", fixed=largest_prefix(4000), again=largest_prefix(4000), valid="'True'", pending=f"n - {largest_prefix(4000)}"),
    "log_meta_guard": f"WITH {OPS}, {DIGESTS} " + told(whole="least(n, 4000)", beyond="'LogStateError'", missing="'LogStateError'", restored="least(n, 4000)", new="0"),
    "log_scan_torn": f"WITH {OPS}, {DIGESTS} " + told(best_effort="least(n, 6999)", strict="CASE WHEN n < 7000 THEN n::VARCHAR ELSE 'LogStateError' END"),
    "log_search_suffix": SQL["log_search_bm25"],
    "log_infer_largest_prefix": f"WITH {OPS}, {DIGESTS} SELECT n AS records, {largest_prefix(5000)} AS found FROM n",
    "log_digests": f"WITH {OPS}, {DIGESTS} SELECT seq, n_docs, mark, mark2 FROM digest",
}
