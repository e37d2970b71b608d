"""The registered queries of this subpackage in SQL, where SQL can express them."""

from __future__ import annotations

#: crc32 of the ASCII text ``s``, bit by bit; 3988292384 is the reversed polynomial.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _sketch(text: str) -> str:
    """The sketch of a text, as operator 11 has it."""
    words = rf"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    hashes = f"CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: left(md5(array_to_string(w[i:i + 4], ' ')), 16)) END"
    return f"""(SELECT CASE WHEN len(low) > 0 THEN low ELSE h[1:1] END FROM (
        SELECT h, list_filter(h, lambda x: x < '2') AS low FROM (SELECT list_sort(list_distinct({hashes})) AS h FROM (SELECT {words} AS w))))"""


OP11 = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
    e AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt,
                 coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS nid FROM d),
    c AS (SELECT doc_id, n, t, nid, substring(t, 1, n - n // 4) || CASE WHEN n >= 4 THEN substring(nt, 1, n // 4) ELSE '' END AS ct FROM e),
    s AS MATERIALIZED (SELECT doc_id, n, nid, ct, {_sketch('t')} AS a, {_sketch('ct')} AS b FROM c),
    p AS (SELECT s.*, x.a AS c FROM s JOIN s AS x ON s.nid = x.doc_id),
    k AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac FROM p)
    SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(ct) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
        CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE ELSE ab::DOUBLE / greatest(len(a) + len(b) - ab, 1) END AS near_edited,
        CASE WHEN len(a) = 0 AND len(c) = 0 THEN 1.0::DOUBLE ELSE ac::DOUBLE / greatest(len(a) + len(c) - ac, 1) END AS near_next,
        CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE ab::DOUBLE / len(a) END AS contained_edited,
        CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE ac::DOUBLE / len(a) END AS contained_next
    FROM k
"""

#: A turn, as operator 12 knows it.
_TURN = "sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"

OP12 = f"""
    WITH o AS (
        SELECT conv_id, length(coalesce(text, '')) AS n, {_TURN} AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN}) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ),
    c AS (SELECT conv_id, conv_id - conv_id % 100 AS donor, {CRC32.replace("(s,", "(conv_id::VARCHAR,")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
    t AS (
        SELECT c.conv_id, pos, g, n FROM c JOIN o ON o.conv_id = c.donor AND pos < h
        UNION ALL SELECT c.conv_id, pos, g, n FROM c JOIN o ON o.conv_id = c.conv_id AND pos >= h
    ),
    p AS MATERIALIZED (
        SELECT conv_id, n, row_number() OVER w AS depth, string_agg(g, '') OVER w AS path FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
        UNION ALL SELECT conv_id, 0, 0, '' FROM c
    ),
    node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM p GROUP BY path, depth),
    kids AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
    full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
    sub AS (
        SELECT p.path, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.n) AS saved_tokens
        FROM full_node x JOIN p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY p.path
    ),
    stop AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
    SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, b.conv_id AS parent_conv_id, CAST(a.n_convs AS BIGINT) AS n_convs, CAST(a.n_children AS BIGINT) AS n_children,
        CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
    FROM full_node a JOIN sub USING (path) LEFT JOIN stop USING (path) LEFT JOIN node b ON a.depth > 0 AND b.path = left(a.path, 64 * (a.depth - 1))
"""

def _plus(x: str, cost: str | int, edits: str) -> str:
    return f"struct_pack(c := {x}.c + {cost}, a := {x}.a || '{edits}')"


def _best(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


#: States: nothing yet, after system, after user, after assistant; costs from _NO on are no ways at all.
_NO = 1_000_000_000_000
_IF = lambda where, cost: f"(CASE WHEN {where} THEN {cost} ELSE {_NO} END)"  # noqa: E731
_KEEP, _REROLE = (lambda initial: _IF(f"NOT must AND ini = '{initial}'", "cut")), _IF("NOT must", "2 + cut")
_STEP = ", ".join((
    f"{_plus('s0', 3, 'D')} AS s0",
    f"{_best(_plus('s1', 3, 'D'), _plus('s0', _KEEP('s'), 'K'))} AS s1",
    f"{_best(_plus('p2', 3, 'D'), *(_plus(x, cost, e) for x in ('s0', 's1', 'p3') for cost, e in ((_KEEP('u'), 'K'), (_REROLE, 'R'))))} AS s2",
    f"{_best(_plus('p3', 3, 'D'), _plus('p2', _KEEP('a'), 'K'), _plus('p2', _REROLE, 'R'))} AS s3",
))  # fmt: skip

OP13 = rf"""
    WITH RECURSIVE m AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {CRC32.replace("(s,", "(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '),")} % 20 AS how FROM conversations
    ),
    d AS (
        SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM m, (SELECT unnest([1, 2]) AS copy) WHERE how <> 0 AND (copy = 1 OR how = 3)
    ),
    r AS (SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN}) AS pos FROM d),
    b AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
                 lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) AS former FROM r),
    f AS MATERIALIZED (SELECT *, blank OR seen AS must, CASE WHEN NOT blank AND NOT seen AND NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 1 ELSE 0 END AS cut FROM b),
    g AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(seen AND NOT blank) AS duplicate, sum(cut) AS truncated,
            count_if(former IS NOT NULL AND former || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
        FROM f GROUP BY conv_id
    ),
    step AS (
        SELECT conv_id, 0::BIGINT AS pos, struct_pack(c := 0::BIGINT, a := '') AS s0, struct_pack(c := {_NO}::BIGINT, a := '') AS s1, struct_pack(c := {_NO}::BIGINT, a := '') AS s2, struct_pack(c := {_NO}::BIGINT, a := '') AS s3 FROM g
        UNION ALL
        SELECT conv_id, pos, {_STEP} FROM (
            SELECT f.conv_id, f.pos, must, cut, ini, s0, s1, {_best('s2', *(_plus(x, 2, 'I') for x in ('s0', 's1', 's3')))} AS p2,
                {_best('s3', _plus('s2', 2, 'I'), _plus('s0', 4, 'II'), _plus('s1', 4, 'II'))} AS p3
            FROM step JOIN f ON f.conv_id IS NOT DISTINCT FROM step.conv_id AND f.pos = step.pos + 1
        )
    ),
    best AS (
        SELECT g.*, {_best('s0', _plus('s1', 4, 'II'), _plus('s2', 2, 'I'), 's3')} AS x
        FROM g JOIN step ON g.conv_id IS NOT DISTINCT FROM step.conv_id AND step.pos = g.n_rows
    ),
    e AS (SELECT f.*, regexp_extract_all(x.a, 'I*[KRD]')[f.pos] AS edit FROM f JOIN best ON best.conv_id IS NOT DISTINCT FROM f.conv_id),
    o AS (SELECT *, length(edit) - 1 AS n, right(edit, 1) AS op, length(edit) - 1 + CASE WHEN right(edit, 1) = 'R' OR right(edit, 1) = 'K' AND ini <> 's' THEN 1 ELSE 0 END AS outs FROM e),
    w AS (SELECT *, coalesce(sum(outs) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o),
    v AS (
        SELECT conv_id, pos, unnest(list_transform(range(1, n + 1), lambda j: CASE WHEN (ahead + j) % 2 = 1 THEN 'user:' ELSE 'assistant:' END)
            || CASE op WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [CASE WHEN (ahead + n) % 2 = 0 THEN 'user:' ELSE 'assistant:' END || text] END) AS line,
            unnest(range(1, n + 1 + CASE WHEN op = 'D' THEN 0 ELSE 1 END)) AS nth
        FROM w
        UNION ALL SELECT conv_id, n_rows + 1, unnest(CASE length(regexp_extract(x.a, 'I*$')) WHEN 1 THEN ['assistant:'] WHEN 2 THEN ['user:', 'assistant:'] ELSE []::VARCHAR[] END), unnest(range(1, 1 + length(regexp_extract(x.a, 'I*$')))) FROM best
    ),
    h AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY pos, nth) AS body FROM v GROUP BY conv_id),
    c AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
        CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256, CAST(coalesce(n_rows, 0) AS BIGINT) AS n_rows
    FROM c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE_SQL = {
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
        ), g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM t JOIN g USING (h)
    """,
    "op11_scaled_sketch": OP11,
    "op12_conversation_trie": OP12,
    "op13_conversation_repair": OP13,
}
