"""The methods themselves against plain versions: out-of-place distances, tilted rates, URL parts in SQL."""

import math
import random
from collections import Counter, defaultdict

import duckdb

from termloom.llm import language_id, mixing, url_filter
from termloom.llm.common import Store

ALPHABET = "abcdeéß"


def plain_grams(text):
    """How often each n-gram of one to three letters is there; what is no letter parts words, and a word has a gap at both ends."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line, found = f" {' '.join(words)} ", Counter()
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if g != " " and not (n == 3 and g[1] == " "):
                found[g] += 1
    return found


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def plain_profile(found, top):
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], code(x[0])))][:top]


def test_out_of_place_distance_equals_a_plain_loop():
    rng, top = random.Random(4), 40
    text = lambda weights: "".join(rng.choices(f"{ALPHABET} ,", weights=weights, k=rng.randrange(1, 300)))
    kinds = {name: [rng.randrange(1, 20) for _ in range(9)] for name in ("aa", "bb", "cc")}
    known = {name: plain_profile(sum((plain_grams(text(w)) for _ in range(20)), Counter()), top) for name, w in kinds.items()}
    profiles = language_id.Profiles({name: [code(g) for g in grams] for name, grams in known.items()}, top)
    ties = 0
    for _ in range(200):
        t = text(rng.choice(list(kinds.values())))
        own = plain_profile(plain_grams(t), top)
        if not own:
            assert profiles.predict(t) == ("und", 0.0)
            continue
        out = {name: sum(abs(grams.index(g) - i) if g in grams else top for i, g in enumerate(own)) for name, grams in known.items()}
        (near, best), (far, _) = sorted((d, name) for name, d in out.items())[:2]
        assert profiles.predict(t) == (best, (far - near) / max(1, far))
        ties += near == far
    # equally near languages: the first by name, with score 0
    twins = language_id.Profiles({"yy": [code("a")], "xx": [code("a")]}, top)
    assert twins.predict("aa") == ("xx", 0.0)


def test_rates_are_tilted_exponentially(spark):
    """Multipliers against bisection in plain Python, for sources above and below their targets; rates differ by size within a source."""
    rng = random.Random(7)
    sources = {"a": 150, "b": 60, "c": 120, None: 4}
    rows, sizes = [], defaultdict(list)
    for source, n in sources.items():
        for _ in range(n):
            size = rng.choice([1, 2, 5, 20, 90])
            sizes[source].append(size)
            rows.append((len(rows), " ".join(["w"] * size), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing._decided(docs, Store(spark, "test"), mixing.WEIGHTS, mixing.CAP).collect()
    target = {None if r.no_source else r.src: r.target for r in made}
    copies = defaultdict(list)
    for r in made:
        copies[None if r.no_source else r.src].append((r.size, r.copies))
    tilted = 0
    for source, own in sizes.items():
        mean, low, high = sum(own) / len(own), -500.0, 500.0
        rate = lambda x, s: min(mixing.CAP, math.exp(min(50, x * s / mean)))  # noqa: E731, B023
        for _ in range(200):
            x = (low + high) / 2
            low, high = (x, high) if sum(s * rate(x, s) for s in own) < target[source] else (low, x)
        if sum(own) * mixing.CAP <= target[source] * (1 + 1e-9):
            assert all(c == mixing.CAP for _, c in copies[source])
            continue
        for size in set(own):
            n = own.count(size)
            want = n * rate(x, size)
            # systematic rounding: copies of a size miss the sum of their rates by at most one
            assert abs(sum(c for s, c in copies[source] if s == size) - want) <= 1 + 1e-6
        tilted += rate(x, 1) != rate(x, 90)
        assert abs(sum(s * c for s, c in copies[source]) - target[source]) <= 90
    assert tilted >= 2


def test_hosts_paths_and_rules_equal_sql(spark):
    rng = random.Random(11)
    hosts = ["example.com", "Shop.Example.COM", "a.b.net", "example.net", "org", "notcom", "com", "x.org", "", "É.com"]
    paths = ["", "/", "/en/", "/en/7", "/en/71", "/En/", "/de/8", "/de/", "/es/x", "/es", "//en/"]
    urls = [rng.choice(["http://", "HTTPS://", "://", "http:/", "x://y://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=/en/", "#/en/", "?a#b"]) for _ in range(600)] + [None, "", "com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_filter.judge(pages).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    want = con.sql(f"""
        WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        rule(h, q, verdict) AS (VALUES {rules}),
        fit AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict FROM p, rule
                WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
        SELECT page_id, coalesce(host, ''), coalesce(path, ''), rule, verdict FROM p LEFT JOIN fit USING (page_id)
    """).fetchall()
    assert got == {i: (h, p, r, v) for i, h, p, r, v in want}
    assert sum(x[2] is not None for x in got.values()) > 40
