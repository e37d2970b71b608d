"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from termloom.llm import exact_dedup, language_id, license_scan, mixing, multi_index, ngram_join, packing, toxicity, url_filter, warc
from termloom.llm.common import Store, components

DOCS = "doc_id long, text string, lang string, source string, digest string, word string, size long"


def docs_of(spark, rows, n=3):
    """(doc_id, text[, lang[, source]]) with columns whose names clash with those used inside."""
    full = [(*r, *[None] * (4 - len(r)), "x", "y", 7) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(n)


def table(df, key=0):
    return {r[key]: r for r in map(tuple, df.collect())}


# -- exact deduplication


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (3, "c"), (None, None), (4, ""), (8, "x" * 200_000), (7, "x" * 200_000), (6, " a b"), (None, "z"), (2, "a b")]
    out = [tuple(r) for r in exact_dedup.decisions(docs_of(spark, rows)).collect()]
    assert len(out) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        text = " ".join(__import__("re").split(r"[\x20\x09-\x0D]+", t or ""))
        want[hashlib.sha256(text.encode()).hexdigest()].append(i)
    for i, keep, size, kept, sha in out:
        ids = want[sha]
        least = min((x for x in ids if x is not None), default=None)
        assert (keep, size, kept) == (least, len(ids), i == least)
    kept = exact_dedup.deduplicated(docs_of(spark, rows))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 3), (False, 4), (False, 6), (False, 7), (True, 0)]
    empty = docs_of(spark, [(1, "a")]).limit(0)
    assert exact_dedup.decisions(empty).count() == exact_dedup.deduplicated(empty).count() == 0


# -- n-gram join


def brute_components(rows, width=4, percent=85):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if sets[a][1] and sets[b][1] and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    names = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            names[find(k)] = min(names.get(find(k), i), i)
    return sorted((i if i is not None else -1, len(s), names.get(find(k), -1)) for k, (i, s) in enumerate(sets))


def near_copies(seed, n=60):
    """Copies of a few texts with words changed: many sit close to the threshold, some chain."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.choice((5, 40, 150)))] for _ in range(4)]
    rows = [(1000 - k, None if k == 0 else "" if k == 1 else " \n") for k in range(3)] + [(None, "only one"), (77, "Only  ONE"), (78, "one two three four")]
    for k in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.randrange(0, max(2, len(own) // 18))):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((rng.randrange(10_000, 90_000), " ".join(own)))
    return [*rows, rows[-1]]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    out = ngram_join.link_components(docs_of(spark, rows))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in out.collect())
    assert got == brute_components(rows)


def test_ngram_join_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4), monkeypatch.setattr(ngram_join, "LEAST_BLOCK", 4)  # lists of many blocks
    rows = near_copies(3, 50)
    out = ngram_join.link_components(docs_of(spark, rows))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in out.collect()) == brute_components(rows)


def test_ngram_join_groups_of_several_classes(spark):
    """Texts of equal size and rarest shingles that differ in passages which many others share."""
    rng, words = random.Random(22), [f"w{k}" for k in range(3000)]
    passages = [[rng.choice(words) for _ in range(40)] for _ in range(6)]
    rows = [(5000 + k, " ".join(rng.choices(words, k=30) + passages[k % 6] + rng.choices(words, k=9))) for k in range(120)]
    for base in range(4):
        own = rng.choices(words, k=(60, 100, 260, 261)[base])
        for k, p in enumerate(passages):
            rows += [(100 * base + 10 * k + j, " ".join(own[:half] + p + own[half:])) for j, half in enumerate((0, len(own)))]
    got = ngram_join.link_components(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_part_without_sketch_is_compared_by_size_and_place(spark):
    """Blocks that hold a part of several classes, which has no sketch."""
    units = spark.createDataFrame([(1, k, r, 100, left, sk, asks, 0, 0) for k, r, left, sk, asks in ((1, 1, 100, [5] * 8, 0), (2, 2, 100, [], 0), (3, 3, 95, [], 1), (4, 4, 10, [], 1))], "token long, k long, root long, n long, left long, sketch array<long>, asks int, u long, v long")
    units = units.coalesce(1).sortWithinPartitions("token", "u", "v", "asks", "k")
    for best in (False, True):
        got = {tuple(r) for r in ngram_join._compared(units, 85, best).collect()}
        assert got and got <= {(1, 3), (2, 3)} and (best or len(got) == 2)


def test_ngram_join_keeps_one_of_each(spark):
    rows = [(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, "z"), (4, None)]
    kept = ngram_join.one_per_component(docs_of(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and "digest" in kept.columns
    assert ngram_join.link_components(docs_of(spark, rows).limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    out = components(spark.createDataFrame(edges, "a long, b long"), Store(spark, "test"))
    assert {r.node: r.root for r in out.collect()} == {**{k: 0 for k in range(41)}, 100: 90, 90: 90, 95: 90}
    assert components(spark.createDataFrame([], "a long, b long"), Store(spark, "test")).count() == 0


# -- mixing


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = []
    for s, n, longest in (("b", 300, 40), ("a", 80, 200), (None, 40, 20), ("é", 10, 5), ("empty", 3, 1)):
        rows += [(len(rows) + k, " ".join(["w"] * (0 if s == "empty" else rng.randrange(1, longest))), None, s) for k in range(n)]
    rows += [(9_000, None, None, "a"), (None, "w w", None, "a"), (None, "w w", None, "a")]
    out = mixing.decisions(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").split())
    sizes, order = Counter(), ["a", "b", "empty", "é", None]
    for _, t, _, s in rows:
        sizes[s] += size(t)
    want, free, left = {}, {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}, sum(sizes.values())
    while True:  # cap, share the rest again
        over = [s for s in free if left * free[s] / sum(free.values()) > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * sizes[s]
        left -= sum(want[s] for s in over)
        free = {s: w for s, w in free.items() if s not in over}
    want |= {s: left * w / sum(free.values()) for s, w in free.items()}
    of = {i: s for i, _, _, s in rows}
    taken, longest = Counter(), Counter()
    for r in out:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s in order:
        assert abs(taken[s] - want[s]) <= longest[s]
    again = mixing.decisions(docs_of(spark, rows[::-1], 5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, out))
    mixed = mixing.mixed(docs_of(spark, rows))
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in Counter({}).items()} | {i: n for i, n in Counter([r.doc_id for r in out for _ in range(r.copies)]).items()})
    assert mixing.decisions(docs_of(spark, rows).limit(0)).count() == 0


# -- packing


def test_packing_loses_nothing(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "x y"), (4, "naïve café 12 " * 2000), (5, "日本語 don't <|endoftext|>"), (1, "Hello world")] + [(10 + k, "word " * (k * 7)) for k in range(40)]
    out = packing.pack(docs_of(spark, rows), capacity=256, group_items=16).collect()
    ids = {(i, len(x)): x for i, t in rows for x in [np.array(model.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")]}
    pieces, sequences = Counter(), defaultdict(list)
    for r in out:
        x = ids[(r.doc_id, r.doc_tokens)]
        assert zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces[(r.doc_id, r.doc_tokens)] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for key, n in Counter((i, len(model.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows).items():
        assert pieces[key] == n * key[1]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(docs_of(spark, rows).limit(0)).count() == 0


def test_first_fit_decreasing_equals_plain_search():
    rng = random.Random(6)
    for _ in range(50):
        lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 80))]
        room, want = [], [None] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            place = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            if place == len(room):
                room.append(100)
            want[i] = (place, 100 - room[place])
            room[place] -= lengths[i]
        assert packing.first_fit_decreasing(lengths, 100) == want


def test_word_cache_equals_tokenizer():
    words, rng = packing.WordIds(packing.tokenizer_path()), random.Random(7)
    letters = "abXY'sStT 12²½!?.,-_\n\t\x85\xa0éÉßÿŁƒ\x00\x1c\x7f’日İ<|>"
    for _ in range(500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 25)))
        assert words(text) == words.whole(text)


# -- language


def test_language_id(spark):
    rng = random.Random(8)
    parts = {"aa": ["la", "ta", "ma", "ra"], "bb": ["xo", "zik", "quo", "vux"]}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(40))
    rows = [(i, text(lang), lang, None) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 !?", "bb"), (903, "lata 𐐀" * 3, None), (None, "lamata", "bb"), (904, "LATAMA " * 50_000, "aa")]
    out = language_id.identify(docs_of(spark, rows)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:120]) and got[904].lang_pred == "aa"
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "aa" and got[903].lang_pred == "aa"
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    unlabelled = docs_of(spark, [(1, "abc"), (2, None)])
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}
    assert language_id.identify(unlabelled.limit(0)).count() == 0


# -- licenses


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy"
    rows = [
        (1, "x MIT-License; the mit license mit"), (2, f"see: {mit.replace('granted', 'grantd').replace('person', 'persons')} of it"), (3, None), (4, "..."),
        (5, "cc by cc by CC-BY"), (6, "ccby mitlicense"), (7, "word " * 100_000 + "Apache License"), (8, "é apache  LICENSE"), (1, "x"), (9, mit.replace("hereby", "not at all")),
    ]
    out = [r for r in license_scan.scan(docs_of(spark, rows)).collect()]
    got = {(r.doc_id, r.n_words): r for r in out}
    one = got[(1, 7)]
    assert (one.n_base, one.first_word, one.last_word, one.base_labels, one.score) == (2, 1, 4, "mit", 1.0)
    two = next(r for r in out if r.doc_id == 2)
    assert two.base_labels == "" and two.labels == "mit" and 0.9 < two.score < 1 and two.spans[0].edits == 2 and two.spans[0]["first"] == 1
    assert [(r.n_words, r.n_base, r.first_word, r.labels, r.score) for i in (3, 4) for r in out if r.doc_id == i] == [(0, 0, None, "", 0.0)] * 2
    assert next(r for r in out if r.doc_id == 5).n_base == 3 and next(r for r in out if r.doc_id == 6).n_base == 0
    seven = next(r for r in out if r.doc_id == 7)
    assert (seven.n_words, seven.first_word, seven.last_word) == (100_002, 100_000, 100_000)
    assert next(r for r in out if r.doc_id == 8).first_word == 1 and next(r for r in out if r.doc_id == 9).labels == ""
    assert license_scan.scan(docs_of(spark, rows).limit(0)).count() == 0


def edited(rng, notice, edits):
    """A notice with so many edits outside its name."""
    text, at = list(notice.text), f" {notice.text} ".find(notice.name) if notice.name else -9
    for _ in range(edits):
        free = [i for i, c in enumerate(text) if c is not None and not at - 1 <= i < at - 1 + len(notice.name)]
        if free:
            i = rng.choice(free)
            text[i] = rng.choice(["", "q", f"{text[i]}q"])
    return "".join(text)


def test_every_bounded_edit_is_found():
    scan, rng = license_scan.scanner(), random.Random(9)
    for notice in scan.notices:
        for _ in range(20):
            text = edited(rng, notice, notice.edits)
            assert notice.label in {x[0] for x in scan.fuzzy(f" before {text} behind ")}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return row[-1]


def least_edits(notice, line):
    """The least edits of any stretch of whole words that has the name unchanged, each side of it compared in full."""
    n, best = len(notice.text), 10**6
    ends = [i for i, c in enumerate(line) if c == " "]
    left, right = (notice.text.split(notice.name.strip(), 1) if notice.name else (notice.text, None))
    for s in ends:
        for e in ends:
            if abs(e - s - 1 - n) > notice.edits or e <= s:
                continue
            stretch = line[s : e + 1]
            if right is None:
                best = min(best, distance(notice.text, stretch[1:-1]))
                continue
            at = stretch.find(notice.name)
            while at >= 0:
                a, b = stretch[1:at] if at else "", stretch[at + len(notice.name) : -1]
                if bool(left) == bool(at) and bool(right) == (at + len(notice.name) < len(stretch)):
                    best = min(best, distance(left.rstrip(), a) + distance(right.lstrip(), b))
                at = stretch.find(notice.name, at + 1)
    return best


def test_notices_equal_brute_force():
    """A notice is found exactly where some whole words are within its edits, its name unchanged; spans have the edits they say."""
    scan, rng = license_scan.scanner(), random.Random(19)
    for k, notice in enumerate(scan.notices):
        near = 0
        for trial in range(8):
            text = edited(rng, notice, rng.randrange(0, 2 * notice.edits + 2) if trial else 1)
            if trial % 4 == 3 and notice.name:
                text = text.replace(notice.name.strip(), "xyz", 1)
            line = f" before {text} behind "
            begins = sorted({e + 1 - size - offset for e, (size, where) in scan.automaton.iter(line) for x, offset in where if x == k})
            found, best = scan._verified(line, k, begins), least_edits(notice, line)
            assert bool(found) == (best <= notice.edits)
            near += bool(found)
            if found:
                assert min(x[2] for x in found) == best and all(line[s - 1] == line[e] == " " and least_edits(notice, line[s - 1 : e + 1]) <= n for s, e, n, _ in found)
            assert notice.least(line) <= best
        assert 0 < near


def test_names_of_licences_are_not_edited(spark):
    """Notices that differ in the licence's name are not taken for one another, and words that only contain a notice's first word are not it."""
    scan = license_scan.scanner()
    labels = lambda text: {x[0] for x in scan.fuzzy(f" {text} ")}
    for name in ("mit", "bsd", "isc", "mpl"):
        assert labels(f"released under the {name} license") == {name} and labels(f"relesed undr the {name} license") == {name}
    assert labels("released under the old license") == labels("released under the license") == set()
    assert labels("small rights reserved") == set() and labels("all rights reservd") == {"all-rights-reserved"}
    assert labels("gnu lesser general public license") == {"lgpl"} and labels("gnu affero general public license") == {"agpl"}
    assert labels("creative commons attribution sharealike 4 0 international") == {"cc-by-sa"}
    # candidates that come to nothing, and places by the thousand, in time that follows the text
    began = time.perf_counter()
    assert not scan.fuzzy(" " + "this program is free software you can redistributing " * 400)
    assert len(scan.fuzzy(" " + "released under the mit license " * 3_200)) == 3_200
    assert time.perf_counter() - began < 15


def test_notices_side_by_side():
    scan = license_scan.scanner()
    spans = lambda text: [x[1:4] for x in scan.fuzzy(text) if x[0] == "mit"]
    assert [n for _, _, n in spans(" relxased undxr the mit license released under the mit license ")] == [2, 0]
    assert [n for _, _, n in spans(" released under the mit license relxased undxr the mit license released under the mit license ")] == [0, 2, 0]
    for many in (200, 1600):
        assert len(spans(" " + "released under the mit license " * many)) == many


def test_base_phrases_equal_plain_search(spark):
    rng = random.Random(20)
    words = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "x", "é", "MIT", "License,", "\n"]
    rows = [(i, None if i == 0 else rng.choice((" ", "-", "\t")).join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(80)]
    got = {r.doc_id: r for r in license_scan.scan(docs_of(spark, rows)).collect()}
    for i, text in rows:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = __import__("re").findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded)
        places = [(p, label) for phrase, label in license_scan.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


# -- URLs


def test_url_filter(spark):
    urls = [
        "http://Shop.Example.COM/en/1?x", "http://example.com/en/77", "http://a.example.com/en/7", "http://example.net/de/8", "http://x.net/de/9", "https://org/es/", "http://notcom/en/", "http://example.com/En/",
        "http://h?q/en/", "http://h#f", None, "no url", "http://", "ftp://a://b/c", "http://x.org/" + "y" * 100_000, "http://é.com/ü",
    ]
    pages = spark.createDataFrame([(i, u, "z", "w") for i, u in enumerate(urls)] + [(0, urls[0], "z", "w")], "page_id long, url string, host string, label string")
    out = url_filter.judge(pages).collect()
    assert len(out) == len(urls) + 1 and out[0].label == "w"
    got = {r.page_id: r for r in out}
    assert [got[i].rule for i in range(8)] == ["com/en/", "example.com/en/7", "example.com/en/7", "example.net/de/8", "net/de/", "org/es/", None, None]
    assert [got[i].verdict for i in range(6)] == ["block", "allow", "allow", "block", "allow", "block"]
    assert got[0].host == "shop.example.com" and got[0].path == "/en/1" and got[8].host == "h" and got[8].path == "" and got[13].host == "a:" and got[13].path == "//b/c"
    assert [(got[i].host, got[i].path) for i in (10, 11, 12)] == [("", "")] * 3 and got[15].host == "é.com"
    assert all(r.verdict in ("allow", "block") and 0 <= r.probability <= 1 for r in out)
    held = [("https://mega-casino.example.com/jackpot/bonus", "block"), ("https://www.school.example.edu/courses/history", "allow")]
    assert [r.verdict for r in url_filter.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")).orderBy("page_id").collect()] == [v for _, v in held]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_filter_after_an_observation(spark):
    seen = Observation()
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 5
    assert url_filter.judge(spark.createDataFrame([(1, "http://org/es/")], "page_id long, url string")).first().verdict == "block"


# -- WARC


def test_warc_round_trip(spark):
    long = "<p>é</p>" * 50
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello" * 3 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "http://a/", long), (3, "http://b/", long), (9, "http://c/\r\nX: y", long), (1, None, None), (2, "", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", tricky), (8, "u", tricky), (None, "n", long), (3, "http://b/", long)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, row int").repartition(3)
    out = warc.round_trip(pages).collect()
    assert len(out) == len(rows)
    first = {long: 3, tricky: 7}
    responses = Counter()
    for r in out:
        html = {(i): h for i, _, h in rows}[r.page_id] or ""
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        responses[html] += r.record_type == "response"
        assert r.refers_to == (first[html] if r.record_type == "revisit" else None)
        assert r.request_id and r.metadata_id
        if r.record_type == "response" and html in first:
            assert r.page_id == first[html]
    assert responses == {long: 2, tricky: 1, "short": 2, "": 2}  # page 3 is there twice
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_assembly(spark):
    base = {f.split(" ")[0]: None for f in warc.RECORD.split(", ")} | {"payload_bytes": 1}
    records = [
        {"record_id": "c1", "type": "response"}, {"record_id": "r1", "type": "request", "concurrent_to": ["c1"]}, {"record_id": "r0", "type": "request", "concurrent_to": ["c1"]},
        {"record_id": "m1", "type": "metadata", "concurrent_to": ["r1"], "block": b"k: v\r\n"}, {"record_id": "c2", "type": "revisit", "refers_to": "c1"}, {"record_id": "m9", "type": "metadata", "concurrent_to": ["gone"]},
        {"record_id": "i", "type": "warcinfo"}, {"record_id": None, "type": "request", "concurrent_to": ["c1"]},
        # the capture names its records, or one that names the other
        {"record_id": "c3", "type": "response", "concurrent_to": ["r3", "m3"]}, {"record_id": "r3", "type": "request"}, {"record_id": "m3", "type": "metadata", "block": b"x: 3\r\n"},
        {"record_id": "c4", "type": "response", "concurrent_to": ["r4"]}, {"record_id": "r4", "type": "request", "concurrent_to": ["m4"]}, {"record_id": "m4", "type": "metadata", "block": b""},
    ]
    df = spark.createDataFrame([tuple((base | r).values()) for r in records], warc.RECORD)
    got = {r.capture.record_id: r for r in warc.assemble(df).collect()}
    assert set(got) == {"c1", "c2", "c3", "c4"} and got["c1"].request.record_id == "r0" and got["c1"].requests == 2
    assert got["c1"].metadata.fields == "k: v\r\n" and got["c2"].request is None and got["c2"].metadata_records == 0
    assert [(got[c].request.record_id, got[c].metadata.record_id, got[c].requests) for c in ("c3", "c4")] == [("r3", "m3", 1), ("r4", "m4", 1)]


def test_warc_versions_and_headers(spark, tmp_path):
    """Archives of both versions, several concurrent-to headers, payloads that hold separators again and again."""
    record = lambda v, name, block, *more: (f"WARC/1.{v}\r\nWARC-Type: metadata\r\nWARC-Record-ID: {name}\r\n" + "".join(f"{x}\r\n" for x in more) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    inner = record(0, "inner", b"x") * 3000
    parts = [record(0, "a", b"one"), record(1, "b", b"", "WARC-Concurrent-To: a", "warc-concurrent-to: c"), record(0, "c", inner), record(0, "d", b"WARC/1.0\r\n"), record(1, "e", b"end")]
    import gzip

    for name, data in (("x.warc.gz", b"".join(map(gzip.compress, parts))), ("y.warc", b"".join(parts))):
        (tmp_path / name).write_bytes(data)
        got = {r.record_id: r for r in warc.read(spark, f"file://{tmp_path}/{name}").collect()}
        assert sorted(got) == ["a", "b", "c", "d", "e"] and got["b"].concurrent_to == ["a", "c"]
        assert [bytes(got[x].block) for x in "acde"] == [b"one", inner, b"WARC/1.0\r\n", b"end"]
    # blocks that end in line ends, wherever the reader's buffers of 64 KB end
    (tmp_path / "edges").mkdir()
    for shift in range(24):
        first = record(0, "first", b"x" * 60_000 + b"\r\n\r\n")
        first = record(0, "first", b"x" * (60_000 + 65_536 + 8 - len(first) - shift) + b"\r\n\r\n")
        (tmp_path / "edges" / f"{shift}.warc").write_bytes(first + record(1, "second", b"2\r\n") + record(0, "third", b""))
    assert Counter(r.record_id for r in warc.read(spark, f"file://{tmp_path}/edges").collect()) == dict.fromkeys(("first", "second", "third"), 24)


# -- nearest neighbours


def test_multi_index_recall_and_ties(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[40:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (2200, [1.0]), (None, [1.0] * 16), (50, x[50].tolist())]
    out = multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    assert set(got) == set(range(0, 1500, 50)) and [i for i, _ in got[50]] == [40, 41, 42, 43, 44]
    found = 0
    for q in range(0, 1500, 50):
        cos = unit @ unit[q]
        cos[q] = -9
        assert len(got[q]) == 5 and all(abs(cos[i] - s) < 1e-12 for i, s in got[q])
        found += len(set(np.argsort(-cos, kind="stable")[:5]) & {i for i, _ in got[q]}) if q != 50 else 5
    assert found >= 0.9 * 5 * len(got)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"]) for r in multi_index.search(few).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert multi_index.search(few.limit(0)).count() == 0


def test_radius_holds_the_sample_queries_neighbours():
    x = multi_index.unit_rows(np.random.default_rng(12).normal(size=(1500, 32)))
    coder = multi_index.fit(x)
    codes, near = coder.codes(x), x[:256] @ x.T
    near[np.arange(256), np.arange(256)] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, :5]
    assert (np.bitwise_count(codes[:256, None] ^ codes[best]) <= coder.radius).mean() >= 0.99


def test_probing_finds_all_within_the_radius():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(800, 64))
    shard = multi_index.Shard(multi_index.fit(x[:400]), np.arange(800), x)
    for q in range(0, 800, 100):
        for radius in (0, 9, 20, 27, 64):
            want = np.flatnonzero(np.bitwise_count(shard.codes ^ shard.codes[q]) <= radius)
            assert (shard.within(shard.codes[q : q + 1], radius) == want).all()


# -- toxicity


def test_toxicity(spark):
    rng = random.Random(12)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(60)]
        if i % 6 == 0:
            text[rng.randrange(60)] = rng.choice(["vilexx", "nastyy"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(900, None), (901, ""), (None, "vilexx"), (902, "vilexx " * 50_000), (0, rows[0][1])]
    labels += [(0, 1, 0), (None, 1, 1), (5000, 0, 1), (7, 0, None)]
    table_of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.judge(docs_of(spark, rows), table_of).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert held and all(r.predicted == (r.doc_id % 6 == 0) for r in held)
    by = {r.doc_id: r for r in out}
    assert by[902].predicted == 1 and by[900].predicted == by[901].predicted == 0 and by[902].evidence[0].toxic == 1
    none = toxicity.judge(docs_of(spark, rows), table_of.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.judge(docs_of(spark, rows).limit(0), table_of).count() == 0


def test_toxicity_of_rare_words(spark):
    """Toxic texts whose telling words each are in fewer than 2 % of the toxic examples."""
    rng = random.Random(14)
    words = ["".join(rng.choices("aeiou", k=2)) + f"{'xyz'[k % 3]}" + "".join(rng.choices("abcde", k=3)) for k in range(80)]
    vile = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=8)) for _ in range(300)]
    rows = []
    for i in range(1200):
        text = rng.choices(words, k=30) + (rng.sample(vile, 4) if i % 3 == 0 else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
    trained = [i for i, in spark.range(1200).where(toxicity.may_train(F.col("id"))).collect() if i % 3 == 0]
    told = Counter(w for i in trained for w in rows[i][1].split() if w in set(vile))
    assert max(told.values()) < 20 and sum(n < 0.02 * len(trained) for n in told.values()) > 0.8 * len(vile)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(1200)], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.judge(docs_of(spark, rows), labels).collect() if r.held_out]
    caught = [r.predicted for r in held if r.doc_id % 3 == 0]
    wrong = [r.predicted for r in held if r.doc_id % 3]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.1 * len(wrong)


def test_toxicity_keeps_the_shares_of_labels(spark):
    """One text in ten is toxic, and nothing tells which: scores come to a tenth, however many examples are drawn."""
    rng = random.Random(15)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    docs = docs_of(spark, [(i, " ".join(rng.choices(words, k=20)) if i % 7 else None) for i in range(1400)])
    labels = spark.createDataFrame([(i, 1, int(rng.random() < 0.1)) for i in range(1400)], "doc_id long, quality int, toxic int")
    for per_label in (50, 2000):
        model = toxicity.learn(docs, labels, per_label)
        scores = [r.score for r in toxicity.score(docs, model).collect()]
        assert 0.07 < model.share < 0.13 and model.bare < 0.3 and 0.05 < sum(scores) / len(scores) < 0.2


def neighbours(ids, counts, labels, vocabulary, **more):
    """Neighbours from dictionaries of the examples' features."""
    known = [sorted((vocabulary.index(f), n) for f, n in c.items() if f in vocabulary) for c in counts]
    flat = np.array([x for c in known for x in c], dtype=np.int64).reshape(-1, 2)
    return toxicity.Neighbours(ids, flat[:, 0], flat[:, 1], np.cumsum([0, *map(len, known)]), labels, vocabulary, **more), [np.array(c, dtype=np.int64).reshape(-1, 2) for c in known]


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = random.Random(13)
    counts = [Counter(rng.choices([f"f{k}" for k in range(40)], k=rng.randrange(1, 9))) for _ in range(500)]
    labels = [int("f1" in c or "f2" in c) if rng.random() < 0.9 else rng.randrange(2) for c in counts]
    model, known = neighbours(list(range(500)), counts, labels, [f"f{k}" for k in range(40)], k=7)
    vectors = {i: dict(zip(*[x.tolist() for x in model.vector(known[i][:, 0], known[i][:, 1])])) for i in range(500)}
    for q in range(0, 500, 25):
        at, w = model.vector(known[q][:, 0], known[q][:, 1])
        own = dict(zip(at.tolist(), w.tolist()))
        for without in (None, q):
            want = sorted((round(sum(own.get(f, 0) * x for f, x in v.items()), 12), -i) for i, v in vectors.items() if i != without)[::-1]
            want = [(s, -i) for s, i in want if s > 0][:7]
            rows, scores = model.nearest(at, w, 7, -1 if without is None else model.row_of.get(q, -1))
            assert sorted(scores.tolist(), reverse=True) == pytest.approx([s for s, _ in want])
            assert sorted(model.ids[rows].tolist()) == sorted(i for _, i in want)
            # votes and evidence, plainly
            score, evidence = model.score(known[q][:, 0], known[q][:, 1], without)
            assert not want or [i for i, _, _ in evidence] == [i for _, i in want]
            if want:
                share = sum(labels) / 500
                p = (sum(s * labels[i] for s, i in want) + toxicity.PRIOR * share) / (sum(s for s, _ in want) + toxicity.PRIOR)
                z = model.curve[0] * np.log(p / (1 - p)) + model.curve[1]
                assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_of_repeated_rows(spark):
    """Rows that are there six times score as they do once, and no document votes on itself."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(80)]
    rows = [(i, " ".join(rng.choices(words, k=25) + (["vilexx"] if i % 5 == 0 else []))) for i in range(150)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    once = {r.doc_id: r for r in toxicity.judge(docs_of(spark, rows), labels).collect()}
    often = toxicity.judge(docs_of(spark, rows * 6), labels).collect()
    assert len(often) == 900 and all(r.score == pytest.approx(once[r.doc_id].score) for r in often)
    assert all(i not in {e.doc_id for e in r.evidence} and (i % 5 or len(r.evidence) > 3) for i, r in once.items())
    assert sum(r.predicted != (i % 5 == 0) for i, r in once.items()) <= 3


def test_toxicity_reads_words_as_a_plain_loop_does():
    texts = [None, "", "  ", "One one ONE, two-two_two 3four 5", "häuser Häuser déjà х" * 3, "abcdef " * 9 + "abcdeg", "²x ½ Ⅷ"]
    want = [Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for t in texts]
    names = sorted({w for c in want for w in c})
    of, base, n, _ = toxicity._counted(pa.array(texts), pa.array(names))
    assert list(zip(of, [names[b] for b in base], n)) == sorted((i, w, k) for i, c in enumerate(want) for w, k in c.items())
    model = toxicity.Neighbours([1], np.arange(len(names)), np.ones(len(names)), np.array([0, len(names)]), [1], names)
    assert (model.weight_of > 0).all()
    read = [Counter({names[f]: k for f, k in zip(*found)}) for found in toxicity.Reader(model)(pa.array(texts))]
    assert read == want


def test_every_word_of_the_examples_weighs():
    """Words of one label, of both alike, and of one example alone."""
    rng = np.random.default_rng(4)
    with_0, with_1 = rng.integers(0, 9, 300), rng.integers(0, 4, 300)
    told = toxicity._telling(with_0, with_1, 500, 2000)
    assert (told > 0).all() and toxicity._telling(np.array([50]), np.array([200]), 500, 2000)[0] == toxicity.LEAST
    assert told[(with_0 == 0) & (with_1 == 1)].min() > 0.01 and (toxicity._telling(with_0, with_1, 0, 10) == 1).all()
