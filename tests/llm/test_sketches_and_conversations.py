"""Operators 11 to 13 against plain Python on small tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from termloom.llm import conversation_repair, conversation_trie, scaled_sketch

TURNS = "conv_id long, turn long, role string, text string, digest string, pos int, id long"


def turns_of(spark, rows, n=3):
    """(conv_id, turn, role, text) with columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "x", 7, 7) for r in rows], TURNS).repartition(n)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(role, text):
    return sha(f"{len(role)}:{role}{text}")


# -- scaled sketches


def brute_sketch(text, width=5):
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    h = {hashlib.md5(" ".join(w[i : i + width]).encode()).hexdigest()[:16] for i in range(max(1, len(w) - width + 1))} if w else set()
    return sorted(x for x in h if x < "2") or sorted(h)[:1]


def brute_likeness(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))


@pytest.mark.parametrize("range_rows", [4_000, 7])
def test_sketches_of_edited_texts(spark, monkeypatch, range_rows):
    monkeypatch.setattr(scaled_sketch, "RANGE_ROWS", range_rows)
    rng = random.Random(5)
    vocabulary = ["Été", "DOG", "cat", "İx", "　y", "z", "naïve", "a", "b"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 6, 40, 200]))) for _ in range(40)] + [None, "", "  \n", "x", "one two three", "é" * 50_000, "w " * 60_000]
    ids = rng.sample(range(-50, 10**12), len(texts))
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame([(*r, "s", "f", 1) for r in rows], "doc_id long, text string, sketch string, fingerprint string, id int").repartition(4)
    got = {r.doc_id: r for r in scaled_sketch.edited(docs).collect()}
    assert len(got) == len(rows)
    rows.sort()
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        t, following = t or "", following or ""
        cut = len(t) // 4
        new = t[: len(t) - cut] + following[:cut]
        a, b, c = brute_sketch(t), brute_sketch(new), brute_sketch(following)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(new), "".join(a), "".join(b))
        assert (r.near_edited, r.near_next) == (pytest.approx(brute_likeness(a, b)), pytest.approx(brute_likeness(a, c)))
        assert r.contained_next == pytest.approx(len(set(a) & set(c)) / len(a) if a else 1.0)


def test_sketches_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "p q r s t u"), (None, "l m n o p q"), (None, "l m n o p q")]
    got = scaled_sketch.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and [r.near_next for r in got if r.doc_id is None] == [1.0, 1.0]
    assert sorted(r.near_next for r in got if r.doc_id == 1) == [0.0, 1.0]  # the other row of document 1, then document 2
    alone = scaled_sketch.edited(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == sha("abca")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert scaled_sketch.edited(empty).count() == 0


def test_sketches_merge_and_estimate_containment(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    large = [rng.choice(words) for _ in range(20_000)]
    parts = [" ".join(large[i : i + 504]) for i in range(0, 20_000, 500)]  # neighbours share four words, so no shingle is lost
    df = spark.createDataFrame([(1, p) for p in parts] + [(2, "only three words"), (2, "and four other words")], "k int, t string").withColumn("sketch", scaled_sketch.sketch(F.col("t")))
    merged = defaultdict(list)
    for r in scaled_sketch.merged(df, "k").collect():
        merged[r.k].append(r["hash"])
    assert sorted(merged[1]) == brute_sketch(" ".join(large))
    both = sorted({h for t in ("only three words", "and four other words") for h in brute_sketch(t)})
    assert sorted(merged[2]) == ([h for h in both if h < "2"] or both[:1])
    # a small text of which half is from the large one
    small = " ".join(large[700:1100] + [f"x{i}" for i in range(400)])
    pair = spark.createDataFrame([(small, " ".join(large))], "a string, b string").select(scaled_sketch.sketch(F.col("a")).alias("a"), scaled_sketch.sketch(F.col("b")).alias("b"))
    r = pair.select(scaled_sketch.containment(F.col("a"), F.col("b")).alias("c"), scaled_sketch.likeness(F.col("a"), F.col("b")).alias("j"), scaled_sketch.union(F.col("a"), F.col("b")).alias("u")).first()
    assert abs(r.c - 0.5) < 0.15 and r.j < 0.05
    assert r.u == sorted(set(brute_sketch(small)) | set(brute_sketch(" ".join(large))))


# -- prefix trie


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, digest(role, text), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - int(__import__("math").fmod(c, 100))
        made[c] = own.get(donor, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = (len(nodes[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[k] for k in children[path])
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], sha(",".join(map(str, sorted(c for c in m if len(made[c]) == len(p))))))
        for p, m in nodes.items()
    )


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed, n, alphabet, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-130, 900), n):
        for t in range(rng.choice([1, 2, 3, longest])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(alphabet)))
    return rows


@pytest.mark.parametrize(("seed", "n", "alphabet", "shard_turns"), [(1, 120, ["a", "bb", None, ""], 250_000), (2, 250, ["a", "bb"], 20), (3, 300, ["a"], 9), (4, 60, ["x" * 30_000, "é", "b"], 5)])
def test_trie_equals_brute_force(spark, seed, n, alphabet, shard_turns):
    rows = conversations(seed, n, alphabet, 9)
    rows += [(None, 1, "user", "no conversation"), (rows[0][0], *rows[0][1:])]
    rows += [(5000 + i, t, "user", "same") for i in range(200) for t in range(8)]  # copies of one conversation
    got = trie_rows(conversation_trie.trie(conversation_trie.rebuilt(turns_of(spark, rows)), shard_turns))
    assert got == brute_trie(rows)


def test_trie_of_nothing_and_of_long_conversations(spark):
    assert conversation_trie.trie(conversation_trie.rebuilt(turns_of(spark, []))).count() == 0
    rows = [(c, t, "user", str(t if t < 2900 else (c, t))) for c in (300, 301, 302) for t in range(3000)]
    for shard_turns in (250_000, 3_000):
        assert trie_rows(conversation_trie.trie(conversation_trie.rebuilt(turns_of(spark, rows)), shard_turns)) == brute_trie(rows)


# -- repair


def fault_rows(rows):
    """Damaged rows of each conversation in order: (turn, role, text, fault)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if how:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(how, text)
            convs[c] += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    out = {}
    for c, v in convs.items():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))
        seen, made = set(), []
        for turn, role, text in v:
            solid = text.strip(" \t\n\v\f\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            made.append((turn, role, text, fault))
        out[c] = made
    return out


def all_edits(rows):
    """The best (cost, initials, lines) of all edits, one state at a time, with plain strings."""
    follows = lambda text: re.fullmatch(r"|s?(ua)*u?|s", text) is not None
    best = {"": (0, "", ())}  # by the initials so far, cut to what matters

    def short(said):
        return said if len(said) < 2 else ("-" if len(said) else "") + said[-1]

    def offer(table, said, way):
        key = short(said)
        if key not in table or way[:2] < table[key][:2]:
            table[key] = way

    def said_of(key):
        return {"-u": "uau", "-a": "ua"}.get(key, key)

    def inserted(table):
        for _ in range(3):
            for key, (cost, audit, lines) in list(table.items()):
                for letter, role in (("u", "user"), ("a", "assistant")):
                    said = said_of(key) + letter
                    if follows(said):
                        offer(table, said, (cost + 2, audit + "I", (*lines, f"{role}:")))
        return table

    for _, role, text, fault in rows:
        table = {}
        for key, (cost, audit, lines) in inserted(dict(best)).items():
            said = said_of(key)
            offer(table, said, (cost + 3, audit + "D", lines))
            if fault in ("", "truncated"):
                more = fault == "truncated"
                if role and follows(said + role[0]):
                    offer(table, said + role[0], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for letter, new in (("u", "user"), ("a", "assistant")):
                    if follows(said + letter):
                        offer(table, said + letter, (cost + 2 + more, audit + "R", (*lines, f"{new}:{text}")))
        best = table
    return min(way for key, way in inserted(dict(best)).items() if re.fullmatch(r"(s?(ua)+)?", said_of(key)))


def brute_repair(rows):
    faults, out = fault_rows(rows), {}
    for c in {r[0] for r in rows}:
        v = faults.get(c, [])
        turns = [t for t, *_ in v if t is not None]
        cost, audit, lines = all_edits(v)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(v, v[1:])]
        count = lambda f: sum(x[3] == f for x in v)  # noqa: E731, B023
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines)))
    return out


def repaired(spark, rows):
    t = turns_of(spark, rows)
    out = conversation_repair.repair(conversation_repair.damaged(t), t).collect()
    assert len(out) == len({r[0] for r in rows})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out}


def test_edits_of_few_rows_are_the_best_of_all():
    """Every way to edit up to two rows, and some rows of three, enumerated."""
    grammar = conversation_repair.Grammar()
    letters = conversation_repair._LETTERS
    every = ["".join(s) for n in range(3) for s in itertools.product(letters, repeat=n)]
    for symbols in every + random.Random(1).sample(["".join(s) for s in itertools.product(letters, repeat=3)], 8):
        found = []
        for ops in itertools.product("DKua", repeat=len(symbols)):
            for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(symbols) + 1):
                said, cost, audit = gaps[0], 2 * len(gaps[0]), "I" * len(gaps[0])
                for s, op, gap in zip(symbols, ops, gaps[1:]):
                    code = letters.index(s)
                    said += {"D": "", "K": "sua??"[code >> 1]}.get(op, op) + gap
                    cost += {"D": 3, "K": code & 1}.get(op, 2 + (code & 1)) + 2 * len(gap)
                    audit += {"D": "D", "K": "K"}.get(op, "R") + "I" * len(gap)
                if re.fullmatch(r"(s?(ua)+)?", said) and all(op == "D" for s, op in zip(symbols, ops) if s == letters[8]):
                    found.append((cost, audit))
        cost, edits = conversation_repair.solve_all([symbols], grammar)[symbols]
        assert (cost, "".join(edits).translate(conversation_repair._INITIAL_OF)) == min(found)


def test_repair_equals_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for c in [None, *range(-3, 120)]:
        for t in range(rng.choice([1, 2, 4, 7, 60])):
            text = rng.choice(["Hi there.", "What?", "no end", "", "  \t", None, "Yes! ", "a.b", f"own {t}.", f"own {t}\n", "é" * 20_000 + "."])
            rows.append((c, rng.choice([t, t, t, t * 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    rows += [(900 + i, t, role, f"{t}.") for i in range(300) for t, role in enumerate(("system", "user", "assistant", "user", "assistant"))]  # one conversation over and over
    assert repaired(spark, rows) == brute_repair(rows)


def test_repair_of_nothing_and_of_long_conversations(spark):
    assert repaired(spark, []) == {}
    gone = next(c for c in range(10_000) if not zlib.crc32(f"{c}:0".encode()) % 20)
    assert repaired(spark, [(gone, 0, "user", "x.")]) == {gone: (0, 0, 0, 0, 0, 0, "", sha(""))}
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), f"{t}{rng.choice('.,')}") for t in range(5_000)]
    assert repaired(spark, rows) == brute_repair(rows)
