"""Repair of a conversation's structure: the cheapest edits that give roles an order of ``(s?(ua)+)?``.

``damaged`` spoils conversations in a way that can be checked; ``repair`` finds each row's fault (blank, then
duplicate, then truncated) and the cheapest edits, ties to the least string of their initials in ASCII.
Keep costs 0, Rerole to user or assistant 2, Delete 3 (all that may happen to blank rows and duplicates),
Insert of an empty row 2, and a truncated row that stays 1 more.

A row is one symbol of role and fault. The order of roles is an automaton of four states, and a symbol is a
min-plus matrix over them: the cheapest edits of that row, insertions before it included, from state to
state. Re-Pair makes rules of the most frequent pairs of symbols in a batch's sequences; a rule has one matrix, the
product of its parts' matrices, made once and shared by all conversations of a task. A matrix holds
costs, the state in the middle and the order of its edits' strings, not the strings: strings of as many rows that end with a row's
edit are never the beginning of one another, so the order of two products follows from the
order of their first parts, or else of their second. The audit is a rope: rule, states and middle state, unrolled at the end.

Only roles' initials, faults and hashes travel to the edits, one byte a row; texts are shuffled once, by conversation,
and hashed as a stream.

Defined cases: null roles and texts are one space. A null conv_id is a conversation of its own. Turns of one number stand in order of the
hash of role and text. Every conversation of ``originals`` has a result, also without rows. Texts of any length are read whole. Rows
that repeat are duplicates. Columns besides conv_id, turn, role and text are ignored, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store
from .conversation_trie import turn_digest

_SPACES = " \t\n\v\f\r"
#: Classes of initials, and pairs of initials that may follow each other.
_INITIALS, LEGAL = "sua", ("su", "ua", "au")
#: A row's symbol: role class times two, plus one if truncated; rows that must go share one.
_MUST_GO = 8
_LETTERS = "abcdefgh" + "x"
INF = 1 << 60
#: Long sequences are compressed in pieces of so many symbols; rules and answers that a task keeps.
PIECE, MOST_RULES, MOST_ANSWERS = 1024, 100_000, 50_000

# states: nothing yet, after system, after user, after assistant
_INSERT = ((2, "u"), (2, "u"), (3, "a"), (2, "u"))
_ACCEPT = {0: (0, ""), 1: (4, "ua"), 2: (2, "a"), 3: (0, "")}
_INITIAL_OF = str.maketrans("uaUA", "IIRR")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space)."""
    space = F.lit(" ")
    mark = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(mark.cast("binary")) % 20).alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


# -- matrices over the states


class _Matrix:
    """Cheapest edits from state to state: costs, and the order of their strings within a row of the matrix."""

    __slots__ = ("cost", "rank", "parts", "middle", "edits")

    def __init__(self, cost, rank, parts=None, middle=None, edits=None):
        self.cost, self.rank, self.parts, self.middle, self.edits = cost, rank, parts, middle, edits


def _follows(state: int, role: int) -> int | None:
    if role == 0:
        return 1 if state == 0 else None
    if role == 1:
        return None if state == 2 else 2
    return 3 if role == 2 and state == 2 else None


def _terminal(symbol: int) -> _Matrix:
    """The matrix of one row: insertions, then its own edit."""
    cost, rank, edits = [], [], []
    for start in range(4):
        best: dict[int, tuple[int, str, str]] = {}
        state, before = start, ""
        for inserted in range(3):
            ways = [(state, 3, "D")]
            if symbol != _MUST_GO:
                role, truncated = symbol >> 1, symbol & 1
                kept = _follows(state, role)
                if kept is not None:
                    ways.append((kept, truncated, "K"))
                ways.append((3, 2 + truncated, "A") if state == 2 else (2, 2 + truncated, "U"))
            for end, more, edit in ways:
                made = before + edit
                way = (2 * inserted + more, made.translate(_INITIAL_OF), made)
                if end not in best or way < best[end]:
                    best[end] = way
            state, letter = _INSERT[state]
            before += letter
        order = {end: n for n, end in enumerate(sorted(best, key=lambda e: best[e][1]))}
        cost.append([best[e][0] if e in best else INF for e in range(4)])
        rank.append([order.get(e, 4) for e in range(4)])
        edits.append([best[e][2] if e in best else "" for e in range(4)])
    return _Matrix(cost, rank, edits=edits)


def _row_times(cost: list[int], rank: list[int], m: _Matrix) -> tuple[list[int], list[int], list[int]]:
    """One row of a product: costs, ranks and middle states."""
    out, middle = [INF] * 4, [0] * 4
    for k in sorted(range(4), key=rank.__getitem__):  # of equal costs, the first in order stays
        if cost[k] < INF:
            mk = m.cost[k]
            for j in range(4):
                if cost[k] + mk[j] < out[j]:
                    out[j], middle[j] = cost[k] + mk[j], k
    order = sorted((j for j in range(4) if out[j] < INF), key=lambda j: (rank[middle[j]], m.rank[middle[j]][j]))
    ranks = [4] * 4
    for n, j in enumerate(order):
        ranks[j] = n
    return out, ranks, middle


def _product(a: _Matrix, b: _Matrix) -> _Matrix:
    rows = [_row_times(a.cost[i], a.rank[i], b) for i in range(4)]
    return _Matrix([r[0] for r in rows], [r[1] for r in rows], (a, b), [r[2] for r in rows])


class Grammar:
    """Re-Pair rules over symbols, each with its matrix; kept from batch to batch."""

    def __init__(self):
        self.matrices = [_terminal(s) for s in range(len(_LETTERS))]
        self.rules: dict[tuple[int, int], int] = {}

    def _rule(self, pair: tuple[int, int]) -> int:
        if pair not in self.rules:
            self.rules[pair] = len(self.matrices)
            self.matrices.append(_product(self.matrices[pair[0]], self.matrices[pair[1]]))
        return self.rules[pair]

    def compress(self, pieces: list[list[int]]) -> None:
        """Replaces the most frequent pair of neighbours by a rule, over and over, while one occurs twice."""
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        total: Counter = Counter()

        def count(n: int, sign: int) -> set:
            found = Counter(zip(pieces[n], pieces[n][1:]))
            for pair, times in found.items():
                total[pair] += sign * times
                if sign > 0:
                    where[pair].add(n)
                else:
                    where[pair].discard(n)
            return set(found)

        for n in range(len(pieces)):
            count(n, 1)
        heap = [(-times, pair) for pair, times in total.items() if times > 1]
        heapq.heapify(heap)
        while heap:
            times, pair = heapq.heappop(heap)
            if -times != total[pair]:
                if total[pair] > 1:
                    heapq.heappush(heap, (-total[pair], pair))
                continue
            if -times < 2:
                continue
            rule, touched = self._rule(pair), set()
            for n in list(where[pair]):
                count(n, -1)
                old, new, i = pieces[n], [], 0
                while i < len(old):
                    if i + 1 < len(old) and (old[i], old[i + 1]) == pair:
                        new.append(rule)
                        i += 2
                    else:
                        new.append(old[i])
                        i += 1
                pieces[n] = new
                touched |= count(n, 1)
            for p in touched:
                if total[p] > 1:
                    heapq.heappush(heap, (-total[p], p))

    def solve(self, symbols: list[int]) -> tuple[int, list[str]]:
        """Cost, and the edits of each row with those that are added at the end: inserted ``u`` and ``a``, then K, D, U or A."""
        cost, rank, steps = [0, INF, INF, INF], [0, 4, 4, 4], []
        for s in symbols:
            cost, rank, middle = _row_times(cost, rank, self.matrices[s])
            steps.append(middle)
        end = min((k for k in range(4) if cost[k] < INF), key=lambda k: (cost[k] + _ACCEPT[k][0], rank[k]))
        state, todo = end, []
        for s, middle in zip(reversed(symbols), reversed(steps)):
            todo.append((self.matrices[s], middle[state], state))
            state = middle[state]
        edits = []
        while todo:  # the last one is the first in order
            m, i, j = todo.pop()
            if m.parts is None:
                edits.append(m.edits[i][j])
            else:
                k = m.middle[i][j]
                todo.append((m.parts[1], k, j))
                todo.append((m.parts[0], i, k))
        return cost[end] + _ACCEPT[end][0], [*edits, _ACCEPT[end][1]]


def solve_all(sequences: list[str], grammar: Grammar) -> dict[str, tuple[int, list[str]]]:
    """The answers of distinct sequences of letters."""
    pieces, owner = [], []
    for s in sequences:
        codes = [_LETTERS.index(c) for c in s]
        cut = [codes[i : i + PIECE] for i in range(0, len(codes), PIECE)]
        owner.append(range(len(pieces), len(pieces) + len(cut)))
        pieces += cut
    grammar.compress(pieces)
    return {s: grammar.solve([x for n in own for x in pieces[n]]) for s, own in zip(sequences, owner)}


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grammar, answers = Grammar(), {}
    for b in batches:
        wanted = b.column("symbols").to_pylist()
        if len(grammar.matrices) > MOST_RULES:
            grammar = Grammar()
        if len(answers) > MOST_ANSWERS:
            answers = {}
        answers |= solve_all(sorted(set(wanted) - answers.keys()), grammar)
        found = [answers[s] for s in wanted]
        columns = [b.column(c) for c in b.schema.names if c != "symbols"]
        columns += [pa.array([c for c, _ in found], pa.int64()), pa.array(["".join(e).translate(_INITIAL_OF) for _, e in found]), pa.array([e for _, e in found], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, [*(c for c in b.schema.names if c != "symbols"), "cost", "audit", "edits"])


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines; its rows arrive together and in order."""
    now, digest, any_line = None, None, False

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    for b in batches:
        for conv, lines in zip(b.column("conv_id").to_pylist(), b.column("lines").to_pylist()):
            if now is None or now[0] != conv:
                if now is not None:
                    yield done()
                now, digest, any_line = (conv,), hashlib.sha256(), False
            if lines is not None:
                digest.update((f"\n{lines}" if any_line else lines).encode())
                any_line = True
    if now is not None:
        yield done()


# -- the operator


def _placed(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of the rows with their place in the conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), *columns).withColumn("pos", F.row_number().over(order) - 1)


def repair(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows of every conversation of ``originals`` (if none are given: of ``rows``)."""
    store = Store(rows.sparkSession, "conversation-repair")
    space = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    solid = F.rtrim(F.col("text"), F.lit(_SPACES))
    signs = _placed(rows, F.substring("role", 1, 1).alias("initial"), (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"))
    in_order = Window.partitionBy("conv_id").orderBy("pos")
    seen = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("pos")) > 1
    faulty = signs.select("conv_id", "turn", "pos", "initial", "blank", "cut", seen.alias("seen"), F.lag("initial").over(in_order).alias("former"), F.lag("turn").over(in_order).alias("former_turn"))
    must_go = F.col("blank") | F.col("seen")
    truncated = ~must_go & F.col("cut")
    role = F.when(F.col("initial") == "", 3).otherwise(F.coalesce(F.nullif(F.instr(F.lit(_INITIALS), F.col("initial")), F.lit(0)) - 1, F.lit(3)))
    symbol = F.substr(F.lit(_LETTERS), F.when(must_go, _MUST_GO + 1).otherwise(role * 2 + truncated.cast("int") + 1), F.lit(1))
    illegal = F.col("former").isNotNull() & ~F.concat("former", "initial").isin(*LEGAL)
    new_turn = F.col("turn").isNotNull() & (F.col("former_turn").isNull() | (F.col("turn") != F.col("former_turn")))
    number = lambda flag: F.coalesce(F.sum(flag.cast("long")), F.lit(0).cast("long"))
    gathered = faulty.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - number(new_turn), F.lit(0).cast("long")).alias("gaps"), number(F.col("blank")).alias("blank"), number(F.col("seen") & ~F.col("blank")).alias("duplicate"),
        number(truncated).alias("truncated"), number(illegal).alias("illegal"), F.count("*").alias("n_rows"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", symbol.alias("s")))), lambda x: x["s"]), "").alias("symbols"),
    )
    kept = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, n_rows long"
    solved = store.put(gathered.mapInArrow(_solve, f"{kept}, cost long, audit string, edits array<string>"), "edits")
    # the window holds a conversation's rows together and in order; the join keeps them so
    edits = solved.select(F.col("conv_id").alias("__conv"), "edits")
    placed = _placed(rows, "role", "text")
    joined = placed.join(edits, placed["conv_id"].eqNullSafe(edits["__conv"]))
    last = F.when(F.col("pos") == F.size("edits") - 2, F.get("edits", F.col("pos") + 1)).otherwise(F.lit(""))
    each = F.filter(F.split(F.concat(F.get("edits", F.col("pos")), last), ""), lambda e: ~e.isin("", "D"))
    line = lambda e: F.concat(F.when(e.isin("u", "U"), "user").when(e.isin("a", "A"), "assistant").otherwise(F.col("role")), F.lit(":"), F.when(e.isin("u", "a"), "").otherwise(F.col("text")))
    lines = joined.select("conv_id", "pos", F.when(F.size(each) > 0, F.array_join(F.transform(each, line), "\n")).alias("lines")).sortWithinPartitions("conv_id", "pos")
    hashed = store.put(lines.select("conv_id", "lines").mapInArrow(_hash_lines, "conv_id long, repaired_sha256 string"), "hashes")
    convs = (rows if originals is None else originals).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    a, b = solved.drop("edits").withColumnRenamed("conv_id", "__a"), hashed.withColumnRenamed("conv_id", "__b")
    every = convs.join(a, convs["conv_id"].eqNullSafe(a["__a"]), "left").join(b, convs["conv_id"].eqNullSafe(b["__b"]), "left")
    zero = F.lit(0).cast("long")
    return every.select(
        convs["conv_id"], *(F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"), F.coalesce("n_rows", zero).alias("n_rows"),
    )
