"""N-gram Jaccard join by grouped prefixes, with the links' connected components.

A document's set holds the 64-bit hashes of its distinct shingles of WIDTH words (words end at ASCII
white space, A-Z lower-cased; with fewer words, the sequence as a whole is one shingle). Two documents
link when their sets have at least ``percent`` % of their union in common. All of it is exact but for
collisions of 64-bit shingle hashes and 128-bit set hashes.

1. Counters of a fixed number of hash slots give every shingle a rough document frequency. It only
   sets the order in which prefixes are taken, rarest first, so that what many documents share comes
   last; any order gives the same links.
2. Equal sets are one class, and classes of equal size and prefix one group. A linking pair shares a
   shingle of both prefixes, so each group has one entry for each of its prefix shingles. Shingles of a
   single group are dropped (a bounded filter spares most of them the shuffle), and of shingles with
   exactly the same groups one is enough. What is left are lists of groups.
3. Pairs of groups are filtered by size and by the places of the shared shingle in both prefixes. First
   each list pairs its groups with one leader; a pair that passes expands to one class of each group, and
   groups pair their classes with one of their own. Parity sketches (whose Hamming distance bounds the
   symmetric difference from below) and then the whole sets verify pairs of classes. That finds nearly all
   components without comparing all groups of a list.
4. Groups are cut by component. Lists that are still in several components are compared in blocks: all
   those outside the list's largest component against everyone, first for the likeliest partner of each
   and one class of a group, then for all. Pairs of groups are filtered as above (by sketches too, where
   both groups are a single class), expanded to their classes, and verified as in step 3.

So no link between different components is lost, and no list is held or expanded as a whole. Keys that
many rows share (a list's shingle, a hub of links) are split by adaptive execution where they are joined
and combined before they shuffle where they are summed up.

Defined cases: a null text, or one without words, has an empty set, links with nothing and is its own
component. Rows that repeat an id are one document of its component if their texts link, else each
its own; a null id never becomes a component's name unless no member has an id. Columns besides id
and text are ignored, whatever their names; ``one_per_component`` carries them along. Texts of any
length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, bit_filter, components, lookup, maybe_in, power_of_two

WIDTH = 4
PERCENT = 85
#: log2 of the counters: 2^24 bytes are sent to each worker, whatever the input.
COUNTER_BITS = 24
#: Counters travel in so many pieces, after so many documents at most.
COUNTER_PIECES = 64
COUNTED = 60_000
#: Bits of the smallest sketch; larger sets have two to four bits for each shingle.
SKETCH_BITS = 512
#: Rows of one side of a block: a sixteenth of the list, but at least and at most these.
LEAST_BLOCK, BLOCK = 256, 4096

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes (unsigned 64 bit) of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    out = one[:n] * _MIX[0]
    for k in range(1, width):
        out += np.roll(one, -k)[:n] * (_MIX[k % len(_MIX)] + np.uint64(2 * (k // len(_MIX))))
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix_length(n: int, percent: int) -> int:
    """So many shingles, first in any order, hold one of every set that links with a set of n."""
    return n - -(-percent * n // 100) + 1


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int64)


def sketch(one: np.ndarray) -> np.ndarray:
    """Parities of the set's slots. Halving (exclusive or of both halves) gives the next smaller sketch."""
    bits = max(SKETCH_BITS, power_of_two(2 * len(one)))
    odd = np.bincount((one & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _slots(one: np.ndarray) -> np.ndarray:
    return (one >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches, small enough to work on, and their column of texts."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield b.slice(at, 256), b.slice(at, 256).column(column)


def _frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """A byte for each slot that grows with the logarithm of the shingles in it, over all documents."""
    each = (1 << COUNTER_BITS) // COUNTER_PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, left = np.zeros(1 << COUNTER_BITS, dtype=np.uint16), COUNTED

        def pieces() -> pa.RecordBatch:
            full = [k for k in range(COUNTER_PIECES) if seen[k * each : (k + 1) * each].any()]
            packed = [zlib.compress(seen[k * each : (k + 1) * each].tobytes(), 1) for k in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary())], ["piece", "counts"])

        for _, column in _texts(batches, 0):
            for t in column:
                seen[_slots(shingles(t.as_py(), width))] += 1
            left -= len(column)
            if left < 256:
                yield pieces()
                seen[:], left = 0, COUNTED
        yield pieces()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, counts in zip(b.column(0).to_pylist(), b.column(1)):
                got = np.frombuffer(zlib.decompress(counts.as_py()), dtype=np.uint16)
                sums[piece] = sums[piece] + got if piece in sums else got.astype(np.uint64)
        coarse = [np.minimum(255, np.log2(1.0 + x) * 8).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(coarse, pa.binary())], ["piece", "counts"])

    summed = texts.mapInArrow(count, "piece int, counts binary").repartition("piece").mapInArrow(add, "piece int, counts binary")
    out = np.zeros(1 << COUNTER_BITS, dtype=np.uint8)
    for piece, counts in summed.collect():
        out[piece * each : (piece + 1) * each] = np.frombuffer(counts, dtype=np.uint8)
    return out


def _profiles(given: DataFrame, sent: Broadcast, width: int, percent: int) -> DataFrame:
    """doc_id, mark (the text's hash), n, set key (c1, c2), group g, prefix and sketch of every row. Groups that collide are compared as one."""
    kind = given.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for part, column in _texts(batches, 1):
            n, keys, prefixes, sketches = [], [], [], []
            for t in column:
                one = shingles(t.as_py(), width)
                first = one[np.lexsort((one, rank[_slots(one)]))[: prefix_length(len(one), percent) if len(one) else 0]]
                n.append(len(one))
                keys.append(np.concatenate((_longs(xxhash.xxh3_128_digest(one.tobytes())), _longs(xxhash.xxh3_64_digest(first.tobytes(), seed=len(one))))))
                prefixes.append(first.view(np.int64))
                sketches.append(sketch(one))
            k = np.array(keys).T
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(n, pa.int64()), *map(pa.array, k), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "mark", "n", "c1", "c2", "g", "prefix", "sketch"],
            )

    return given.withColumn("mark", F.xxhash64("text")).mapInArrow(make, f"doc_id {kind}, mark long, n long, c1 long, c2 long, g long, prefix array<long>, sketch array<long>")


def _shared_entries(filled: DataFrame, store: Store, rows: int, entries: int) -> DataFrame:
    """token, g, n, left: the entries of prefix shingles that several groups may have, once each.

    ``filled`` has g, n, prefix of every document with words. Of equal groups one row is taken; only rows that
    may have an equal shuffle for that. A shingle moves only as a slot number until a second one is known
    to share its slot. ``left`` is the number of shingles from the entry on.
    """
    group_slot = F.expr(f"pmod(xxhash64(g), {power_of_two(max(rows, 1) * 64)}L)")
    again = filled.select(group_slot.alias("slot")).groupBy("slot").count().where("count > 1")
    marked = maybe_in(filled, store.put(bit_filter(again), "equal-groups"), group_slot, "again")
    one_each = marked.where("not again").drop("again").unionByName(marked.where("again").drop("again").dropDuplicates(["g"]))
    slot = F.expr(f"pmod(token, {power_of_two(max(entries, 1) * 32)}L)")
    every = one_each.select("g", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "g", "n", F.expr("n - pos").alias("left"))
    twice = every.select(slot.alias("slot")).groupBy("slot").count().where("count > 1")
    return maybe_in(every, store.put(bit_filter(twice), "shared-shingles"), slot, "shared").where("shared").drop("shared")


def _sets(given: DataFrame, nodes: DataFrame, width: int, n: int) -> DataFrame:
    """k and its whole set for the classes ``nodes`` (k, c1, c2, min_doc), from the texts once more.

    A bounded filter on the classes' ids spares most other texts.
    """
    slot = F.expr(f"pmod(xxhash64(__id), {power_of_two(max(n, 1) * 64)}L)")
    words = bit_filter(nodes.select(F.col("min_doc").alias("__id")).select(slot.alias("slot")))
    rows = maybe_in(given.withColumnRenamed("doc_id", "__id"), words, slot, "asked").where("asked").select("text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, column in _texts(batches, 0):
            sets = [shingles(t.as_py(), width) for t in column]
            keys = np.array([_longs(xxhash.xxh3_128_digest(s.tobytes())) for s in sets]).T
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["c1", "c2", "shingles"])

    made = rows.mapInArrow(make, "c1 long, c2 long, shingles array<long>").dropDuplicates(["c1", "c2"])
    return made.join(nodes.select("k", "c1", "c2"), ["c1", "c2"]).select("k", "shingles")


def _apart(percent: int) -> str:
    """SQL that sketches (sketch_a, sketch_b, sizes n_a, n_b) leave a link possible."""
    half = lambda x: f"zip_with(slice({x}, 1, cast(size({x}) / 2 as int)), slice({x}, cast(size({x}) / 2 as int) + 1, cast(size({x}) / 2 as int)), (p, q) -> p ^ q)"
    far = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, x) -> s + x)"
    a, b, s = "sketch_a", "sketch_b", "(n_a + n_b)"
    apart = f"CASE WHEN size({a}) = size({b}) THEN {far(a, b)} WHEN size({a}) = 2 * size({b}) THEN {far(half(a), b)} WHEN size({b}) = 2 * size({a}) THEN {far(a, half(b))} ELSE 0 END"
    return f"{100 + percent} * ({s} - {apart}) >= {2 * percent} * {s}"


def _possible(percent: int) -> str:
    """SQL that sizes (n_a, n_b), and what is left of both from a common shingle on, leave a link possible where that shingle is the first in common."""
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND {100 + percent} * least(left_a, left_b) >= {percent} * (n_a + n_b)"


def _linking(pairs: DataFrame, classes: DataFrame, given: DataFrame, width: int, percent: int, rows: int, store: Store) -> DataFrame:
    """Of the pairs (a, b) of classes those that link; only sets of likely pairs are made again."""
    of = lambda x: classes.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    likely = store.put(pairs.distinct().join(of("a"), "a").join(of("b"), "b").where(_apart(percent)).select("a", "b"), "likely")
    nodes = classes.select("k", "c1", "c2", "min_doc").join(likely.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "k", "left_semi")
    sets = store.put(_sets(given, nodes, width, rows), "sets")
    whole = lambda x: sets.select(F.col("k").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = likely.join(whole("a"), "a").join(whole("b"), "b")
    common = F.expr("cast(size(array_intersect(set_a, set_b)) as long)")
    return both.select("a", "b", common.alias("o"), F.expr("cast(size(set_a) + size(set_b) as long)").alias("s")).where(f"{100 + percent} * o >= {percent} * s").select("a", "b")


def _with_leaders(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes: of each list's leading group with the others, and of each group's first class with the others.

    Pairs of groups are filtered before they expand to one class of each.
    """
    lead = lists.groupBy("token").agg(F.min(F.struct(F.xxhash64("token", "g"), "g", "n", "left")).alias("of"))
    lead = lead.select("token", F.col("of.g").alias("g_b"), F.col("of.n").alias("n_b"), F.col("of.left").alias("left_b"))
    named = lists.select("token", F.col("g").alias("g_a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"))
    pairs = named.join(lead, "token").where("g_a <> g_b").where(_possible(percent)).select(F.least("g_a", "g_b").alias("g_a"), F.greatest("g_a", "g_b").alias("g_b")).distinct()
    first = classes.groupBy("g").agg(F.min("k").alias("first"), F.count("*").alias("classes"))
    head = lambda x: first.select(F.col("g").alias(f"g_{x}"), F.col("first").alias(x))
    across = pairs.join(head("a"), "g_a").join(head("b"), "g_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    inside = classes.join(first.where("classes > 1"), "g").where("k <> first").select(F.col("first").alias("a"), F.col("k").alias("b"))
    return across.unionByName(inside)


def _across(lists: DataFrame, classes: DataFrame, roots: DataFrame, percent: int, best: bool, store: Store) -> tuple[DataFrame, dict]:
    """Pairs (a, b) of classes of different components whose groups are in one list and may link; and how many pairs of parts ("rows").

    A part is what of a group is in one component; it is named by its smallest class. Lists are compared in
    blocks of parts. With ``best``, of each part outside its list's largest component only the likeliest pair
    in a block, and of the pair's classes only those with one of the two names.
    """
    homes = store.put(classes.join(roots.withColumnRenamed("node", "k"), "k", "left").select("k", "g", "n", "sketch", F.coalesce("root", "k").alias("root")), "homes")
    parts = homes.groupBy("g", "root").agg(F.min("k").alias("part"), F.count("*").alias("classes"), F.first("n").alias("n"), F.min_by("sketch", "k").alias("sketch"))
    parts = store.put(parts.withColumn("sketch", F.when(F.col("classes") == 1, F.col("sketch")).otherwise(F.expr("array()"))), "parts")
    several = parts.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g")
    slim = parts.select("g", "part", "root", "n")
    placed = lists.select("token", "g", "left").join(slim, "g").unionByName(slim.join(several, "g", "left_semi").select(F.xxhash64("g", F.lit("group")).alias("token"), "g", F.col("n").alias("left"), "part", "root", "n"))
    counted = placed.groupBy("token", "root").agg(F.count("*").alias("m"))
    tokens = counted.groupBy("token").agg(F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("total"), F.count("*").alias("parts")).where("parts > 1")
    tokens = tokens.withColumn("block", F.expr(f"least({BLOCK}, greatest({LEAST_BLOCK}, total div 16))")).select(
        "token", F.col("most.root").alias("bulk"), F.expr("(total + block - 1) div block").alias("blocks"), F.expr("(total - most.m + block - 1) div block").alias("minor_blocks")
    )
    rows = placed.drop("g").join(tokens, "token").join(parts.select("part", "sketch"), "part").withColumn("h", F.xxhash64("part", F.lit("block"))).withColumnRenamed("part", "k")
    fields = ["token", "k", "root", "n", "left", "sketch"]
    right = rows.select(*fields, F.lit(0).alias("asks"), F.explode(F.expr("sequence(0L, minor_blocks - 1)")).alias("u"), F.expr("pmod(h, blocks)").alias("v"))
    others = rows.where("root <> bulk").select(*fields, F.lit(1).alias("asks"), F.expr("pmod(h, minor_blocks)").alias("u"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("v"))
    units = right.unionByName(others).repartition("token", "u", "v").sortWithinPartitions("token", "u", "v", "asks", "k")
    pairs, seen = store.put_seen(_compared(units, percent, best).distinct(), "part-pairs", rows=F.count("*"))
    member = lambda x: homes.join(slim, ["g", "root"]).select(F.col("part").alias(f"part_{x}"), F.col("k").alias(x))
    expanded = pairs.join(member("a"), "part_a").join(member("b"), "part_b")
    expanded = expanded.where("a = part_a OR b = part_b") if best else expanded
    return expanded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), seen


def _compared(units: DataFrame, percent: int, best: bool) -> DataFrame:
    """part_a, part_b: the pairs of each block that pass size, place and (where both have one) sketch."""

    def compare(k: np.ndarray, root: np.ndarray, n: np.ndarray, rest: np.ndarray, sk: list[np.ndarray], split: int) -> Iterator[tuple]:
        """The first ``split`` rows are everyone of the block, the others those to compare with them."""
        size = np.array([len(x) for x in sk])
        for own in np.unique(size[split:]).tolist():
            mine = np.flatnonzero(size[split:] == own) + split
            for other in np.unique(size[:split]).tolist():
                if own and other and not own <= 2 * other <= 4 * own:  # such sizes cannot link
                    continue
                them = np.flatnonzero(size[:split] == other)
                x, y = np.stack([sk[i] for i in mine]), np.stack([sk[i] for i in them])
                if not own or not other:  # a part of several classes has no sketch
                    x, y = x[:, :0], y[:, :0]
                elif own > other:
                    x = x[:, :other] ^ x[:, other:]
                elif other > own:
                    y = y[:, :own] ^ y[:, own:]
                few, some = 64, max(1, (1 << 15) // max(1, x.shape[1]))
                for r in range(0, len(mine), few):
                    for c in range(0, len(them), some):
                        i, j = mine[r : r + few], them[c : c + some]
                        s, low = n[i, None] + n[None, j], np.minimum(n[i, None], n[None, j])
                        most = np.minimum(rest[i, None], rest[None, j])
                        ok = (root[i, None] != root[None, j]) & (100 * low >= percent * (s - low)) & ((100 + percent) * most >= percent * s)
                        if ok.any():
                            far = np.bitwise_count(x[r : r + few, None, :] ^ y[None, c : c + some, :]).sum(axis=2, dtype=np.int64)
                            spare = (100 + percent) * (s - far) - 2 * percent * s
                            at = np.nonzero(ok & (spare >= 0))
                            yield i[at[0]], j[at[1]], spare[at] / s[at]

    def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def unit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            k, root, n, rest = (t.column(c).to_numpy() for c in ("k", "root", "n", "left"))
            sketches = t.column("sketch").combine_chunks()
            flat, cuts = sketches.flatten().to_numpy().view(np.uint64), sketches.offsets.to_numpy() - sketches.offsets[0].as_py()
            split = int((t.column("asks").to_numpy() == 0).sum())
            likeliest: dict[int, tuple] = {}
            for i, j, spare in compare(k, root, n, rest, np.split(flat, cuts[1:-1]), split):
                if best:
                    for at in np.lexsort((-spare, i))[np.r_[True, np.diff(np.sort(i)) > 0]] if len(i) else ():
                        if spare[at] > likeliest.get(i[at], (-1.0,))[0]:
                            likeliest[i[at]] = (spare[at], j[at])
                elif len(i):
                    yield pairs(k[i], k[j])
            if likeliest:
                yield pairs(k[np.array(list(likeliest))], k[np.array([x[1] for x in likeliest.values()])])

        def pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["part_a", "part_b"])

        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in (b.schema.get_field_index(c) for c in ("token", "u", "v"))])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                part = b.slice(s, e - s)
                if held and any(held[-1].column(c)[-1].as_py() != part.column(c)[0].as_py() for c in ("token", "u", "v")):
                    yield from unit(held)
                    held = []
                held.append(part)
        if held:
            yield from unit(held)

    return units.mapInArrow(block_pairs, "part_a long, part_b long")


def _linked(docs: DataFrame, width: int, percent: int, store: Store) -> tuple[DataFrame, DataFrame, int]:
    """Every row's profile, every class with copies, its component's smallest doc_id and whether it stands for the component, and the number of rows.

    ``foremost`` of a class is (without an id, doc_id, mark) of its smallest row; the class with the smallest one
    stands for its component, of equals the first.
    """
    given = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(_frequencies(docs.select("text"), width))
    profiles, seen = store.put_seen(_profiles(given, sent, width, percent), "profiles", rows=F.count("*"), entries=F.sum(F.size("prefix").cast("long")))
    sent.destroy()  # what is stored is not made again
    rows, filled = seen["rows"], profiles.where("n > 0")

    slim = filled.groupBy("c1", "c2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("foremost"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("g").alias("g"), F.first("sketch").alias("sketch"))
    classes = store.put(slim.withColumn("min_doc", F.col("foremost.doc_id")).withColumn("k", F.monotonically_increasing_id()), "classes")

    shared = store.put(_shared_entries(filled.select("g", "n", "prefix"), store, rows, seen["entries"] or 0), "entries")
    signed = shared.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("g")).alias("x"), F.bit_xor(F.xxhash64("g", F.lit(7))).alias("y"), F.sum(F.col("n") - F.col("left")).alias("at")).where("c > 1")
    # of shingles with the same groups the first in the common order; it stands first in every prefix
    tokens = signed.groupBy("c", "x", "y").agg(F.min_by("token", F.struct("at", "token")).alias("token")).select("token")
    lists = store.put(shared.join(tokens, "token", "left_semi"), "lists")
    store.drop(shared)

    links = store.put(_linking(_with_leaders(lists, classes, percent), classes, given, width, percent, rows, store), "links")
    roots = components(links, store)

    # once with the likeliest partners, then all that is still apart; where no pair is possible none is later
    for best in (True, False):
        pairs, seen = _across(lists, classes, roots, percent, best, store)
        if not seen["rows"]:
            break
        more, seen = store.put_seen(_linking(pairs, classes, given, width, percent, rows, store), "more", rows=F.count("*"))
        if seen["rows"]:
            links = store.put(links.unionByName(more), "links")
            roots = components(links, store)

    named = roots.join(classes.select(F.col("k").alias("node"), "foremost"), "node")
    names = named.groupBy("root").agg(F.min("foremost.doc_id").alias("component_id"), F.min_by("node", F.struct("foremost", "node")).alias("keeper"))
    least = roots.join(names, "root").select(F.col("node").alias("k"), "component_id", (F.col("node") == F.col("keeper")).alias("keeper"))
    of_class = classes.select("k", "c1", "c2", "copies", "min_doc", "foremost").join(least, "k", "left")
    of_class = of_class.select("c1", "c2", "copies", "foremost", F.coalesce("component_id", "min_doc").alias("component_id"), F.coalesce("keeper", F.lit(True)).alias("keeper"))
    return profiles, store.put(of_class, "components"), rows


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    profiles, of_class, rows = _linked(docs, width, percent, Store(docs.sparkSession, "ngram-join"))
    slim = profiles.select("doc_id", F.col("n").alias("n_shingles"), "c1", "c2")
    empty = slim.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = lookup(slim.where("n_shingles > 0"), of_class, ["c1", "c2"], "copies", rows).select(*empty.columns)
    return empty.unionByName(found)


def one_per_component(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component, with all columns, and all rows without words.

    Rows are known by their id and text, since links are a row's own, whatever other rows have its id: the row with the
    smallest id stays, of several the one whose text has the smallest hash, and a row without an id only where
    no other is there. Only rows that a bounded filter cannot clear are shuffled.
    """
    store = Store(docs.sparkSession, "ngram-keep")
    profiles, of_class, rows = _linked(docs, width, percent, store)
    placed = lookup(profiles.where("n > 0").select("doc_id", "mark", "c1", "c2"), of_class, ["c1", "c2"], "copies", rows)
    stays = F.col("keeper") & F.col("doc_id").eqNullSafe(F.col("foremost.doc_id")) & (F.col("mark") == F.col("foremost.mark"))
    known = store.put(placed.where(~stays | (F.col("copies") > 1)).groupBy("doc_id", "mark").agg(F.max(stays).alias("stays"), F.count("*").alias("n")), "known")
    # those that go, and those that are there several times
    asked, seen = store.put_seen(known.where(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("stays").alias("__stays")), "asked", rows=F.count("*"))
    slot = lambda i, m: F.pmod(F.xxhash64(i, m), F.lit(power_of_two(max(seen["rows"], 1) * 64)).cast("long"))
    words = bit_filter(asked.select(slot(F.col("__id"), F.col("__mark")).alias("slot")))
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"))
    marked = maybe_in(whole, words, slot(F.col("id"), F.col("mark")), "maybe")
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark"))
    found = marked.where("maybe").join(asked, same, "left")
    once = found.where("__stays").dropDuplicates(["id", "mark"])
    return marked.where("not maybe").select("row.*").unionByName(found.where("__stays IS NULL").select("row.*")).unionByName(once.select("row.*"))
