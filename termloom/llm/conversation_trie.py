"""The prefix trie of conversations: ternary search trees over dictionary-encoded turns, one per range shard.

``rebuilt`` puts every conversation c together from the first h turns of the conversation c - c % 100 and
its own turns after the first h, where h is the crc32 of c in decimal, modulo 6. ``trie`` returns one row for
every distinct sequence of first turns (role, text) that any conversation has.

A turn is known by the SHA-256 of role and text, and a dictionary gives each distinct turn a number; texts
are never shuffled. Conversations, as arrays of such numbers, are sorted in ranges of (sequence, conv_id),
so copies of one conversation spread over as many shards as they need. Each shard builds a ternary search
tree of its distinct sequences, the middle one first and then the middles of both halves, which keeps it
balanced, and accumulates members, children, leaves and savings from the deepest nodes up, without recursion.

What two shards share is a beginning of the last sequence of one and the first sequence of the next. So only
nodes on the first and the last path of a shard are merged: their counts are added up, and what two
neighbours both counted (the shared node itself, a child, a leaf, its text) is taken off once for every pair.
Numbers of those who end at a shared node arrive in ascending pieces and are hashed as a stream.

Defined cases: rows without a conv_id belong to no conversation. Null roles and texts are empty. Turns of one
number stand in order of the hash of role and text. Conversations without turns are members of the root only. Rows that
repeat stay turns of their own. Columns besides conv_id, turn, role and text are ignored, whatever their
names. An empty table gives an empty result. Texts of any length are read whole; a conversation's numbers (16 bytes a turn)
are held as one array, so a conversation of some 10^8 turns is the most that a task can hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, lookup

#: Conversations whose numbers differ only in the last so many take their first turns from one of them.
FAMILY = 100
#: A conversation takes fewer than so many turns.
TAKEN = 6
#: Turns of a shard.
SHARD_TURNS = 250_000
#: Rows of a batch of results.
OUT_ROWS = 10_000

_PARTIAL = (
    "shard int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends string, key binary, parent_key binary, on_first boolean, on_last boolean, chars long, total long"
)
_COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def turn_digest(role: Column, text: Column) -> Column:
    """What a turn is known by; roles and texts are not null."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, digest, chars of every rebuilt turn in order of pos; one row with nulls for a conversation without turns."""
    store = Store(conversations.sparkSession, "conversation-trie")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("digest"), F.char_length(text).cast("long").alias("chars"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")) - 1
    own = store.put(rows.select("conv_id", place.alias("pos"), "digest", "chars"), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN
    convs = own.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("donor"), h.alias("h"))
    donors = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < TAKEN - 1)).withColumnRenamed("conv_id", "donor")
    taken = convs.join(donors, "donor").where("pos < h").select("conv_id", "pos", "digest", "chars")
    kept = own.where(F.col("pos") >= h)
    nothing = convs.select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("chars"))
    return kept.unionByName(taken).unionByName(nothing)


def _tree(groups: list[tuple[list[int], list[int], list[int]]]) -> tuple:
    """The ternary search tree of sorted, distinct sequences (ids, chars, conv_ids): lists by node, node 0 the root.

    A node is made after its parent, so going backwards visits children before parents.
    """
    key, lower, higher, child, parent, chars, members, least = [0], [0], [0], [0], [-1], [0], [0], [None]
    ends: dict[int, list[int]] = {}
    spans = [(0, len(groups))]
    while spans:
        low, high = spans.pop()
        if low >= high:
            continue
        middle = (low + high) // 2
        spans += [(low, middle), (middle + 1, high)]
        ids, sizes, convs = groups[middle]
        n, first = len(convs), convs[0]
        at = 0
        for depth in range(len(ids) + 1):
            members[at] += n
            if least[at] is None or first < least[at]:
                least[at] = first
            if depth == len(ids):
                break
            turn, p = ids[depth], child[at]
            before, arrow = at, child
            while p and key[p] != turn:
                before, arrow = p, lower if turn < key[p] else higher
                p = arrow[p]
            if not p:
                p = arrow[before] = len(key)
                for values, value in ((key, turn), (lower, 0), (higher, 0), (child, 0), (parent, at), (chars, sizes[depth]), (members, 0), (least, None)):
                    values.append(value)
            at = p
        ends[at] = convs
    return key, parent, chars, members, least, ends


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial nodes of one shard; its rows are sorted by sequence and conv_id."""
    groups: list[tuple[list[int], list[int], list[int]]] = []
    shard = 0
    for b in batches:
        for shard, conv, ids, sizes in zip(*(b.column(c).to_pylist() for c in ("shard", "conv_id", "ids", "chars"))):
            if groups and groups[-1][0] == ids:
                groups[-1][2].append(conv)
            else:
                groups.append((ids, sizes, [conv]))
    if not groups:
        return
    key, parent, chars, members, least, ends = _tree(groups)
    n = len(key)
    depth, children, leaves, saved = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    for i in range(n - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (members[i] - 1) * chars[i]
        if i:
            up = parent[i]
            children[up] += 1
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    # the first and last paths: the nodes where the outermost sequences end, and all above them
    by_ids = {tuple(groups[g][0]): None for g in (0, -1)}
    for i, convs in ends.items():
        for g in (0, -1):
            if convs is groups[g][2]:
                by_ids[tuple(groups[g][0])] = i
    edge: dict[int, tuple[bytes, int]] = {}
    sides = []
    for g in (0, -1):
        path, i = [], by_ids[tuple(groups[g][0])]
        while i >= 0:
            path.append(i)
            i = parent[i]
        digest, total = hashlib.blake2b(digest_size=16), 0
        for i in reversed(path):
            digest.update(key[i].to_bytes(8, "little", signed=True))
            total += chars[i]
            edge[i] = (digest.digest(), total)
        sides.append(set(path))

    def ended(i: int) -> str:
        listed = ",".join(map(str, ends.get(i, ())))
        return listed if i in edge else hashlib.sha256(listed.encode()).hexdigest()

    schema = pa.schema([
        ("shard", pa.int32()), *((c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", *_COUNTS)), ("ends", pa.string()),
        ("key", pa.binary()), ("parent_key", pa.binary()), ("on_first", pa.bool_()), ("on_last", pa.bool_()), ("chars", pa.int64()), ("total", pa.int64()),
    ])
    for start in range(0, n, OUT_ROWS):
        rows = range(start, min(n, start + OUT_ROWS))
        above = [edge.get(parent[i]) for i in rows]
        columns = [
            [shard] * len(rows), [depth[i] for i in rows], [least[i] for i in rows], [None if a or not i else least[parent[i]] for i, a in zip(rows, above)],
            *([v[i] for i in rows] for v in (members, children, leaves, saved)), [ended(i) for i in rows],
            [edge[i][0] if i in edge else None for i in rows], [a[0] if a else None for a in above],
            [i in sides[0] for i in rows], [i in sides[1] for i in rows], [chars[i] for i in rows], [edge[i][1] if i in edge else None for i in rows],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which arrive in order."""
    now, digest = None, None

    def done():
        return pa.RecordBatch.from_pydict({"key": pa.array([now], pa.binary()), "ends_sha256": [digest.hexdigest()]})

    for b in batches:
        for key, piece in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
            if key != now:
                if now is not None:
                    yield done()
                now, digest = key, hashlib.sha256(piece.encode())
            else:
                digest.update(f",{piece}".encode())
    if now is not None:
        yield done()


def trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``turns`` is as ``rebuilt`` returns it: conv_id, pos, digest, chars.
    """
    spark = turns.sparkSession
    store = Store(spark, "conversation-trie")
    turns, seen = store.put_seen(turns, "rebuilt", turns=F.count("pos"))
    n = seen["turns"]
    named = turns.where("pos IS NOT NULL")
    dictionary = store.put(named.groupBy("digest").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    encoded = lookup(named, dictionary, ["digest"], "n", n).select("conv_id", F.struct("pos", "id", "chars").alias("turn"))
    nothing = turns.where("pos IS NULL").select("conv_id", F.lit(None).cast(encoded.schema["turn"].dataType).alias("turn"))
    gathered = encoded.unionByName(nothing).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    sequences = store.put(gathered.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars")), "sequences")
    parts = max(1, -(-n // shard_turns))
    ranged = sequences.repartitionByRange(parts, "ids", "conv_id").sortWithinPartitions("ids", "conv_id").withColumn("shard", F.spark_partition_id())
    partial, seen = store.put_seen(ranged.mapInArrow(_shard, _PARTIAL), "partial", inner=F.count_if(F.col("key").isNull()), edge=F.count("key"))
    edge = partial.where("key IS NOT NULL")

    # pairs of neighbouring shards; one number a shard comes to the driver
    shards = sorted(r.shard for r in edge.where("depth = 0").select("shard").collect())
    pairs = spark.createDataFrame(list(zip(shards, shards[1:])), "pair int, next int")
    left = edge.where("on_last").join(pairs, F.col("shard") == F.col("pair")).select("pair", "depth", "key", "chars", "total", (F.col("n_children") == 0).alias("leaf"))
    right = edge.where("on_first").join(pairs, F.col("shard") == F.col("next")).select("pair", "depth", "key")
    shared = store.put(left.join(right, ["pair", "depth", "key"]), "shared")
    deepest = shared.groupBy("pair").agg(F.max_by(F.struct("depth", "total", "leaf"), "depth").alias("last"))
    twice = shared.join(deepest, "pair").groupBy("key").agg(
        F.sum(F.col("last.total") - F.col("total") + F.col("chars")).alias("more_saved"),
        F.sum((F.col("depth") < F.col("last.depth")).cast("long")).alias("less_children"), F.sum(F.col("last.leaf").cast("long")).alias("less_leaves"),
    )
    summed = edge.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *(F.sum(c).alias(c) for c in _COUNTS))
    zero = F.lit(0).cast("long")
    hashed = edge.where("ends <> ''").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_stream_hashes, "key binary, ends_sha256 string")
    merged = summed.join(twice, "key", "left").join(hashed, "key", "left").select(
        "key", "parent_key", "conv_id", "depth", "n_convs", (F.col("n_children") - F.coalesce("less_children", zero)).alias("n_children"),
        (F.col("n_leaves") - F.coalesce("less_leaves", zero)).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    merged = store.put(merged, "edge")
    out = ("conv_id", "depth", "parent_conv_id", *_COUNTS, "ends_sha256")
    inner = partial.where("key IS NULL").withColumnRenamed("ends", "ends_sha256")
    below = inner.where("parent_key IS NOT NULL").select("parent_key", *(c for c in out if c != "parent_conv_id")).unionByName(merged.where("parent_key IS NOT NULL").drop("key"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__n"))
    found = lookup(below, parents, ["parent_key"], "__n", seen["inner"] + seen["edge"])
    root = merged.where("parent_key IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return inner.where("parent_key IS NULL").select(*out).unionByName(found.select(*out)).unionByName(root.select(*out))
