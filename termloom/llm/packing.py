"""Packing token sequences by first-fit decreasing with a tournament tree.

Each document is tokenised whole and closed with END_ID. Its full stretches of ``capacity`` ids are
sequences of their own; what is left of each is an item. Items are dealt to randomised groups of about
``group_items`` by a hash, and each group packs its items by itself: longest first, each into the
first open sequence that has room. A tournament tree over the open sequences' free room finds it in
O(log n). Sequence ids are unique over all groups, and offsets run without gaps.

Defined cases: a null text counts as empty and gives the one id END_ID. Rows that repeat a document
are packed each for itself. Ids may be null. Texts of any length are cut at ``capacity`` and never
shortened.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store

CAPACITY = 2048
END_ID = 1
GROUP_ITEMS = 8192
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers at most.
REMEMBERED = 300_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    The tokenizer's pieces never cross its words, so a word has the same ids wherever it stands. Texts
    of plain Latin letters are cut to words here and each word is encoded once in a worker; any other
    text goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spaces = "\t-\r \x85\xa0"
        # below U+0250, but for one letter that lower-cases to two code points, and the special tokens
        self.other = re.compile("[^\x00-įı-ɏ]|<\\|")
        letters, digits = _classes("L"), _classes("N")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+")
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return _packed(self.model.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if self.other.search(text):
            return self.whole(text)
        words = self.words.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        # words stay words with a space between them; the encoding says which word each id is of
        made = self.model.encode(" ".join(new), add_special_tokens=False)
        ids, of, start = made.ids, made.word_ids, 0
        for end in range(1, len(ids) + 1):
            if end == len(ids) or of[end] != of[start]:
                self.known[new[of[start]]] = struct.pack(f"<{end - start}I", *ids[start:end])
                start = end
        return b"".join(map(self.known.__getitem__, words))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_MODELS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own tokenizer."""
    if path not in _MODELS:
        _MODELS[path] = WordIds(path)
    return _MODELS[path]


class TournamentTree:
    """Free room of sequences; finds the first with room enough."""

    def __init__(self, places: int):
        self.size = 1 << max(0, places - 1).bit_length()
        self.best = [0] * (2 * self.size)

    def set(self, place: int, room: int) -> None:
        at, best = place + self.size, self.best
        best[at] = room
        at >>= 1
        while at:
            left, right = best[2 * at], best[2 * at + 1]
            best[at] = left if left >= right else right
            at >>= 1

    def first(self, need: int) -> int:
        """The first place with room ``need``, or -1."""
        best = self.best
        if best[1] < need:
            return -1
        at = 1
        while at < self.size:
            at *= 2
            if best[at] < need:
                at += 1
        return at - self.size


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """For each item its sequence and its offset there; longest items first, ties as given."""
    tree = TournamentTree(max(1, len(lengths)))
    used: list[int] = []
    out = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        place = tree.first(n)
        if place < 0:
            place = len(used)
            used.append(0)
        out[i] = (place, used[place])
        used[place] += n
        tree.set(place, capacity - used[place])
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, at most ``capacity`` ids long."""
    path = path or tokenizer_path()
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = word_ids(path), _packed([END_ID]), 4 * capacity
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows, starts, lengths, sums, totals = [], [], [], [], []
                for k, text in enumerate(part.column(1)):
                    ids = encode(text.as_py()) + end
                    for s in range(0, len(ids), step):
                        piece = ids[s : s + step]
                        rows.append(k)
                        starts.append(s // 4)
                        lengths.append(len(piece) // 4)
                        sums.append(zlib.crc32(piece))
                        totals.append(len(ids) // 4)
                longs = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *longs], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return given.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    store = Store(docs.sparkSession, "packing")
    cut = store.put(pieces(docs, capacity, path), "pieces")
    groups = -(-max(1, cut.count()) // group_items)
    kind = cut.schema["doc_id"].dataType.simpleString()
    # the piece's own number within its task spreads pieces that are alike in everything
    dealt = cut.withColumn("group", F.expr(f"pmod(xxhash64(doc_id, start, ids_crc32, monotonically_increasing_id()), {groups}L)"))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        at = first_fit_decreasing(pdf["length"].tolist(), capacity)
        base = int(key[0]) << 32
        return pdf.drop(columns="group").assign(sequence_id=[base + s for s, _ in at], offset=[o for _, o in at])

    return dealt.groupBy("group").applyInPandas(
        place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
