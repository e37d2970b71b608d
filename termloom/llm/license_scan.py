"""License scans: exact phrases, and short notices with a bounded number of edits.

A text becomes its words (letters, digits and everything outside ASCII, A-Z lower-cased) with one space
between them. Base phrases are found where their words stand side by side. Notices may differ from
the text by one edit for every EDIT_EVERY characters, but not in the words that name the licence, and a span
begins and ends with whole words. By the pigeonhole principle, of a notice cut into edits + 1 pieces one at
least stands unchanged in any such place, so one Aho-Corasick pass over the text for all pieces of all
notices gives every candidate: a piece says where the notice would begin. In each candidate's own stretch of
text, which is too short for two places side by side, a plain search looks for the notice as it stands; else
the least number of edits anywhere in the stretch is counted with bit vectors (Myers, 1999), and from that
number on the regex library's bounded-error matching verifies the edits, one more at a time, and reports the
span. Where a better span covers part of a stretch, what is left of it is searched again. The work grows with
the text's length and its candidates.

Defined cases: a null text counts as empty; a text without words has no place, no label and score 0.
Overlapping places of a phrase all count; of overlapping spans of a notice the one with fewest edits
stays, then the first. Whole texts are scanned. Rows that repeat are scanned each for itself. Columns besides
id and text are ignored, whatever their names. An empty table gives an empty result. The session's Arrow
batches are held to the library's limits.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Openings and reference lines of common licences (words in lower case, without punctuation), their labels, and the words that name the licence.
NOTICES = {
    "licensed under the apache license version 2 0": ("apache", "apache"),
    "apache license version 2 0 january 2004": ("apache", "apache"),
    "this work is licensed under the gnu general public license version 3": ("gpl", "gnu general public license"),
    "this program is free software you can redistribute it and or modify it": ("gpl", ""),
    "under the terms of the gnu general public license as published by the free software foundation": ("gpl", "gnu general public license"),
    "gnu affero general public license": ("agpl", "affero"),
    "gnu lesser general public license": ("lgpl", "lesser"),
    "gnu library general public license": ("lgpl", "library"),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", ""),
    "released under the mit license": ("mit", "mit"),
    "licensed under the mit license": ("mit", "mit"),
    "redistribution and use in source and binary forms": ("bsd", ""),
    "released under the bsd license": ("bsd", "bsd"),
    "licensed under the bsd license": ("bsd", "bsd"),
    "neither the name of the copyright holder nor the names of its contributors may be used": ("bsd", ""),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", ""),
    "released under the isc license": ("isc", "isc"),
    "licensed under the isc license": ("isc", "isc"),
    "this work is licensed under a creative commons attribution license": ("cc-by", "creative commons attribution license"),
    "creative commons attribution 4 0 international": ("cc-by", "creative commons attribution 4"),
    "creative commons attribution sharealike": ("cc-by-sa", "sharealike"),
    "creative commons attribution share alike": ("cc-by-sa", "share alike"),
    "creative commons attribution noncommercial": ("cc-by-nc", "noncommercial"),
    "creative commons attribution noderivatives": ("cc-by-nd", "noderivatives"),
    "cc0 1 0 universal": ("cc0", "cc0"),
    "this source code form is subject to the terms of the mozilla public license": ("mpl", "mozilla"),
    "mozilla public license version 2 0": ("mpl", "mozilla"),
    "released under the mpl license": ("mpl", "mpl"),
    "eclipse public license": ("epl", "eclipse"),
    "boost software license version 1 0": ("boost", "boost"),
    "this is free and unencumbered software released into the public domain": ("unlicense", ""),
    "all rights reserved": ("all-rights-reserved", ""),
}
EDIT_EVERY = 10

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def pieces_of(notice: str, edits: int) -> list[tuple[int, str]]:
    """A notice in edits + 1 pieces of nearly equal length, each with its start."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(s, notice[s:e]) for s, e in zip(cuts, cuts[1:])]


class Notice:
    """One notice: where it is looked for and how it is verified."""

    def __init__(self, text: str, label: str, name: str, edits: int):
        self.text, self.label, self.edits = text, label, edits
        at = f" {text} ".find(f" {name} ") if name else -1
        if name and at < 0:
            raise ValueError(f"{name!r} does not stand in {text!r}")
        self.name = f" {name} " if name else ""
        escaped = lambda t: regex.escape(t, literal_spaces=True)
        if name:
            left, right = text[: max(0, at - 1)], text[at + len(name) + 1 :]
            self._parts = (escaped(left), escaped(name), escaped(right))
        else:
            self._parts = (escaped(text), None, "")
        self._patterns: dict[int, regex.Pattern] = {}
        self._bits: dict[str, int] = {}
        for i, c in enumerate(text):
            self._bits[c] = self._bits.get(c, 0) | 1 << i

    def _pattern(self, edits: int) -> regex.Pattern:
        """Whole words within so many edits for each side of the name; the best match, if there are two sides."""
        if edits not in self._patterns:
            left, name, right = self._parts
            near = lambda t: f"(?:{t}){{e<={edits}}}"
            body = near(left) if name is None else (f"{near(left)} " if left else "") + name + (f" {near(right)}" if right else "")
            self._patterns[edits] = regex.compile(f"{'(?b)' if left and right else ''}(?<= ){body}(?= )")
        return self._patterns[edits]

    def least(self, text: str) -> int:
        """The least number of edits between the notice and any stretch of the text."""
        n = len(self.text)
        every, top, bits = (1 << n) - 1, 1 << (n - 1), self._bits
        plus, minus, score = every, 0, n
        best = n
        for c in text:
            eq = bits.get(c, 0)
            v = eq | minus
            h = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(h | plus) & every
            down = plus & h
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best = score
            up, down = up << 1 & every, down << 1 & every
            plus = down | ~(v | up) & every
            minus = up & v
        return best

    def best(self, line: str, start: int, end: int) -> tuple[int, int, int] | None:
        """Edits, start and end of the best place between two places of a line."""
        at = line.find(f" {self.text} ", start, end)
        if at >= 0:
            return 0, at + 1, at + 1 + len(self.text)
        if self.name and line.find(self.name, start, end) < 0:
            return None
        for edits in range(max(1, self.least(line[start:end])), self.edits + 1):
            m = self._pattern(edits).search(line, start, end)
            if m and sum(m.fuzzy_counts) <= edits:
                return sum(m.fuzzy_counts), m.start(), m.end()
        return None


class Scanner:
    """All notices' pieces in one automaton."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, str]] = NOTICES, edit_every: int = EDIT_EVERY):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices: list[Notice] = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (text, (label, name)) in enumerate(notices.items()):
            self.notices.append(Notice(text, label, name, len(text) // edit_every))
            for start, piece in pieces_of(text, len(text) // edit_every):
                seeds.setdefault(piece, []).append((k, start))
        self.automaton = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.automaton.add_word(piece, (len(piece), where))
        if seeds:
            self.automaton.make_automaton()
        self.seeds = bool(seeds)

    def base(self, line: bytes) -> list[tuple[int, str]]:
        """First word and label of every place of a phrase; ``line`` has a space at both ends."""
        out = []
        for phrase, label in self.phrases:
            at, before, words = line.find(phrase), 0, 0
            while at >= 0:
                words += line.count(b" ", before, at)
                out.append((words, label))
                before, at = at, line.find(phrase, at + 1)
        return out

    def fuzzy(self, line: str) -> list[tuple[str, int, int, int, float]]:
        """label, start, end (characters), edits and similarity of every notice found."""
        begins: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(line) if self.seeds else ():
            for k, offset in where:
                begins.setdefault(k, set()).add(end + 1 - size - offset)
        return [(self.notices[k].label, *span) for k in sorted(begins) for span in self._verified(line, k, sorted(begins[k]))]

    def _verified(self, line: str, k: int, begins: list[int]) -> list[tuple[int, int, int, float]]:
        """start, end, edits and similarity of the places of a notice that would begin within its edits of ``begins``."""
        notice = self.notices[k]
        n, edits = len(notice.text), notice.edits
        stretches, first = [], None
        for at in begins:
            if first is None or at > first + edits:
                first = at
                stretches.append([max(0, at - edits - 1), 0])
            stretches[-1][1] = min(len(line), at + n + edits + 1)
        taken: list[tuple[int, int, int]] = []
        while stretches:
            found = [(place, x) for x in stretches if (place := notice.best(line, *x))]
            for cost, s, e in sorted({place for place, _ in found}):
                i = bisect_left(taken, (s,))
                if (i == 0 or taken[i - 1][1] <= s) and (i == len(taken) or e <= taken[i][0]):
                    taken.insert(i, (s, e, cost))
            # what the places taken leave of the stretches that had one; the space between two belongs to both
            stretches = sorted({(max(0, a - 1), min(len(line), b + 1)) for _, x in found for a, b in _gaps(*x, taken) if b - a >= n - edits and (a, b) != tuple(x)})
        return [(s, e, cost, 1 - cost / n) for s, e, cost in taken]


def _gaps(s: int, e: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a stretch that no place in ``taken`` (in order) covers."""
    out, i = [], max(0, bisect_left(taken, (s,)) - 1)
    while i < len(taken) and taken[i][0] < e:
        if taken[i][0] > s:
            out.append((s, taken[i][0]))
        s = max(s, taken[i][1])
        i += 1
    return [*out, (s, e)] if s < e else out


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    """The worker's own scanner."""
    return Scanner()


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists label, first and last word, edits and similarity of every notice found.
    """
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for t in part.column(1):
                    words = words_of(t.as_py())
                    raw = b" " + b" ".join(words) + b" "
                    line = raw.decode("utf-8", "surrogatepass")
                    places, near = find.base(raw), find.fuzzy(line)
                    own = {label for _, label in places}
                    gaps = [i for i, c in enumerate(line) if c == " "] if near else []
                    spans = [{"label": x, "first": bisect_right(gaps, s) - 1, "last": bisect_left(gaps, e) - 1, "edits": n, "similarity": y} for x, s, e, n, y in near]
                    starts = [p for p, _ in places]
                    rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in near})), max([float(bool(places)), *(x[4] for x in near)]), spans))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
                names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], ["doc_id", *names])

    return given.mapInArrow(
        look,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label: string, first: long, last: long, edits: long, similarity: double>>",
    )
