"""License scans: fuzzy search for short notices.

A notice that may hold up to k edits is split into k + 1 pieces. By the pigeonhole principle one piece is still exact, so
exact piece look-ups locate every candidate; around each one the ``regex`` library's bounded-error matching decides
and reports the span, then looks on both sides of it in the window of the piece. A notice that differs from others by a name
must have that name with one edit at most. Phrases that must stand exactly (runs of whole words) are found by their words.

Defined results: a null text counts as an empty one and gives zero words, no places, empty labels and score 0; repeated
rows are answered one by one; of overlapping spans the one with the fewest edits is reported; very long texts are searched
whole; an empty table gives an empty table; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.ship import map_arrow
from leadlake.llm.textbytes import ALNUM, LOWER, flat, word_spans

#: Exact phrases (runs of words) and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices for the fuzzy search and their labels: usual wordings of public licences.
NOTICES = {
    "permission is hereby granted, free of charge": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license": "apache",
    "gnu general public license": "gpl",
    "lesser general public license": "lgpl",
    "redistribution and use in source and binary forms": "bsd",
    "released under the bsd license": "bsd",
    "mozilla public license": "mpl",
    "licensed under cc by": "cc",
    "creative commons attribution": "cc",
    "all rights reserved": "reserved",
}

#: Words that tell one notice from another of the same wording: of these one edit may be missed at most.
NAMES = ("mit", "bsd", "apache")

_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _edits(text: str, other: str) -> int:
    row = list(range(len(other) + 1))
    for i, c in enumerate(text, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(other, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


@dataclass
class Notice:
    """One notice: its exact pieces, and the pattern that checks a candidate."""

    text: str
    label: str
    errors: int
    pieces: list[tuple[int, str]] = field(default_factory=list)

    def __post_init__(self):
        step = len(self.text) / (self.errors + 1)
        cuts = [round(i * step) for i in range(self.errors + 2)]
        self.pieces = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.pattern = regex.compile(f"(?b)(?:{regex.escape(self.text)}){{e<={self.errors}}}")
        self.name = next((w for w in self.text.split() if w in NAMES), "")

    def has_name(self, found: str) -> bool:
        """Whether ``found`` is the notice within its edits, of which one at most is in the name."""
        if not self.name or self.text == found:
            return True
        before, behind = f" {self.text} ".split(f" {self.name} ", 1)
        before, behind = f"{before} ".lstrip(), f" {behind}".rstrip()
        for i in range(max(0, len(before) - self.errors), len(before) + self.errors + 1):
            spent = _edits(before, found[:i])
            for j in range(i + len(self.name) - 1, min(i + len(self.name) + 1, len(found)) + 1) if spent <= self.errors else ():
                own = _edits(self.name, found[i:j])
                if own <= 1 and spent + own + _edits(behind, found[j:]) <= self.errors:
                    return True
        return False

    def hits(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the notice's places in a window: the best one, then those on both sides of it."""
        found, todo, seen = [], [(start, end)], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in seen or b - a < len(self.text) - self.errors:
                continue
            seen.add((a, b))
            if not (hit := self.pattern.search(text, a, b)):
                continue
            i, j = hit.span()
            if self.has_name(hit.group()):
                found.append((i, j, sum(hit.fuzzy_counts)))
                todo += [(a, i), (j, b)]
            else:  # another place may share a part of this one
                todo += [(a, j - 1), (i + 1, b)]
        return found


def make_notices(notices: dict[str, str], letters_per_error: int = 10) -> list[Notice]:
    """One edit is allowed for each ``letters_per_error`` characters of a notice."""
    return [Notice(" ".join(_GAP.split(t)).strip(), label, len(t) // letters_per_error) for t, label in notices.items()]


def fuzzy_spans(text: str, notices: list[Notice]) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) of every notice in ``text``, whose words must be one space apart."""
    found = []
    for notice in notices:
        # the window of a seed is as long as the notice and its edits, so the work grows with the seeds alone
        windows = set()
        for offset, piece in notice.pieces:
            at = text.find(piece)
            while at >= 0:
                windows.add((max(0, at - offset - notice.errors), min(len(text), at - offset + len(notice.text) + notice.errors)))
                at = text.find(piece, at + 1)
        places = {hit for a, b in windows for hit in notice.hits(text, a, b)}
        found += [(i, j, notice.label, edits) for i, j, edits in places]
    kept: list = []  # where spans overlap, the one with the fewest edits (then the longest) is the notice
    for span in sorted(found, key=lambda s: (s[3], s[0] - s[1], s[0], s[2])):
        i = bisect.bisect_left(kept, span)
        if (i == 0 or kept[i - 1][1] <= span[0]) and (i == len(kept) or span[1] <= kept[i][0]):
            kept.insert(i, span)
    return kept


@dataclass
class Scan:
    n_words: int = 0
    #: places of exact phrases: (first word, last word, label)
    places: list = field(default_factory=list)
    #: fuzzy spans: (first character, end, label, edits) in the lower-cased text with words one space apart
    spans: list = field(default_factory=list)
    score: float = 0.0


def scan_words(words: np.ndarray | list[str], phrases: list[tuple[list[str], str]], notices: list[Notice]) -> Scan:
    out = Scan(n_words=len(words))
    text = " ".join(words)
    inner = f" {text} "
    for parts, label in phrases:
        needle = f" {' '.join(parts)} "
        at, counted, word = inner.find(needle), 0, 0
        while at >= 0:
            word += inner.count(" ", counted, at)
            counted = at
            out.places.append((word, word + len(parts) - 1, label))
            at = inner.find(needle, at + 1)
    out.spans = fuzzy_spans(text, notices)
    longest = {n.label: max(len(m.text) for m in notices if m.label == n.label) for n in notices}
    out.score = max([1.0 * bool(out.places), *(1 - edits / longest[label] for _, _, label, edits in out.spans)])
    return out


def scan_licenses(
    docs: DataFrame, text: str = "text", key: str = "doc_id", phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES, letters_per_error: int = 10,
) -> DataFrame:
    """One row per document: words, exact places, fuzzy spans (with the words they are in) and labels."""
    kind = docs.schema[key].dataType.simpleString()
    exact = [(p.split(), label) for p, label in phrases.items()]
    fuzzy = make_notices(notices, letters_per_error)
    # a text with none of the pieces and none of the phrases' last words needs no closer look
    pieces = {piece for n in fuzzy for _, piece in n.pieces} | {parts[-1] for parts, _ in exact}
    spaceless = sorted({max(p.split(" "), key=len) for p in pieces}, key=len)
    seeds = [s for s in spaceless if not any(o != s and o in s for o in spaceless)]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64()), ("text", pa.string())])
    place = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string())])

    def scan(batches):
        first_pass = re.compile("|".join(map(re.escape, seeds)).encode())
        for batch in batches:
            data, offsets = flat(batch.column(1))
            lowered = LOWER[data]
            _, _, bounds = word_spans(lowered, offsets, ALNUM)
            counts = np.diff(bounds)
            whole = lowered.tobytes()
            scans = []
            for n, a, b in zip(counts, offsets[:-1], offsets[1:]):
                if first_pass.search(whole, a, b):
                    words = [w for w in _GAP.split(whole[a:b].decode()) if w]
                    scans.append((s := scan_words(words, exact, fuzzy), " ".join(words) if s.spans else ""))
                else:
                    scans.append((Scan(n_words=int(n)), ""))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([s.n_words for s, _ in scans], pa.int64()),
                    pa.array([[{"first_word": a, "last_word": b, "label": c} for a, b, c in s.places] for s, _ in scans], pa.list_(place)),
                    pa.array(
                        [[{"start": a, "end": b, "label": c, "edits": e, "text": t[a:b]} for a, b, c, e in s.spans] for s, t in scans],
                        pa.list_(span),
                    ),
                    pa.array([s.score for s, _ in scans], pa.float64()),
                ],
                names=["key", "n_words", "places", "spans", "score"],
            )

    schema = (
        f"key {kind}, n_words bigint, places array<struct<first_word: bigint, last_word: bigint, label: string>>, "
        "spans array<struct<start: bigint, end: bigint, label: string, edits: bigint, text: string>>, score double"
    )
    found = map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), scan, schema)
    return found.withColumnRenamed("key", key)


def license_summary(scans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, word range and sorted label lists of each document."""
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("spans.label"))))
    return scans.select(
        key, "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places.first_word").alias("first_word"),
        F.array_max("places.first_word").alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), "score", F.size("spans").cast("bigint").alias("n_spans"),
    )
