"""Phrase collocations by Rabin-Karp fingerprints.

Words are hashed by prefix polynomials over their bytes, n-grams by prefix polynomials over the hashes of their words, so
every n-gram of a batch has its fingerprint from two look-ups. Counting goes in two rounds:

1. Fingerprints are counted level by level. A batch counts its own, sorted, and sends them in packed ranges, which are
   merged range by range; only those that occur often enough come out. An n-gram of a higher level is sent only if the
   shorter ones in it are frequent: these stand in a bitmap of bounded size, which may let more pass but never less.
2. The occurrences of frequent fingerprints are counted again with a second hash and a pointer to one occurrence (row and
   word). Equal fingerprints with unequal second hashes have collided; such phrases are counted by their text instead.
   The others are read from the text they point to, where the fingerprint is checked once more. No other phrase is ever
   written out.

Scores need the counts of both parts of a phrase; a part is at least as frequent as the whole, so it is in the table, too.

Defined results: a null text counts as an empty one; a null language is ``und``; repeated rows count each; texts are read
whole, and a text is never cut between batches; ties are broken by count, then by the bytes of the phrase; an empty table
(or one without frequent phrases) gives no rows; other columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm.filters import in_filter, make_filter
from leadlake.llm.ship import map_arrow, ship_package
from leadlake.llm.textbytes import LOWER, flat, mix, prefix_hash, slices, span_hash, word_spans
from leadlake.session import stored

LONGEST = 5
#: Levels that are counted together; the first has no filter, the others need the last level's n-grams of the one before.
LEVELS = ((1,), (2,), (3, 4, 5))
#: Bytes between words, and bytes between pieces.
GAPS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Bytes of texts that are hashed together, and words whose n-grams are counted together.
SLICE, TOGETHER = 1 << 20, 1 << 20
#: Bytes of text for each range of fingerprints that is merged by itself.
RANGE_BYTES = 1 << 23
#: A pointer is 38 bits of a row's hash and the number of a word; larger numbers mean that the row must be searched.
WORD_BITS = 25
LONG_WORD = 64
#: Tasks that share the phrases of a language.
SALTS = 64

_IN_WORD = np.ones(256, bool)
_IN_WORD[list(GAPS + BREAKS)] = False
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
#: Values of bytes for the second hash: any fixed numbers that are no polynomial of the byte.
_SECOND = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SIZES = np.arange(LONGEST + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)


@dataclass
class Words:
    """The words of some texts: hashes (and second hashes), the piece each is in, its text, its number there, its bytes."""

    hashes: np.ndarray
    second: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    nth: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, twice: bool = False) -> Words:
        lowered = LOWER[data]
        starts, ends, bounds = word_spans(lowered, offsets, _IN_WORD)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        breaks = np.zeros(len(lowered) + 1, np.int64)
        np.cumsum(_BREAK[lowered], out=breaks[1:])
        hashes = span_hash(prefix_hash(lowered), starts, ends)
        second = span_hash(prefix_hash(_SECOND[lowered]), starts, ends) if twice else np.zeros(0, np.uint64)
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():  # polynomials over 64 bits are weak on long periodic strings
            word = lowered[starts[i] : ends[i]].tobytes()
            hashes[i] = xxhash.xxh64_intdigest(word, 1)
            if twice:
                second[i] = xxhash.xxh64_intdigest(word, 2)
        return cls(hashes, second, breaks[starts] + text, text, np.arange(len(text)) - bounds[text], starts, ends)

    @classmethod
    def joined(cls, parts: list[Words], texts: list[int]) -> Words:
        """Words of several runs of texts; ``texts``: how many texts each run has."""
        first = np.cumsum([0, *texts[:-1]])
        pieces = np.cumsum([0, *[int(p.piece[-1]) + 1 if len(p.piece) else 0 for p in parts[:-1]]])
        column = lambda name, more=None: np.concatenate([getattr(p, name) + (0 if more is None else more[i]) for i, p in enumerate(parts)])
        return cls(*[np.concatenate([getattr(p, c) for p in parts]) for c in ("hashes", "second")], column("piece", pieces), column("text", first), column("nth"), column("starts"), column("ends"))

    def grams(self, n: int) -> np.ndarray:
        """First words of the n-grams: n words of one piece."""
        last = len(self.piece) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :]) if last > 0 else np.zeros(0, np.int64)


class Fingerprints:
    """Fingerprints of n-grams, each within a language."""

    def __init__(self, words: Words, languages: np.ndarray, bits: int = 64):
        self.words, self.bits = words, bits
        self.sums = prefix_hash(words.hashes)
        self.second = prefix_hash(words.second) if len(words.second) else None
        self.language = mix(languages.view(np.uint64))[words.text] if len(words.text) else np.zeros(0, np.uint64)

    def of(self, at: np.ndarray, n: int) -> np.ndarray:
        value = mix(span_hash(self.sums, at, at + n) + self.language[at] + _SIZES[n])
        return value if self.bits == 64 else mix(value & np.uint64((1 << self.bits) - 1))

    def check(self, at: np.ndarray, n: int) -> np.ndarray:
        return span_hash(self.second, at, at + n) ^ self.language[at]


def _groups(batches, twice: bool):
    """(words, languages, rows) of about ``TOGETHER`` words, always of whole texts; columns 0 and 1 are language and text."""
    parts, texts, languages, rows, size = [], [], [], [], 0
    for batch in batches:
        data, offsets = flat(batch.column(1))
        for i, j in slices(offsets, SLICE):
            parts.append(Words.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], twice))
            texts.append(j - i)
            languages.append(np.asarray(batch.column(0).slice(i, j - i), np.int64))
            rows.append(np.asarray(batch.column(2).slice(i, j - i), np.int64) if batch.num_columns > 2 else None)
            size += len(parts[-1].hashes)
            if size >= TOGETHER:
                yield Words.joined(parts, texts), np.concatenate(languages), rows[0] if rows[0] is None else np.concatenate(rows)
                parts, texts, languages, rows, size = [], [], [], [], 0
    if parts:
        yield Words.joined(parts, texts), np.concatenate(languages), rows[0] if rows[0] is None else np.concatenate(rows)


def _counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(first)
    if weights is None:
        return values[at], np.diff(at, append=len(values))
    return values[at], np.add.reduceat(weights[order], at) if len(at) else weights[:0]


def frequent_fingerprints(rows: DataFrame, level: tuple[int, ...], below: np.ndarray | None, least: int, ranges: int, bits: int) -> DataFrame:
    """(part, fp, f): n-grams of a level that occur ``least`` times or more; part -1 holds the words of each language instead, by the
    hash of the language. ``rows``: (language, text). ``below`` is the filter of the level before, for n-grams of its length."""
    shared = None if below is None else rows.sparkSession.sparkContext.broadcast(below)
    shift = np.uint64(64 - (ranges - 1).bit_length()) if ranges > 1 else None

    def work(batches):
        for words, languages, _ in _groups(batches, False):
            fingerprints = Fingerprints(words, languages, bits)
            known = level[0] - 1
            if known:
                passes = np.zeros(len(words.hashes) + 1, bool)
                at = words.grams(known)
                passes[at] = in_filter(shared.value, fingerprints.of(at, known))
            found = []
            for n in level:
                at = words.grams(n)
                for k in range(n - known + 1) if known else ():
                    at = at[passes[at + k]]
                found.append(fingerprints.of(at, n))
            values, counts = _counted(np.concatenate(found))
            cuts = [0, len(values)] if shift is None else [*np.searchsorted(values, np.arange(ranges, dtype=np.uint64) << shift).tolist(), len(values)]
            out = [(p, values[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            if not known:
                totals, counts = _counted(languages[words.text])
                out.append((-1, totals.tobytes(), counts.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "fps", "counts"]) if out else _no_rows()

    def merge(key, table):
        part = key[0].as_py()
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()]).astype(np.int64)
        values, sums = _counted(np.concatenate([np.frombuffer(c, np.uint64) for c in table.column("fps").to_pylist()]), counts)
        keep = np.ones(len(sums), bool) if part < 0 else sums >= least
        return pa.table({"part": pa.array(np.full(keep.sum(), part, np.int32)), "fp": pa.array(values[keep].view(np.int64)), "f": pa.array(sums[keep])})

    packed = map_arrow(rows.select("language", "text"), work, "part int, fps binary, counts binary")
    return packed.groupBy("part").applyInArrow(merge, "part int, fp bigint, f bigint")


def _no_rows() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["part", "fps", "counts"])


def pointed_counts(rows: DataFrame, frequent: np.ndarray, least: int, ranges: int, bits: int) -> DataFrame:
    """(fp, n, f, pointer, low, high): fingerprints in the filter with their counts, a pointer to one occurrence, and the least
    and greatest second hash. ``rows``: (language, text, row). As in the first round, a batch sums its own and sends them in packed
    ranges, so that what is sent are ranges of a batch and not its phrases."""
    shared, word_bits = rows.sparkSession.sparkContext.broadcast(frequent), WORD_BITS
    shift = np.uint64(64 - (ranges - 1).bit_length()) if ranges > 1 else None
    kinds = {"fps": np.uint64, "ns": np.uint8, "counts": np.int64, "pointers": np.int64, "lows": np.int64, "highs": np.int64}

    def summed(fps, ns, counts, pointers, lows, highs):
        order = np.lexsort((ns, fps))
        fps, ns = fps[order], ns[order]
        fresh = np.ones(len(fps), bool)
        fresh[1:] = (fps[1:] != fps[:-1]) | (ns[1:] != ns[:-1])
        at = np.flatnonzero(fresh)
        if not len(at):
            return fps, ns, counts, pointers, lows, highs
        sums = np.add.reduceat(counts[order], at), np.minimum.reduceat(pointers[order], at)
        return fps[at], ns[at], *sums, np.minimum.reduceat(lows[order], at), np.maximum.reduceat(highs[order], at)

    def work(batches):
        for words, languages, row in _groups(batches, True):
            fingerprints = Fingerprints(words, languages, bits)
            pointer = row[words.text] << word_bits | np.minimum(words.nth, (1 << word_bits) - 1)
            found = []
            for n in range(1, LONGEST + 1):
                at = words.grams(n)
                fps = fingerprints.of(at, n)
                some = in_filter(shared.value, fps)
                at, fps = at[some], fps[some]
                check = fingerprints.check(at, n).view(np.int64)
                found.append(summed(fps, np.full(len(at), n, np.uint8), np.ones(len(at), np.int64), pointer[at], check, check))
            columns = summed(*[np.concatenate(c) for c in zip(*found)])
            fps = columns[0]
            cuts = [0, len(fps)] if shift is None else [*np.searchsorted(fps, np.arange(ranges, dtype=np.uint64) << shift).tolist(), len(fps)]
            parts = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            packed = [pa.array([c[a:b].tobytes() for _, a, b in parts], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in parts], pa.int32()), *packed], names=["part", *kinds])

    def merge(table):
        fps, ns, counts, pointers, lows, highs = summed(*[np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in kinds.items()])
        keep = counts >= least
        found = {"fp": fps.view(np.int64), "n": ns.astype(np.int32), "f": counts, "pointer": pointers, "low": lows, "high": highs}
        return pa.table({c: pa.array(v[keep]) for c, v in found.items()})

    sent = map_arrow(rows.select("language", "text", "row"), work, "part int, " + ", ".join(f"{c} binary" for c in kinds))
    return sent.groupBy("part").applyInArrow(merge, "fp bigint, n int, f bigint, pointer bigint, low bigint, high bigint")


def materialised(rows: DataFrame, pointed: DataFrame, bits: int) -> DataFrame:
    """(fp, n, lang, phrase): the phrases that pointers lead to, each proved by its fingerprint. ``rows``: (language, text, row, lang)."""
    ask = F.collect_list(F.struct(F.col("pointer").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).alias("word"), "n", "fp"))
    wanted = stored(pointed.groupBy(F.shiftright("pointer", WORD_BITS).alias("row")).agg(ask.alias("asked")), "phrase-pointers")
    furthest = wanted.agg(F.max("row")).first()[0]
    if furthest is None:
        furthest = -1
    # the least pointer of a frequent phrase leads to a row of a small hash, so few rows are read again
    joined, beyond = rows.where(F.col("row") <= furthest).join(wanted, "row"), (1 << WORD_BITS) - 1

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                data, offsets = flat(one.column(1))
                words = Words.of(data, offsets)
                fingerprints = Fingerprints(words, np.asarray(one.column(0), np.int64), bits)
                asked, body = one.column(3)[0].as_py(), LOWER[data].tobytes()
                place, n, want = (np.array([a[c] for a in asked], np.int64) for c in ("word", "n", "fp"))
                out: list[tuple[int, int, str]] = []
                for size in np.unique(n).tolist():
                    at = words.grams(size)
                    fps = fingerprints.of(at, size).view(np.int64)
                    near, far = (n == size) & (place < beyond), (n == size) & (place == beyond)
                    k = np.minimum(np.searchsorted(at, place[near]), max(len(at) - 1, 0))
                    hits = k[(at[k] == place[near]) & (fps[k] == want[near])] if len(at) else k[:0]
                    hits = np.concatenate([hits, *[np.flatnonzero(fps == w)[:1] for w in want[far]]]) if far.any() else hits
                    for k in hits.tolist():
                        a = at[k]
                        out.append((int(fps[k]), size, b" ".join(body[x:y] for x, y in zip(words.starts[a : a + size].tolist(), words.ends[a : a + size].tolist())).decode()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x for x, _, _ in out], pa.int64()), pa.array([x for _, x, _ in out], pa.int32()),
                        pa.array([one.column(2)[0].as_py()] * len(out), pa.string()), pa.array([x for _, _, x in out], pa.string()),
                    ],
                    names=["fp", "n", "lang", "phrase"],
                )

    found = map_arrow(joined.select("language", "text", "lang", "asked"), work, "fp bigint, n int, lang string, phrase string")
    return found.groupBy("fp", "n").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))


def counted_by_text(rows: DataFrame, collided: DataFrame, least: int, bits: int) -> DataFrame:
    """(lang, n, phrase, f) of the phrases whose fingerprints have collided, by their words. ``rows``: (language, text, row, lang)."""
    shared = rows.sparkSession.sparkContext.broadcast(make_filter(collided))

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                data, offsets = flat(one.column(1))
                words = Words.of(data, offsets)
                fingerprints, body = Fingerprints(words, np.asarray(one.column(0), np.int64), bits), LOWER[data].tobytes()
                spelt = [body[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]
                for n in range(1, LONGEST + 1):
                    at = words.grams(n)
                    fps = fingerprints.of(at, n)
                    some = in_filter(shared.value, fps)
                    phrases = [b" ".join(spelt[a : a + n]).decode() for a in at[some].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fps[some].view(np.int64)), pa.array([one.column(2)[0].as_py()] * len(phrases), pa.string()), pa.array([n] * len(phrases), pa.int32()), pa.array(phrases, pa.string())],
                        names=["fp", "lang", "n", "phrase"],
                    )

    found = map_arrow(rows.select("language", "text", "lang"), work, "fp bigint, lang string, n int, phrase string")
    exact = found.join(collided.select("fp", "n"), ["fp", "n"], "left_semi")
    return exact.groupBy("lang", "n", "phrase").agg(F.count("*").alias("f")).where(F.col("f") >= least)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", least: int = 100, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, f) of all phrases of 1 to 5 words that occur ``least`` times or more in a language, and (lang, words) of all
    languages with a word. ``bits``: width of fingerprints (smaller ones collide more, with the same results)."""
    ship_package(docs.sparkSession.sparkContext)
    name, body = F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.coalesce(F.col(text), F.lit(""))
    row = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), body), 64 - 38)
    rows = docs.select(F.xxhash64(name).alias("language"), body.alias("text"), row.alias("row"), name.alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(0, (size // RANGE_BYTES).bit_length())
    counted, below, totals = [], None, None
    for level in LEVELS:
        found = stored(frequent_fingerprints(rows, level, below, least, ranges, bits), f"fingerprints-{level[0]}")
        totals = found.where("part < 0") if totals is None else totals
        counted.append(found.where("part >= 0").select("fp"))
        below = make_filter(counted[-1])
    every = counted[0].unionByName(counted[1]).unionByName(counted[2])
    pointed = stored(pointed_counts(rows, make_filter(every), least, ranges, bits), "phrase-counts")
    collided = pointed.where("low != high")
    certain = pointed.where("low = high")
    phrases = certain.join(materialised(rows, certain, bits), ["fp", "n"]).select("lang", "n", "phrase", "f")
    if not collided.isEmpty():
        phrases = phrases.unionByName(counted_by_text(rows, collided, least, bits))
    names = rows.select("language", "lang").distinct()
    return stored(phrases, "phrases"), totals.join(names, totals["fp"] == names["language"]).select("lang", F.col("f").alias("words"))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", least: int = 100, cover: int = 100, most: int = 2000, bits: int = 64
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of each language. Phrases of which a longer one holds ``cover``
    percent of the occurrences or more are left out."""
    phrases, totals = frequent_phrases(docs, text, lang, key, least, bits)
    words = F.split("phrase", " ")
    several = phrases.where("n > 1").select("lang", "phrase", "n", F.col("f").alias("a"), words.alias("words"))
    part = lambda start, size: F.array_join(F.slice(F.col("words"), start, size), " ")
    cuts = several.select("lang", "phrase", "n", "a", "words", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("n") - F.col("k")).alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    # one row per language, repeated, so that the phrases of one language go to several tasks
    salted = totals.select("lang", F.col("words").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    cuts = cuts.withColumn("above", (F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).cast("decimal(38,0)")).withColumn("below", wide("l") * wide("r"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut"))
    # words of a phrase that stand in a longer one: at most 9 for each
    inner = several.where("n > 2").select("lang", "n", "a", "words", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("size"))
    inner = inner.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("start"))
    longer = inner.groupBy("lang", part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank).where(F.col("rank") <= most)
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
