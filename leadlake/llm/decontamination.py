"""Benchmark decontamination with a positional inverted index of the training texts.

The index is cut by documents: each block of texts holds, for every term in it, the sorted places where the term stands
(as gaps, compressed), and where its documents begin. It is written once, whatever will be searched. Test phrases are then
looked up block by block: a phrase with a term that the block lacks is out at once; for the others the places of the rarest
term, moved back by its offset in the phrase, are the candidates, and the offset-adjusted places of the next rarest
terms are intersected with them until the phrase is proved or no candidate is left. Proximity search takes the places
of the rarest term in the same way and looks for the other terms around them.

Test items are broadcast in slices of bounded size; a larger test set is searched in several passes over the index, so neither
side has to fit anywhere as a whole. A document lies in one block, and a block holds ``BLOCK_WORDS`` words or one text.

Terms are known by 64-bit hashes. Defined results: a null or wordless text has no words, no hits and is clean; a null or
wordless item has no window; items with one id count as one, a null id is written as an empty string; repeated documents
are answered each; very long texts are indexed whole; empty tables give empty results; other columns are neither read nor
returned, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm.ship import map_arrow
from leadlake.llm.textbytes import ALNUM, LOWER, flat, mix, prefix_hash, slices, span_hash, word_spans
from leadlake.session import stored

WINDOW = 10
#: Words of the texts in one block of the index (or one longer text), and of the test items in one broadcast slice.
BLOCK_WORDS, SLICE_WORDS = 1 << 20, 1 << 18
#: Bytes of texts that are split into words together.
SLICE = 1 << 20
#: Binary columns of the index.
COLUMNS = ("terms", "ends", "gaps", "wide", "bounds")
#: Words longer than this are hashed one by one, as polynomial hashes are weak on long periodic strings.
LONG_WORD = 64


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, and the word offsets of each text."""
    lowered = LOWER[data]
    starts, ends, bounds = word_spans(lowered, offsets, ALNUM)
    terms = span_hash(prefix_hash(lowered), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        terms[i] = xxhash.xxh64_intdigest(lowered[starts[i] : ends[i]].tobytes(), 42)
    return terms, bounds


@dataclass
class Block:
    """The postings of one block: ``terms`` ascending, the places of term i are ``places[ends[i - 1] : ends[i]]``."""

    terms: np.ndarray
    ends: np.ndarray
    places: np.ndarray
    bounds: np.ndarray  # first place of each document, and the end of the last

    @classmethod
    def build(cls, words: np.ndarray, bounds: np.ndarray) -> Block:
        places = np.argsort(words, kind="stable").astype(np.int32)
        ordered = words[places]
        last = np.ones(len(words), bool)
        last[:-1] = ordered[1:] != ordered[:-1]
        ends = np.flatnonzero(last) + 1
        return cls(ordered[ends - 1], ends, places, bounds)

    def packed(self) -> dict[str, bytes]:
        """Places as gaps; a term's first gap counts from -1, so no gap is below 1."""
        before = np.concatenate([[-1], self.places[:-1]]).astype(np.int32)
        before[self.ends[:-1]] = -1
        squeeze = zstandard.ZstdCompressor(level=1)
        gaps = self.places - before
        small = np.minimum(gaps, 255).astype(np.uint8)
        wide = gaps[gaps > 254].astype(np.int32)
        return {
            "terms": self.terms.tobytes(), "ends": squeeze.compress(np.diff(self.ends, prepend=0).astype(np.int32).tobytes()),
            "gaps": squeeze.compress(small.tobytes()), "wide": squeeze.compress(wide.tobytes()), "bounds": np.asarray(self.bounds, np.int64).tobytes(),
        }

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> Block:
        expand = zstandard.ZstdDecompressor()
        ends = np.cumsum(np.frombuffer(expand.decompress(row["ends"]), np.int32), dtype=np.int64)
        gaps = np.frombuffer(expand.decompress(row["gaps"]), np.uint8).astype(np.int64)
        gaps[gaps == 255] = np.frombuffer(expand.decompress(row["wide"]), np.int32)
        sums = np.cumsum(gaps)
        starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
        base = np.where(starts > 0, sums[starts - 1], 0) if len(starts) else starts
        places = sums - np.repeat(base, np.diff(ends, prepend=0)) - 1
        return cls(np.frombuffer(row["terms"], np.uint64), ends, places, np.frombuffer(row["bounds"], np.int64))

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the list of each term begins, and its length (0: the block lacks the term)."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        start = np.where(at > 0, self.ends[at - 1], 0)
        return start, np.where(self.terms[at] == terms, self.ends[at] - start, 0)

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, "right") - 1


def phrase_places(block: Block, phrases: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(phrase, first places) of the phrases (rows of terms, of one length) that stand in the block, within one document."""
    size = phrases.shape[1]
    start, length = block.lists(phrases)
    out = []
    for p in np.flatnonzero((length > 0).all(1)).tolist():
        order = np.argsort(length[p], kind="stable").tolist()
        first = order[0]
        found = block.places[start[p, first] : start[p, first] + length[p, first]] - first
        for k in order[1:]:
            if not len(found):
                break
            own = block.places[start[p, k] : start[p, k] + length[p, k]]
            at = np.minimum(np.searchsorted(own, found + k), len(own) - 1)
            found = found[own[at] == found + k]
        if len(found):
            found = found[(found >= 0) & (block.documents(found) == block.documents(found + size - 1))]
            if len(found):
                out.append((p, found))
    return out


def near_places(block: Block, phrases: np.ndarray, within: int) -> list[tuple[int, int, int]]:
    """(phrase, first place, last place) of stretches of ``within`` words at most that hold all words of a phrase in any order:
    around each place of the phrase's rarest word the narrowest one, then the first."""
    out = set()
    for p, phrase in enumerate(phrases):
        start, length = block.lists(terms := np.unique(phrase))
        if not (length > 0).all():
            continue
        lists = [block.places[start[k] : start[k] + length[k]] for k in np.argsort(length, kind="stable").tolist()]
        around = lists[0]
        for own in lists[1:]:  # a place of the rarest word needs one of each other word near it
            at = np.searchsorted(own, around - within + 1)
            around = around[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] < around + within)]
        for place in around.tolist():
            nth = int(block.documents(place))
            low, high = max(place - within + 1, int(block.bounds[nth])), min(place + within, int(block.bounds[nth + 1]))
            last: dict[int, int] = {}
            found = []
            for x, k in sorted((int(x), k) for k, own in enumerate(lists) for x in own[np.searchsorted(own, low) : np.searchsorted(own, high)]):
                before, last[k] = last.get(k, -1), x
                least = min(last.values())
                # with the word in it before its last place, the stretch is not a narrowest one
                if len(last) == len(terms) and before < least <= place <= x < least + within:
                    found.append((x - least, least, x))
            if found:
                out.add((p, *min(found)[1:]))
    return sorted(out)


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The stored index: one row per block with its postings and the keys and word counts of its documents."""
    kind = docs.schema[key].dataType.simpleString()

    def packed_block(number, held):
        counts = np.concatenate([np.diff(bounds) for _, _, bounds in held])
        block = Block.build(np.concatenate([words for _, words, _ in held]), np.concatenate([[0], np.cumsum(counts)])).packed()
        keys = pa.concat_arrays([keys for keys, _, _ in held])
        rows = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), rows, *[pa.array([block[c]], pa.binary()) for c in COLUMNS]], names=["block", "keys", *COLUMNS])

    def work(batches):
        held, size, made, part = [], 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets, SLICE):
                words, bounds = terms_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if held and size + len(words) > block_words:
                    yield packed_block(part << 32 | made, held)
                    held, size, made = [], 0, made + 1
                held.append((batch.column(0).slice(i, j - i), words, bounds))
                size += len(words)
        if held:
            yield packed_block(part << 32 | made, held)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))
    binary = ", ".join(f"{c} binary" for c in COLUMNS)
    return stored(map_arrow(rows, work, f"block bigint, keys array<{kind}>, {binary}"), "positional-index")


@dataclass
class Items:
    """A slice of the test items: their windows by length, each with its item and its place in the item."""

    ids: list[str]
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, rows: list, window: int) -> Items:
        data, offsets = flat(pa.array([r["text"] for r in rows], pa.string()))
        terms, bounds = terms_of(data, offsets)
        by_size: dict[int, list[int]] = {}
        for i, n in enumerate(np.diff(bounds).tolist()):
            if n:
                by_size.setdefault(min(n, window), []).append(i)
        windows = []
        for size, some in sorted(by_size.items()):
            count = np.diff(bounds)[some] - size + 1
            item = np.repeat(some, count)
            first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            windows.append((terms[(bounds[item] + first)[:, None] + np.arange(size)], item, first))
        return cls([r["id"] for r in rows], windows)


def item_slices(items: DataFrame, text: str, key: str, slice_words: int):
    """Slices of the items, each small enough for a broadcast: its items hold about ``slice_words`` words."""
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"), words.alias("words"))
    total = rows.agg(F.sum("words")).first()[0] or 0
    n = max(1, -(-total // slice_words))
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).select("id", "text").distinct()
        yield own.orderBy("id", "text").collect()  # bounded by slice_words


def _searched(index: DataFrame, items: DataFrame, text: str, key: str, window: int, slice_words: int, search) -> DataFrame:
    """(block, nth, item_id, item_first, first, n_words) by ``search``, which gives (row of phrases, places, words of each place)
    for a block and phrases of one length."""
    found = None
    for rows in item_slices(items, text, key, slice_words):
        shared = index.sparkSession.sparkContext.broadcast(Items.build(rows, window))

        def work(batches, shared=shared):
            asked = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block.unpacked(row)
                    hits = [
                        (np.full(len(places), item[p]), np.full(len(places), first[p]), places, sizes)
                        for phrases, item, first in asked.windows for p, places, sizes in search(block, phrases)
                    ]
                    if hits:
                        item, first, places, sizes = (np.concatenate(x).astype(np.int64) for x in zip(*hits))
                        nth = block.documents(places)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(nth), row["block"], np.int64)), pa.array(nth), pa.array(asked.ids).take(pa.array(item)),
                                pa.array(first), pa.array(places - block.bounds[nth]), pa.array(sizes),
                            ],
                            names=["block", "nth", "item_id", "item_first", "first", "n_words"],
                        )

        part = map_arrow(index.select("block", *COLUMNS), work, "block bigint, nth bigint, item_id string, item_first bigint, first bigint, n_words bigint")
        found = part if found is None else found.unionByName(part)
    return found


def phrase_matches(
    index: DataFrame, items: DataFrame, text: str = "text", key: str = "item_id", window: int = WINDOW, slice_words: int = SLICE_WORDS
) -> DataFrame:
    """(block, nth, item_id, item_first, first, n_words): each place of each window of ``window`` words of an item (or the whole item,
    if it is shorter). ``first`` counts the words of the document, ``item_first`` those of the item."""

    def search(block, phrases):
        return [(p, places, np.full(len(places), phrases.shape[1])) for p, places in phrase_places(block, phrases)]

    return _searched(index, items, text, key, window, slice_words, search)


def proximity_matches(
    index: DataFrame, items: DataFrame, within: int = 2 * WINDOW, text: str = "text", key: str = "item_id", window: int = WINDOW, slice_words: int = SLICE_WORDS
) -> DataFrame:
    """Like :func:`phrase_matches` for windows whose words all stand, in any order, within ``within`` words of a document;
    ``n_words`` is the length of the stretch."""

    def search(block, phrases):
        return [(p, np.array([a]), np.array([b - a + 1])) for p, a, b in near_places(block, phrases, within)]

    return _searched(index, items, text, key, window, slice_words, search)


def index_documents(index: DataFrame) -> DataFrame:
    """(block, nth, key, n_words) of every indexed row."""

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                bounds = np.frombuffer(batch.column(2)[i].as_py(), np.int64)
                n = len(bounds) - 1
                keys = batch.column(1).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array(np.arange(n)), keys, pa.array(np.diff(bounds))], names=["block", "nth", "key", "n_words"])

    kind = index.schema["keys"].dataType.elementType.simpleString()
    return map_arrow(index.select("block", "keys", "bounds"), work, f"block bigint, nth bigint, key {kind}, n_words bigint")


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
    window: int = WINDOW, index: DataFrame | None = None,
) -> DataFrame:
    """(key, n_words, n_hit, n_items, item_ids, contaminated) of every row: the words inside a place of a window of an item."""
    index = build_index(docs, text, key) if index is None else index
    matches = phrase_matches(index, items, item_text, item_key, window)
    # windows overlap: a place counts the words behind the furthest end so far
    along = Window.partitionBy("block", "nth").orderBy("first", "n_words")
    reached = F.max(F.col("first") + F.col("n_words")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = matches.groupBy("block", "nth", "first", "n_words").agg(F.collect_set("item_id").alias("ids"))
    fresh = F.greatest(F.lit(0), F.col("first") + F.col("n_words") - F.greatest("first", F.coalesce(reached, F.lit(0))))
    hit = spans.withColumn("fresh", fresh).groupBy("block", "nth").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"))
    rows = index_documents(index).join(hit, ["block", "nth"], "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return rows.select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))
