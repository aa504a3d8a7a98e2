"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance r or less have a common variant within r / 2 of each. So every fingerprint emits all variants
within half the radius, variants are shuffled together, and the fingerprints that meet at one variant are at most r
apart: they are all linked to the smallest of them, without forming pairs. A bucket never holds more fingerprints than
a ball has variants, so no group is unbounded.

Distinct fingerprints only are expanded. Before the full balls (2,081 variants of 64 bits at distance 2), the same is
done with the two halves of the fingerprints: of r differing bits one half holds r / 2 at most, so its ball of radius
r / 4 (33 variants) must meet another's. Fingerprints that meet nobody near enough there can link to nobody and emit no more.

:func:`keep_unlike` finds near copies by the similarity of their five-word shingles, which differ in more bits than a ball of the
whole fingerprint can span. There a text has a wide fingerprint, cut into bands; each band emits its ball, and texts that meet in
any band are compared by their shingles. The width of a band grows with the logarithm of the number of texts, so that
chance meetings stay rare, and the number of bands is the least that finds the aimed share of the pairs at the
border of similarity. What the bands leave is found by an exact join of the groups that they made, so no link is lost.

Defined results: a null text counts as an empty one; texts without words have fingerprint zero, linked like any other;
repeated rows share a component; documents with a null key keep a fingerprint, and their component is the smallest
other key reachable, or null; an empty table gives an empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm.components import connected_components
from leadlake.llm.filters import in_filter, make_filter
from leadlake.llm.ship import give_back, map_arrow
from leadlake.llm.textbytes import LOWER, NOT_SPACE, flat, mix, prefix_hash, slices, span_hash, word_spans
from leadlake.session import stored


def simhash_text(words: list[bytes], shingle: int = 4) -> int:
    """Fingerprint of one text's words, plainly: a bit is set where over half the shingle hashes have it."""
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhashes(data: np.ndarray, offsets: np.ndarray, shingle: int = 4) -> np.ndarray:
    """Fingerprints of a batch of texts."""
    lowered = LOWER[data]
    starts, ends, bounds = word_spans(lowered, offsets, NOT_SPACE)
    size = ends - starts
    # the words one space apart, so that each shingle is one slice
    place = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=place[1:])
    packed = np.full(place[-1], 32, np.uint8)
    take = np.arange(size.sum())
    shift = np.repeat(np.cumsum(size) - size, size)
    packed[take - shift + np.repeat(place[:-1], size)] = lowered[take - shift + np.repeat(starts, size)]
    text = packed.tobytes()
    counts = np.diff(bounds)
    made = np.where(counts > 0, np.maximum(1, counts - shingle + 1), 0)
    first = np.repeat(bounds[:-1], made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    last = np.minimum(first + shingle, np.repeat(bounds[1:], made)) - 1
    digest = xxhash.xxh64_intdigest
    begin, stop = place[first].tolist(), (place[last] + size[last]).tolist()
    hashes = np.array([digest(text[a:b], 42) for a, b in zip(begin, stop)], "<u8")
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(made)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = (np.cumsum(made) - made)[full]
        sums = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        majority = (2 * sums > made[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(majority, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4) -> DataFrame:
    """(key, fp) of every row, the fingerprint as a signed 64-bit number."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            parts = [simhashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle) for i, j in slices(offsets, 1 << 20)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    return map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), work, f"key {kind}, fp bigint")


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of ``radius`` bits or fewer."""
    return np.array([sum(1 << b for b in some) for k in range(radius + 1) for some in combinations(range(bits), k)], np.uint64)


def _meeting_halves(fps: DataFrame, radius: int, few: int = 64) -> DataFrame:
    """Fingerprints that meet another within ``radius`` in the ball of one of their halves. In buckets of more than ``few``
    all members count as met: this is a filter before the balls, which decide."""
    masks = [int(m) for m in ball(32, -(-(radius // 2) // 2))]

    def variants(shift: int):
        half = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << 32) - 1))
        return F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: half.bitwiseXOR(m) + F.lit(shift << 32))

    rows = _spread(fps).select("fp", F.explode(F.concat(variants(0), variants(32))).alias("variant"))
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy("variant"))).where("n > 1")
    counted = stored(counted, "halves")
    bucket = counted.where(F.col("n") <= few).groupBy("variant").agg(F.collect_list("fp").alias("near"))
    close = lambda x: F.exists("near", lambda y: (x != y) & (F.bit_count(x.bitwiseXOR(y)) <= radius))
    small = bucket.select(F.explode(F.filter("near", close)).alias("fp"))
    return small.union(counted.where(F.col("n") > few).select("fp")).distinct()


def _spread(fps: DataFrame) -> DataFrame:
    """Few bytes that become many: dealt over all tasks by number, since their size would put them into one."""
    return _spread_by(fps, "fp")


def fingerprint_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v) links that connect all fingerprints at ``radius`` or fewer bits. ``fps``: distinct (fp)."""
    if radius % 2:
        raise ValueError("an even radius is needed: else members of a bucket can be one bit too far apart")
    masks = ball(64, radius // 2)

    def expand(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for i in range(0, len(fp), 256):
                some = fp[i : i + 256]
                variants = (some[:, None] ^ masks[None, :]).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(masks)).view(np.int64)), pa.array(variants.view(np.int64))], names=["fp", "variant"])

    active = stored(_meeting_halves(fps, radius), "meeting")
    spread = map_arrow(_spread(active), expand, "fp bigint, variant bigint")
    around = Window.partitionBy("variant")
    met = spread.select("fp", F.min("fp").over(around).alias("low")).where("fp != low").distinct()
    return met.select(F.col("fp").alias("u"), F.col("low").alias("v"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(key, fp, component) of every row; the component is the smallest key reachable by links."""
    rows = stored(fingerprint_documents(docs, text, key, shingle), "simhash")
    fps = stored(rows.groupBy("fp").agg(F.min("key").alias("least")), "fingerprints")
    roots = stored(connected_components(fingerprint_links(fps.select("fp"), radius)), "roots")
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "placed")
    names = placed.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = placed.join(names, "root").select("fp", "component")
    # copies share a fingerprint: the side of the documents may be skewed, the other holds each fingerprint once
    return rows.join(by_fp, "fp").select(F.col("key").alias(key), "fp", "component")


def keep_representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One document of each group stays: the one with the smallest key, then the least text hash (the first of repeated
    rows); rows with a null key stay. All columns of ``docs`` are returned. Texts with one key may be in different groups."""
    named = docs.withColumn("_tid", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    keyed = named.where(F.col(key).isNotNull())
    rows = stored(fingerprint_documents(keyed, text, "_tid", shingle).withColumnRenamed("key", "_tid").distinct(), "simhash")
    links = fingerprint_links(stored(rows.select("fp").distinct(), "fingerprints"), radius)
    roots = stored(connected_components(links), "roots")
    groups = rows.join(roots, rows["fp"] == roots["node"], "left").select("_tid", F.coalesce("root", "fp").alias("_root"))
    # the first of each group by a partial aggregate, however large the group is
    first = keyed.select(F.col(key).alias("_key"), "_tid").join(groups, "_tid").groupBy("_root").agg(F.min(F.struct("_key", "_tid")).alias("_first"))
    kept = first.select("_first._key", F.col("_first._tid").alias("_kept"))
    nth = F.row_number().over(Window.partitionBy(key, "_tid").orderBy(*[F.col(f"`{c}`") for c in docs.columns]))
    once = keyed.join(kept, (F.col(key) == F.col("_key")) & (F.col("_tid") == F.col("_kept")), "left_semi").withColumn("_nth", nth).where("_nth = 1")
    return once.drop("_nth", "_tid").unionByName(docs.where(F.col(key).isNull()))


# --- near copies by similarity of shingles, candidates by balls of bands ------------------------------
#: Bits of the wide fingerprint at most: 64 for each of so many lanes.
LANES = 16
#: Shingles whose bits are summed in bytes.
SUMMED = 240


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, repeats included (fewer words: the whole sequence; none: no shingle), and their bounds."""
    lowered = LOWER[data]
    starts, ends, bounds = word_spans(lowered, offsets, NOT_SPACE)
    words = span_hash(prefix_hash(lowered), starts, ends)
    counts = np.diff(bounds)
    made = np.where(counts > 0, np.maximum(1, counts - shingle + 1), 0)
    stop = np.cumsum(made)
    first = np.repeat(bounds[:-1], made) + np.arange(made.sum()) - np.repeat(stop - made, made)
    return span_hash(prefix_hash(words), first, np.minimum(first + shingle, np.repeat(bounds[1:], made))), np.concatenate([[0], stop])


def wide_bits(hashes: np.ndarray, bounds: np.ndarray, lanes: int) -> np.ndarray:
    """A row of ``64 * lanes`` majority bits for each text; lane k takes its bits from the hashes mixed with k."""
    made = np.diff(bounds)
    out = np.zeros((len(made), 64 * lanes), np.uint8)
    full = np.flatnonzero(made)
    if not len(full):
        return out
    # runs of at most SUMMED shingles are summed in bytes, then the runs of a text
    parts = -(-made[full] // SUMMED)
    head = np.cumsum(parts) - parts
    starts = np.repeat(bounds[:-1][full], parts) + (np.arange(parts.sum()) - np.repeat(head, parts)) * SUMMED
    for k in range(lanes):
        bits = np.unpackbits(mix(hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(np.add.reduceat(bits, starts, axis=0, dtype=np.uint8), head, axis=0, dtype=np.int32)
        out[full, 64 * k : 64 * k + 64] = 2 * sums > made[full][:, None]
    return out


def band_plan(texts: int, similarity: float, recall: float) -> tuple[int, int]:
    """(bits, bands): bands with eight bits more than number the texts; as many as find a pair at the border of similarity, which
    differs by two bits or fewer in one of them, with probability ``recall``."""
    width = max(12, texts.bit_length() + 8)
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    meet = sum(math.comb(width, k) * differ**k * (1 - differ) ** (width - k) for k in range(3))
    return width, min(64 * LANES // width, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def wide_fingerprints(texts: DataFrame, shingle: int, bits: int) -> DataFrame:
    """(tid, wide) of every row: its wide fingerprint, packed. ``texts``: (tid, text)."""
    lanes = -(-bits // 64)

    def work(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets, 1 << 19):
                found = wide_bits(*shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle), lanes)
                packed = np.packbits(found, axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in packed], pa.binary())], names=["tid", "wide"])

    return map_arrow(texts, work, "tid bigint, wide binary")


def _band_ranges(prints: DataFrame, width: int, bands: int, high: int) -> DataFrame:
    """(range, tids, values, sketches): every band of the fingerprints in the range of values that its ``high`` upper bits name, and
    with one of these bits flipped in the range next to it. Packed by range: 64-bit tids, twice the values (and one more in the
    range where the text is at home), and 64 bits of the fingerprint that begin behind the band."""
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
    flips = np.concatenate([np.zeros(1, np.uint64), weights[width - high :]])

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(packed, axis=1, bitorder="little")[:, : width * bands].reshape(-1, bands, width)
            value = (bits * weights).sum(2, dtype=np.uint64)[:, :, None] ^ flips
            band = np.arange(bands, dtype=np.uint64)[None, :, None]
            place = ((band << np.uint64(high)) | (value >> np.uint64(width - high))).reshape(-1)
            twice = ((value << np.uint64(1)) | (np.arange(len(flips)) == 0).astype(np.uint64)).reshape(-1)
            behind = (-(-width * np.arange(1, bands + 1) // 8)[:, None] + np.arange(8)) % packed.shape[1]
            sketch = np.repeat(np.ascontiguousarray(packed[:, behind]).view(np.uint64).reshape(-1), len(flips))
            tid = np.repeat(np.asarray(batch.column(0), np.int64), bands * len(flips))
            order = np.argsort(place, kind="stable")
            place = place[order]
            ends = np.flatnonzero(np.append(place[1:] != place[:-1], True)) + 1
            cut = list(zip(np.append(0, ends[:-1]).tolist(), ends.tolist()))
            columns = [pa.array([x[order[i:j]].tobytes() for i, j in cut], pa.binary()) for x in (tid, twice, sketch)]
            yield pa.RecordBatch.from_arrays([pa.array(place[ends - 1].astype(np.int64)), *columns], names=["range", "tids", "values", "sketches"])

    return map_arrow(_spread_by(prints, "tid"), work, "range bigint, tids binary, values binary, sketches binary")


def _most_apart(bits: int, similarity: float) -> float:
    """Of so many bits, how many may differ for a pair at the border of similarity: the expected share and four standard deviations."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits * differ + 4 * math.sqrt(bits * differ * (1 - differ))


def meet_in_range(tid: np.ndarray, twice: np.ndarray, sketch: np.ndarray, low_bits: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(tid, low): the texts of one range of a band that meet at a value within one bit of theirs, with the least text there, if their
    sketches differ by ``most`` bits or fewer. Of texts at home with one value the least looks around, so a group of copies stays small."""
    order = np.lexsort((tid, twice))
    tid, twice, sketch = tid[order], twice[order], sketch[order]
    fresh = np.ones(len(tid), bool)
    fresh[1:] = twice[1:] != twice[:-1]
    least = np.flatnonzero(fresh & (twice & np.uint64(1) == 1))
    value = twice >> np.uint64(1)
    around = (value[least][:, None] ^ (np.uint64(1) << np.arange(low_bits, dtype=np.uint64))).reshape(-1)
    value, who = np.concatenate([value, around]), np.concatenate([np.arange(len(tid)), np.repeat(least, low_bits)])
    order = np.lexsort((tid[who], value))
    value, who = value[order], who[order]
    first = np.ones(len(who), bool)
    first[1:] = value[1:] != value[:-1]
    low = who[np.flatnonzero(first)[np.cumsum(first) - 1]]
    met = (tid[who] != tid[low]) & (np.bitwise_count(sketch[who] ^ sketch[low]) <= most)
    found = np.unique(np.stack([tid[who[met]], tid[low[met]]], 1), axis=0)
    return found[:, 0], found[:, 1]


def _band_pairs(prints: DataFrame, texts: int, width: int, bands: int, similarity: float) -> DataFrame:
    """(tid, low): texts whose fingerprints differ by two bits or fewer in a band, each with the least of those that it meets at a
    value. A range of a band is one group; ranges get narrower with the number of texts, so no group grows with the table."""
    high = min(width - 1, max(3, texts.bit_length() - 17))
    most = _most_apart(64, similarity)

    def meet(table):
        tid, twice, sketch = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("tids", np.int64), ("values", np.uint64), ("sketches", np.uint64)))
        tid, low = meet_in_range(tid, twice, sketch, width - high, most)
        give_back()
        return pa.table({"tid": pa.array(tid), "low": pa.array(low)})

    ranges = _band_ranges(prints, width, bands, high)
    return ranges.groupBy("range").applyInArrow(meet, "tid bigint, low bigint").distinct()


def _not_by_chance(pairs: DataFrame, prints: DataFrame, bits: int, similarity: float) -> DataFrame:
    """The pairs (tid, low) whose wide fingerprints differ by no more bits than a pair at the border of similarity may: the expected
    share and four standard deviations."""
    most = _most_apart(bits, similarity)

    def near(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            # bits behind the bands are part of the last lane and differ as often
            apart = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) if batch.num_rows else np.zeros(0, np.int64)
            yield batch.filter(pa.array(apart <= most * (8 * a.shape[1] / bits) if batch.num_rows else np.zeros(0, bool))).select(["tid", "low"])

    other = prints.select(F.col("tid").alias("low"), F.col("wide").alias("others"))
    rows = pairs.join(prints, "tid").join(other, "low").select("tid", "low", "wide", "others")
    return map_arrow(rows, near, "tid bigint, low bigint")


def _spread_by(rows: DataFrame, column: str) -> DataFrame:
    """Few bytes that become many: dealt over all tasks by number, since their size would put them into one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


#: Bits of the parity bitmap of a text's different shingles, at least.
PARITY = 1024
#: Shingles counted together in a task, and how many of the commonest ones are ranked by their count.
COUNTED, COMMON = 1 << 22, 1 << 16


def _distinct_shingles(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text, sorted within the text, and the number of the text of each."""
    hashes, bounds = shingle_hashes(data, offsets, shingle)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[fresh], text[fresh]


def _of_wanted(texts: DataFrame, wanted: DataFrame, shingle: int, name: str, of_text) -> DataFrame:
    """(tid, n, ``name``) of the wanted texts, (tid): the number of different shingle hashes, and what ``of_text`` makes of the sorted
    hashes."""
    shared = texts.sparkSession.sparkContext.broadcast(make_filter(wanted, "tid"))

    def work(batches):
        for batch in batches:
            tids = np.asarray(batch.column(0), np.int64)
            some = batch.take(pa.array(np.flatnonzero(in_filter(shared.value, tids.view(np.uint64)))))
            data, offsets = flat(some.column(1))
            for i, j in slices(offsets, 1 << 20):
                hashes, text = _distinct_shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                ends = np.searchsorted(text, np.arange(j - i + 1))
                made = [of_text(hashes[a:b]) for a, b in zip(ends, ends[1:])]
                columns = [some.column(0).slice(i, j - i), pa.array(np.diff(ends).astype(np.int32)), pa.array(made, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["tid", "n", name])

    rows = map_arrow(texts, work, f"tid bigint, n int, {name} binary")
    return rows.join(wanted, "tid", "left_semi").dropDuplicates(["tid"])


def _parity(hashes: np.ndarray) -> bytes:
    """The parity of how many hashes fall on each bit of a bitmap, by their low bits. It has a bit or more for each hash: in a narrower
    one the parities of unlike texts differ in no more bits than similar texts may."""
    size = max(PARITY, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else PARITY
    return np.packbits((np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def _lacking(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """In how many bits the parities of each pair differ. The wider one of a pair is folded to the other's width."""
    out = np.zeros(len(one), np.int64)
    least = [k for k, (a, b) in enumerate(zip(one, other)) if len(a) == len(b) == PARITY // 8]
    if least:
        x, y = (np.frombuffer(b"".join([some[k] for k in least]), np.uint64).reshape(len(least), -1) for some in (one, other))
        out[least] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    for k, (a, b) in enumerate(zip(one, other)):
        if len(a) > PARITY // 8 or len(b) > PARITY // 8:
            x, y = (np.bitwise_xor.reduce(np.frombuffer(c, np.uint64).reshape(-1, min(len(a), len(b)) // 8), axis=0) for c in (a, b))
            out[k] = np.bitwise_count(x ^ y).sum()
    return out


def _alike(texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): the pairs (tid, low) whose shingles are similar enough. All are compared by parity; only the texts of pairs that this
    leaves send their shingles."""

    def members(some: DataFrame, name: str) -> DataFrame:
        return stored(some.select(F.explode(F.array("tid", "low")).alias("tid")).distinct(), name)

    def both(some: DataFrame, of_texts: DataFrame, column: str) -> DataFrame:
        mine = of_texts.select("tid", "n", column)
        other = of_texts.select(F.col("tid").alias("low"), F.col("n").alias("other_n"), F.col(column).alias(f"other_{column}"))
        return some.join(mine, "tid").join(other, "low").select(F.col("tid").alias("u"), F.col("low").alias("v"), "n", "other_n", column, f"other_{column}")

    def near(batches):
        # each odd bit that differs is a shingle that one of them lacks; similar texts lack no more than this share
        for batch in batches:
            if batch.num_rows:
                lacking = _lacking(batch.column(4).to_pylist(), batch.column(5).to_pylist())
                n = np.asarray(batch.column(2), np.int64) + np.asarray(batch.column(3), np.int64)
                yield batch.filter(pa.array(lacking <= (1 - similarity) / (1 + similarity) * n + 1e-6)).select(["u", "v"])

    def compare(batches):
        for batch in batches:
            alike = []
            for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.filter(pa.array(alike, pa.bool_())).select(["u", "v"])

    parities = stored(_of_wanted(texts, members(pairs, "compared"), shingle, "parity", _parity), "parities")
    left = map_arrow(both(pairs, parities, "parity"), near, "u bigint, v bigint").select(F.col("u").alias("tid"), F.col("v").alias("low"))
    left = stored(left, "near-pairs")
    # not stored: both sides of the pairs read one shuffle of the sets
    sets = _of_wanted(texts, members(left, "near-texts"), shingle, "shingles", np.ndarray.tobytes)
    return map_arrow(both(left, sets, "shingles"), compare, "u bigint, v bigint")


def _common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """About the commonest shingles, sorted, and their counts: those seen four times or more by a task. They only set the order
    of shingles, and any order finds the same links."""

    def work(batches):
        held, size = [], 0

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= 4
            return pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(counts[some])], names=["shingle", "n"])

        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                held.append(_distinct_shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)[0])
                size += len(held[-1])
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    seen = map_arrow(texts, work, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    most = seen.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    values, counts = np.asarray(most.column(0), np.int64).view(np.uint64), np.asarray(most.column(1), np.int64)
    order = np.argsort(values)
    return values[order], counts[order]


def _prefix_rows(texts: DataFrame, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray], met: np.ndarray | None = None) -> DataFrame:
    """(tid, shingle, n, place): the first of a text's n different shingles, rarest first, as many as a similar text cannot lack
    all of; or those in the filter ``met`` only. Texts without words share a shingle of their own."""
    shared = texts.sparkSession.sparkContext.broadcast((*common, met))

    def work(batches):
        values, counts, met = shared.value
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                hashes, text = _distinct_shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                times = np.zeros(len(hashes), np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
                    times = np.where(values[at] == hashes, counts[at], 0)
                order = np.lexsort((hashes, times, text))
                hashes, text = hashes[order], text[order]
                n = np.bincount(text, minlength=j - i)
                place = np.arange(len(text)) - (np.cumsum(n) - n)[text]
                keep = place < (n - np.ceil(similarity * n - 1e-6).astype(np.int64) + 1)[text]
                blank = np.flatnonzero(n == 0)
                hashes, text, place = (np.concatenate([a[keep], b]) for a, b in ((hashes, np.zeros(len(blank), np.uint64)), (text, blank), (place, np.zeros(len(blank), np.int64))))
                if met is not None:
                    some = in_filter(met, hashes)
                    hashes, text, place = hashes[some], text[some], place[some]
                tid = np.asarray(batch.column(0).slice(i, j - i), np.int64)[text]
                columns = [pa.array(tid), pa.array(hashes.view(np.int64)), pa.array(n[text].astype(np.int32)), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["tid", "shingle", "n", "place"])

    return map_arrow(texts, work, "tid bigint, shingle bigint, n int, place int")


def missed_links(texts: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): every link between texts of different groups, ``roots``: (node, root); texts without a row are groups of their own.

    Exact, by prefix filtering: with the shingles of all texts in one order, similar texts share one of the first few, and their
    numbers of shingles and its places in them bound what they can share. Rare shingles come first, so what many texts hold
    seldom brings them together. Groups meet before their texts do, so texts of one group form no pairs.
    """
    common = _common_shingles(texts, shingle)
    firsts = _prefix_rows(texts, shingle, similarity, common).groupBy("shingle").agg(F.min("tid").alias("low"), F.max("tid").alias("high"))
    met = make_filter(stored(firsts.where("low != high").select("shingle"), "shared-shingles"), "shingle")
    held = _prefix_rows(texts, shingle, similarity, common, met).distinct()
    rows = held.join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    rows = stored(rows.select("shingle", "root", "tid", "n", (F.col("n") - 1 - F.col("place")).alias("rest")), "prefixes")
    groups = rows.groupBy("shingle", "root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))

    def fits(least: str, most: str) -> Column:
        long = (F.col(f"x.{most}") >= similarity * F.col(f"y.{least}") - 1e-6) & (F.col(f"y.{most}") >= similarity * F.col(f"x.{least}") - 1e-6)
        needed = similarity / (1 + similarity) * (F.col(f"x.{least}") + F.col(f"y.{least}"))
        return (F.col("x.shingle") == F.col("y.shingle")) & long & (1 + F.least("x.rest", "y.rest") >= needed - 1e-6)

    met = groups.alias("x").join(groups.alias("y"), fits("low", "high") & (F.col("x.root") < F.col("y.root")))
    met = met.select("x.shingle", F.col("x.root").alias("one"), F.col("y.root").alias("two"))
    left = met.join(rows.withColumnRenamed("root", "one"), ["shingle", "one"]).alias("x")
    both = left.join(rows.alias("y"), fits("n", "n") & (F.col("x.two") == F.col("y.root")))
    pairs = both.select(F.greatest("x.tid", "y.tid").alias("tid"), F.least("x.tid", "y.tid").alias("low")).distinct()
    return _alike(texts, stored(pairs, "left-candidates"), shingle, similarity)


def similar_links(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.9) -> DataFrame:
    """(u, v): links between texts whose different shingles have at least that similarity (Jaccard); similar texts are always
    connected by them. ``texts``: (tid bigint, text), where equal texts have equal tids. Texts without words are alike.

    Texts that meet in a band are each linked to the least of them, if they are similar, so a group of copies forms no pairs.
    Bands find ``recall`` of the pairs at the border; :func:`missed_links` finds every link that is left between two groups.
    """
    number = texts.agg(F.approx_count_distinct("tid")).first()[0]
    width, bands = band_plan(number, similarity, recall)
    prints = stored(wide_fingerprints(texts, shingle, width * bands).dropDuplicates(["tid"]), "wide-fingerprints")
    pairs = _band_pairs(prints, number, width, bands, similarity)
    pairs = stored(_not_by_chance(pairs, prints, width * bands, similarity), "candidates")
    found = stored(_alike(texts, pairs, shingle, similarity), "band-links")
    roots = stored(connected_components(found), "band-roots")
    return found.unionByName(missed_links(texts, roots, shingle, similarity))


def keep_unlike(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, similarity: float = 0.8, recall: float = 0.9
) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest key (null keys last), then the least text hash, then
    the first of repeated rows. All columns of ``docs`` are returned, whatever their names. Links are those of :func:`similar_links`."""
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    rows = docs.select(F.xxhash64(body).alias("tid"), F.col(key).alias("key"), F.xxhash64(*hashed).alias("whole"), F.struct("*").alias("doc"))
    roots = stored(connected_components(similar_links(docs.select(F.xxhash64(body).alias("tid"), body.alias("text")), shingle, similarity, recall)), "roots")
    place = F.struct(F.col("key").isNull().alias("last"), "key", "tid", "whole")
    # first of each text, then of each group: partial aggregates, however many copies there are
    first = rows.groupBy("tid").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.count_distinct("whole").alias("kinds"))
    first = stored(first, "first-copies")
    kept = first.join(roots, first["tid"] == roots["node"], "left").groupBy(F.coalesce("root", "tid").alias("root")).agg(F.min("first").alias("first"))
    kept = kept.select("first.tid", "first.key", "first.whole")
    same = (F.col("r.tid") == F.col("k.tid")) & (F.col("r.whole") == F.col("k.whole")) & F.col("r.key").eqNullSafe(F.col("k.key"))
    chosen = rows.alias("r").join(kept.alias("k"), same, "left_semi")
    if not first.where("n > kinds").isEmpty():  # equal rows are one document
        chosen = chosen.dropDuplicates(["tid", "whole"])
    return chosen.select("doc.*")
