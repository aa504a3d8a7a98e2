"""Suffix-array dedup: bytes that a long string covers which also starts earlier are removed.

Every window of 100 bytes (a string to look for) is filed under its anchor: the least hash of a 32-byte string in it. Equal
windows have equal anchors, so only texts around a shared anchor can hold repeats; a run of windows with one anchor,
with the bytes it covers, is that anchor's context. Equal contexts are folded into their first (they repeat it as a whole),
by hashes alone. The different contexts of one anchor (and those that can repeat within themselves) go together to one task, which splits them into shards, builds the
Burrows-Wheeler transform of each shard, and merges the transforms by refining their interleave a few symbols at a time.
After 100 symbols the interleave sorts all suffixes that still share them, and the borders kept along the way (common prefixes
shorter than that) delimit the repeated intervals; no suffixes are sorted again. Suffixes that share nothing more, or have met
the end of their context, are left out of the steps that follow. All but the first window of an interval are repeats. An anchor's group is as large as the different contexts around one string of 32 bytes, not as its copies.

Defined results: a null text counts as an empty one; rows with equal id and text are one document and get the same
answer; texts with one id are in order of a hash of the text; a null id comes before all others; texts shorter than
the string length lose nothing; an empty table gives an empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm.ship import map_arrow
from leadlake.llm.textbytes import _powers, flat, mix, prefix_hash, slices, span_hash
from leadlake.session import stored

LENGTH, GRAM = 100, 32
#: Windows of one context; bytes of contexts that are merged at a time; shards of such a group.
RUN, GROUP_BYTES, SHARDS = 1024, 1 << 17, 4
_NO_KEY = -(1 << 63)


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, start in the text, windows, anchor, hash of the bytes covered, whether the
    run can hold equal windows itself)."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    sums = prefix_hash(data)
    _, inverse = _powers(n + 1)
    gram_hash = least = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    size, want = 1, length - gram + 1
    while size * 2 <= want:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    windows = n - length + 1
    anchor = np.minimum(least[:windows], least[want - size : want - size + windows])
    change = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= length)
    change[offsets[long]] += 1
    change[offsets[long + 1] - length + 1] -= 1
    whole = np.cumsum(change[:windows], dtype=np.int8) > 0  # windows that lie within one text
    begin = whole.copy()
    begin[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
    stop = np.ones(windows, bool)
    stop[:-1] = ~whole[1:] | begin[1:]
    start = np.flatnonzero(begin)
    count = np.flatnonzero(stop & whole) + 1 - start
    parts = -(-count // RUN)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, count = np.repeat(start, parts) + nth * RUN, np.minimum(RUN, np.repeat(count, parts) - nth * RUN)
    text = np.searchsorted(offsets, start, "right") - 1
    # equal windows have their anchors at equal places, so one window but the last must begin with its anchor
    leads = np.zeros(windows + 1, np.int32)
    np.cumsum(gram_hash[:windows] == anchor, out=leads[1:])
    itself = leads[start + count - 1] > leads[start]
    return text, start - offsets[text], count, anchor[start], span_hash(sums, start, start + count - 1 + length), itself


# --- Burrows-Wheeler transforms of shards, and their merge ------------------------------------------
def _ranked(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys below 2^(64 - ``bits``), and which of them, in that order, differ from the one before: each takes its
    place along in the low bits, so that plain numbers are sorted."""
    value = (keys << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64)
    value.sort()
    order = (value & np.uint64((1 << bits) - 1)).astype(np.int64)
    value >>= np.uint64(bits)
    return order, value[1:] != value[:-1]


def _dense(codes: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Codes below ``size`` renumbered in their order without gaps, and how many there are."""
    used = np.zeros(size, bool)
    used[codes] = True
    return (np.cumsum(used, dtype=np.int32) - 1)[codes], int(used.sum())


def shard_transform(strings: list[bytes], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all strings (as places in the strings joined with an end mark each) in order of ``depth`` symbols or
    more, each string read as a ring; the symbol before each; and the rank of the suffix one symbol longer."""
    size = np.array([len(s) + 1 for s in strings])
    end = np.cumsum(size) - 1
    symbols = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255: the mark is 0
    follow = np.arange(1, len(symbols) + 1, dtype=np.int64)
    follow[end] = end - size + 1
    bits = len(symbols).bit_length()
    # as many symbols at first, and as many ranks in each later step, as stand in a number beside the place
    codes, kinds = _dense(symbols, 256)
    rank, width, step, ahead = codes.astype(np.uint64), kinds.bit_length(), 1, follow
    while True:
        keys, taken, part = rank, 1, ahead
        while (taken + 1) * width + bits <= 64 and taken * step < depth:
            keys, taken, part = (keys << np.uint64(width)) | rank[part], taken + 1, ahead[part]
        if taken > 1 or step >= depth:
            order, differ = _ranked(keys, bits)
        else:  # too many symbols for that
            keys, taken, part = (rank << np.uint64(32)) | rank[ahead], 2, ahead[ahead]
            order = np.argsort(keys, kind="stable")
            differ = keys[order[1:]] != keys[order[:-1]]
        ahead, step, width = part, step * taken, bits
        if step >= depth:
            break
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(differ)]).astype(np.uint64)
    back = np.empty_like(follow)
    back[follow] = np.arange(len(follow))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    before = back[order]
    return order, symbols[before], place[before]


def merge_transforms(
    shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int = LENGTH, left: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The shards' suffixes (numbered through all shards) interleaved in order of ``depth`` symbols, and the number of
    the interval of each: suffixes of one interval share ``depth`` symbols. ``depth`` is even: a step takes two symbols, or four
    where the group has few different ones.

    With ``left``, the symbols that each suffix has before its end mark, only suffixes are returned that reach ``depth`` before
    it and share an interval. The others are left out once this is known: a longer suffix that begins with two or four symbols before
    one that stands alone, or has met its end, does so itself in the next step.
    """
    base = np.cumsum([0] + [len(o) for o, _, _ in shards]).astype(np.int32)
    symbols = np.concatenate([s for _, s, _ in shards]).astype(np.uint16)
    longer = np.concatenate([rank + b for (_, _, rank), b in zip(shards, base)])
    ahead, longer, step = (symbols[longer] << 8) | symbols, longer[longer], 2
    if depth % 4 == 0:
        pairs, n = _dense(ahead, 1 << 16)
        if n <= 1 << 12:
            fours, m = _dense(pairs[longer] * n + pairs, n * n)
            if m <= 1 << 16:
                ahead, longer, step = fours.astype(np.uint16), longer[longer], 4
    interleave = np.arange(len(symbols), dtype=np.int32)
    interval = np.zeros(len(symbols), np.int32)
    for reached in range(step, depth + 1, step):
        # the suffixes a step longer: by the symbols of the step first, then in the present order
        key = ahead[interleave]
        order = np.argsort(key, kind="stable")
        interleave = longer[interleave[order]]
        key, interval = key[order], interval[order]
        border = np.ones(len(key) + 1, bool)
        border[1:-1] = (key[1:] != key[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(border[:-1], dtype=np.int32)
        if left is not None:
            stay = ~(border[:-1] & border[1:]) & (left[interleave] >= reached)
            interleave, interval = interleave[stay], interval[stay]
    return interleave, interval


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For contexts in order of their places: the windows of each that stand earlier, too."""
    if not contexts:
        return []
    bounds = np.linspace(0, len(contexts), min(SHARDS, len(contexts)) + 1).astype(int)
    parts = [contexts[a:b] for a, b in zip(bounds, bounds[1:])]
    shards = [shard_transform(p, length) for p in parts]
    size = np.array([len(c) + 1 for c in contexts])
    stop = np.cumsum(size)
    base = np.cumsum([0] + [len(o) for o, _, _ in shards])
    at = np.concatenate([o + b for (o, _, _), b in zip(shards, base)])
    # windows are the suffixes that reach their length before the end mark
    left = (np.repeat(stop, size) - 1 - np.arange(stop[-1])).astype(np.int32)[at]
    interleave, interval = merge_transforms(shards, length, left)
    place = at[interleave]
    owner = np.searchsorted(stop, place, "right")
    within = place - (stop - size)[owner]
    order = np.lexsort((place, interval))  # contexts stand in order, so the least place is the first window
    later = np.zeros(len(order), bool)
    later[1:] = interval[order][1:] == interval[order][:-1]
    hit = order[later]
    hit = hit[np.argsort(place[hit], kind="stable")]
    cuts = np.searchsorted(owner[hit], np.arange(len(contexts) + 1))
    hits = within[hit]
    return [hits[a:b] for a, b in zip(cuts, cuts[1:])]


# --- jobs --------------------------------------------------------------------------------------------
def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, tag, text): the tag, a hash of the text, tells texts with one key apart; it is 0 where no key has several."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_KEY))
    rows = docs.select(own.alias("key"), F.xxhash64(body).alias("tag"), body.alias("text"))
    several = rows.groupBy("key").agg((F.min("tag") != F.max("tag")).alias("several")).where("several")
    return rows.withColumn("tag", F.lit(0).cast("bigint")) if several.isEmpty() else rows


def _anchor_rows(rows: DataFrame) -> DataFrame:
    """(anchor, hash, key, tag, place): one row per run; place holds start, windows and two marks. A run that its own batch has
    earlier is marked as known, and spread by its place."""

    def work(batches):
        for batch in batches:
            key, tag = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64)
            data, offsets = flat(batch.column(2))
            for i, j in slices(offsets, 1 << 19):
                part = offsets[i : j + 1]
                text, start, count, anchor, context, own = anchored_runs(data[part[0] : part[-1]], part - part[0])
                k, t = key[text + i], tag[text + i]
                order = np.lexsort((start, t, k, context, anchor))
                text, start, count, anchor, context, own, k, t = (x[order] for x in (text, start, count, anchor, context, own, k, t))
                known = np.zeros(len(order), bool)
                known[1:] = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
                # one document may hold a row twice: that is the same place, not an earlier one
                known[1:] &= (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (start[1:] != start[:-1])
                anchor = np.where(known, mix(k.astype(np.uint64) ^ (start.astype(np.uint64) << np.uint64(40))), anchor)
                packed = (start << 13) | (count << 2) | (own.astype(np.int64) << 1) | known.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(k), pa.array(t), pa.array(packed)],
                    names=["anchor", "hash", "key", "tag", "place"],
                )

    return map_arrow(rows, work, "anchor bigint, hash bigint, key bigint, tag bigint, place bigint")


def _found_runs(rows: DataFrame) -> DataFrame:
    """(anchor, key, tag, start, windows, open): runs that repeat as a whole, and (open) first runs of anchors that have
    different contexts, or runs that may repeat within themselves."""
    known = F.col("place").bitwiseAND(F.lit(1)) == 1
    itself = F.shiftright("place", 1).bitwiseAND(F.lit(1)) == 1
    windows = F.shiftright("place", 2).bitwiseAND(F.lit((1 << 11) - 1)).cast("int").alias("windows")
    start = F.shiftright("place", 13).alias("start")
    runs = _anchor_rows(rows).select("anchor", "hash", "key", "tag", start, windows, known.alias("known"), itself.alias("own"))
    by_place = Window.partitionBy("anchor").orderBy("hash", "key", "tag", "start")
    # in the same order, so that the rows of an anchor are gone through once
    same = by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag(F.struct("hash", "key", "tag", "start")).over(by_place)
    return (
        runs.withColumn("before", before).withColumn("mixed", F.min("hash").over(same) != F.max("hash").over(same))
        .withColumn("twice", F.coalesce(F.col("before.hash") == F.col("hash"), F.lit(False)))
        .withColumn("same_row", F.col("twice") & (F.col("before.key") == F.col("key")) & (F.col("before.tag") == F.col("tag")) & (F.col("before.start") == F.col("start")))
        .withColumn("whole", F.col("known") | F.col("twice")).where("not same_row and (whole or mixed or own)")
        .select("anchor", "key", "tag", "start", "windows", (~F.col("whole")).alias("open"))
    )


def _packed_texts(rows: DataFrame) -> DataFrame:
    """Texts compressed for a shuffle."""

    def work(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([squeeze.compress(t.encode()) for t in some.column(2).to_pylist()], pa.binary())],
                    names=["key", "tag", "body"],
                )

    return map_arrow(rows, work, "key bigint, tag bigint, body binary")


def _contexts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(anchor, key, tag, start, context) of the open runs."""
    wanted = found.where("open").groupBy("key", "tag").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("runs"))
    joined = _packed_texts(rows).join(wanted, ["key", "tag"])

    def work(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200).to_pylist()
                out: list[list] = [[], [], [], [], []]
                for row in some:
                    body = expand.decompress(row["body"]) if row["body"] else b""
                    for run in row["runs"]:
                        values = (run["anchor"], row["key"], row["tag"], run["start"], body[run["start"] : run["start"] + run["windows"] - 1 + LENGTH])
                        for column, value in zip(out, values):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["anchor", "key", "tag", "start", "context"],
                )

    return map_arrow(joined.select("key", "tag", "body", "runs"), work, "anchor bigint, key bigint, tag bigint, start bigint, context binary")


def _merged(contexts: DataFrame) -> DataFrame:
    """(key, tag, start, windows): repeated windows among the different contexts of each anchor."""

    def work(batches):
        held: list[dict] = []
        size = 0

        def solve(group):
            # by place, and only once where a row of the input stands twice
            group = sorted({(r["key"], r["tag"], r["start"]): r for r in group}.values(), key=lambda r: (r["key"], r["tag"], r["start"]))
            out: list[tuple[int, int, int, int]] = []
            for row, at in zip(group, repeated_windows([r["context"] for r in group])):
                if len(at):
                    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                        out.append((row["key"], row["tag"], row["start"] + int(run[0]), len(run)))
            columns = list(zip(*out)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "tag", "start", "windows"])

        for batch in batches:
            for row in batch.to_pylist():
                if size >= GROUP_BYTES and row["anchor"] != held[-1]["anchor"]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["context"])
        if held:
            yield solve(held)

    return map_arrow(contexts.repartition("anchor").sortWithinPartitions("anchor"), work, "key bigint, tag bigint, start bigint, windows int")


def _without(bodies: list[bytes], counts: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For each body, which has ``counts`` of the runs: removed bytes, removed spans and what is left."""
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies], dtype=np.int64)])
    owner = np.repeat(np.arange(len(bodies)), counts)
    start = offsets[owner] + start
    stop = start + windows - 1 + length
    order = np.argsort(start, kind="stable")  # the runs of a body stay with it, as all bodies stand in a row
    start, stop, owner = start[order], np.maximum.accumulate(stop[order]), owner[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] > stop[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    begin, end, owner = start[first], stop[np.append(first, len(stop))[1:] - 1], owner[first]
    change = np.zeros(offsets[-1] + 1, np.int8)
    change[begin] += 1
    change[end] -= 1
    keep = np.cumsum(change[:-1], dtype=np.int8) == 0
    kept = np.frombuffer(b"".join(bodies), np.uint8)[keep].tobytes()
    spans, removed = np.bincount(owner, minlength=len(bodies)), np.zeros(len(bodies), np.int64)
    np.add.at(removed, owner, end - begin)
    bounds = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).tolist()
    return removed, spans, [kept[i:j] for i, j in zip(bounds, bounds[1:])]


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` are the bytes that stay (they may start or end
    within a character)."""
    rows = _keyed(docs, text, key)
    found = stored(_found_runs(rows), "runs")
    merged = _merged(_contexts(rows, found))
    # runs that repeat as a whole overlap heavily: the same columns, whatever they come from
    every = found.where("not open").select("key", "tag", "start", "windows").unionByName(merged)
    # a run has at most RUN windows
    one = F.shiftleft("start", 11).bitwiseOR(F.col("windows").cast("bigint"))
    by_text = every.groupBy("key", "tag").agg(F.collect_list(one).alias("runs"))
    joined = _packed_texts(rows).join(by_text, ["key", "tag"], "left")

    def work(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                bodies = [expand.decompress(b) if b else b"" for b in some.column(1).to_pylist()]
                runs = some.column(2)
                packed = np.asarray(runs.flatten(), np.int64)
                removed, spans, kept = _without(bodies, np.asarray(runs.value_lengths().fill_null(0)), packed >> 11, packed & ((1 << 11) - 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0), pa.array([len(b) for b in bodies], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                        pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    ],
                    names=["key", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    out = map_arrow(joined.select("key", "body", "runs"), work, "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
    own = F.when(F.col("key") != _NO_KEY, F.col("key")).alias(key)
    return out.select(own, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
