"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. At each level runs of one symbol become a single symbol; deterministic coin tossing then gives
each symbol a small label that depends on a few neighbours only; symbols whose label is a local maximum begin phrases, and
each phrase is named by a hash of its symbols. Equal substrings so get equal phrases away from their borders, at
whatever offset they stand. The fingerprint keeps, for each of a fixed number of slots, the smallest name of the upper
levels (one-permutation min-hashing), so the share of equal slots estimates the share of common phrases.

Defined results: a null text counts as an empty one; the fingerprint of an empty text has only empty slots, and is
fully like that of another empty text and unlike any other; equal texts have equal fingerprints; repeated rows are
answered one by one, documents with the same id follow each other in the order of their texts; an empty table gives an
empty table; the only document of a table is its own successor; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.ship import map_arrow
from leadlake.llm.textbytes import flat, mix, slices
from leadlake.session import stored

LEVELS, SKETCH_FROM, SLOT_BITS = 6, 3, 6
SLOTS, HEX = 1 << SLOT_BITS, 4
EMPTY = "-" * HEX


def _coin_table(size: int) -> np.ndarray:
    """Label of symbol x beside a different symbol y: the place of their lowest differing bit, and x's bit there."""
    x, y = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    low = (x ^ y) & -(x ^ y)
    place = np.where(low > 0, np.bitwise_count(np.maximum(low, 1) - 1), 0)
    return (2 * place + ((x >> place) & 1)).astype(np.uint8).reshape(-1)


_COINS8, _COINS7, _COINS4 = _coin_table(256), _coin_table(128), _coin_table(16)
_ONE = np.uint64(1)


def _runs(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where runs of one symbol begin; ``first`` marks the starts of texts."""
    begin = first.copy()
    begin[1:] |= symbols[1:] != symbols[:-1]
    return begin


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, different for neighbours within a text (but for text starts), from a few left neighbours each."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[0] = 0
    if symbols.dtype == np.uint8:
        label = _COINS8[(symbols.astype(np.uint16) << 8) | before]
    else:
        differ = symbols ^ before
        place = np.bitwise_count((differ & (~differ + _ONE)) - _ONE).astype(np.uint64) & np.uint64(63)
        label = ((place << _ONE) | ((symbols >> place) & _ONE)).astype(np.uint8)
        label[first] = 0
        before7 = np.empty_like(label)
        before7[1:], before7[0] = label[:-1], 0
        label = _COINS7[(label.astype(np.uint16) << 7) | before7]
    label[first] = 0
    for _ in range(2):
        before4 = np.empty_like(label)
        before4[1:], before4[0] = label[:-1], 0
        label = _COINS4[(label << 4) | before4]
        label[first] = 0
    return label


def _phrases(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin: at local maxima of the labels, and at text starts."""
    label = _labels(symbols, first)
    begin = first.copy()
    if len(label) > 2:
        begin[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~first[1:-1] & ~first[:-2] & ~first[2:]
    return begin


def _names(symbols: np.ndarray, length: np.ndarray, begin: np.ndarray, level: int) -> np.ndarray:
    """Hash of the symbols of each phrase and of how often each is repeated, in order."""
    starts = np.flatnonzero(begin)
    nth = np.arange(len(symbols), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(symbols)))).astype(np.uint64)
    place = nth * np.uint64(0xD6E8FEB86659FD93) + (length << np.uint64(8)) + np.uint64(level)
    spread = mix(symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place)
    return mix(np.add.reduceat(spread, starts))


def sketches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The slots of each text (rows), 65536 where a slot is empty."""
    n = len(offsets) - 1
    out = np.full(n * SLOTS, 1 << 16, np.int64)
    symbols: np.ndarray = data
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    for level in range(1, LEVELS + 1):
        if not len(symbols):
            break  # only empty texts
        first = np.ones(len(symbols), bool)
        first[1:] = owner[1:] != owner[:-1]
        starts = np.flatnonzero(_runs(symbols, first))
        length = np.diff(np.append(starts, len(symbols))).astype(np.uint64)
        symbols, owner, first = symbols[starts], owner[starts], first[starts]
        begin = _phrases(symbols, first)
        symbols, owner = _names(symbols, length, begin, level), owner[begin]
        if level >= SKETCH_FROM:
            slot = owner.astype(np.int64) * SLOTS + (symbols >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            np.minimum.at(out, slot, ((symbols >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64))
    return out.reshape(n, SLOTS)


def to_text(rows: np.ndarray) -> list[str]:
    table = np.array([f"{i:0{HEX}x}" for i in range(1 << 16)] + [EMPTY], f"U{HEX}")
    return ["".join(r) for r in table[rows]]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either fingerprint fills; 1 for two empty ones."""
    filled = (a < 1 << 16) | (b < 1 << 16)
    total = filled.sum(1)
    return np.where(total > 0, ((a == b) & filled).sum(1) / np.maximum(total, 1), 1.0)


def fingerprint_texts(texts: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    parts = [sketches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, 1 << 20)]
    return np.concatenate(parts) if parts else np.zeros((0, SLOTS), np.int64)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            parts = [sketches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, 1 << 20)]
            rows = np.concatenate(parts) if parts else np.zeros((0, SLOTS), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to_text(rows), pa.string())], names=["key", "fingerprint"])

    found = map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), work, f"key {kind}, fingerprint string")
    return found.withColumnRenamed("key", key)


def _answers(keys: list, texts: list[str], key_type: pa.DataType) -> pa.RecordBatch:
    """Rows for all texts but the last, each with the next as its successor."""
    own = [t.encode() for t in texts]
    mixed = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
    prints, others = fingerprint_texts(own), fingerprint_texts(mixed)
    n = len(mixed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys[:n], key_type),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in mixed], pa.string()),
            pa.array(to_text(prints[:n]), pa.string()),
            pa.array(to_text(others), pa.string()),
            pa.array(likeness(prints[:n], others), pa.float64()),
            pa.array(likeness(prints[:n], prints[1:]), pa.float64()),
        ],
        names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def edit_sensitivity(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """How the fingerprint of each document reacts when its second half is replaced by the start of the next one (in
    descending order of the key; the first follows the last).

    The texts are range-partitioned by key once. Inside a partition the next row is the next document; only the first
    and last text of each partition are set aside, written, and joined by partition number.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = rows.repartitionByRange(F.desc("key")).sortWithinPartitions(F.desc("key"), "text").withColumn("part", F.spark_partition_id())
    columns = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def work(batches):
        held_keys: list = []
        held: list[str] = []
        part = first = key_type = None

        def edge(role: str, k, t: str):
            row = _answers([k, k], [t, ""], key_type).slice(0, 1)
            return pa.RecordBatch.from_arrays([*row.columns, pa.array([part], pa.int32()), pa.array([role]), pa.array([t])], names=[*row.schema.names, "part", "role", "text"])

        def done():
            row = _answers(held_keys, held, key_type)
            n = row.num_rows
            return pa.RecordBatch.from_arrays([*row.columns, pa.array([part] * n, pa.int32()), pa.array(["row"] * n, pa.string()), pa.nulls(n, pa.string())], names=[*row.schema.names, "part", "role", "text"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key_type = batch.column(0).type
            part = batch.column(2)[0].as_py()
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if first is None:
                first = (keys[0], texts[0])
                yield edge("head", *first)
            for i in range(0, len(keys), 500):  # a few hundred texts at a time
                held_keys += keys[i : i + 500]
                held += texts[i : i + 500]
                if len(held) > 1:
                    yield done()
                held_keys, held = held_keys[-1:], held[-1:]
        if held:
            yield edge("tail", held_keys[0], held[0])

    schema = f"key {kind}, {columns}, part int, role string, text string"
    found = stored(map_arrow(placed, work, schema), "fingerprints")
    # one head and one tail per partition that has rows: a small table whatever the texts are
    heads = found.where("role = 'head'").select(F.col("part").alias("head_part"), F.col("text").alias("next_text"))
    parts = sorted(r["part"] for r in found.where("role = 'head'").select("part").collect())
    if not parts:
        return found.select("key", *found.columns[1:7]).withColumnRenamed("key", key)
    follower = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, head_part int")
    ends = found.where("role = 'tail'").select("part", "key", "text").join(follower, "part").join(heads, "head_part").select("key", "text", "next_text")

    def close(batches):
        for batch in batches:
            for k, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                yield _answers([k, k], [a, b], batch.column(0).type)

    closed = map_arrow(ends, close, f"key {kind}, {columns}")
    return found.where("role = 'row'").select("key", *found.columns[1:7]).unionByName(closed).withColumnRenamed("key", key)
