"""Bitmaps of hashes, built by Spark and tested in numpy: they let more pass than they should, but never less."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap at most (16 MB).
MOST_BITS = 27


def make_filter(hashes: DataFrame, column: str = "fp") -> np.ndarray:
    """A bitmap of the hashes' low bits, 16 MB at most; Spark builds it, so no hash goes to the driver."""
    size = min(MOST_BITS, max(15, (64 * hashes.count()).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit((1 << size) - 1))
    rows = hashes.select(F.shiftright(slot, 15).alias("bucket"), slot.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
    out = np.zeros(1 << (size - 3), np.uint8)
    for row in rows.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).toLocalIterator():
        out[row["bucket"] << 12 : (row["bucket"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
