"""What near copies send: bands packed by range, parities as wide as a text needs, shingles of pairs that these leave."""

import random

import numpy as np
from pyspark.sql import functions as F

from leadlake.llm import simhash as sh
from leadlake.llm.components import connected_components


def test_ranges_of_a_band_connect_all_within_two_bits(spark):
    rng = random.Random(21)
    values = [rng.getrandbits(12) for _ in range(60)] + [7, 7, 7 | 3 << 10, 7 | 1 << 11 | 1]  # also two of the upper bits apart
    prints = spark.createDataFrame([(i, v.to_bytes(8, "little")) for i, v in enumerate(values)], "tid bigint, wide binary")
    pairs = sh._band_pairs(prints, len(values), 12, 1, 0.8)
    near = {(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2}
    links = {(r.tid, r.low) for r in pairs.collect()}
    assert all((values[i] ^ values[j]).bit_count() <= 2 and i > j for i, j in links)
    root = {r.node: r.root for r in connected_components(pairs.select(F.col("tid").alias("u"), F.col("low").alias("v"))).collect()}
    assert len(near) > 20 and all(root.get(i, i) == root.get(j, j) for i, j in near)
    # a row for each range of a batch, not one for each value around a band
    batches = prints.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tid").select(F.spark_partition_id()).distinct().count()
    assert sh._band_ranges(prints, 12, 1, 3).count() <= 8 * batches
    assert sh._band_pairs(prints.where("false"), 0, 12, 1, 0.8).count() == 0


def test_chance_meetings_are_told_by_what_stands_behind_the_band():
    tid, twice = np.array([3, 5, 9]), np.array([11, 11, 11], np.uint64)
    found = sh.meet_in_range(tid, twice, np.array([0, 1, (1 << 64) - 1], np.uint64), 9, 21)
    assert [x.tolist() for x in found] == [[5], [3]]


def test_parities_tell_long_texts_apart():
    rng = np.random.default_rng(22)
    share = (1 - 0.8) / (1 + 0.8)
    for n in (1, 50, 1000, 5000, 40000):
        a, b = (np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1 & n)) for _ in range(2))
        if n >= 50:
            assert sh._lacking([sh._parity(a)], [sh._parity(b)])[0] > share * 2 * n
        # similar ones are never told apart, whatever their widths
        for keep in (0.81, 0.9, 1.0):
            c = np.sort(rng.permutation(a)[: max(1, round(keep * n))])
            assert sh._lacking([sh._parity(c), sh._parity(a)], [sh._parity(a), sh._parity(c)]).max() <= len(a) - len(c)
    none = np.zeros(0, np.uint64)
    assert sh._lacking([sh._parity(none)], [sh._parity(none)])[0] == 0


def test_texts_of_all_lengths_are_compared_exactly(spark):
    rng = random.Random(23)
    texts = []
    for size in (3, 40, 900, 1300, 5000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for changes in (0, max(1, size // 200), max(1, size // 70), size // 10):
            copy = list(base)
            for k in rng.sample(range(size), changes):
                copy[k] = "changed"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "tid bigint, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    want = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    found = sh._alike(docs, spark.createDataFrame(pairs, "tid bigint, low bigint"), 5, 0.8)
    assert {(r.u, r.v) for r in found.collect()} == want and len(want) >= 6
