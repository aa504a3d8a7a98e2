"""Exact top-k search by inner product, with an impact-ordered, score-at-a-time index.

Vectors are packed into blocks. In a block each component has a posting list that is cut into segments of one quantised
impact. A query processes the segments of all components in descending impact on its score, so that after any segment
the impact of what is still to come is known for each component. As soon as that rest cannot lift any other vector to the
k-th best certain score, the search of the block stops; the vectors that may be members are scored again exactly.

Queries and vectors meet block by block: a block of queries is read with every block of vectors, and each pair of
blocks returns only its best rows, which a window merges by query.

Defined results: vectors that are null, or hold null or non-finite components, take no part; a query is compared with
vectors of its own length only; its own row (by id) is no candidate; ties go to the smaller id; repeated rows are
candidates each, but one query (equal id and vector); unequal vectors of one id are queries each, ranked on their own, and
none of them is a candidate of the others; fewer than k candidates give fewer rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm.ship import map_arrow
from leadlake.session import stored

LEVELS = 6


class ImpactIndex:
    """Posting segments of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        low, high = vectors.min(0), vectors.max(0)
        self.width = np.maximum(1, -(-(high - low + 1) // LEVELS))
        level = (vectors - low) // self.width
        self.segments: list[tuple[int, np.ndarray]] = []  # component, members
        least, most = [], []
        for d in range(vectors.shape[1]):
            order = np.argsort(level[:, d], kind="stable").astype(np.int32)
            cuts = np.searchsorted(level[order, d], np.arange(level[:, d].max() + 2))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    self.segments.append((d, order[a:b]))
                    own = vectors[order[a:b], d]
                    least.append(own.min())
                    most.append(own.max())
        self.component = np.array([d for d, _ in self.segments])
        self.least, self.most = np.array(least, np.int64), np.array(most, np.int64)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best (score descending, id ascending), without the query's own row."""
        q = query[self.component]
        certain = np.where(q >= 0, self.least, self.most) * q  # the segment's members get this at least
        possible = np.where(q >= 0, self.most, self.least) * q
        floor = np.full(len(query), np.iinfo(np.int64).max)
        np.minimum.at(floor, self.component, certain)
        certain = certain - floor[self.component]  # impact above the least that the component can give
        possible = possible - floor[self.component]
        order = np.argsort(-possible, kind="stable")
        n = len(self.ids)
        score = np.zeros(n, np.int64)  # certain impact so far; what it misses is in slack
        spread = np.zeros(len(query), np.int64)
        np.maximum.at(spread, self.component, possible - certain)
        slack = int(spread.sum())
        # the impact still to come of each component: that of its next segment
        ahead = _after(self.component, order, possible, len(query))
        members = np.ones(n, bool)
        members[self.ids == own] = False
        keep = min(k, int(members.sum()))
        if not keep:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        looks = {int(x) for x in np.linspace(len(order) // 2, len(order) - 1, 7)}
        for i, s in enumerate(order):
            if certain[s]:
                score[self.segments[s][1]] += certain[s]
            rest = ahead[i]
            if i in looks or rest == 0:
                own_scores = score[members]
                kth = np.partition(own_scores, len(own_scores) - keep)[len(own_scores) - keep]
                may = members & (score + rest + slack >= kth)
                if rest == 0 or may.sum() <= 4 * keep:
                    break
        else:
            may = members
        at = np.flatnonzero(may)
        exact = self.vectors[at] @ query
        best = np.lexsort((self.ids[at], -exact))[:keep]
        return self.ids[at][best], exact[best]


def _after(component: np.ndarray, order: np.ndarray, possible: np.ndarray, dims: int) -> np.ndarray:
    """Sum over components of the greatest impact among segments not yet processed, after each step."""
    sorted_component, impact = component[order], possible[order]
    # the next segment of the same component in processing order
    by = np.lexsort((np.arange(len(order)), sorted_component))
    following = np.zeros(len(order), np.int64)
    same = sorted_component[by][1:] == sorted_component[by][:-1]
    following[by[:-1][same]] = impact[by[1:][same]]
    first = np.zeros(dims, np.int64)
    np.maximum.at(first, sorted_component, impact)
    return first.sum() - np.cumsum(impact - following)


def integer_vectors(rows: DataFrame, vector: str, key: str, scale: int) -> DataFrame:
    """(id, vec) with components floor(scale * x), of the vectors that are whole and finite."""
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.col(key).isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    )
    return rows.where(fine).select(F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vec"))


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows of one length packed into blocks as they are read: (part, nth, dim, ids, vecs)."""

    def work(batches):
        waiting: dict[int, list] = {}
        part, nth = None, 0

        def block(dim):
            nonlocal nth
            parts = waiting.pop(dim)
            ids = np.concatenate([a for a, _ in parts])
            vecs = np.concatenate([b for _, b in parts])
            for i in range(0, len(ids), most):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([dim], pa.int32()),
                     pa.array([ids[i : i + most].tobytes()], pa.binary()), pa.array([vecs[i : i + most].tobytes()], pa.binary())],
                    names=["part", "nth", "dim", "ids", "vecs"],
                )
                nth += 1

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            ids = np.asarray(batch.column(0), np.int64)
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths())
            values = np.asarray(lists.flatten(), np.int64)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                waiting.setdefault(dim, []).append((ids[rows], values[starts[rows][:, None] + np.arange(dim)]))
                if sum(len(a) for a, _ in waiting[dim]) >= most:
                    yield from block(dim)
        for dim in sorted(waiting):
            yield from block(dim)

    return map_arrow(rows.withColumn("part", F.spark_partition_id()), work, "part int, nth int, dim int, ids binary, vecs binary")


def top_k(
    vectors: DataFrame, is_query: Column, vector: str = "embedding", key: str = "vec_id", k: int = 10, scale: int = 1024,
    block_rows: int = 4096, query_rows: int = 128,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row that ``is_query`` holds for."""
    blocks = stored(packed(integer_vectors(vectors, vector, key, scale), block_rows), "blocks")
    queries = stored(packed(integer_vectors(vectors.where(is_query), vector, key, scale).distinct(), query_rows), "queries")
    # every block of queries goes to every shard of blocks; a shard is a few blocks, read one after another
    shards = max(1, blocks.count() // 2)
    held = blocks.select(F.pmod(F.xxhash64("part", "nth"), F.lit(shards)).alias("shard"), "dim", "part", "nth", "ids", "vecs")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), "dim", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    pairs = held.join(asked, ["shard", "dim"])

    def work(batches):
        kept, index = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if kept != (row["part"], row["nth"]):
                    kept = (row["part"], row["nth"])
                    index = ImpactIndex(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"], np.int64).reshape(-1, row["dim"]))
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                q_vecs = np.frombuffer(row["q_vecs"], np.int64).reshape(-1, row["dim"])
                out = [index.search(v, own, k) for own, v in zip(q_ids, q_vecs)]
                sizes = [len(a) for a, _ in out]
                name = np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in q_vecs], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids, sizes)), pa.array(np.repeat(name, sizes)),
                        pa.array(np.concatenate([a for a, _ in out])), pa.array(np.concatenate([b for _, b in out])),
                    ],
                    names=["query_id", "query", "vec_id", "score"],
                )

    found = map_arrow(pairs.select("part", "nth", "dim", "ids", "vecs", "q_ids", "q_vecs"), work, "query_id bigint, query bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
