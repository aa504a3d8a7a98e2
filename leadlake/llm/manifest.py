"""A Merkle manifest of a dataset, and proofs by checkpoint and recomputation. DataFrame operations only.

Every row is a leaf: the SHA-256 of its fields, each written with its length. In each group (source) the leaves ascend by
key, and runs of ``fanout`` consecutive nodes become their hash until one is left, the subroot; subroots in order of their
groups become the root in the same way. Only every ``stride``-th level is stored. A proof needs the levels between, too:
for each aligned subtree they are regenerated from its stored descendants, the siblings of every node are
emitted, and the regenerated nodes are not kept. So a subtree of ``fanout ** stride`` nodes is the largest group of any step,
however many rows a source has.

Places are counted without a sort in one task: rows are range-partitioned by (group, key), counted per partition, and a
row's place is its place in the partition behind the rows of the partitions before.

Defined results: null fields are written as ``-``; a null group is a group of its own, first in order; null keys come
first; rows with one key are in order of their leaf hash; equal rows are leaves each; an empty table gives no rows; columns
that are not among the fields are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.session import stored

FANOUT, STRIDE = 16, 2
#: Fields of a document's leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def written(field: Column) -> Column:
    """A field as its UTF-8 byte count, ``:`` and its value; ``-`` where it is null."""
    value = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    return digest(*map(written, fields))


@dataclass
class Manifest:
    """``levels[k]``: (tree, place, n, digest) of the nodes ``k * stride`` levels above the leaves, n the nodes of that
    level in the tree; the last level has one node a tree. ``leaves`` are those of level 0 with the columns they came with."""

    leaves: DataFrame
    levels: list[DataFrame]
    fanout: int = FANOUT
    stride: int = STRIDE

    @property
    def roots(self) -> DataFrame:
        return self.levels[-1].select("tree", "digest")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their place (from 0) in their tree, and n, the rows of the tree. ``order`` is a total order in a tree."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "tree", *order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "manifest-order")
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("own"))
    # a row for each partition that a tree reaches
    tree = Window.partitionBy("tree")
    before = F.sum("own").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("own").over(tree).alias("n"))
    nth = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    return dealt.withColumn("nth", nth).join(counts, ["tree", "part"]).withColumn("place", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def _runs(nodes: Column, fanout: int) -> Column:
    """One level up: the hash of every run of ``fanout`` nodes."""
    last = F.floor((F.size(nodes) - 1) / fanout).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), ""), 256))


def _subtrees(level: DataFrame, fanout: int, stride: int) -> DataFrame:
    """(tree, up, n, nodes, l0 .. l{stride}): aligned subtrees with their stored nodes, the digests of these (l0) and the
    levels above, regenerated. Levels above the root of a tree are the root again."""
    width = fanout**stride
    up = F.floor(F.col("place") / width).alias("up")
    own = [c for c in level.columns if c not in ("tree", "place", "n")]
    held = level.groupBy("tree", up, "n").agg(F.array_sort(F.collect_list(F.struct("place", *own))).alias("nodes"))
    held = held.withColumn("l0", F.col("nodes.digest"))
    for j in range(stride):
        more = F.col("n") > fanout**j
        held = held.withColumn(f"l{j + 1}", F.when(more, _runs(F.col(f"l{j}"), fanout)).otherwise(F.col(f"l{j}")))
    return held


def build_manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT, stride: int = STRIDE) -> Manifest:
    """The forest over ``leaves``: (tree string, digest string, ...), each tree in ``order``. Every ``stride``-th level is
    written to the shared folder."""
    leaves = stored(numbered(leaves, order), "manifest-leaves")
    levels = [leaves.select("tree", "place", "n", "digest")]
    most = leaves.agg(F.max("n")).first()[0] or 1
    while most > 1:
        raised = _subtrees(levels[-1], fanout, stride)
        n = F.ceil(F.col("n") / fanout**stride).cast("bigint")
        levels.append(stored(raised.select("tree", F.col("up").alias("place"), n.alias("n"), F.element_at(f"l{stride}", 1).alias("digest")), "manifest-level"))
        most = -(-most // fanout**stride)
    return Manifest(leaves, levels, fanout, stride)


STEPS = "array<struct<before: string, after: string>>"


def _descend(level: DataFrame, paths: DataFrame, fanout: int, stride: int) -> DataFrame:
    """(tree, place, steps, ...): the steps from each node of a level to the root, by those of the nodes ``stride`` levels above,
    with the other columns of the node and of ``paths``. A step holds the siblings of a run, joined: those before the
    node and those behind it."""
    blocks = _subtrees(level, fanout, stride).join(paths.withColumnRenamed("place", "up"), ["tree", "up"])
    carried = [c for c in paths.columns if c not in ("tree", "place", "steps")]
    kept = [f"l{j}" for j in range(stride)]
    nodes = blocks.select("tree", "up", "n", "steps", *carried, *kept, F.posexplode("nodes").alias("i", "node"))
    own = []
    for j in range(stride):
        at = F.floor(F.col("i") / fanout**j).cast("int")
        run = at - F.pmod(at, F.lit(fanout))
        before = F.array_join(F.slice(F.col(f"l{j}"), run + 1, at - run), "")
        after = F.array_join(F.slice(F.col(f"l{j}"), at + 2, run + (fanout - 1) - at), "")
        step = F.array(F.struct(before.alias("before"), after.alias("after")))
        own.append(F.when(F.col("n") > fanout**j, step).otherwise(F.array().cast(STEPS)))
    return nodes.select("tree", "node.*", F.concat(*own, F.col("steps")).alias("steps"), *carried)


def proofs(manifest: Manifest, paths: DataFrame | None = None) -> DataFrame:
    """The leaves, each with its steps up to the root of its tree, or further by ``paths``: (tree, steps, ...) of the trees'
    roots, whose other columns are handed down."""
    if paths is None:
        paths = manifest.roots.select("tree", F.array().cast(STEPS).alias("steps"))
    paths = paths.withColumn("place", F.lit(0).cast("bigint"))
    for level in manifest.levels[-2:0:-1]:
        paths = stored(_descend(level, paths, manifest.fanout, manifest.stride).drop("digest"), "manifest-paths")
    return _descend(manifest.leaves, paths, manifest.fanout, manifest.stride)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda now, s: F.sha2(F.concat(s["before"], now, s["after"]), 256))


def siblings(steps: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def audit(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", source: str = "source",
    tampered: dict[str, Column] | None = None, where: Column | None = None, fanout: int = FANOUT, stride: int = STRIDE,
) -> DataFrame:
    """(key, source, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: its proof in the manifest of ``docs``, and the
    root that the proof gives for the row as it is, or as ``tampered`` (new values by field) where ``where`` holds."""
    now = [(tampered or {}).get(f, F.col(f)) for f in fields]
    changed = F.when(where, leaf_of(*now)) if where is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))  # null first, then by bytes
    leaves = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), tree.alias("tree"), leaf_of(*map(F.col, fields)).alias("digest"),
        changed.alias("changed"), F.monotonically_increasing_id().alias("nth_read"),
    )
    # numbers of equal rows must not change when a task is run again, so they are written first
    manifest = build_manifest(stored(leaves, "manifest-rows"), ["key", "digest", "nth_read"], fanout, stride)
    subroots = manifest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    top = build_manifest(subroots, ["group"], fanout, stride)
    of_source = proofs(top).join(top.roots.withColumnRenamed("digest", "root"), "tree")
    of_source = of_source.select(F.col("group").alias("tree"), "steps", F.col("digest").alias("subroot"), "root")
    found = proofs(manifest, of_source)
    end = folded(F.coalesce("changed", "digest"), F.col("steps"))
    return found.select(
        F.col("key").alias(key), F.col("source").alias(source), F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), end.alias("folded_root"), (end == F.col("root")).alias("verified"),
    )


def tampered_audit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """:func:`audit` where every fifth key (by CRC-32 of its digits) has its text lower-cased."""
    hit = F.crc32(F.col(key).cast("string")) % 5 == 0
    return audit(docs, key=key, tampered={text: F.translate(F.col(text), UPPER, LOWER)}, where=hit)
