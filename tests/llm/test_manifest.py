"""The manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from leadlake.llm import manifest as mf

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(row, **changed):
    return sha("".join(written(changed.get(f, row[f])) for f in FIELDS))


def plain_tree(leaves, fanout):
    """The root, and for each leaf its siblings as (before, behind) of every level."""
    steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k - k % fanout
            steps[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + fanout])))
            at[i] = k // fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], steps


def plain_audit(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"], plain_leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in groups[s]], fanout) for s in names if groups[s].sort(key=lambda x: (x[:1], x[1] or 0, x[2])) is None}
    root, tops = plain_tree([trees[s][0] for s in names], fanout)
    out = []
    for s, top in zip(names, tops):
        subroot, proofs = trees[s]
        for (_, key, leaf, row), steps in zip(groups[s], proofs):
            now = leaf
            if key is not None and zlib.crc32(str(key).encode()) % 5 == 0 and row["text"] is not None:
                now = plain_leaf(row, text=row["text"].translate(LOWER))
            for before, behind in steps + top:
                now = sha(before + now + behind)
            out.append((key, leaf, subroot, root, sha("".join(a + b for a, b in steps + top)), now, now == root))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("fanout, stride", [(16, 2), (2, 2), (3, 1), (2, 3)])
def test_manifest_against_a_plain_tree(corpus, fanout, stride):
    rows = [r.asDict() for r in corpus.collect()]
    tamper = {"text": F.translate(F.col("text"), mf.UPPER, mf.LOWER)}
    out = mf.audit(corpus, tampered=tamper, where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, fanout=fanout, stride=stride)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect()]
    assert ordered(got) == ordered(plain_audit(rows, fanout))
    assert {r[6] for r in got} == {True, False}


def test_a_deep_tree_of_one_hot_source(spark):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.lit("Same").alias("text"))
    docs = docs.union(docs.where("doc_id < 3").withColumn("source", F.lit(None).cast("string"))).union(docs.where("doc_id = 5"))
    rows = [r.asDict() for r in docs.collect()]
    out = [tuple(r) for r in mf.tampered_audit(docs).drop("source").collect()]
    assert ordered(out) == ordered(plain_audit(rows, 16))


def test_manifest_edges(spark, nothing):
    assert mf.tampered_audit(nothing).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None, "x")], "doc_id bigint, text string, lang string, source string, n_chars int, place string")
    (row,) = mf.tampered_audit(one).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == sha("-----") and row.verified and row.proof_sha256 == sha("")
