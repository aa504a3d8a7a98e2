"""An index that follows changes, and posting blocks, against rebuilt ones."""

import random

import pytest
from pyspark.sql import functions as F

from leadlake.operators import index as ix
from leadlake.session import work_folder
from leadlake.sources.sinks import read_postings, write_posting_blocks
from leadlake.streaming import upkeep as up


@pytest.mark.parametrize("fold", [False, True])
def test_index_follows_changes(spark, sample, sample_rows, fold):
    rng = random.Random(4)
    folder = work_folder(spark, "upkeep")
    schema = sample.withColumn("op", F.lit("")).withColumn("seq", F.lit(1)).schema
    now = {}
    for step in range(4):
        rows = []
        for seq in range(12):
            row = dict(rng.choice(sample_rows), seq=step * 100 + seq, id=rng.randrange(12))
            op = "delete" if rng.random() < 0.3 else "update" if row["id"] in now else "create"
            if op == "delete":
                row = {k: v if k in ("id", "seq") else None for k, v in row.items()}
                now.pop(row["id"], None)
            else:
                row["company"] = f"{row['company']} v{step}x{seq}"
                now[row["id"]] = row
            rows.append((*[row[f.name] for f in schema.fields if f.name not in ("op", "seq")], op, row["seq"]))
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        for _ in range(2):  # the second run finds nothing new
            up.keep_index(stream, f"{folder}/index", f"{folder}/checkpoint", once=True).awaitTermination()
        if fold and step != 2:
            assert up.compact_index(spark, f"{folder}/index", 3) >= 0
        got = sorted(map(tuple, up.read_index(spark, f"{folder}/index").collect()))
        leads = [tuple(r[f.name] for f in sample.schema.fields) for r in now.values()]
        assert got == sorted(map(tuple, ix.build_postings(spark.createDataFrame(leads, sample.schema)).collect()))
    if fold:
        last = up.compact_index(spark, f"{folder}/index", 3)
        assert up.compact_index(spark, f"{folder}/index", 3) == last


def test_blocks_intersect_like_lists(spark, tmp_path):
    rng = random.Random(6)
    rows = [(t, i) for t, share in (("hot", 0.9), ("warm", 0.3), ("rare", 0.01), ("range", 0)) for i in range(-300, 5000) if rng.random() < share]
    rows += [("range", i) for i in range(2000, 2100)] + [("hot", 7), ("hot", 7)]
    postings = spark.createDataFrame(rows, "token string, lead_id long")
    blocks = ix.posting_blocks(postings, 128)
    write_posting_blocks(blocks, str(tmp_path / "b"), buckets=4)
    assert blocks.agg(F.max("n")).first()[0] <= 128 and dict(blocks.dtypes)["gaps"] == "array<smallint>"
    for tokens in (["hot"], ["hot", "warm"], ["rare", "hot", "warm"], ["range", "rare"], ["hot", "none"], ["hot", "hot"]):
        want = set.intersection(*({i for t, i in rows if t == x} for x in tokens))
        got = [r.lead_id for r in ix.intersect_blocks(read_postings(spark, str(tmp_path / "b"), tokens, buckets=4), tokens).collect()]
        assert sorted(got) == sorted(want), tokens
    assert ix.intersect_blocks(blocks.limit(0), ["hot"]).count() == 0
