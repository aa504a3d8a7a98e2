"""An inverted index that follows a stream of changed leads: new, updated and removed ones.

Each micro-batch appends what its leads now say, as postings, and a mark for each lead it changed; nothing that was written before is
touched, and a batch that is run again replaces its own folders. A reader keeps the postings of a lead's newest batch
only. Compaction folds batches into a base that is partitioned by lead, and replaces only the partitions that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadlake.operators.changes import DELETE, latest_change
from leadlake.operators.index import build_postings
from leadlake.session import path_exists, spread, stored

#: Partitions of the compacted base.
BUCKETS = 64


def keep_index(changes: DataFrame, path: str, checkpoint: str, order: str = "seq", once: bool = False) -> StreamingQuery:
    """Follow ``changes``: lead rows as they are after each change, with ``op`` (a delete needs no more than the id) and an order
    within a micro-batch; of several changes of a lead the last counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # rows are few bytes and postings much work: dealt over all tasks, and held for both tables
        last = latest_change(spread(batch, "id"), "id", order).persist()
        marks = last.select(F.col("id").alias("lead_id"), (F.col("op") == DELETE).alias("removed"))
        marks.write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
        build_postings(last.filter(F.col("op") != DELETE)).write.mode("overwrite").parquet(f"{path}/postings/batch={batch_id}")
        last.unpersist()

    writer = changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _folded_to(spark: SparkSession, path: str) -> int:
    """The last batch that the base holds."""
    if not path_exists(spark, f"{path}/folded"):
        return -1
    return spark.read.parquet(f"{path}/folded").agg(F.max("batch")).first()[0]


def _since(spark: SparkSession, path: str, folded: int) -> tuple[DataFrame, DataFrame]:
    """(lead_id) of leads changed after a batch, and (token, lead_id) of what they say now."""
    marks = spark.read.parquet(f"{path}/marks").filter(F.col("batch") > folded)
    newest = marks.groupBy("lead_id").agg(F.max(F.struct("batch", "removed")).alias("m"))
    live = newest.filter(~F.col("m.removed")).select("lead_id", F.col("m.batch").alias("batch"))
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("batch") > folded)
    return newest.select("lead_id"), postings.join(live, ["lead_id", "batch"]).select("token", "lead_id")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(token, lead_id) after all batches so far."""
    folded = _folded_to(spark, path)
    changed, fresh = _since(spark, path, folded)
    if folded < 0:
        return fresh
    base = spark.read.parquet(f"{path}/base").filter(F.col("token").isNotNull()).select("token", "lead_id")
    return base.join(changed, "lead_id", "left_anti").select("token", "lead_id").unionByName(fresh)


def compact_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> int:
    """Fold all batches so far into the base; returns the last of them. Only partitions with changed leads are written. The mark
    of the fold comes last, so a compaction that is cut off is simply run again."""
    folded = _folded_to(spark, path)
    last = spark.read.parquet(f"{path}/marks").agg(F.max("batch")).first()[0]
    if last is None or last <= folded:
        return folded
    bucket = F.pmod(F.xxhash64("lead_id"), F.lit(buckets)).cast("int").alias("bucket")
    changed, fresh = _since(spark, path, folded)
    rows = fresh.select("token", "lead_id", bucket)
    if folded >= 0:
        # a partition that loses its last lead must be written, too: it keeps a row that no search finds
        touched = changed.select(bucket).distinct()
        kept = spark.read.parquet(f"{path}/base").select("token", "lead_id", "bucket").join(touched, "bucket", "left_semi").join(changed, "lead_id", "left_anti")
        empty = touched.select(F.lit(None).cast("string").alias("token"), F.lit(None).cast("bigint").alias("lead_id"), "bucket")
        rows = rows.unionByName(kept.filter(F.col("token").isNotNull()).select("token", "lead_id", "bucket")).unionByName(empty)
    merged = rows if folded < 0 else stored(rows, "folded-postings")  # read before its source is replaced
    # a bucket is split by lead over several tasks; four pieces to a task, so that chance does not give one task much more
    splits = -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    dealt = spread(merged.withColumn("_part", F.pmod(F.hash("lead_id"), F.lit(splits))), "bucket", "_part").drop("_part")
    dealt.sortWithinPartitions("bucket", "token", "lead_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/base")
    spark.createDataFrame([(last,)], "batch int").write.mode("append").parquet(f"{path}/folded")
    return last
