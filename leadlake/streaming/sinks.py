"""Starting streaming queries. Every query has a checkpoint, so a lost executor or driver resumes it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leadlake.operators.events import lead_counters
from leadlake.session import work_folder

#: A time after all events, at which a bounded replay is closed.
CLOSING_TIME = datetime(9000, 1, 1)


def append_to(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append finished rows to Parquet files, exactly once."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def drain(df: DataFrame, spark: SparkSession, purpose: str) -> DataFrame:
    """Run a stream over everything that is available, then read its output back as a table."""
    folder = work_folder(spark, purpose)
    append_to(df, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _closing_marker(spark: SparkSession, schema: T.StructType, column: str, at: datetime) -> DataFrame:
    """One row that no filter on null or blank values drops, with the time ``at``."""

    def value(field: T.StructField):
        if field.name == column:
            return at
        if isinstance(field.dataType, T.StringType):
            return "closing marker"
        return -1 if isinstance(field.dataType, T.IntegralType) else None

    return spark.createDataFrame([tuple(value(f) for f in schema)], schema)


def replay(spark: SparkSession, purpose: str, build: Callable[..., DataFrame], *streams: DataFrame, column: str = "created_at") -> DataFrame:
    """Run ``build`` over bounded streams to their very end, and read its output back as a table.

    When all events have been read, the query goes on from its checkpoint with one marker per stream, whose late time moves
    the watermark past every event; so windows, sessions and searches that were still open come out too. What the
    markers themselves open stays open. Markers of several streams lie days apart, so they never meet in a join.
    """
    folder = work_folder(spark, purpose)
    schemas = [T.StructType([T.StructField(f.name, f.dataType) for f in s.schema]) for s in streams]
    ends = []
    for i, (stream, schema) in enumerate(zip(streams, schemas)):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/end-{i}")
        ends.append(stream.unionByName(spark.readStream.schema(schema).parquet(f"{folder}/end-{i}")))
    live = build(*ends)
    append_to(live, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    for i, schema in enumerate(schemas):
        marker = _closing_marker(spark, schema, column, CLOSING_TIME - timedelta(days=i))
        marker.write.mode("append").parquet(f"{folder}/end-{i}")
    append_to(live, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(live.schema).parquet(f"{folder}/out")


def keep_top_queries(counts: DataFrame, path: str, checkpoint: str, limit: int = 10, once: bool = False) -> StreamingQuery:
    """Keep the current top texts of the newest window, one small table per micro-batch; see :func:`read_top_queries`.

    Counts of a window only rise. So the top texts are among the former top and the texts counted since, and the stream
    keeps state for open windows only. A repeated batch replaces its own table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id:
            former = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={batch_id - 1}")
            rows = batch.unionByName(former.join(batch, ["window_start", "query"], "left_anti"))
        newest = rows.agg(F.max("window_start").alias("window_start"))
        top = rows.join(newest, "window_start", "left_semi").orderBy(F.col("count").desc(), F.col("query").desc()).limit(limit)
        top.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_top_queries(spark: SparkSession, path: str) -> DataFrame:
    """The top texts after the newest micro-batch."""
    tables = spark.read.parquet(path)
    return tables.join(tables.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")


def append_events_once(events: DataFrame, path: str, checkpoint: str, column: str = "created_at", once: bool = False) -> StreamingQuery:
    """Append arriving events, one folder per micro-batch and day. A batch that is run again replaces its own folders, so the
    table holds each event once, whenever the driver or an executor is lost."""

    def write(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("event_date", F.to_date(column))
        dated.write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/batch={batch_id}")

    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def collect_lead_counters(interactions: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Counters per lead and micro-batch. A repeated batch replaces its own folder, so no event counts twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        lead_counters(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = interactions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_lead_counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters of all batches so far, in the form of :func:`lead_counters`."""
    return spark.read.parquet(path).groupBy("lead_id").agg(
        F.sum("views").alias("views"),
        F.sum("contacts").alias("contacts"),
        F.max("contacted_at").alias("contacted_at"),
        F.sum("conversions").alias("conversions"),
    )
