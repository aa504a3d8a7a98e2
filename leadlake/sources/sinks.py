"""Writers. Each takes the table to write and where; all are plain Spark file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.functions.common import any_of
from leadlake.session import spread


def write_postings(postings: DataFrame, path: str, buckets: int = 256, mode: str = "overwrite", splits: int = 4) -> None:
    """Postings laid out by token bucket and sorted by token, so that a token lookup reads one folder
    and few row groups. A frequent token is spread over ``splits`` tasks and files by its lead id; raise both numbers with
    the table.
    """
    parted = postings.withColumn("token_bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    (
        spread(parted.withColumn("_part", F.pmod(F.xxhash64("lead_id"), F.lit(splits))), "token_bucket", "_part")
        .drop("_part")
        .sortWithinPartitions("token_bucket", "token", "lead_id")
        .write.mode(mode)
        .partitionBy("token_bucket")
        .parquet(path)
    )


def read_postings(spark: SparkSession, path: str, tokens: list[str], buckets: int = 256) -> DataFrame:
    """The postings of some tokens; the bucket conditions fold to constants and prune folders."""
    in_bucket = any_of(
        F.col("token_bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in tokens
    )
    return spark.read.parquet(path).filter(in_bucket & F.col("token").isin(tokens)).drop("token_bucket")


def write_posting_blocks(blocks: DataFrame, path: str, buckets: int = 256, mode: str = "overwrite") -> None:
    """Posting blocks laid out by token bucket, sorted by token and first id; :func:`read_postings` reads the blocks of some tokens."""
    bucketed = blocks.withColumn("token_bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    spread = bucketed.repartition("token_bucket", F.pmod("chunk", F.lit(4))).sortWithinPartitions("token_bucket", "token", "first")
    spread.write.mode(mode).partitionBy("token_bucket").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append events, one folder per day so that "since T" scans prune folders."""
    (
        events.withColumn("event_date", F.to_date("created_at"))
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )
