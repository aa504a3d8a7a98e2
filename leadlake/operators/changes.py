"""Change sets on keyed tables (leads, preferences): create, partial update, delete."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.operators.metrics import timestamp

CREATE, UPDATE, DELETE = "create", "update", "delete"


def apply_changes(
    base: DataFrame, changes: DataFrame, key: str, as_of: datetime, stamp: str | None = "updated_at"
) -> DataFrame:
    """The table after one change per key.

    ``changes`` has the key, a column ``op`` and any of the table's columns; unknown columns are
    ignored and null means "not given". A create keeps an existing row, an update or delete of a
    missing key does nothing. Both sides must hold each key once.
    """
    given = [c for c in changes.columns if c in base.columns and c != key]
    renamed = changes.select(key, "op", *[F.col(c).alias(f"_new_{c}") for c in given])
    marked = base.withColumn("_exists", F.lit(True))
    joined = marked.join(renamed, key, "full_outer")
    exists = F.col("_exists").isNotNull()
    op = F.coalesce(F.col("op"), F.lit("keep"))
    kept = joined.filter((exists & (op != DELETE)) | (~exists & (op == CREATE)))
    writes = (op == UPDATE) | ~exists
    for c in given:
        kept = kept.withColumn(c, F.when(writes, F.coalesce(F.col(f"_new_{c}"), F.col(c))).otherwise(F.col(c)))
    if stamp and stamp in base.columns:
        kept = kept.withColumn(stamp, F.when(writes, timestamp(as_of)).otherwise(F.col(stamp)))
    return kept.select(*base.columns)


def latest_change(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key, picked by partial aggregation rather than by sorting each key."""
    fields = F.struct(*[c for c in changes.columns if c != key])
    return changes.groupBy(key).agg(F.max_by(fields, F.col(order)).alias("_last")).select(key, "_last.*")
