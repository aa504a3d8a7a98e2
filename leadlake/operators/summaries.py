"""Popular texts from mergeable summaries, one per hour and tenant, beside the exact counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions.common import blank_to_null

#: Texts that a summary tracks. Texts beyond that make counts inexact: a text's estimate is too high by at most the events of the
#: summary divided by three quarters of this number, and a text that occurs more often is never missed.
TRACKED = 10_000


def query_summaries(events: DataFrame, tracked: int = TRACKED, window: str = "1 hour") -> DataFrame:
    """(window_start, user_id, summary) of the query texts of search events; a summary has a bounded size."""
    texts = events.withColumn("query", blank_to_null(F.trim(F.col("query_text")))).filter(F.col("query").isNotNull())
    by = texts.groupBy(F.window("created_at", window)["start"].alias("window_start"), "user_id")
    return by.agg(F.expr(f"approx_top_k_accumulate(query, {tracked})").alias("summary"))


def popular_from_summaries(summaries: DataFrame, limit: int = 10, tracked: int = TRACKED, by: list[str] | None = None) -> DataFrame:
    """(by..., query, count): the ``limit`` most frequent texts over all summaries, or for each value of ``by``. Events are not read."""
    merged = summaries.groupBy(*(by or [])).agg(F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"))
    top = F.expr(f"approx_top_k_estimate(summary, {limit})")
    return merged.select(*(by or []), F.explode(top).alias("t")).select(*(by or []), F.col("t.item").alias("query"), F.col("t.count").alias("count"))
