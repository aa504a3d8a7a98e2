"""Structured Streaming forms of the live counters, activity, popular queries and attribution.

Every function maps a streaming DataFrame to a streaming DataFrame; :mod:`leadlake.streaming.sinks`
starts the queries. Event time must be TIMESTAMP: see :func:`event_time`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions.common import blank_to_null
from leadlake.operators.events import is_contact_interaction
from leadlake.operators.index import build_postings


def event_time(events: DataFrame, late_by: str = "10 minutes", column: str = "created_at") -> DataFrame:
    """Events with a watermark; a time without zone is read in the session zone."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late_by)


def live_search_counter(events: DataFrame, key: str = "user_id", gap: str = "5 minutes") -> DataFrame:
    """Searches, response time and cache hits per burst of activity of a key."""
    return (
        events.groupBy(F.session_window("created_at", gap).alias("w"), F.col(key))
        .agg(
            F.count(F.lit(1)).alias("total_searches"),
            F.sum("response_time_ms").alias("total_response_time"),
            F.count_if(F.col("cache_hit") == "hit").alias("cache_hits"),
        )
        .select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"), "total_searches", "total_response_time", "cache_hits")
    )


def live_interaction_counter(interactions: DataFrame, key: str = "user_id", gap: str = "5 minutes") -> DataFrame:
    """Interactions by kind per burst of activity of a key."""
    return (
        interactions.groupBy(F.session_window("created_at", gap).alias("w"), F.col(key))
        .agg(
            F.count(F.lit(1)).alias("total_interactions"),
            F.count_if(F.col("interaction_type") == "view").alias("views"),
            F.count_if(is_contact_interaction()).alias("contacts"),
            F.count_if(F.col("interaction_type") == "convert").alias("conversions"),
        )
        .select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"), "total_interactions", "views", "contacts", "conversions")
    )


def fixed_window_counter(events: DataFrame, key: str, window: str = "5 minutes") -> DataFrame:
    """Events per key in fixed windows. Windows start on the clock, not at the first event of a key."""
    return (
        events.groupBy(F.window("created_at", window).alias("w"), F.col(key))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), key, "n")
    )


def last_hour_activity(events: DataFrame, every: str = "5 minutes") -> DataFrame:
    """Searches and active users of the last hour, refreshed ``every`` so often. Users are counted first, so a window is
    summed over one row per user."""
    users = events.groupBy(F.window("created_at", "1 hour", every).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        users.groupBy("w")
        .agg(F.sum("n").alias("searches"), F.count("user_id").alias("active_users"))
        .select(F.col("w.end").alias("as_of"), "searches", "active_users")
    )


def popular_query_counts(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """How often each query text was searched in each window."""
    texts = events.withColumn("query", blank_to_null(F.trim(F.col("query_text")))).filter(F.col("query").isNotNull())
    return (
        texts.groupBy(F.window("created_at", window).alias("w"), "query")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("window_start"), "query", "count")
    )


def new_postings(leads: DataFrame) -> DataFrame:
    """Postings of arriving leads; stateless, so they can be appended to the index as they come."""
    return build_postings(leads)


def attributed_searches(searches: DataFrame, clicks: DataFrame, within: str = "30 minutes") -> DataFrame:
    """Each search with each click on its results, or with null if none came ``within`` that time.

    Both streams need watermarks; a search is kept in state only until its time is over.
    """
    s, k = searches.alias("s"), clicks.alias("k")
    late = F.expr(f"INTERVAL {within}")
    cond = (
        (F.col("k.search_event_id") == F.col("s.id"))
        & (F.col("k.created_at") >= F.col("s.created_at"))
        & (F.col("k.created_at") <= F.col("s.created_at") + late)
    )
    return s.join(k, cond, "left_outer").select(
        F.col("s.id").alias("search_event_id"), F.col("s.created_at").alias("searched_at"), F.col("k.lead_id").alias("lead_id")
    )


def unique_events(events: DataFrame, key: str = "id", late_by: str = "10 minutes", column: str = "created_at") -> DataFrame:
    """Events of a source that may send one more than once, each once: a key is remembered for as long as a repeat may be late.

    Events without a key cannot be told apart and are all kept.
    """
    known = event_time(events.filter(F.col(key).isNotNull()), late_by, column).dropDuplicatesWithinWatermark([key])
    return known.unionByName(event_time(events.filter(F.col(key).isNull()), late_by, column))
