"""Search-event and interaction analytics. Time bounds compare the bare column, so they reach the scan."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake import fixed_values as fv
from leadlake.functions.common import blank_to_null, percent
from leadlake.operators.metrics import timestamp
from leadlake.sources.tables import scan_since, tenant_scan


def is_contact_interaction() -> Column:
    return F.col("interaction_type").isin(fv.CONTACT_INTERACTIONS)


def _zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def search_summary(events: DataFrame, as_of: datetime, days: int = 30, user_id: int | None = None) -> DataFrame:
    """Totals and rates of the searches of the last ``days`` days, in one pass."""
    c = F.col
    recent = scan_since(events, timestamp(as_of - timedelta(days=days)), user_id)
    counted = recent.agg(
        F.count(F.lit(1)).alias("total_searches"),
        _zero(F.sum("response_time_ms")).alias("response"),
        F.count_if(c("cache_hit") == "hit").alias("hits"),
        _zero(F.sum("results_count")).alias("results"),
        _zero(F.sum("clicked_results")).alias("total_clicks"),
        _zero(F.sum(c("converted_leads") + c("contacted_leads"))).alias("total_conversions"),
    )
    n = c("total_searches")

    def mean(total: str, digits: int) -> Column:
        return F.bround(F.when(n > 0, c(total) / n).otherwise(F.lit(0.0)), digits)

    return counted.select(
        "total_searches",
        mean("response", 0).cast("long").alias("avg_response_time_ms"),
        percent(c("hits"), n).alias("cache_hit_rate"),
        mean("results", 1).alias("avg_results_per_search"),
        "total_clicks",
        "total_conversions",
        percent(c("total_clicks"), n).alias("click_through_rate"),
        percent(c("total_conversions"), n).alias("conversion_rate"),
    )


def cache_hit_rate(events: DataFrame, user_id: int | None = None) -> DataFrame:
    """Hits over hits and misses, in percent."""
    counted = tenant_scan(events, user_id).agg(
        F.count_if(F.col("cache_hit") == "hit").alias("hits"), F.count_if(F.col("cache_hit") == "miss").alias("misses")
    )
    return counted.withColumn("cache_hit_rate", percent(F.col("hits"), F.col("hits") + F.col("misses")))


def popular_queries(
    events: DataFrame, as_of: datetime, days: int = 30, limit: int = 10, user_id: int | None = None
) -> DataFrame:
    recent = scan_since(events, timestamp(as_of - timedelta(days=days)), user_id)
    return (
        recent.filter(F.col("query_text") != "")
        .groupBy(F.col("query_text").alias("query"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.bround(_zero(F.avg("results_count")), 1).alias("avg_results"),
            F.bround(_zero(F.avg("response_time_ms")), 0).cast("long").alias("avg_response_time_ms"),
        )
        .orderBy(F.col("count").desc(), "query")
        .limit(limit)
    )


def query_counts(events: DataFrame) -> DataFrame:
    """How often each trimmed query text was searched."""
    text = F.trim(F.col("query_text"))
    return events.select(blank_to_null(text).alias("query")).filter(F.col("query").isNotNull()).groupBy("query").agg(
        F.count(F.lit(1)).alias("count")
    )


def popular_searches(events: DataFrame, limit: int = 10) -> DataFrame:
    """The most searched texts. Equal counts come in descending text order, as in a score-ordered set."""
    return query_counts(events).orderBy(F.col("count").desc(), F.col("query").desc()).limit(limit)


def lead_counters(interactions: DataFrame) -> DataFrame:
    """Views, contacts, last contact and conversions per lead, derived from the whole log (repeatable)."""
    contact = is_contact_interaction()
    return interactions.groupBy("lead_id").agg(
        F.count_if(F.col("interaction_type") == "view").alias("views"),
        F.count_if(contact).alias("contacts"),
        F.max(F.when(contact, F.col("created_at"))).alias("contacted_at"),
        F.count_if(F.col("interaction_type") == "convert").alias("conversions"),
    )


def update_lead_counters(leads: DataFrame, counters: DataFrame) -> DataFrame:
    """Leads with counters added to their stored values; columns they lack start at zero."""

    def stored(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in leads.columns else F.lit(0).cast(kind)

    old_contact = F.col("last_contact") if "last_contact" in leads.columns else F.lit(None).cast("timestamp_ntz")
    raised = stored("conversion_score", "double") + F.lit(0.1) * _zero(F.col("conversions"))
    joined = leads.join(counters.withColumnRenamed("lead_id", "id"), "id", "left")
    return joined.withColumns(
        {
            "view_count": stored("view_count", "long") + _zero(F.col("views")),
            "contact_count": stored("contact_count", "long") + _zero(F.col("contacts")),
            "last_contact": F.coalesce(F.col("contacted_at"), old_contact),
            "conversion_score": F.least(raised, F.lit(1.0)),
        }
    ).drop("views", "contacts", "contacted_at", "conversions")


def _funnel_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(F.col("view_count") > 0).alias("viewed"),
        F.count_if(F.col("contact_count") > 0).alias("contacted"),
        F.count_if(F.col("email").isNotNull() | F.col("phone").isNotNull()).alias("qualified"),
        F.count_if(F.col("conversion_score") > 0.5).alias("converted"),
    ]


# --- fixed values: stages in order, with their labels ---
FUNNEL_STAGES = [
    ("discovered", "Descobertos"),
    ("viewed", "Visualizados"),
    ("contacted", "Contatados"),
    ("qualified", "Qualificados"),
    ("converted", "Convertidos"),
]


def conversion_funnel(leads: DataFrame, user_id: int | None = None) -> DataFrame:
    """Count, share and drop-off per stage; the first stage with the largest drop-off is marked.

    Stages are independent conditions, so a drop-off may be negative.
    """
    total = F.col("discovered")
    previous = None
    stages = []
    for position, (stage, label) in enumerate(FUNNEL_STAGES):
        count = F.col(stage)
        lost = F.lit(0.0)
        if previous is not None:
            lost = F.bround(F.when(previous > 0, (previous - count) / previous * 100).otherwise(F.lit(0.0)), 1)
        stages.append(
            F.struct(
                F.lit(position).alias("stage_order"),
                F.lit(stage).alias("stage"),
                F.lit(label).alias("label"),
                count.alias("count"),
                percent(count, total).alias("conversion_rate"),
                lost.alias("drop_off_rate"),
            )
        )
        previous = count
    counted = tenant_scan(leads, user_id).agg(*_funnel_counts()).select(F.array(*stages).alias("stages"))
    largest = F.array_max(F.transform(F.slice("stages", 2, len(stages)), lambda s: s["drop_off_rate"]))
    is_largest = F.filter(
        F.slice("stages", 2, len(stages)), lambda s: s["drop_off_rate"] == F.col("largest")
    )
    return (
        counted.withColumn("largest", largest)
        .withColumn("worst", F.get(is_largest, F.lit(0))["stage"])
        .select("worst", F.inline("stages"))
        .select(
            "stage_order", "stage", "label", "count", "conversion_rate", "drop_off_rate",
            (F.col("stage") == F.col("worst")).alias("is_biggest_drop_off"),
        )
    )


def merge_single_rows(*rows: DataFrame) -> DataFrame:
    """One row from several one-row frames, without a join."""
    merged = rows[0]
    for row in rows[1:]:
        merged = merged.unionByName(row, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def realtime_activity(
    searches: DataFrame, interactions: DataFrame, as_of: datetime, user_id: int | None = None
) -> DataFrame:
    """Searches, interactions and active users of the last hour (one user counts as one)."""
    since = timestamp(as_of - timedelta(hours=1))
    searched = scan_since(searches, since, user_id).agg(
        F.count(F.lit(1)).alias("searches_last_hour"), F.count_distinct("user_id").alias("active_users")
    )
    if user_id is not None:
        searched = searched.withColumn("active_users", F.lit(1).cast("long"))
    interacted = scan_since(interactions, since, user_id).agg(F.count(F.lit(1)).alias("interactions_last_hour"))
    return merge_single_rows(searched, interacted)


def todays_activity(leads: DataFrame, searches: DataFrame, as_of: datetime, user_id: int | None = None) -> DataFrame:
    midnight = timestamp(as_of.replace(hour=0, minute=0, second=0, microsecond=0))
    added = scan_since(leads, midnight, user_id).agg(F.count(F.lit(1)).alias("leads_added_today"))
    searched = scan_since(searches, midnight, user_id).agg(F.count(F.lit(1)).alias("searches_today"))
    return merge_single_rows(added, searched).withColumn(
        "trend", F.when(F.col("leads_added_today") > 0, F.lit("up")).otherwise(F.lit("stable"))
    )


def activity_feed(searches: DataFrame, interactions: DataFrame, limit: int = 20, user_id: int | None = None) -> DataFrame:
    """The newest searches and interactions (half each), merged by time."""
    half = limit // 2

    def newest(df: DataFrame) -> DataFrame:
        return tenant_scan(df, user_id).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(half)

    what = F.coalesce(blank_to_null(F.col("query_text")), F.lit("filtros"))
    searched = newest(searches).select(
        F.lit("search").alias("type"),
        F.col("created_at").alias("timestamp"),
        "id",
        F.concat(F.lit("Busca por '"), what, F.lit("' retornou "), F.col("results_count").cast("string"), F.lit(" resultados")).alias(
            "description"
        ),
    )
    touched = newest(interactions).select(
        F.lit("interaction").alias("type"),
        F.col("created_at").alias("timestamp"),
        "id",
        F.concat(F.lit("Lead "), F.col("lead_id").cast("string"), F.lit(" - "), F.col("interaction_type")).alias("description"),
    )
    return searched.unionByName(touched).orderBy(F.col("timestamp").desc(), F.col("type").desc(), F.col("id").desc()).limit(limit)


def attribute_clicks(searches: DataFrame, clicks: DataFrame) -> DataFrame:
    """Searches with the clicks on their results added; clicks without a search are ignored."""
    counted = clicks.groupBy(F.col("search_event_id").alias("id")).agg(F.count(F.lit(1)).alias("new_clicks"))
    return (
        searches.join(counted, "id", "left")
        .withColumn("clicked_results", F.col("clicked_results") + _zero(F.col("new_clicks")))
        .drop("new_clicks")
    )


def attribute_conversions(searches: DataFrame, conversions: DataFrame) -> DataFrame:
    """Searches with contacts and conversions (qualified or sale) that came from them added."""
    kind = F.col("conversion_type")
    counted = conversions.groupBy(F.col("search_event_id").alias("id")).agg(
        F.count_if(kind == "contact").alias("new_contacts"),
        F.count_if(kind.isin("qualified", "sale")).alias("new_conversions"),
    )
    return (
        searches.join(counted, "id", "left")
        .withColumn("contacted_leads", F.col("contacted_leads") + _zero(F.col("new_contacts")))
        .withColumn("converted_leads", F.col("converted_leads") + _zero(F.col("new_conversions")))
        .drop("new_contacts", "new_conversions")
    )


def with_event_defaults(events: DataFrame) -> DataFrame:
    """Search events ready to append: a session id, "miss" and zero counters where nothing was given."""
    return events.withColumns(
        {
            "session_id": F.coalesce(F.col("session_id"), F.uuid()),
            "cache_hit": F.coalesce(F.col("cache_hit"), F.lit("miss")),
            "clicked_results": _zero(F.col("clicked_results")),
            "contacted_leads": _zero(F.col("contacted_leads")),
            "converted_leads": _zero(F.col("converted_leads")),
        }
    )


def with_interaction_defaults(interactions: DataFrame) -> DataFrame:
    """Interaction events ready to append: an empty JSON object where no data was given."""
    return interactions.withColumn("interaction_data", F.coalesce("interaction_data", F.lit("{}")))


def session_counters(events: DataFrame, key: str = "user_id", gap_minutes: int = 5) -> DataFrame:
    """Counters per burst of activity: a burst ends after ``gap_minutes`` of silence.

    Events in one gap-long slot can never be split, so they are summed per (key, slot) before the
    shuffle. Sorting then only sees slots: a key has at most one per gap of elapsed time, however
    many events it has.
    """
    gap_us = gap_minutes * 60 * 1_000_000
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    slots = (
        events.groupBy(F.col(key), F.floor(at / F.lit(gap_us)).alias("slot"))
        .agg(
            F.min(at).alias("first_us"),
            F.max(at).alias("last_us"),
            F.count(F.lit(1)).alias("n"),
            _zero(F.sum("response_time_ms")).alias("response"),
            F.count_if(F.col("cache_hit") == "hit").alias("hits"),
        )
    )
    in_order = Window.partitionBy(key).orderBy("slot")
    starts = F.coalesce((F.col("first_us") - F.lag("last_us").over(in_order) > gap_us).cast("int"), F.lit(1))
    numbered = slots.withColumn("starts", starts).withColumn("burst", F.sum("starts").over(in_order))
    return numbered.groupBy(key, "burst").agg(
        F.timestamp_micros(F.min("first_us")).alias("started_at"),
        F.timestamp_micros(F.max("last_us")).alias("ended_at"),
        F.sum("n").alias("total_searches"),
        F.sum("response").alias("total_response_time"),
        F.sum("hits").alias("cache_hits"),
    ).drop("burst")


def window_counters(events: DataFrame, key: str, minutes: int = 60) -> DataFrame:
    """Events per key in fixed windows."""
    at = F.window(F.col("created_at"), f"{minutes} minutes")
    return (
        events.groupBy(at.alias("w"), F.col(key))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), key, "n")
    )


def sum_by_key(increments: DataFrame, key: str, amount: str) -> DataFrame:
    """Value of each counter after all its increments."""
    return increments.groupBy(key).agg(F.sum(amount).alias("value"))
