"""Composite reports built from the metric operators."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions import predicates as p
from leadlake.functions.common import percent
from leadlake.operators import events as ev
from leadlake.operators import metrics as m
from leadlake.sources.tables import scan_since, tenant_scan


def _health_class(response_ms: Column, hit_rate: Column) -> Column:
    return (
        F.when((response_ms < 200) & (hit_rate > 70), F.lit("excellent"))
        .when((response_ms < 500) & (hit_rate > 50), F.lit("good"))
        .when(response_ms < 1000, F.lit("fair"))
        .otherwise(F.lit("poor"))
    )


def _alerts(response_ms: Column, hit_rate: Column, conversion: Column) -> Column:
    def alert(cond: Column, kind: str, title: str, message: Column, action: str) -> Column:
        item = F.struct(F.lit(kind).alias("type"), F.lit(title).alias("title"), message.alias("message"), F.lit(action).alias("action"))
        return F.when(cond, item)

    return F.array_compact(
        F.array(
            alert(
                response_ms > 500,
                "warning",
                "Tempo de resposta alto",
                F.concat(F.lit("Tempo médio de resposta: "), response_ms.cast("string"), F.lit("ms")),
                "Considere otimizar consultas ou cache",
            ),
            alert(
                hit_rate < 50,
                "info",
                "Taxa de cache baixa",
                F.concat(F.lit("Taxa de acerto do cache: "), hit_rate.cast("string"), F.lit("%")),
                "Verifique a configuração do cache",
            ),
            alert(
                conversion < 20,
                "info",
                "Taxa de conversão baixa",
                F.concat(F.lit("Taxa de conversão: "), conversion.cast("string"), F.lit("%")),
                "Revise critérios de qualificação de leads",
            ),
        )
    )


def dashboard_summary(
    leads: DataFrame, searches: DataFrame, as_of: datetime, user_id: int | None = None, search_as_of: datetime | None = None
) -> DataFrame:
    """Lead overview, measured search performance, today's activity, health class and alerts."""
    now = search_as_of or as_of
    midnight = m.timestamp(now.replace(hour=0, minute=0, second=0, microsecond=0))
    overview = m.dashboard_metrics(leads, as_of, user_id)
    counted = searches.agg(
        F.bround(F.coalesce(F.avg("response_time_ms"), F.lit(0.0)), 0).cast("long").alias("avg_response_time"),
        F.count_if(F.col("cache_hit") == "hit").alias("hits"),
        F.count_if(F.col("cache_hit") == "miss").alias("misses"),
        F.count_if(F.col("created_at") >= midnight).alias("searches_today"),
    )
    performance = counted.select(
        "avg_response_time",
        percent(F.col("hits"), F.col("hits") + F.col("misses")).alias("cache_hit_rate"),
        "searches_today",
    )
    today = m.timestamp(as_of.replace(hour=0, minute=0, second=0, microsecond=0))
    added = scan_since(leads, today, user_id).agg(F.count(F.lit(1)).alias("leads_added_today"))
    row = ev.merge_single_rows(overview, performance, added)
    response, hit_rate = F.col("avg_response_time"), F.col("cache_hit_rate")
    return row.withColumns(
        {
            "system_health": _health_class(response, hit_rate),
            "trend": F.when(F.col("leads_added_today") > 0, F.lit("up")).otherwise(F.lit("stable")),
            "alerts": _alerts(response, hit_rate, F.col("conversion_rate")),
        }
    )


def search_health(leads: DataFrame, popular: DataFrame | None = None, user_id: int | None = None) -> DataFrame:
    """Index coverage with what to do about it: re-index below 90 %, complete data above 20 % gaps."""
    c = F.col
    counted = tenant_scan(leads, user_id).agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.count("indexed_at").alias("indexed_leads"),
        F.count_if(p.is_hard_to_find()).alias("incomplete_leads"),
    )
    coverage = F.when(c("total_leads") > 0, c("indexed_leads") / c("total_leads") * 100).otherwise(F.lit(0.0))
    tips = [F.when(c("incomplete_leads") > c("total_leads") * 0.2, F.lit("incomplete_data"))]
    row = counted
    if popular is not None:
        seen = popular.orderBy(c("count").desc(), c("query").desc()).limit(5).agg(F.count(F.lit(1)).alias("n_popular"))
        row = ev.merge_single_rows(counted, seen)
        tips.insert(0, F.when(c("n_popular") > 0, F.lit("popular_queries")))
    return row.select(
        "total_leads",
        "indexed_leads",
        "incomplete_leads",
        F.bround(coverage, 2).alias("index_coverage_percent"),
        F.array_compact(F.array(F.when(coverage < 90, F.lit("reindex_leads")))).alias("recommendations"),
        F.array_compact(F.array(*tips)).alias("optimization_tips"),
        F.when(coverage < 90, F.lit("needs_attention")).otherwise(F.lit("good")).alias("overall_health"),
    )


def search_analytics_report(leads: DataFrame, popular: DataFrame, user_id: int | None = None) -> DataFrame:
    """Coverage, score bands, top industries and locations and popular searches as (section, name, value, extra) rows.

    One pass over the leads: the three groupings share a scan through grouping sets.
    """
    c = F.col
    grouped = (
        tenant_scan(leads, user_id)
        .groupingSets([[], ["industry"], ["location"]], "industry", "location")
        .agg(
            F.grouping_id().alias("gid"),
            F.count(F.lit(1)).alias("n"),
            F.count("indexed_at").alias("indexed"),
            F.count_if(c("score") >= 80).alias("high"),
            F.count_if((c("score") >= 50) & (c("score") < 80)).alias("medium"),
            F.count_if(c("score") < 50).alias("low"),
            F.avg("score").alias("avg_score"),
        )
    )
    # grouping_id: one bit per column, set when the column is rolled up (industry is the high bit).
    order = Window.partitionBy("gid").orderBy(c("n").desc(), F.coalesce("industry", "location"))
    kept = grouped.filter((c("gid") == 3) | F.coalesce("industry", "location").isNotNull())
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= 10)

    def item(section: Column, name: Column, value: Column, extra: Column) -> Column:
        return F.struct(
            section.alias("section"), name.alias("name"), value.cast("double").alias("value"), extra.cast("double").alias("extra")
        )

    none = F.lit(None)
    coverage = F.bround(F.when(c("n") > 0, c("indexed") / c("n") * 100).otherwise(F.lit(0.0)), 2)
    totals = F.array(
        item(F.lit("coverage"), F.lit("total_leads"), c("n"), none),
        item(F.lit("coverage"), F.lit("indexed_leads"), c("indexed"), none),
        item(F.lit("coverage"), F.lit("search_coverage_percent"), coverage, none),
        item(F.lit("quality"), F.lit("high_quality"), c("high"), none),
        item(F.lit("quality"), F.lit("medium_quality"), c("medium"), none),
        item(F.lit("quality"), F.lit("low_quality"), c("low"), none),
        item(F.lit("quality"), F.lit("total_scored_leads"), c("high") + c("medium") + c("low"), none),
    )
    kind = F.when(c("gid") == 1, F.lit("industry")).otherwise(F.lit("location"))
    mean = F.bround(F.coalesce("avg_score", F.lit(0.0)), 1)
    group = F.array(item(kind, F.coalesce("industry", "location"), c("n"), mean))
    rows = ranked.select(F.inline(F.when(c("gid") == 3, totals).otherwise(group)))
    top = popular.orderBy(c("count").desc(), c("query").desc()).limit(5)
    searched = top.select(
        F.lit("popular").alias("section"), c("query").alias("name"), c("count").cast("double").alias("value"), none.cast("double").alias("extra")
    )
    return rows.unionByName(searched)


def comprehensive_report(leads: DataFrame, as_of: datetime, months: int = 6, user_id: int | None = None) -> DataFrame:
    """Dashboard, conversion, months, industries, sources and quality tiers as (section, name, value) rows.

    Everything comes from one scan: grouping sets give the totals, the months and the industries.
    Empty months are added as in ``leads_by_month``: if fewer than ``months`` months have leads.
    """
    c = F.col
    start = as_of - timedelta(days=months * 30)
    week, fortnight = m.timestamp(as_of - timedelta(days=7)), m.timestamp(as_of - timedelta(days=14))
    in_window = c("created_at") >= m.timestamp(start)
    base = tenant_scan(leads, user_id).select(
        F.when(in_window, F.date_format("created_at", "yyyy-MM")).alias("month"),
        "industry",
        p.is_qualified().alias("qualified"),
        p.is_high_quality().alias("high_quality"),
        p.all_set("email", "phone", "industry").alias("full"),
        p.is_contacted().alias("contacted"),
        p.is_blank_lead().alias("blank"),
        F.coalesce(c("created_at") >= week, F.lit(False)).alias("recent"),
        F.coalesce((c("created_at") >= fortnight) & (c("created_at") < week), F.lit(False)).alias("previous"),
        p.all_set("industry", "location", "description").alias("described"),
        c("website").isNotNull().alias("has_site"),
        (c("email").isNotNull() & c("phone").isNull()).alias("mail_only"),
        p.all_set("email", "phone", "industry", "location", "description").alias("tier1"),
        (p.is_qualified() & p.all_set("industry", "location")).alias("tier2"),
    )
    names = [
        "qualified", "high_quality", "full", "contacted", "blank", "recent", "previous",
        "described", "has_site", "mail_only", "tier1", "tier2",
    ]
    grouped = base.groupingSets([[], ["month"], ["industry"]], "month", "industry").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), *[F.count_if(x).alias(x) for x in names]
    )
    label = F.coalesce("month", "industry")
    kept = grouped.filter((c("gid") == 3) | label.isNotNull())
    # A bounded top-k: only ten industries of each partition move.
    industries = kept.filter(c("gid") == 2).orderBy(c("n").desc(), label).limit(10)
    at = F.concat_ws("-", "year", F.lpad(c("month_number").cast("string"), 2, "0"))
    empty = m.month_spine(leads.sparkSession, start, as_of).select(at.alias("month"), F.lit(0).alias("real"), *[F.lit(0).alias(x) for x in ("n", *names)])
    real = kept.filter(c("gid") == 1).select("month", F.lit(1).alias("real"), "n", *names)
    filled = real.unionByName(empty).groupBy("month").agg(*[F.sum(x).alias(x) for x in ("real", "n", *names)])
    # one row per month reaches this window
    filled = filled.withColumn("n_real", F.sum("real").over(Window.partitionBy())).filter((c("real") == 1) | (c("n_real") < months))
    by_month = filled.select("month", F.lit(None).cast("string").alias("industry"), F.lit(1).cast("bigint").alias("gid"), "n", *names)
    ranked = kept.filter(c("gid") == 3).unionByName(by_month).unionByName(industries)

    def item(section: str, name, value: Column) -> Column:
        name = name if isinstance(name, Column) else F.lit(name)
        return F.struct(F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))

    n = c("n")
    good, medium = c("tier2") - c("tier1"), c("qualified") - c("tier2")
    growth = F.bround(F.when(c("previous") > 0, (c("recent") - c("previous")) / c("previous") * 100).otherwise(F.lit(0.0)), 1)
    roi = F.bround(m.roi_value(c("full"), c("qualified"), n), 0)
    rest = F.greatest(F.lit(0), n - c("described") - c("has_site") - c("mail_only"))
    totals = F.array(
        item("dashboard", "total_leads", n),
        item("dashboard", "qualified_leads", c("qualified")),
        item("dashboard", "conversion_rate", percent(c("qualified"), n)),
        item("dashboard", "average_roi", roi),
        item("dashboard", "high_quality_leads", c("high_quality")),
        item("dashboard", "recent_leads", c("recent")),
        item("dashboard", "growth_rate", growth),
        item("conversion", "search_to_contact_rate", percent(c("contacted"), n)),
        item("conversion", "search_to_qualified_rate", percent(c("qualified"), n)),
        item("conversion", "zero_results_rate", percent(c("blank"), n)),
        item("source", "LinkedIn", c("described")),
        item("source", "Google Search", c("has_site")),
        item("source", "Website", c("mail_only")),
        item("source", "Referências", rest),
        item("quality", "high_quality", c("tier1")),
        item("quality", "good_quality", good),
        item("quality", "medium_quality", medium),
        item("quality", "low_quality", F.greatest(F.lit(0), n - c("tier1") - good - medium)),
    )
    month = F.array(item("month_leads", label, n), item("month_qualified", label, c("qualified")))
    industry = F.array(item("industry", label, n))
    return ranked.select(F.inline(F.when(c("gid") == 3, totals).when(c("gid") == 1, month).otherwise(industry)))
