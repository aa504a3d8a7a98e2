"""Lead metrics. Each operator is one conditional aggregate (one scan, one small shuffle) or one
group-by with partial aggregation, so a dominant key never reaches a single task unreduced."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadlake import fixed_values as fv
from leadlake.functions import predicates as p
from leadlake.functions.common import any_of, percent
from leadlake.operators.filters import text_matches
from leadlake.sources.tables import tenant_scan


def timestamp(value: datetime) -> Column:
    """A literal that compares with timestamp columns of either kind without casting the column."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def month_name(month: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in fv.MONTH_NAMES]), month.cast("int") - 1)


def roi_value(full: Column, qualified: Column, total: Column) -> Column:
    """Mean value per lead: complete leads, other reachable leads and the rest weigh differently."""
    value = full * fv.ROI_HIGH + (qualified - full) * fv.ROI_MEDIUM + (total - qualified) * fv.ROI_LOW
    return F.when(total > 0, value / total).otherwise(F.lit(0.0))


def _dashboard_counts(as_of: datetime) -> list[Column]:
    week, fortnight = timestamp(as_of - timedelta(days=7)), timestamp(as_of - timedelta(days=14))
    created = F.col("created_at")
    return [
        F.count(F.lit(1)).alias("total_leads"),
        F.count_if(p.is_qualified()).alias("qualified_leads"),
        F.count_if(p.is_high_quality()).alias("high_quality_leads"),
        F.count_if(p.all_set("email", "phone", "industry")).alias("full_leads"),
        F.count_if(created >= week).alias("recent_leads"),
        F.count_if((created >= fortnight) & (created < week)).alias("previous_leads"),
    ]


def _growth(recent: Column, previous: Column) -> Column:
    return F.bround(F.when(previous > 0, (recent - previous) / previous * 100).otherwise(F.lit(0.0)), 1)


def dashboard_metrics(leads: DataFrame, as_of: datetime, user_id: int | None = None) -> DataFrame:
    c = F.col
    return (
        tenant_scan(leads, user_id)
        .agg(*_dashboard_counts(as_of))
        .select(
            "total_leads",
            "qualified_leads",
            percent(c("qualified_leads"), c("total_leads")).alias("conversion_rate"),
            F.bround(roi_value(c("full_leads"), c("qualified_leads"), c("total_leads")), 0).alias("average_roi"),
            "high_quality_leads",
            "recent_leads",
            _growth(c("recent_leads"), c("previous_leads")).alias("growth_rate"),
        )
    )


def average_roi(leads: DataFrame, user_id: int | None = None) -> DataFrame:
    counted = tenant_scan(leads, user_id).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(p.is_qualified()).alias("qualified"),
        F.count_if(p.all_set("email", "phone", "industry")).alias("full"),
    )
    return counted.select(roi_value(F.col("full"), F.col("qualified"), F.col("total")).alias("average_roi"))


def search_conversion(leads: DataFrame, user_id: int | None = None) -> DataFrame:
    counted = tenant_scan(leads, user_id).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(p.is_contacted()).alias("contacted"),
        F.count_if(p.is_qualified()).alias("qualified"),
        F.count_if(p.is_blank_lead()).alias("blank"),
    )
    return counted.select(
        percent(F.col("contacted"), F.col("total")).alias("search_to_contact_rate"),
        percent(F.col("qualified"), F.col("total")).alias("search_to_qualified_rate"),
        percent(F.col("blank"), F.col("total")).alias("zero_results_rate"),
    )


def _month_spine(start: datetime, end: datetime) -> list[tuple[int, int]]:
    """Months to show when some are empty. From the start date the walk jumps 32 days, then goes month
    by month, so a start on the 31st may skip a short month."""
    months = [(start.year, start.month)]
    day = (start + timedelta(days=32)).replace(day=1)
    while day <= end:
        months.append((day.year, day.month))
        day = (day + timedelta(days=32)).replace(day=1)
    return months


def month_spine(spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
    """(year, month_number) of every month in between."""
    months = [F.struct(F.lit(y).alias("year"), F.lit(m).alias("month_number")) for y, m in _month_spine(start, end)]
    return spark.range(1).select(F.inline(F.array(*months)))


def leads_by_month(leads: DataFrame, as_of: datetime, months: int = 6, user_id: int | None = None) -> DataFrame:
    """Leads and qualified leads per month. Empty months are added only if fewer than ``months``
    months have leads."""
    start = as_of - timedelta(days=months * 30)
    real = (
        tenant_scan(leads, user_id)
        .filter(F.col("created_at") >= timestamp(start))
        .groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month_number"))
        .agg(F.count(F.lit(1)).alias("leads"), F.count_if(p.is_qualified()).alias("qualified"))
        .withColumn("is_real", F.lit(1))
    )
    zero = month_spine(leads.sparkSession, start, as_of).select("year", "month_number", F.lit(0).cast("long").alias("leads"), F.lit(0).cast("long").alias("qualified"), F.lit(0).alias("is_real"))
    merged = (
        real.unionByName(zero)
        .groupBy("year", "month_number")
        .agg(F.sum("leads").alias("leads"), F.sum("qualified").alias("qualified"), F.max("is_real").alias("is_real"))
    )
    # At most months + 2 rows reach this window.
    n_real = F.sum("is_real").over(Window.partitionBy())
    return (
        merged.withColumn("n_real", n_real)
        .filter((F.col("is_real") == 1) | (F.col("n_real") < months))
        .select("year", month_name(F.col("month_number")).alias("month"), "month_number", "leads", "qualified")
        .orderBy("year", "month_number")
    )


def period_trend(leads: DataFrame, as_of: datetime, period: str = "7d", user_id: int | None = None) -> DataFrame:
    """Leads over the months a period covers (at least six)."""
    days = {"1d": 1, "7d": 7, "30d": 30, "90d": 90}.get(period, 7)
    months = max(6, days // 30)
    return leads_by_month(leads, as_of, months, user_id).agg(
        F.lit(period).alias("period"), F.coalesce(F.sum("leads"), F.lit(0)).alias("total_period")
    )


def _top_counts(df: DataFrame, key: str, limit: int, *extra: Column) -> DataFrame:
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("count"), *extra)
        .orderBy(F.col("count").desc(), key)
        .limit(limit)
    )


def industry_breakdown(leads: DataFrame, limit: int = 10, user_id: int | None = None) -> DataFrame:
    return _top_counts(tenant_scan(leads, user_id), "industry", limit)


def insights(leads: DataFrame, by: str, limit: int = 10, user_id: int | None = None) -> DataFrame:
    """Lead count and mean score per industry or location, most frequent first."""
    mean = F.bround(F.coalesce(F.avg("score"), F.lit(0.0)), 1).alias("avg_quality_score")
    return _top_counts(tenant_scan(leads, user_id), by, limit, mean).withColumnRenamed("count", "lead_count")


def source_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(p.all_set("industry", "location", "description")).alias("linkedin"),
        F.count_if(F.col("website").isNotNull()).alias("google"),
        F.count_if(F.col("email").isNotNull() & F.col("phone").isNull()).alias("website"),
    ]


def _labelled(*pairs: tuple[str, Column], label: str, value: str) -> Column:
    return F.array(*[F.struct(F.lit(n).alias(label), v.alias(value)) for n, v in pairs])


def source_metrics(leads: DataFrame, user_id: int | None = None) -> DataFrame:
    """Leads per presumed source. The sources overlap; only the last one is what remains."""
    c = F.col
    rest = F.greatest(F.lit(0), c("total") - c("linkedin") - c("google") - c("website"))
    items = _labelled(
        ("LinkedIn", c("linkedin")),
        ("Google Search", c("google")),
        ("Website", c("website")),
        ("Referências", rest),
        label="source",
        value="leads",
    )
    return (
        tenant_scan(leads, user_id)
        .agg(*source_counts())
        .filter(c("total") > 0)
        .select("total", F.posexplode(items).alias("pos", "item"))
        .select("pos", "item.source", "item.leads", percent(c("item.leads"), c("total")).alias("percentage"))
        .orderBy(c("leads").desc(), "pos")
        .drop("pos")
    )


def quality_scores(leads: DataFrame, user_id: int | None = None) -> DataFrame:
    """Leads per completeness tier; each tier excludes the better ones."""
    c = F.col
    counted = tenant_scan(leads, user_id).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(p.all_set("email", "phone", "industry", "location", "description")).alias("high"),
        F.count_if(p.is_qualified() & p.all_set("industry", "location")).alias("good_or_high"),
        F.count_if(p.is_qualified()).alias("reachable"),
    )
    good = c("good_or_high") - c("high")
    medium = c("reachable") - c("high") - good
    low = F.greatest(F.lit(0), c("total") - c("high") - good - medium)
    tiers = [
        ("high_quality", "90-100", "Alta Prioridade", c("high")),
        ("good_quality", "70-89", "Boa Qualidade", good),
        ("medium_quality", "50-69", "Média Qualidade", medium),
        ("low_quality", "0-49", "Baixa Prioridade", low),
    ]
    items = F.array(
        *[
            F.struct(F.lit(t).alias("tier"), F.lit(r).alias("range"), F.lit(lb).alias("label"), n.alias("count"))
            for t, r, lb, n in tiers
        ]
    )
    return counted.select(F.inline(items))


def score_bands(leads: DataFrame, user_id: int | None = None) -> DataFrame:
    """Leads per score band; leads without a score are in none."""
    score = F.col("score")
    counted = tenant_scan(leads, user_id).agg(
        F.count_if(score >= 80).alias("high"),
        F.count_if((score >= 50) & (score < 80)).alias("medium"),
        F.count_if(score < 50).alias("low"),
    )
    items = _labelled(
        ("high_quality", F.col("high")),
        ("medium_quality", F.col("medium")),
        ("low_quality", F.col("low")),
        label="band",
        value="count",
    )
    return counted.select(F.inline(items))


FACET_COLUMNS = {
    "industries": "industry",
    "locations": "location",
    "company_sizes": "employees",
    "revenue_ranges": "revenue",
}
FACET_LIMITS = {"industries": 20, "locations": 20, "company_sizes": 10, "revenue_ranges": 10}


def facet_counts(df: DataFrame, limits: dict[str, int], drop_blank: bool = False) -> DataFrame:
    """Most frequent values of several columns in one pass: unpivot, count, rank per facet."""
    named = df.select(*[F.col(FACET_COLUMNS[f]).alias(f) for f in limits])
    values = named.unpivot([], list(limits), "facet", "value")
    kept = values.filter((F.col("value") != "") if drop_blank else F.col("value").isNotNull())
    counted = kept.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy("facet").orderBy(F.col("count").desc(), "value")
    ranked = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(limits.values()))
    within = any_of((F.col("facet") == f) & (F.col("rank") <= n) for f, n in limits.items())
    return ranked.filter(within)


def facets(leads: DataFrame, user_id: int | None = None) -> DataFrame:
    return facet_counts(tenant_scan(leads, user_id), FACET_LIMITS)


def facets_for_text(leads: DataFrame, text: str | None = None, user_id: int | None = None) -> DataFrame:
    """Facets of the leads whose company, industry or description contains ``text``."""
    found = tenant_scan(leads, user_id)
    if text:
        found = found.filter(text_matches(text))
    return facet_counts(found, {f: 10 for f in FACET_COLUMNS}, drop_blank=True)


def result_facets(results: DataFrame) -> DataFrame:
    """Facets of a result page, five values each."""
    return facet_counts(results, {"industries": 5, "locations": 5, "company_sizes": 5}, drop_blank=True)


def conversion_by_query_type(leads: DataFrame, user_id: int | None = None) -> DataFrame:
    named = p.all_set("company", "description")
    placed = p.all_set("industry", "location")
    counted = tenant_scan(leads, user_id).agg(
        F.count_if(named).alias("named"),
        F.count_if(named & p.is_qualified()).alias("named_qualified"),
        F.count_if(placed).alias("placed"),
        F.count_if(placed & p.is_qualified()).alias("placed_qualified"),
    )
    c = F.col

    def item(label: str, searches: str, conversions: str) -> Column:
        return F.struct(
            F.lit(label).alias("type"),
            c(searches).alias("searches"),
            c(conversions).alias("conversions"),
            percent(c(conversions), c(searches)).alias("rate"),
        )

    items = F.array(item("Company Name", "named", "named_qualified"), item("Industry + Location", "placed", "placed_qualified"))
    return counted.select(F.inline(items)).filter(c("searches") > 0)


def conversion_by_industry(leads: DataFrame, min_leads: int = 5, limit: int = 5, user_id: int | None = None) -> DataFrame:
    """Share of contacted leads in the most frequent industries."""
    c = F.col
    return (
        tenant_scan(leads, user_id)
        .filter(c("industry").isNotNull())
        .groupBy("industry")
        .agg(F.count(F.lit(1)).alias("total_searches"), F.count_if(p.is_contacted()).alias("conversions"))
        .filter(c("total_searches") >= min_leads)
        .orderBy(c("total_searches").desc(), "industry")
        .limit(limit)
        .select(
            F.concat(F.lit("Industry: "), c("industry")).alias("query_type"),
            "total_searches",
            "conversions",
            percent(c("conversions"), c("total_searches")).alias("conversion_rate"),
        )
    )


def _usage_by_filter(df: DataFrame, columns: dict[str, str], converted: Column) -> DataFrame:
    """Usage and conversions per value of several columns, in one pass."""
    named = df.select(converted.alias("converted"), *[F.col(c).alias(f) for f, c in columns.items()])
    return (
        named.unpivot(["converted"], list(columns), "kind", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("kind", "value")
        .agg(F.count(F.lit(1)).alias("usage"), F.count_if("converted").alias("conversions"))
    )


def _top_per_kind(usage: DataFrame, limits: dict[str, int]) -> DataFrame:
    order = Window.partitionBy("kind").orderBy(F.col("usage").desc(), "value")
    ranked = usage.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(limits.values()))
    return ranked.filter(any_of((F.col("kind") == k) & (F.col("rank") <= n) for k, n in limits.items()))


def top_converting_filters(leads: DataFrame, user_id: int | None = None) -> DataFrame:
    """The three most used industries, then the two most used locations; four rows at most."""
    usage = _usage_by_filter(
        tenant_scan(leads, user_id), {"industry": "industry", "location": "location"}, p.is_qualified()
    )
    c = F.col
    return (
        _top_per_kind(usage, {"industry": 3, "location": 2})
        .orderBy("kind", "rank")
        .limit(4)
        .select(
            F.concat(c("kind"), F.lit(":"), c("value")).alias("filter"),
            "usage",
            percent(c("conversions"), c("usage")).alias("conversion_rate"),
        )
    )


def top_converting_filters_variant(leads: DataFrame, min_leads: int = 3, user_id: int | None = None) -> DataFrame:
    """The three most used locations and two most used sizes, best contact rate first."""
    usage = _usage_by_filter(
        tenant_scan(leads, user_id), {"location": "location", "company_size": "employees"}, p.is_contacted()
    ).filter(F.col("usage") >= min_leads)
    c = F.col
    return (
        _top_per_kind(usage, {"location": 3, "company_size": 2})
        .select(
            c("kind").alias("filter_type"),
            c("value").alias("filter_value"),
            percent(c("conversions"), c("usage")).alias("conversion_rate"),
            c("usage").alias("total_leads"),
        )
        .orderBy(c("conversion_rate").desc(), c("filter_type").desc(), c("total_leads").desc(), "filter_value")
        .limit(5)
    )


def _coverage_counts(since_day: Column | None = None) -> list[Column]:
    indexed = F.col("indexed_at")
    counts = [
        F.count(F.lit(1)).alias("total_leads"),
        F.count(indexed).alias("indexed_leads"),
        F.max(indexed).alias("last_index_update"),
    ]
    if since_day is not None:
        counts.append(F.count_if(indexed >= since_day).alias("recent_indexed_24h"))
    return counts


def indexing_status(leads: DataFrame, as_of: datetime, user_id: int | None = None) -> DataFrame:
    c = F.col
    counted = tenant_scan(leads, user_id).agg(*_coverage_counts(timestamp(as_of - timedelta(hours=24))))
    coverage = F.when(c("total_leads") > 0, c("indexed_leads") / c("total_leads") * 100).otherwise(F.lit(0.0))
    return counted.select(
        "total_leads",
        "indexed_leads",
        F.bround(coverage, 1).alias("coverage_percent"),
        "recent_indexed_24h",
        F.when(coverage > 90, F.lit("healthy")).otherwise(F.lit("needs_attention")).alias("status"),
    )


def indexing_coverage(leads: DataFrame, healthy_above: float = 95, user_id: int | None = None) -> DataFrame:
    """Unindexed leads, exact coverage, the newest index time and a verdict with a stricter bound."""
    c = F.col
    coverage = F.when(c("total_leads") > 0, c("indexed_leads") / c("total_leads") * 100).otherwise(F.lit(0.0))
    return (
        tenant_scan(leads, user_id)
        .agg(*_coverage_counts())
        .select(
            "total_leads",
            "indexed_leads",
            (c("total_leads") - c("indexed_leads")).alias("unindexed_leads"),
            F.bround(coverage, 1).alias("indexing_coverage"),
            "last_index_update",
            F.when(coverage > healthy_above, F.lit("healthy")).otherwise(F.lit("needs_attention")).alias("status"),
        )
    )


def hourly_trend(leads: DataFrame, as_of: datetime, factor: int = 2, user_id: int | None = None) -> DataFrame:
    """Searches per hour of the day of ``as_of``, taken as ``factor`` per lead created in that hour."""
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    created = F.col("created_at")
    real = (
        tenant_scan(leads, user_id)
        .filter((created >= timestamp(midnight)) & (created < timestamp(midnight + timedelta(days=1))))
        .groupBy(F.hour("created_at").alias("h"))
        .agg((F.count(F.lit(1)) * factor).alias("searches"))
    )
    spine = leads.sparkSession.range(24).select(F.col("id").cast("int").alias("h"), F.lit(0).cast("long").alias("searches"))
    return (
        real.unionByName(spine)
        .groupBy("h")
        .agg(F.sum("searches").alias("searches"))
        .select(F.concat(F.lpad(F.col("h").cast("string"), 2, "0"), F.lit(":00")).alias("hour"), "searches")
    )


def missing_fields(leads: DataFrame, user_id: int | None = None) -> DataFrame:
    c = F.col
    return (
        tenant_scan(leads, user_id)
        .agg(
            F.count(F.lit(1)).alias("total_leads"),
            F.count_if(c("industry").isNull()).alias("without_industry"),
            F.count_if(c("location").isNull()).alias("without_location"),
            F.count_if(p.is_hard_to_find()).alias("incomplete_leads"),
        )
        .withColumn("needs_completion", c("incomplete_leads") > c("total_leads") * 0.2)
    )


def contact_performance(leads: DataFrame, user_id: int | None = None) -> DataFrame:
    """Expected e-mails and calls: fixed shares of the reachable leads, rounded down."""
    c = F.col
    return (
        tenant_scan(leads, user_id)
        .agg(F.count(F.lit(1)).alias("total_leads"), F.count_if(p.is_qualified()).alias("qualified_leads"))
        .withColumn("emails_sent", F.floor(c("qualified_leads") * F.lit(0.8)))
        .withColumn("calls_made", F.floor(c("qualified_leads") * F.lit(0.3)))
    )
