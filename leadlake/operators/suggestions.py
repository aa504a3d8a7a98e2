"""Autocomplete suggestions and related queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions.text import parse_query
from leadlake.operators.filters import ilike_contains, ilike_prefix
from leadlake.operators.suffixes import containing
from leadlake.session import spread
from leadlake.sources.tables import tenant_scan


def _distinct_values(leads: DataFrame, column: str, cond: Column, limit: int) -> DataFrame:
    """The first ``limit`` distinct non-blank values in text order."""
    return (
        leads.filter(cond & (F.col(column) != ""))
        .select(F.col(column).alias("text"))
        .distinct()
        .orderBy("text")
        .limit(limit)
    )


def suggestions(leads: DataFrame, popular: DataFrame, partial: str, limit: int = 10) -> DataFrame:
    """Texts that start with ``partial``: popular searches, companies, then industries.

    ``popular`` has columns ``query`` and ``count``.
    """
    empty = popular.select(F.lit(0).alias("position"), F.col("query").alias("text")).limit(0)
    if len(partial or "") < 2:
        return empty
    prefix = F.lit(partial)
    # More than "limit" are never shown, and ties are shown by text.
    fitting = popular.filter(F.startswith(F.lower("query"), F.lower(prefix)))
    searched = fitting.orderBy(F.col("count").desc(), F.col("query")).limit(limit).select(
        F.lit(0).alias("source"), (-F.col("count")).alias("weight"), F.col("query").alias("text")
    )

    def values(source: int, column: str) -> DataFrame:
        # More than "limit" are never shown, whatever the sources before this one give.
        found = _distinct_values(leads, column, ilike_prefix(F.col(column), prefix), limit)
        return found.select(F.lit(source).alias("source"), F.lit(0).cast("long").alias("weight"), "text")

    merged = searched.unionByName(values(1, "company")).unionByName(values(2, "industry"))
    first = merged.groupBy("text").agg(F.min(F.struct("source", "weight")).alias("at"))
    # At most 3 * limit rows are left here.
    order = Window.partitionBy().orderBy("at.source", "at.weight", "text")
    return first.select(F.row_number().over(order).alias("position"), "text").filter(F.col("position") <= limit)


def typed_suggestions(
    leads: DataFrame, popular: DataFrame, partial: str, limit: int = 10, user_id: int | None = None
) -> DataFrame:
    """Plain suggestions (half) and values that contain the text, by kind (half)."""
    if len((partial or "").strip()) < 2:
        return suggestions(leads, popular, "", limit).select(
            "position", "text", F.lit("").alias("type"), F.lit("").alias("description")
        )
    half = limit // 2
    plain = suggestions(leads, popular, partial, limit)
    own = tenant_scan(leads, user_id)
    kinds = [
        ("industry", "industry", "Buscar por indústria: "),
        ("location", "location", "Buscar por localização: "),
        ("company", "company", "Empresa: "),
    ]
    context = None
    for rank, (kind, column, label) in enumerate(kinds):
        found = _distinct_values(own, column, ilike_contains(F.col(column), F.lit(partial)), 3).select(
            F.lit(rank).alias("kind_rank"),
            "text",
            F.lit(kind).alias("type"),
            F.concat(F.lit(label), "text").alias("description"),
        )
        context = found if context is None else context.unionByName(found)
    fresh = context.join(plain.select("text"), "text", "left_anti")
    order = Window.partitionBy().orderBy("kind_rank", "text")
    numbered = fresh.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= half)
    shown = plain.filter(F.col("position") <= half).select(
        F.col("position").alias("n"), "text", F.lit("text").alias("type"), F.concat(F.lit("Buscar por: "), "text").alias("description")
    )
    both = shown.withColumn("block", F.lit(0)).unionByName(numbered.drop("kind_rank").withColumn("block", F.lit(1)))
    place = Window.partitionBy().orderBy("block", "n")
    return both.select(F.row_number().over(place).alias("position"), "text", "type", "description").filter(
        F.col("position") <= limit
    )


def related_queries(queries: DataFrame, popular: DataFrame, pool: int | None = None, limit: int = 5) -> DataFrame:
    """For each query the popular texts that contain any of its terms, most popular first, then by text.

    ``queries`` has ``query_id`` and ``query_text``, ``popular`` each text once with its ``count``. Terms are looked up among all
    popular texts, or among the ``pool`` most popular ones; no more than ``limit`` of a term can be among the first
    ``limit`` of a query.
    """
    if pool is not None:
        popular = popular.orderBy(F.col("count").desc(), F.col("query").desc()).limit(pool)
    one = F.lit(0).cast("bigint").alias("scope")
    keyed = spread(queries, "query_id", "query_text").select("query_id", "query_text", F.explode_outer(F.array_distinct(parse_query(F.col("query_text"))["terms"])).alias("piece"))
    texts = popular.filter(F.col("query").isNotNull()).select(F.col("query").alias("text"), "count")
    lowered = texts.select(one, F.lower("text").alias("text"))
    met = containing(lowered, keyed.select(one, "piece")).select("piece", F.col("text").alias("lowered"))
    met = met.join(texts.withColumn("lowered", F.lower("text")), "lowered").select("piece", F.struct((-F.col("count")).alias("w"), "text").alias("t"))
    first = Window.partitionBy("piece").orderBy("t")
    best = met.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= limit).groupBy("piece").agg(F.collect_list("t").alias("best"))
    joined = keyed.join(best, "piece", "left").groupBy("query_id", "query_text")
    found = joined.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))).alias("best"))
    return found.select("query_id", "query_text", F.slice(F.col("best.text"), 1, limit).alias("related_queries"))
