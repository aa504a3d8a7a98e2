"""User preferences: lookup with defaults, what they change in a search, and weight checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake import fixed_values as fv
from leadlake.functions.common import str_array
from leadlake.functions.scoring import weight_map


def default_weights() -> Column:
    return weight_map(fv.PREFERENCE_WEIGHTS)


def weights_valid(weights: Column) -> Column:
    """Weights sum to about one and each lies between 0 and 1; no weights at all is fine."""
    values = F.map_values(weights)
    total = F.aggregate(values, F.lit(0.0), lambda acc, w: acc + w)
    ok = total.between(0.95, 1.05) & F.forall(values, lambda w: w.between(0, 1))
    return weights.isNull() | F.coalesce(ok, F.lit(False))


def preferences_for(users: DataFrame, preferences: DataFrame) -> DataFrame:
    """Each user with stored or default preferences. ``users`` has a ``user_id`` column."""
    joined = users.join(preferences.withColumn("_stored", F.lit(True)), "user_id", "left")
    given = F.col("scoring_weights").isNotNull() & (F.size("scoring_weights") > 0)
    return joined.withColumns(
        {
            "preferred_industries": F.coalesce("preferred_industries", str_array([])),
            "preferred_locations": F.coalesce("preferred_locations", str_array([])),
            "scoring_weights": F.when(given, F.col("scoring_weights")).otherwise(default_weights()),
            "preferences_applied": F.coalesce("_stored", F.lit(False)),
        }
    ).drop("_stored")


def applied_preferences(users: DataFrame, preferences: DataFrame) -> DataFrame:
    """Which preferences a search of each user would apply; only non-empty lists count as boosts."""
    found = preferences_for(users, preferences)

    def boost(name: str, column: str) -> Column:
        return F.when(F.size(column) > 0, F.struct(F.lit(name).alias("key"), F.col(column).alias("value")))

    boosts = F.array_compact(F.array(boost("industries", "preferred_industries"), boost("locations", "preferred_locations")))
    return found.select(
        *users.columns,
        "preferences_applied",
        F.col("scoring_weights").alias("custom_weights_used"),
        F.map_from_entries(boosts).alias("preference_boosts"),
    )


def preference_filters(users: DataFrame, preferences: DataFrame) -> DataFrame:
    """Non-empty preference lists and ranges per user, null where not set."""
    found = users.join(preferences, "user_id", "left")
    lists = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("preferred_industries", "preferred_locations")]
    ranges = [F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("company_size_range", "revenue_range")]
    return found.select("user_id", *lists, *ranges)
