"""Table schemas and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


LEAD_TEXT_FIELDS = [
    "company", "contact", "email", "phone", "website", "industry",
    "location", "revenue", "employees", "description",
]

LEAD_SCHEMA = _schema(
    ("id", T.LongType()),
    ("user_id", T.LongType()),
    *[(name, _TEXT) for name in LEAD_TEXT_FIELDS],
    ("keywords", T.ArrayType(_TEXT)),
    ("score", T.IntegerType()),
    ("status", _TEXT),
    ("priority", _TEXT),
    ("view_count", T.LongType()),
    ("contact_count", T.LongType()),
    ("conversion_score", T.DoubleType()),
    ("indexed_at", T.TimestampType()),
    ("last_contact", T.TimestampType()),
    ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
)

SEARCH_EVENT_SCHEMA = _schema(
    ("id", T.LongType()),
    ("user_id", T.LongType()),
    ("query_text", _TEXT),
    ("filters_applied", _TEXT),
    ("results_count", T.IntegerType()),
    ("response_time_ms", T.IntegerType()),
    ("clicked_results", T.LongType()),
    ("contacted_leads", T.LongType()),
    ("converted_leads", T.LongType()),
    ("cache_hit", _TEXT),
    ("session_id", _TEXT),
    ("user_agent", _TEXT),
    ("ip_address", _TEXT),
    ("created_at", T.TimestampType()),
)

INTERACTION_SCHEMA = _schema(
    ("id", T.LongType()),
    ("user_id", T.LongType()),
    ("lead_id", T.LongType()),
    ("interaction_type", _TEXT),
    ("interaction_data", _TEXT),
    ("source_search_query", _TEXT),
    ("source_campaign_id", T.LongType()),
    ("created_at", T.TimestampType()),
)

PREFERENCE_SCHEMA = _schema(
    ("user_id", T.LongType()),
    ("preferred_industries", T.ArrayType(_TEXT)),
    ("preferred_locations", T.ArrayType(_TEXT)),
    ("company_size_range", _TEXT),
    ("revenue_range", _TEXT),
    ("scoring_weights", T.MapType(_TEXT, T.DoubleType())),
)

PAGE_SCHEMA = _schema(("page_id", T.LongType()), ("url", _TEXT), ("html", _TEXT))

IMPORT_SCHEMA = _schema(
    *[(name, _TEXT) for name in LEAD_TEXT_FIELDS],
    ("keywords", T.ArrayType(_TEXT)),
    ("score", T.IntegerType()),
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """A table in any Spark format; give a schema for text formats so that nothing is inferred."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def read_lead_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lead records to import, one object per line; malformed lines are kept in ``_bad_record``."""
    schema = T.StructType(IMPORT_SCHEMA.fields + [T.StructField("_bad_record", _TEXT)])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad_record").json(path)


def tenant_scan(df: DataFrame, user_id: int | None = None) -> DataFrame:
    """The rows of one user, or all of them."""
    return df if user_id is None else df.filter(F.col("user_id") == user_id)


def scan_since(events: DataFrame, since, user_id: int | None = None) -> DataFrame:
    """Events from ``since`` on; the bare column comparison reaches the file scan."""
    return tenant_scan(events.filter(F.col("created_at") >= since), user_id)
