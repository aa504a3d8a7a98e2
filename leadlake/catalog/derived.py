"""Lead, event, query-log and change tables derived from the sample star schema.

A deployment reads its own tables with :mod:`leadlake.sources.tables`; here every one is a plan over
whole sample tables, so that each registered query grows with them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEADS_AS_OF = datetime(2001, 8, 2)
EVENTS_AS_OF = datetime(2024, 1, 31)
BATCH_USER = 1


# --- fixed values: schemas of the sample tables (reading with a schema starts no inference job) ---
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _digits(col: Column, width: int) -> Column:
    return F.lpad(col.cast("string"), width, "0")


def leads(spark: SparkSession, sf_dir: str, description: bool = True) -> DataFrame:
    """One lead per customer with orders. Without ``description`` the documents are not read at all."""
    key = F.col("c_custkey")
    text = key.cast("string")
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.max("o_orderdate").alias("last_order"),
            F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_final"),
        )
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("c_custkey"), "p_name")
    customer = table(spark, sf_dir, "customer").join(nation, "c_nationkey").join(region, "r_regionkey")
    if description:
        # The large joins below all use this key, so this is the one shuffle of the customers. Its number is given, so
        # that adaptive execution does not fold few bytes, which become much text work, into one task.
        customer = customer.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    # files of texts that repeat are far smaller than their rows: by their size these would be broadcast through the driver
    joined = (
        customer.join(part.hint("merge"), "c_custkey")
        .join(orders.hint("merge"), "c_custkey")
    )
    if description:
        documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("c_custkey"), F.col("text").alias("description"))
        joined = joined.join(documents, "c_custkey", "left")
    shown = [F.col("description")] if description else []
    suffix = F.when(key % 6 == 0, F.lit(" Ltda")).otherwise(F.lit(""))
    email = (
        F.when(key % 3 == 0, F.lit(None).cast("string"))
        .when(key % 7 == 0, F.concat(F.lit("user"), text, F.lit("@gmail.com")))
        .when(key % 11 == 0, F.concat(F.lit("noreply@site"), text, F.lit(".com")))
        .otherwise(F.concat(F.lit("c"), text, F.lit("@"), F.lower("c_mktsegment"), F.lit(".com.br")))
    )
    phone = F.concat(
        F.lit("("), (F.lit(11) + key % 89).cast("string"), F.lit(") 9"), _digits(key % 10000, 4), F.lit("-"), _digits((key * 7) % 10000, 4)
    )
    website = (
        F.when(key % 5 == 0, F.lit(None).cast("string"))
        .when(key % 13 == 0, F.concat(F.lit("https://facebook.com/p"), text))
        .otherwise(F.concat(F.lit("https://www.company"), (key % 500).cast("string"), F.lit(".com.br")))
    )
    employees = (
        F.when(key % 5 == 0, F.lit("1-10")).when(key % 5 == 1, F.lit("11-50")).when(key % 5 == 2, F.lit("51-200")).when(key % 5 == 3, F.lit("200+"))
    )
    revenue = (
        F.when(key % 4 == 0, F.lit("R$ 1M - R$ 5M")).when(key % 4 == 1, F.lit("R$ 5M - R$ 20M")).when(key % 4 == 2, F.lit("R$ 20M - R$ 100M"))
    )
    return joined.select(
        key.cast("long").alias("id"),
        (key % 10 + 1).cast("long").alias("user_id"),
        F.concat("p_name", F.lit(" "), text, suffix).alias("company"),
        F.when(key % 8 != 0, F.col("c_name")).alias("contact"),
        email.alias("email"),
        F.when(key % 4 != 0, phone).alias("phone"),
        website.alias("website"),
        F.when(key % 17 != 0, F.col("c_mktsegment")).alias("industry"),
        F.when(key % 19 != 0, F.concat("n_name", F.lit(", "), F.col("r_name"))).alias("location"),
        employees.alias("employees"),
        revenue.alias("revenue"),
        *shown,
        F.floor((F.col("c_acctbal") + 1000) / 110).cast("int").alias("score"),
        F.col("last_order").alias("created_at"),
        F.col("last_final").alias("last_contact"),
        F.when(key % 10 != 0, F.col("last_order")).alias("indexed_at"),
        F.when(F.col("last_final").isNotNull(), F.lit("Contatado")).otherwise(F.lit("Novo")).alias("status"),
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _event_case(**names: str) -> Column:
    kind = F.col("event_type")
    first, *others = [(k, v) for k, v in names.items() if k != "other"]
    case = F.when(kind == first[0], F.lit(first[1]))
    for k, v in others:
        case = case.when(kind == k, F.lit(v))
    return case.otherwise(F.lit(names["other"])) if "other" in names else case


def search_events_from(events: DataFrame) -> DataFrame:
    """Search events from raw events; works on a stream as well."""
    slot = _k() % 12
    text = F.when(slot == 1, F.lit("")).when(slot != 0, F.concat(F.lit("query "), slot.cast("string")))
    return events.select(
        F.col("event_id").alias("id"),
        "user_id",
        text.alias("query_text"),
        _k().alias("results_count"),
        F.floor(F.col("value") * 4).cast("int").alias("response_time_ms"),
        (F.col("event_type") == "click").cast("int").alias("clicked_results"),
        (F.col("event_type") == "signup").cast("int").alias("contacted_leads"),
        (F.col("event_type") == "purchase").cast("int").alias("converted_leads"),
        _event_case(view="hit", error="partial", other="miss").alias("cache_hit"),
        F.col("ts").alias("created_at"),
    )


def interactions_from(events: DataFrame) -> DataFrame:
    kind = _event_case(view="view", click="contact", signup="email", error="call", other="convert")
    return events.select(
        F.col("event_id").alias("id"),
        "user_id",
        _k().cast("long").alias("lead_id"),
        kind.alias("interaction_type"),
        F.col("ts").alias("created_at"),
    )


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_events_from(table(spark, sf_dir, "events"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions_from(table(spark, sf_dir, "events"))


def clicks_from(events: DataFrame) -> DataFrame:
    """Clicks refer back to a search a few events earlier."""
    return events.filter(F.col("event_type") == "click").select(
        (F.col("event_id") - _k() % 5).alias("search_event_id"), _k().cast("long").alias("lead_id"), F.col("ts").alias("created_at")
    )


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = _event_case(signup="contact", purchase="sale", error="qualified")
    return (
        table(spark, sf_dir, "events")
        .select((F.col("event_id") - _k()).alias("search_event_id"), kind.alias("conversion_type"))
        .filter(F.col("conversion_type").isNotNull())
    )


def raw_query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One free-text query per part, in several styles."""
    style = F.col("p_size") % 6
    name, kind = F.col("p_name"), F.lower("p_type")
    text = (
        F.when(style == 0, name)
        .when(style == 1, F.concat(F.lit('"'), name, F.lit('" '), kind))
        .when(style == 2, F.concat(F.lit("Tech startup em São Paulo: "), name))
        .when(style == 3, F.concat(name, F.lit(" & the BANK of "), kind, F.lit(" RJ")))
        .when(style == 4, F.concat(F.lit("large health-care "), name, F.lit(", Brasília!")))
        .otherwise(F.concat(name, F.lit(" for retail in minas mid-size")))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), text.alias("query_text"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query for each part: by name, by exact phrase, and with a word no lead has."""
    style = F.col("p_size") % 3
    name = F.col("p_name")
    text = (
        F.when(style == 0, name)
        .when(style == 1, F.concat(F.lit('"'), name, F.lit('"')))
        .otherwise(F.concat(name, F.lit(" unobtainable")))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), text.alias("query_text"))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New lead records, one per part; some repeat stored leads by name, mail, phone or site."""
    key, size = F.col("p_partkey"), F.col("p_size")
    text = key.cast("string")
    company = (
        F.when(size % 9 == 0, F.lit(""))
        .when(size % 4 == 0, F.concat("p_name", F.lit(" "), text, F.lit(" Inc.")))
        .when(size % 4 == 1, F.concat("p_name", F.lit(" "), text))
        .otherwise(F.concat("p_brand", F.lit(" "), F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" Trading House "), text))
    )
    email = F.when(size % 5 == 0, F.concat(F.lit("C"), text, F.lit("@building.com.br"))).when(size % 5 == 1, F.concat(F.lit("new"), text, F.lit("@shop.net")))
    phone = F.when(
        size % 7 == 0,
        F.concat(F.lit("("), (F.lit(11) + key % 89).cast("string"), F.lit(") 9"), _digits(key % 10000, 4), F.lit("-"), _digits((key * 7) % 10000, 4)),
    )
    website = F.when(size % 11 == 0, F.concat(F.lit("http://company"), (key % 900).cast("string"), F.lit(".com.br/contact")))
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        (key % 10 + 1).alias("user_id"),
        company.alias("company"),
        email.alias("email"),
        phone.alias("phone"),
        website.alias("website"),
        F.col("p_type").alias("industry"),
        F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit("-"), (size * 2).cast("string"))).alias("employees"),
        F.when(size % 3 == 0, size).alias("score"),
    )


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences of four users in five."""
    key = F.col("c_custkey")

    def weights(**values: float) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])

    chosen = (
        F.when(key % 4 == 0, weights(industry_match=0.25, location_proximity=0.15, company_size=0.1, text_relevance=0.4, data_quality=0.1))
        .when(key % 4 == 1, weights(industry_match=0.5, text_relevance=0.5))
        .when(key % 4 == 2, weights(industry_match=1.5, text_relevance=0.5))
    )
    place = F.concat("n_name", F.lit(", "), F.col("r_name"))
    empty = F.array().cast("array<string>")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, "c_nationkey")
        .join(region, "r_regionkey")
        .filter(key % 5 != 0)
        .select(
            key.alias("user_id"),
            F.when(key % 3 == 0, empty).otherwise(F.array("c_mktsegment")).alias("preferred_industries"),
            F.when(key % 7 == 0, empty).otherwise(F.array(place)).alias("preferred_locations"),
            F.when(key % 2 == 0, F.lit("51-200")).alias("company_size_range"),
            F.when(key % 6 == 0, F.lit("")).when(key % 6 == 1, F.lit("R$ 5M - R$ 20M")).alias("revenue_range"),
            chosen.alias("scoring_weights"),
        )
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


def lead_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes taken from orders: finished ones delete, open ones update, pending ones create (under ids no customer has)."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.when(status == "P", -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("id"),
        F.col("o_orderkey").alias("seq"),
        F.when(status == "F", F.lit("delete")).when(status == "P", F.lit("create")).otherwise(F.lit("update")).alias("op"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).alias("company"),
        F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"),
        F.col("o_orderpriority").alias("not_a_lead_column"),
    )


def import_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One import job per document source and language."""
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source", F.col("lang").alias("status"))
        .agg(F.count(F.lit(1)).alias("leads_found"), F.count_if(F.col("n_chars") > 1000).alias("leads_saved"))
    )
