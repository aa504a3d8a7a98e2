"""From raw pages or records to stored leads, as DataFrame chains. Rejected rows are kept, with a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake import fixed_values as fv
from leadlake.functions import html as h
from leadlake.functions.common import filled, str_array
from leadlake.functions.contact import (
    completeness,
    enhance_record,
    extract_email,
    extract_location_page,
    extract_phone,
    lead_keywords,
    url_domain,
)
from leadlake.functions.predicates import should_skip
from leadlake.functions.validation import validate_lead
from leadlake.operators.duplicates import drop_existing
from leadlake.operators.index import build_postings
from leadlake.session import stored
from leadlake.sources.tables import LEAD_TEXT_FIELDS

CONTACT_FIELDS = ["email", "phone", "location", "linkedin_url", "facebook_url", "twitter_url"]


def extract_pages(pages: DataFrame, default_industry: str | None = None) -> DataFrame:
    """Company facts of each page (page_id, url, html)."""
    read = (
        pages.withColumn("_markup", h.decode_references(h.without_hidden(F.col("html"))))
        .withColumn("_text", h.text_of(F.col("_markup")))
        .withColumn("_links", h.anchors(F.col("_markup")))
    )
    markup, text, links = F.col("_markup"), F.col("_text"), F.col("_links")
    linkedin, facebook, twitter = h.social_links(links)
    industry = h.page_industry(text)
    if default_industry:
        industry = F.coalesce(industry, F.lit(default_industry))
    return read.select(
        "page_id",
        "url",
        url_domain(F.col("url")).alias("host"),
        h.company_name(markup, F.col("url")).alias("company"),
        F.col("url").alias("website"),
        extract_email(text).alias("email"),
        extract_phone(text).alias("phone"),
        extract_location_page(text).alias("location"),
        linkedin.alias("linkedin_url"),
        facebook.alias("facebook_url"),
        twitter.alias("twitter_url"),
        h.contact_pages(links, F.col("url")).alias("contact_pages"),
        h.page_description(markup).alias("description"),
        industry.alias("industry"),
    ).filter(F.col("company").isNotNull())


def _filled_from(parts: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """First non-null value of each field per key, by partial aggregation."""
    return parts.groupBy(key).agg(
        *[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    )


def merge_linked_pages(extracted: DataFrame) -> DataFrame:
    """Each page's contact fields completed from the contact pages it links to, in the order of the links."""
    linked = extracted.select("page_id", F.posexplode("contact_pages").alias("n", "link"))
    targets = extracted.select(F.col("url").alias("link"), *CONTACT_FIELDS)
    own = extracted.select("page_id", F.lit(-1).alias("n"), *CONTACT_FIELDS)
    others = linked.join(targets, "link").select("page_id", "n", *CONTACT_FIELDS)
    merged = _filled_from(own.unionByName(others), "page_id", "n", CONTACT_FIELDS)
    return extracted.drop(*CONTACT_FIELDS).join(merged, "page_id")


def merge_host_pages(extracted: DataFrame) -> DataFrame:
    """One row per host: its first page, completed from all other pages of the host.

    Every field is a minimum by page, so a host with very many pages sends one partial row per task.
    """
    ranked = extracted.withColumn("n", F.col("page_id"))
    main_only = ["page_id", "company", "website", "description", "industry"]
    first = [F.min_by(F.col(c), F.col("n")).alias(c) for c in main_only]
    rest = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("n"))).alias(f) for f in CONTACT_FIELDS]
    return ranked.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), *first, *rest)


def _fields(df: DataFrame) -> dict[str, Column]:
    return {name: F.col(name) for name in [*LEAD_TEXT_FIELDS, "address"] if name in df.columns}


def _complete_columns(df: DataFrame) -> DataFrame:
    missing = [n for n in LEAD_TEXT_FIELDS if n not in df.columns]
    return df.withColumns({n: F.lit(None).cast("string") for n in missing}) if missing else df


def make_leads(records: DataFrame) -> DataFrame:
    """Enhanced records with confidence and keywords."""
    df = _complete_columns(records)
    enhanced = enhance_record(_fields(df))
    out = df.withColumns(enhanced)
    return out.withColumn("confidence", completeness(_fields(out), last="employees")).withColumn(
        "keywords", lead_keywords(F.col("description"), F.col("company"))
    )


def validate_leads(leads: DataFrame) -> DataFrame:
    df = _complete_columns(leads)
    return df.withColumn("validation", validate_lead(_fields(df)))


def lead_pipeline(
    pages: DataFrame,
    existing: DataFrame,
    user_id: int,
    required: list[str] | None = None,
    min_employees: int | None = None,
    max_employees: int | None = None,
    default_industry: str | None = None,
) -> DataFrame:
    """Pages to lead rows with a ``stage``: skipped, invalid, exists or saved.

    Only rows that reach a stage are judged by it: an invalid lead never shadows a later valid one.
    Extraction and validation are written once to the shared work folder, because the steps after
    them read their result several times.
    """
    read = stored(extract_pages(pages, default_industry), "extracted")
    extracted = _complete_columns(merge_linked_pages(read))
    skip = should_skip(_fields(extracted), required, min_employees, max_employees)
    judged = validate_leads(make_leads(extracted.withColumn("_skip", skip)))
    staged = judged.withColumn(
        "stage",
        F.when(F.col("_skip"), F.lit("skipped"))
        .when(~F.col("validation.is_valid"), F.lit("invalid"))
        .otherwise(F.lit("saved")),
    ).select(
        "page_id",
        F.lit(user_id).cast("long").alias("user_id"),
        *LEAD_TEXT_FIELDS,
        "keywords",
        F.floor(F.col("validation.confidence_score") * 100).cast("int").alias("score"),
        F.lit(fv.LEAD_STATUS_NEW).alias("status"),
        F.lit(fv.PRIORITY_MEDIUM).alias("priority"),
        "stage",
    )
    staged = stored(staged, "staged")
    valid = staged.filter(F.col("stage") == "saved")
    checked = drop_existing(valid, existing, key="page_id", dedupe_within_batch=True)
    decided = checked.withColumn(
        "stage", F.when(F.col("already_exists"), F.lit("exists")).otherwise(F.lit("saved"))
    ).drop("already_exists")
    return staged.filter(F.col("stage") != "saved").unionByName(decided)


def save_scraped(leads: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Scraped leads to append: first of each name wins, score from confidence, default status."""
    fresh = drop_existing(leads, existing, key=key, dedupe_within_batch=True).filter(~F.col("already_exists"))
    return fresh.withColumns(
        {
            "score": F.floor(F.col("confidence") * 100).cast("int"),
            "status": F.lit(fv.LEAD_STATUS_NEW),
            "priority": F.lit(fv.PRIORITY_MEDIUM),
        }
    ).drop("already_exists", "confidence")


def import_leads(
    records: DataFrame, existing: DataFrame, key: str = "id", dedupe_within_batch: bool = False
) -> DataFrame:
    """Imported records with an ``outcome``: imported, exists or rejected (no company name).

    Defaults fill score, keywords, status and priority. Stored leads of the same user whose company
    contains the name make a record "exists"; by default records of the batch do not see each other.
    """
    df = records
    if "keywords" not in df.columns:
        df = df.withColumn("keywords", F.lit(None).cast("array<string>"))
    if "score" not in df.columns:
        df = df.withColumn("score", F.lit(None).cast("int"))
    named = filled(F.col("company"))
    checked = drop_existing(df.filter(named), existing, key, dedupe_within_batch)
    outcome = F.when(F.col("already_exists"), F.lit("exists")).otherwise(F.lit("imported"))
    good = checked.withColumn("outcome", outcome).drop("already_exists")
    bad = df.filter(~named).withColumn("outcome", F.lit("rejected"))
    return (
        good.unionByName(bad)
        .withColumn("keywords", F.coalesce("keywords", str_array([])))
        .withColumn("score", F.coalesce("score", F.lit(fv.DEFAULT_IMPORT_SCORE)))
        .withColumn("status", F.lit(fv.LEAD_STATUS_NEW))
        .withColumn("priority", F.lit(fv.PRIORITY_MEDIUM))
    )


def import_errors(imported: DataFrame, key: str = "id") -> DataFrame:
    """(key, error): why each rejected record was not imported."""
    name = F.coalesce(F.col("company"), F.lit("lead"))
    error = F.concat(F.lit(fv.IMPORT_ERROR), name, F.lit(": no company name"))
    return imported.filter(F.col("outcome") == "rejected").select(key, error.alias("error"))


def pipeline_postings(staged: DataFrame) -> DataFrame:
    """Postings of the leads that a pipeline run saved: the last step, which adds them to the index."""
    saved = staged.filter(F.col("stage") == "saved").withColumn("id", F.col("page_id"))
    return build_postings(saved)


def import_report(imported: DataFrame) -> DataFrame:
    """How many records were imported and rejected."""
    return imported.agg(
        F.count_if(F.col("outcome") == "imported").alias("imported_count"),
        F.count_if(F.col("outcome") == "rejected").alias("error_count"),
    )


def job_summary(jobs: DataFrame) -> DataFrame:
    """Totals over import jobs (status, source, leads_found, leads_saved) and the mean success rate
    of the jobs that found anything."""
    rate = F.when(F.col("leads_found") > 0, F.col("leads_saved") / F.col("leads_found") * 100)
    return jobs.agg(
        F.count(F.lit(1)).alias("jobs"),
        F.coalesce(F.sum("leads_found"), F.lit(0)).alias("total_leads_found"),
        F.coalesce(F.sum("leads_saved"), F.lit(0)).alias("total_leads_saved"),
        F.bround(F.coalesce(F.avg(rate), F.lit(0.0)), 4).alias("average_success_rate"),
    )


def jobs_by(jobs: DataFrame, column: str) -> DataFrame:
    """Number of jobs per status, or per source if each job lists its sources."""
    value = F.explode(column) if dict(jobs.dtypes)[column].startswith("array") else F.col(column)
    return jobs.select(value.alias(column)).groupBy(column).agg(F.count(F.lit(1)).alias("jobs"))
