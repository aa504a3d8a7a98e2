"""Lead filters: listing, structured and keyword filters, free text, prefix, facet selection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions.common import all_of, any_of
from leadlake.sources.tables import tenant_scan


@dataclass(frozen=True)
class LeadFilters:
    """Structured filters of a request; empty ones do not apply."""

    industry: str | None = None
    location: str | None = None
    company_size: str | None = None
    revenue_range: str | None = None
    keywords: list[str] = field(default_factory=list)


_FILTER_COLUMNS = [
    ("industry", "industry"),
    ("location", "location"),
    ("company_size", "employees"),
    ("revenue_range", "revenue"),
]
_TEXT_COLUMNS = ["company", "industry", "description"]


def ilike_contains(col: Column, needle: Column) -> Column:
    """Case-insensitive "contains"; ``%`` and ``_`` in the needle act as wildcards."""
    no_escape = F.lit("\u0001")
    return F.coalesce(F.ilike(col, F.concat(F.lit("%"), needle, F.lit("%")), no_escape), F.lit(False))


def ilike_prefix(col: Column, prefix: Column) -> Column:
    return F.coalesce(F.ilike(col, F.concat(prefix, F.lit("%")), F.lit("\u0001")), F.lit(False))


def text_matches(text: str) -> Column:
    """Free text: company, industry or description contains it."""
    return any_of(ilike_contains(F.col(c), F.lit(text)) for c in _TEXT_COLUMNS)


def matches_filters(filters: LeadFilters) -> Column:
    """All given filters hold; each keyword may be in company, description or industry."""
    tests = [F.lit(True)]
    for name, column in _FILTER_COLUMNS:
        value = getattr(filters, name)
        if value:
            tests.append(ilike_contains(F.col(column), F.lit(value)))
    tests += [text_matches(k) for k in filters.keywords or []]
    return all_of(tests)


def matches_filter_columns(industry: Column, location: Column, company_size: Column) -> Column:
    """As :func:`matches_filters` with one set of filters per row; null means "any"."""
    pairs = [("industry", industry), ("location", location), ("employees", company_size)]
    return all_of(wanted.isNull() | (wanted == "") | ilike_contains(F.col(c), wanted) for c, wanted in pairs)


def filter_leads(leads: DataFrame, filters: LeadFilters) -> DataFrame:
    return leads.filter(matches_filters(filters))


def text_filter(leads: DataFrame, text: str) -> DataFrame:
    return leads.filter(text_matches(text))


def list_leads(
    leads: DataFrame,
    skip: int = 0,
    limit: int = 100,
    industry: str | None = None,
    status: str | None = None,
    location: str | None = None,
    user_id: int | None = None,
) -> DataFrame:
    """A page of leads, newest first; ties by id."""
    found = filter_leads(tenant_scan(leads, user_id), LeadFilters(industry=industry, location=location))
    if status:
        found = found.filter(F.col("status") == status)
    return found.orderBy(F.col("created_at").desc_nulls_last(), "id").offset(skip).limit(limit)


def get_lead(leads: DataFrame, lead_id: int, user_id: int | None = None) -> DataFrame:
    return tenant_scan(leads, user_id).filter(F.col("id") == lead_id)


def company_prefix(leads: DataFrame, prefix: str) -> DataFrame:
    return leads.filter(ilike_prefix(F.col("company"), F.lit(prefix)))


def facet_selection(selection: dict[str, list[str]], base: LeadFilters | None = None) -> LeadFilters:
    """Filters from facet choices: the first value of each facet replaces the request's own."""
    base = base or LeadFilters()

    def first(facet: str, own: str | None) -> str | None:
        values = selection.get(facet) or []
        return values[0] if values else own

    return LeadFilters(
        industry=first("industries", base.industry),
        location=first("locations", base.location),
        company_size=first("company_sizes", base.company_size),
        revenue_range=first("revenue_ranges", base.revenue_range),
        keywords=list(base.keywords),
    )
