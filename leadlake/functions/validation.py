"""Lead validation: per-field scores, issues, suggestions and derived facts, all as one struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake import fixed_values as fv
from leadlake.functions.common import any_of, contains_any, filled, flags, strip
from leadlake.functions.contact import (
    EMAIL_WHOLE,
    PHONE_INTERNATIONAL,
    PHONE_WITH_AREA,
    PHONE_WITH_BRACKETS,
    url_domain,
    url_scheme,
)



def _facts(*triples: tuple[Column, str, Column]) -> Column:
    return F.array(
        *[F.when(cond, F.struct(F.lit(k).alias("key"), v.alias("value"))) for cond, k, v in triples]
    )


def company_check(company: Column) -> tuple[Column, Column]:
    name = strip(company)
    low = F.lower(name)
    missing, short = ~filled(company), F.length(name) < 2
    placeholder = low.isin(fv.PLACEHOLDER_COMPANIES)
    long_name = F.length(name) > 100
    base = F.when(placeholder, F.lit(0.1)).when(long_name, F.lit(0.5)).otherwise(F.lit(0.8))
    bonus = F.when(contains_any(low, fv.BUSINESS_SUFFIXES), base + F.lit(0.2)).otherwise(base)
    score = F.when(missing | short, F.lit(0.0)).otherwise(F.least(bonus, F.lit(1.0)))
    issues = flags(
        (missing, "Missing company name"),
        (~missing & short, "Company name too short"),
        (~missing & long_name, "Company name unusually long"),
        (~missing & ~short & placeholder, "Company name appears to be placeholder"),
    )
    return score, issues


def email_check(email: Column) -> tuple[Column, Column, Column]:
    mail = F.lower(strip(email))
    given = filled(email)
    valid = given & F.coalesce(F.rlike(mail, F.lit(EMAIL_WHOLE)), F.lit(False))
    domain = F.substring_index(mail, "@", -1)
    mailbox = F.substring_index(mail, "@", 1)
    personal = domain.isin(fv.VALIDATOR_PERSONAL_DOMAINS)
    system = contains_any(mailbox, fv.SYSTEM_MAILBOX_WORDS)
    score = (
        F.when(~valid, F.lit(0.0))
        .when(system, F.lit(0.2))
        .when(personal, F.lit(0.3))
        .otherwise(F.lit(1.0))
    )
    issues = flags(
        (given & ~valid, "Invalid email format"),
        (valid & personal, "Personal email domain detected"),
        (valid & system, "Email appears to be system/admin email"),
    )
    facts = _facts(
        (valid, "email_domain", domain),
        (valid & ~personal, "is_business_email", F.lit("true")),
    )
    return score, issues, facts


def phone_check(phone: Column) -> tuple[Column, Column, Column]:
    number = strip(phone)
    digits = F.regexp_replace(number, r"[^0-9]", "")
    given = filled(phone)
    short, long_number = F.length(digits) < 8, F.length(digits) > 15
    usable = given & F.coalesce(~short & ~long_number, F.lit(False))
    local_form = any_of(
        F.rlike(number, F.lit(f"^(?:{p})")) for p in (PHONE_INTERNATIONAL, PHONE_WITH_BRACKETS, PHONE_WITH_AREA)
    )
    area = F.substring(digits, 1, 2)
    known = area.isin(fv.AREA_CODES)
    with_form = F.lit(0.6) + F.when(local_form, F.lit(0.4)).otherwise(F.lit(0.0))
    with_area = with_form + F.when(known, F.lit(0.2)).otherwise(F.lit(0.0))
    score = F.when(usable, F.least(with_area, F.lit(1.0))).otherwise(F.lit(0.0))
    issues = F.array_compact(
        F.array(
            F.when(given & short, F.lit("Phone number too short")),
            F.when(given & long_number, F.lit("Phone number too long")),
            F.when(usable & ~known, F.concat(F.lit("Invalid Brazilian area code: "), area)),
        )
    )
    facts = _facts(
        (usable & local_form, "phone_format", F.lit("brazilian")),
        (usable, "area_code", area),
        (usable & known, "valid_area_code", F.lit("true")),
    )
    return score, issues, facts


def website_check(website: Column) -> tuple[Column, Column, Column]:
    url = strip(website)
    given = filled(website)
    scheme, host = url_scheme(url), url_domain(url)
    web = F.coalesce(scheme.isin("http", "https"), F.lit(False))
    usable = given & web & host.isNotNull()
    bare = F.replace(host, F.lit("www."), F.lit(""))
    business = F.coalesce(contains_any(bare, fv.BUSINESS_TLDS), F.lit(False))
    social = F.coalesce(contains_any(bare, fv.SOCIAL_DOMAINS), F.lit(False))
    secure = F.coalesce(scheme == "https", F.lit(False))
    base = F.lit(0.6) + F.when(business, F.lit(0.3)).otherwise(F.lit(0.0))
    base = F.when(social, F.lit(0.2)).otherwise(base)
    total = base + F.when(secure, F.lit(0.1)).otherwise(F.lit(0.0))
    score = F.when(usable, F.least(total, F.lit(1.0))).otherwise(F.lit(0.0))
    issues = flags(
        (given & scheme.isNull(), "Missing URL scheme (http/https)"),
        (given & scheme.isNotNull() & ~web, "Invalid URL scheme"),
        (given & web & host.isNull(), "Missing domain in URL"),
        (usable & social, "Website appears to be social media or search engine"),
    )
    facts = _facts(
        (usable, "website_domain", host),
        (usable & business, "business_domain", F.lit("true")),
        (usable & secure, "secure_website", F.lit("true")),
    )
    return score, issues, facts


def location_check(location: Column) -> tuple[Column, Column]:
    place = strip(location)
    given = filled(location)
    short = F.length(place) < 2
    in_state = contains_any(F.upper(place), fv.STATES)
    in_city = contains_any(F.lower(place), [c.lower() for c in fv.MAJOR_CITIES])
    total = F.lit(0.5) + F.when(in_state, F.lit(0.3)).otherwise(F.lit(0.0))
    total = total + F.when(in_city, F.lit(0.2)).otherwise(F.lit(0.0))
    score = F.when(given & ~short, F.least(total, F.lit(1.0))).otherwise(F.lit(0.0))
    return score, flags((given & short, "Location too short"))


def suggestions_for(issues: Column, email: Column, phone: Column) -> Column:
    def has(*labels: str) -> Column:
        return any_of(F.array_contains(issues, F.lit(x)) for x in labels)

    return flags(
        (has("Missing company name"), "Try to extract company name from website title or domain"),
        (has("Personal email domain detected"), "Look for alternative business email on company website"),
        (has("Invalid email format"), "Verify email format and try alternative extraction methods"),
        (
            has("Phone number too short", "Phone number too long"),
            "Validate phone number format and try alternative extraction",
        ),
        (
            ~filled(email) & ~filled(phone),
            "Lead has no contact information - consider skipping or finding alternative sources",
        ),
    )


def validate_lead(fields: dict[str, Column]) -> Column:
    """Struct ``is_valid, confidence_score, issues, suggestions, enhanced`` for one lead row."""
    company, company_issues = company_check(fields["company"])
    email, email_issues, email_facts = email_check(fields["email"])
    phone, phone_issues, phone_facts = phone_check(fields["phone"])
    website, website_issues, website_facts = website_check(fields["website"])
    location, location_issues = location_check(fields["location"])
    confidence = (
        company * F.lit(0.3) + email * F.lit(0.25) + phone * F.lit(0.2) + website * F.lit(0.15) + location * F.lit(0.1)
    )
    issues = F.concat(company_issues, email_issues, phone_issues, website_issues, location_issues)
    named = filled(fields["company"]) & F.coalesce(F.length(strip(fields["company"])) >= 2, F.lit(False))
    facts = F.array_compact(F.concat(email_facts, phone_facts, website_facts))
    return F.struct(
        ((confidence >= 0.4) & named).alias("is_valid"),
        F.least(confidence, F.lit(1.0)).alias("confidence_score"),
        issues.alias("issues"),
        suggestions_for(issues, fields["email"], fields["phone"]).alias("suggestions"),
        F.map_from_entries(facts).alias("enhanced"),
    )
