"""Contact-data functions: e-mail, phone, URL, company name, location, completeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake import fixed_values as fv
from leadlake.functions.common import (
    any_of,
    contains_any,
    filled,
    keep_if,
    let,
    match,
    str_array,
)
from leadlake.functions.text import clean_scrape_text, frequent_words, squeeze_spaces, word_jaccard, words

# --- fixed values: patterns ------------------------------------------------------------------
EMAIL_IN_TEXT = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMAIL_WHOLE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_INTERNATIONAL = r"\+55\s*[0-9]{2}\s*[0-9]{4,5}-?[0-9]{4}"
PHONE_WITH_BRACKETS = r"\([0-9]{2}\)\s*[0-9]{4,5}-?[0-9]{4}"
PHONE_WITH_AREA = r"[0-9]{2}\s*[0-9]{4,5}-?[0-9]{4}"
PHONE_LOCAL = r"[0-9]{4,5}-?[0-9]{4}"
_SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.-]*):"
_NETLOC = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def extract_email(text: Column, skip_words: list[str] | None = None) -> Column:
    """First e-mail address without a skip word in it, lower-cased; null when there is none."""
    skip = skip_words or fv.EMAIL_SKIP_WORDS
    found = F.regexp_extract_all(text, F.lit(EMAIL_IN_TEXT), F.lit(0))
    usable = F.filter(found, lambda e: ~contains_any(F.lower(e), skip))
    return F.when(F.contains(text, F.lit("@")), F.lower(F.get(usable, F.lit(0))))


def _first_match(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[match(text, p, 0) for p in patterns])


def extract_phone(text: Column) -> Column:
    """First Brazilian phone number with an area code, international form preferred."""
    return _first_match(text, [PHONE_INTERNATIONAL, PHONE_WITH_BRACKETS, PHONE_WITH_AREA])


def extract_phone_br(text: Column) -> Column:
    """As :func:`extract_phone`, also accepting local numbers; inner spaces are collapsed."""
    found = _first_match(text, [PHONE_INTERNATIONAL, PHONE_WITH_BRACKETS, PHONE_WITH_AREA, PHONE_LOCAL])
    return F.regexp_replace(found, r"\s+", " ")


def normalize_phone(phone: Column) -> Column:
    """``+55`` form for numbers with a known mobile area code, otherwise unchanged."""
    cleaned = F.regexp_replace(phone, r"[^0-9+]", "")
    known_area = any_of(F.startswith(cleaned, F.lit(c)) for c in fv.MOBILE_AREA_CODES)
    return (
        F.when(~filled(phone), F.lit(None).cast("string"))
        .when(F.startswith(cleaned, F.lit("+55")), cleaned)
        .when(F.length(cleaned).isin(10, 11) & known_area, F.concat(F.lit("+55"), cleaned))
        .otherwise(phone)
    )


def email_domain(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", -1))


def is_business_email(email: Column) -> Column:
    return filled(email) & ~F.coalesce(email_domain(email).isin(fv.PERSONAL_EMAIL_DOMAINS), F.lit(False))


def is_valid_business_email(email: Column) -> Column:
    """Well-formed and not at a personal mail provider."""
    return F.coalesce(F.rlike(email, F.lit(EMAIL_WHOLE)), F.lit(False)) & is_business_email(email)


def url_scheme(url: Column) -> Column:
    return F.lower(match(url, _SCHEME))


def url_domain(url: Column) -> Column:
    """Host part in lower case, null when the text has none."""
    return F.lower(match(url, _NETLOC))


def url_domain_bare(url: Column) -> Column:
    """Host part without ``www.``, the key for comparing sites."""
    return keep_if(F.replace(url_domain(url), F.lit("www."), F.lit("")), lambda v: v != "")


def is_valid_url(url: Column) -> Column:
    return url_scheme(url).isNotNull() & url_domain(url).isNotNull()


def is_company_site(url: Column) -> Column:
    """A full URL whose host is not a portal, a market place or a directory."""
    return is_valid_url(url) & ~F.coalesce(contains_any(url_domain(url), fv.LISTING_DOMAINS), F.lit(False))


def is_company_result_link(url: Column) -> Column:
    """The check applied to links of a search-result page: host, length and ending."""
    host = url_domain(url)
    ending = any_of(F.endswith(host, F.lit(t)) for t in fv.COMPANY_SITE_ENDINGS)
    return F.coalesce(~contains_any(host, fv.NON_COMPANY_DOMAINS) & (F.length(host) >= 4) & ending, F.lit(False))


def is_business_website(url: Column) -> Column:
    host = url_domain(url)
    return F.coalesce(url_scheme(url).isin("http", "https") & ~contains_any(host, fv.SOCIAL_DOMAINS), F.lit(False))


def unwrap_redirect(url: Column) -> Column:
    """Target of a search-result redirect (parameter ``uddg``, decoded twice)."""

    def decoded(raw: Column) -> Column:
        return F.coalesce(F.try_url_decode(raw), raw)

    def decoded_again(text: Column) -> Column:
        # The second decoding must leave "+" alone.
        return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)

    target = let(match(url, r"[?&]uddg=([^&#]*)"), lambda raw: let(decoded(raw), decoded_again))
    return F.coalesce(target, url)


def normalize_company(name: Column) -> Column:
    """Lower-cased company name without legal suffixes, for comparison."""
    pattern = rf"(?U)\b(?:{'|'.join(fv.LEGAL_SUFFIXES)})\b\.?"
    return squeeze_spaces(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), pattern, ""))


def clean_company(name: Column) -> Column:
    """Company name without legal suffixes, case kept."""
    pattern = rf"(?iU)\b(?:{'|'.join(fv.LEGAL_SUFFIXES_LONG)})\b\.?"
    return squeeze_spaces(F.regexp_replace(F.coalesce(name, F.lit("")), pattern, ""))


def company_words(name: Column) -> Column:
    """Sorted distinct words of the cleaned, lower-cased name: the key for name similarity."""
    return F.array_sort(F.array_distinct(words(clean_company(F.lower(name)))))


def company_similarity(left: Column, right: Column) -> Column:
    return word_jaccard(normalize_company(left), normalize_company(right))


def _first_listed(found: Column, choices: list[str]) -> Column:
    """The earliest of ``choices`` that is among ``found``."""
    return F.get(F.filter(str_array(choices), lambda c: F.array_contains(found, c)), F.lit(0))


def extract_location_br(text: Column) -> Column:
    """A known city, with the state that follows it if any; else a bare state code."""
    upper = F.upper(text)
    states = "|".join(fv.STATES)
    tries = []
    for city in fv.CITIES:
        with_state = F.regexp_extract_all(upper, F.lit(rf"{city.upper()}[,\s]*({states})"), F.lit(1))
        state = let(with_state, lambda found: _first_listed(found, fv.STATES))
        full = F.coalesce(F.concat(F.lit(f"{city}, "), state), F.lit(city))
        tries.append(F.when(F.contains(upper, F.lit(city.upper())), full))
    bare = F.regexp_extract_all(upper, F.lit(rf"[ ,]({states})"), F.lit(1))
    return F.coalesce(*tries, let(bare, lambda found: _first_listed(found, fv.STATES)))


def extract_location_page(text: Column) -> Column:
    """``City, ST`` or the city of a street address in page text; else a known city name."""
    city_state = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),\s*([A-Z]{2})"
    street = r"Rua\s+[^,]+,\s*[^,]+,\s*([^,]+)"
    avenue = r"Av\.\s+[^,]+,\s*[^,]+,\s*([^,]+)"
    pair = F.concat(match(text, city_state, 1), F.lit(", "), F.regexp_extract(text, city_state, 2))
    cities = [F.when(F.contains(text, F.lit(c)), F.lit(c)) for c in fv.MAJOR_CITIES]
    return F.coalesce(
        pair,
        match(text, street),
        match(text, avenue),
        *cities,
    )


def completeness(fields: dict[str, Column], last: str = "contact") -> Column:
    """Weighted share of filled fields, 0 to 1; ``last`` names the field of the final 0.05."""
    total = F.lit(0.0)
    for name, weight in fv.COMPLETENESS_WEIGHTS + [(last, 0.05)]:
        has = filled(fields[name]) if name in fields else F.lit(False)
        total = total + F.when(has, F.lit(weight)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


def format_record(raw: dict[str, Column]) -> dict[str, Column]:
    """Cleaned fields of a raw record; e-mail, phone and website are dropped unless usable."""
    out = {
        name: F.when(filled(raw[name]), clean_scrape_text(raw[name]))
        for name in ("company", "contact", "description", "industry", "location", "address")
        if name in raw
    }
    if "email" in raw:
        email = extract_email(raw["email"], fv.EMAIL_SKIP_WORDS_STRICT)
        out["email"] = F.when(is_business_email(email), email)
    if "phone" in raw:
        out["phone"] = extract_phone_br(raw["phone"])
    if "website" in raw:
        out["website"] = F.when(is_company_site(raw["website"]), raw["website"])
    out["data_quality_score"] = completeness(dict(out), last="contact")
    return out


def enhance_record(raw: dict[str, Column]) -> dict[str, Column]:
    """Company cleaned, unusable e-mail and website removed, phone normalised; rest unchanged."""
    out = dict(raw)
    if "company" in raw:
        out["company"] = F.when(filled(raw["company"]), clean_company(raw["company"])).otherwise(raw["company"])
    if "email" in raw:
        out["email"] = F.when(is_valid_business_email(raw["email"]), raw["email"])
    if "phone" in raw:
        out["phone"] = F.when(filled(raw["phone"]), normalize_phone(raw["phone"])).otherwise(raw["phone"])
    if "website" in raw:
        out["website"] = F.when(is_business_website(raw["website"]), raw["website"])
    return out


def lead_keywords(description: Column, company: Column, limit: int = 10) -> Column:
    """Frequent words of the description and long words of the company name, first ``limit`` sorted."""
    empty = str_array([])
    from_text = F.when(filled(description), frequent_words(description)).otherwise(empty)
    from_name = F.filter(words(F.lower(F.coalesce(company, F.lit("")))), lambda w: F.length(w) > 2)
    return F.slice(F.array_sort(F.array_distinct(F.concat(from_text, from_name))), 1, limit)


def headcount(text: Column) -> Column:
    """``n+`` from texts such as ``1,200 employees``; the first known word that is present decides."""
    low = F.lower(text)
    result = None
    for word in fv.HEADCOUNT_WORDS:
        number = match(low, rf"([0-9]+[0-9,]*)\s*{word}")
        value = F.concat(F.replace(number, F.lit(","), F.lit("")), F.lit("+"))
        cond = F.contains(low, F.lit(word)) & number.isNotNull()
        result = F.when(cond, value) if result is None else result.when(cond, value)
    return result


def rating_number(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9]+\.?[0-9]*)", 1).try_cast("double")


def first_number(text: Column) -> Column:
    """First run of digits as a number, null when there is none or it does not fit."""
    return F.regexp_extract(text, r"([0-9]+)", 1).try_cast("long")


