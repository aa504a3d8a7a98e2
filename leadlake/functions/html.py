"""Reading company facts out of raw HTML with built-in expressions (no Python per row)."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake import fixed_values as fv
from leadlake.functions.common import all_of, contains_any, first_group_match, keep_if, let, match
from leadlake.functions.contact import url_domain
from leadlake.functions.text import squeeze_spaces

# --- fixed values: patterns ------------------------------------------------------------------
HIDDEN_BLOCKS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<![^>]*>"
ANY_TAG = r"(?s)</?[A-Za-z][^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*>"
ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)[^>]*>.*?</a\s*>"
ANCHOR_HREF = r"(?is)^<a\b[^>]*?\bhref\s*=\s*[\"']?([^\s>\"']*)"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
H1 = r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"
HEADER = r"(?is)<header\b[^>]*>(.*?)</header\s*>"
TITLE_TAIL = r"(?iu)\s*[-|]\s*(Home|Início|Welcome).*$"


# Characters that mean something in markup: decoded only once the tags are gone.
_MARKUP_REFS = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def _entity_map() -> Column:
    """Name to character for every reference that cannot be mistaken for markup, as one literal."""
    kept = {name: chr(code) for name, code in name2codepoint.items() if name not in ("lt", "gt", "quot", "amp")}
    return F.from_json(F.lit(json.dumps(kept)), "map<string,string>")


def _code_point(number: Column) -> Column:
    text = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    for ref, char in _MARKUP_REFS:
        text = F.when(number == ord(char), F.lit(ref)).otherwise(text)
    return text


def _decode_piece(piece: Column) -> Column:
    """Text after an ampersand, with the character reference at its start decoded."""
    ref = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
    rest = F.substr(piece, F.length(ref) + F.lit(2))
    decimal = F.substr(ref, F.lit(2)).try_cast("int")
    hexadecimal = F.conv(F.substr(ref, F.lit(3)), 16, 10).try_cast("int")
    number = F.when(F.rlike(ref, F.lit("^#[xX]")), hexadecimal).otherwise(decimal)
    usable = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.when(F.startswith(ref, F.lit("#")), F.when(usable, _code_point(number))).otherwise(
        F.try_element_at(_entity_map(), ref)
    )
    return F.coalesce(F.when(ref != "", F.concat(char, rest)), F.concat(F.lit("&"), piece))


def decode_references(markup: Column) -> Column:
    """Markup with named and numeric references decoded, except those of markup characters."""
    pieces = F.split(markup, "&")
    decoded = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(_decode_piece(p)))
    return F.when(F.contains(markup, F.lit("&")), F.array_join(decoded, "")).otherwise(markup)


def unescape(text: Column) -> Column:
    """Last step on text taken out of markup: the markup characters themselves, the ampersand last."""
    for ref, char in _MARKUP_REFS:
        text = F.replace(text, F.lit(ref), F.lit(char))
    return text


def without_hidden(html: Column) -> Column:
    """Markup without comments, scripts, styles and declarations; see also :func:`decode_references`."""
    return F.regexp_replace(html, HIDDEN_BLOCKS, "")


def text_of(markup: Column) -> Column:
    """Text of a piece of markup; neighbouring elements are joined without a space."""
    return unescape(F.regexp_replace(markup, ANY_TAG, ""))


def _between(text: Column, low: int, high: int) -> Column:
    """The text if its length is strictly between the bounds."""
    return keep_if(text, lambda t: (F.length(t) > low) & (F.length(t) < high))


def _class_element(markup: Column, name: str) -> Column:
    pattern = (
        rf"(?is)<([a-z][a-z0-9]*)\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{name}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1\s*>"
    )
    return match(markup, pattern, 2)


def _id_element(markup: Column, name: str) -> Column:
    pattern = rf"(?is)<([a-z][a-z0-9]*)\b[^>]*\bid\s*=\s*[\"']?{name}[\"'\s>][^>]*>?(.*?)</\1\s*>"
    return match(markup, pattern, 2)


def attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    value = F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))
    return unescape(keep_if(value, lambda v: v != ""))


def _logo_name(markup: Column) -> Column:
    by_alt = F.regexp_extract(markup, r"(?s)<(?i:img)\b[^>]*\s(?i:alt)\s*=\s*[\"'][^\"']*logo[^\"']*[\"'][^>]*>", 0)
    by_class = F.regexp_extract(markup, r"(?s)<(?i:img)\b[^>]*\s(?i:class)\s*=\s*[\"'][^\"']*logo[^\"']*[\"'][^>]*>", 0)
    img = r"(?is)<img\b[^>]*>"
    in_logo = F.regexp_extract(_class_element(markup, "logo"), img, 0)
    in_header = F.regexp_extract(F.regexp_extract(markup, HEADER, 1), img, 0)
    alts = [_between(attribute(tag, "alt"), 2, 50) for tag in (by_alt, by_class, in_logo, in_header)]
    return squeeze_or_null(F.coalesce(*alts))


def squeeze_or_null(text: Column) -> Column:
    return keep_if(squeeze_spaces(text), lambda t: t != "")


def _heading_name(markup: Column) -> Column:
    h1 = match(markup, H1)
    in_header = match(F.regexp_extract(markup, HEADER, 1), H1)
    found = [h1, _class_element(markup, "company-name"), _class_element(markup, "brand-name"), in_header]
    return F.coalesce(*[_between(squeeze_or_null(text_of(m)), 2, 100) for m in found])


def _name_from_domain(url: Column) -> Column:
    host = F.replace(F.replace(url_domain(url), F.lit("www."), F.lit("")), F.lit(".com"), F.lit(""))
    # initcap works per space-separated word: open a gap after every other character, then close it.
    gapped = F.regexp_replace(host, r"([^\p{L}]+)", "$1 ")
    return F.replace(F.initcap(gapped), F.lit(" "), F.lit(""))


def company_name(markup: Column, url: Column) -> Column:
    """Page title without its "- Home" tail, else logo text, else main heading, else the host."""
    title = F.regexp_replace(squeeze_or_null(unescape(F.regexp_extract(markup, TITLE, 1))), TITLE_TAIL, "")
    return F.coalesce(
        _between(title, 2, 100), _logo_name(markup), _heading_name(markup), _name_from_domain(url)
    )


def anchors(markup: Column) -> Column:
    """Array of (href, text) of the links of a page, in order."""
    return F.transform(
        F.regexp_extract_all(markup, F.lit(ANCHOR), F.lit(0)),
        lambda a: F.struct(
            unescape(F.regexp_extract(a, ANCHOR_HREF, 1)).alias("href"),
            F.lower(text_of(a)).alias("text"),
        ),
    )


def social_links(links: Column) -> tuple[Column, Column, Column]:
    """First professional-network, social-network and micro-blog link; one link serves one site only."""

    def first(site: str, *taken: Column) -> Column:
        hits = F.transform(
            links,
            lambda a, i: F.when(F.contains(F.lower(a["href"]), F.lit(site)) & all_of([F.lit(True)] + [i != t for t in taken]), i),
        )
        return F.coalesce(F.array_min(hits), F.lit(-1))

    linkedin = first("linkedin.com")
    facebook = first("facebook.com", linkedin)
    twitter = first("twitter.com", linkedin, facebook)
    return tuple(F.get(links, i)["href"] for i in (linkedin, facebook, twitter))


def _resolve_path(path: Column) -> Column:
    """Remove "." and ".." steps from an absolute path."""
    steps = F.split(path, "/")
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.least(F.size(acc), F.lit(1)))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(F.rlike(path, F.lit(r"/\.{1,2}$")), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), tail)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*/)", 1)
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (
        F.when(href == "", base)
        .when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .when(F.startswith(href, F.lit("?")), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, let(path, _resolve_path), tail))
        .otherwise(
            let(
                F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path),
                lambda whole: F.concat(root, _resolve_path(whole), tail),
            )
        )
    )


def contact_pages(links: Column, url: Column) -> Column:
    """Distinct links on the same host whose address or text speaks of contact or the company."""

    def speaks_of_contact(link: Column) -> Column:
        both = F.concat(F.lower(link["href"]), F.lit("\n"), link["text"])
        return F.rlike(both, F.lit("|".join(fv.CONTACT_PAGE_WORDS)))

    absolute = F.transform(F.filter(links, speaks_of_contact), lambda a: resolve_url(url, a["href"]))
    same_host = F.filter(absolute, lambda u: F.coalesce(url_domain(u) == url_domain(url), F.lit(False)))
    return F.array_distinct(same_host)


def meta_description(markup: Column) -> Column:
    tag = F.regexp_extract(markup, r"(?is)<meta\b[^>]*\sname\s*=\s*[\"']?description[\"'\s/][^>]*>", 0)
    return squeeze_or_null(keep_if(attribute(tag, "content"), lambda c: F.length(c) > 20))


def about_text(markup: Column) -> Column:
    """Text of the first about-like section that is neither a stub nor a whole page."""
    first, *others = fv.ABOUT_CLASSES
    found = [_class_element(markup, first), _id_element(markup, "about")]
    found += [_class_element(markup, name) for name in others]
    return F.coalesce(*[_between(squeeze_or_null(text_of(m)), 50, 500) for m in found])


def page_description(markup: Column) -> Column:
    """An about section wins over the meta description."""
    return F.coalesce(about_text(markup), meta_description(markup))


def page_industry(page_text: Column) -> Column:
    return first_group_match(F.lower(page_text), fv.PAGE_INDUSTRIES, contains_any)

