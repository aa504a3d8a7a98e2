"""Text functions used by the index and by query parsing (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake import fixed_values as fv
from leadlake.functions.common import any_of, blank_to_null, filled, first_group_match, let, str_array

# One replacement does both "other characters become a space" and "collapse spaces".
# ASCII ranges come first, as most characters are found there.
_NOT_INDEX_CHARS = r"[^a-z0-9_\-\p{L}\p{N}]+"
_NOT_QUERY_CHARS = r"[^a-z0-9_\"\-\p{L}\p{N}]+"
_NOT_SCRAPE_CHARS = r"[^\p{L}\p{N}_.,()-]+"
_SPACES = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
_QUOTED = '"([^"]*)"'
# Anchored at a word start and possessive, so a word without a digit is given up after one pass.
_WORD_WITH_DIGIT = r"(?<![\p{L}\p{N}_])[\p{L}_[\p{N}&&[^0-9]]]*+[0-9][\p{L}\p{N}_]*+"


def _clean(text: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), pattern, " "))


def clean_index_text(text: Column) -> Column:
    """Lower case, keep letters, digits, ``_`` and ``-``, single spaces."""
    return _clean(text, _NOT_INDEX_CHARS)


def clean_query_text(text: Column) -> Column:
    """As :func:`clean_index_text`, but double quotes survive for phrase search."""
    return _clean(text, _NOT_QUERY_CHARS)


def clean_scrape_text(text: Column) -> Column:
    """Lower case, keep letters, digits, ``_``, ``-``, ``.``, ``,`` and brackets."""
    return _clean(text, _NOT_SCRAPE_CHARS)


def squeeze_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " "))


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty text has none."""
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def _content_words(found: Column) -> Column:
    return F.array_except(F.filter(found, lambda w: F.length(w) >= 2), str_array(fv.STOP_WORDS))


def tokenize(text: Column) -> Column:
    """Distinct words of at least two characters that are not stop words, sorted."""
    return F.sort_array(_content_words(F.split(text, _SPACES)))


def tokenize_cleaned(cleaned: Column, other: Column | None = None) -> Column:
    """:func:`tokenize` for a text of :func:`clean_index_text`, whose words are one plain space apart, and any other text behind it."""
    found = F.split(cleaned, " ")
    return F.sort_array(_content_words(found if other is None else F.concat(found, F.split(other, _SPACES))))


def _has_word(text: Column, choices: list[str]) -> Column:
    pattern = rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(choices)})($|[^\p{{L}}\p{{N}}_])"
    return F.rlike(text, F.lit(pattern))


def implicit_industry(cleaned_query: Column) -> Column:
    return first_group_match(cleaned_query, fv.IMPLICIT_INDUSTRIES, _has_word)


def implicit_location(cleaned_query: Column) -> Column:
    return first_group_match(cleaned_query, fv.IMPLICIT_LOCATIONS, _has_word)


def implicit_size(cleaned_query: Column) -> Column:
    return first_group_match(cleaned_query, fv.IMPLICIT_SIZES, _has_word)


def parse_query(text: Column) -> Column:
    """Struct of terms, phrases and the filters the words imply."""
    cleaned = clean_query_text(text)
    without_phrases = F.regexp_replace(cleaned, _QUOTED, "")
    return F.struct(
        tokenize(without_phrases).alias("terms"),
        F.regexp_extract_all(cleaned, F.lit(_QUOTED), F.lit(1)).alias("phrases"),
        implicit_industry(cleaned).alias("industry"),
        implicit_location(cleaned).alias("location"),
        implicit_size(cleaned).alias("company_size"),
    )


def keyword_candidates(text: Column, max_keywords: int = 10) -> Column:
    """Capitalised words, words with a digit and acronyms, cleaned; first ``max_keywords`` in order."""
    capitalised = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][a-z]+\b"), F.lit(0))
    technical = F.regexp_extract_all(text, F.lit(r"(?U)\b\w*[0-9]\w*\b|\b[A-Z]{2,}\b"), F.lit(0))
    cleaned = F.transform(F.concat(capitalised, technical), clean_index_text)
    kept = F.array_except(F.filter(cleaned, lambda w: F.length(w) >= 3), str_array(fv.STOP_WORDS))
    return F.slice(F.array_sort(kept), 1, max_keywords)


def description_keywords(cleaned_description: Column, max_keywords: int = 10) -> Column:
    """Keywords of an already lower-cased text: there only words with a digit can qualify."""
    found = F.regexp_extract_all(cleaned_description, F.lit(_WORD_WITH_DIGIT), F.lit(0))
    kept = F.array_except(F.filter(found, lambda w: F.length(w) >= 3), str_array(fv.STOP_WORDS))
    return F.slice(F.array_sort(kept), 1, max_keywords)


def frequent_words(text: Column, max_keywords: int = 10) -> Column:
    """Most frequent words longer than three letters; ties keep the order of first appearance.

    Sorting tagged words makes equal words adjacent, so counting stays linear after one sort.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(lowered, F.lit(r"(?U)\b[a-z]{4,}\b"), F.lit(0))
    stop = str_array(fv.FREQUENCY_STOP_WORDS)
    tagged = F.array_sort(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    top = let(
        tagged,
        lambda all_words: let(
            F.filter(all_words, lambda t, k: (k == 0) | (F.get(all_words, k - 1)["w"] != t["w"])),
            lambda firsts: F.transform(
                F.slice(
                    # Stop words are dropped here, where each word is left only once.
                    F.array_sort(F.filter(_with_counts(all_words, firsts), lambda t: ~F.array_contains(stop, t["w"]))),
                    1,
                    max_keywords,
                ),
                lambda t: t["w"],
            ),
        ),
    )
    empty = F.array().cast("array<string>")
    return F.when(F.length(F.coalesce(text, F.lit(""))) < 10, empty).otherwise(top)


def _with_counts(all_words: Column, firsts: Column) -> Column:
    """(minus count, position, word) for each run of equal words in a sorted array."""
    run_starts = F.filter(
        F.transform(all_words, lambda t, k: F.when((k == 0) | (F.get(all_words, k - 1)["w"] != t["w"]), k)),
        lambda k: k.isNotNull(),
    )
    return let(
        run_starts,
        lambda starts: F.transform(
            firsts,
            lambda t, n: F.struct(
                (F.get(starts, n) - F.coalesce(F.get(starts, n + 1), F.size(all_words))).alias("minus_count"),
                t["i"].alias("i"),
                t["w"].alias("w"),
            ),
        ),
    )


def word_jaccard(left: Column, right: Column) -> Column:
    """Shared words over all words of two texts, 0 when either has none."""
    a, b = F.array_distinct(words(left)), F.array_distinct(words(right))
    share = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), share).otherwise(F.lit(0.0))


def expand_query(query: Column) -> Column:
    """Up to five longer queries suggested by industry stems and city names in ``query``."""
    low = F.lower(query)
    parts = []
    for stem, extra in fv.QUERY_EXPANSIONS:
        fresh = F.filter(str_array(extra), lambda t: ~F.contains(low, t))
        longer = F.transform(fresh, lambda t: F.concat(query, F.lit(" "), t))
        parts.append(F.when(F.contains(low, F.lit(stem)), longer).otherwise(str_array([])))
    has_city = any_of(F.contains(low, F.lit(c)) for c in fv.EXPANSION_CITIES)
    areas = F.array(*[F.concat(query, F.lit(f" {a}")) for a in fv.EXPANSION_AREAS])
    parts.append(F.when(has_city, areas).otherwise(str_array([])))
    usable = F.coalesce(F.length(query) >= 2, F.lit(False))
    return F.when(usable, F.slice(F.concat(*parts), 1, 5)).otherwise(str_array([]))


def request_hash(*parts: Column) -> Column:
    """Stable hash of a search request; equal requests give equal hashes."""
    named = F.struct(*[p.alias(f"p{i:02d}") for i, p in enumerate(parts)])
    return F.md5(F.to_json(named, {"ignoreNullFields": "false"}))


def merge_filter(explicit: Column, implicit: Column) -> Column:
    """An explicit filter wins over one implied by the query text."""
    return F.coalesce(blank_to_null(explicit), implicit)


def highlight(text: Column, terms: Column, phrases: Column) -> Column:
    """``text`` with every search term wrapped in ``<mark>``; null when nothing matches."""
    marked = F.aggregate(
        F.concat(terms, phrases),
        text,
        lambda acc, t: F.when(
            F.contains(F.lower(text), F.lower(t)),
            F.regexp_replace(
                acc,
                F.concat(F.lit(r"(?iu)\Q"), t, F.lit(r"\E")),
                F.concat(F.lit("<mark>"), t, F.lit("</mark>")),
            ),
        ).otherwise(acc),
    )
    return F.when(filled(text) & F.contains(marked, F.lit("<mark>")), marked)

