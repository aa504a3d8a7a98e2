"""Relevance search: one request, or a whole log of requests, as a single DataFrame plan."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake import fixed_values as fv
from leadlake.functions.common import any_of, filled, flags, let, str_array
from leadlake.functions.scoring import (
    Taste,
    Wanted,
    default_taste,
    freshness_score,
    industry_score,
    location_score,
    quality_score,
    relevance,
    size_score,
    weighted_sum,
)
from leadlake.functions.text import (
    clean_index_text,
    highlight,
    merge_filter,
    parse_query,
    tokenize,
    tokenize_cleaned,
)
from leadlake.operators.filters import (
    LeadFilters,
    facet_selection,
    ilike_contains,
    matches_filter_columns,
    matches_filters,
)
from leadlake.operators.index import (
    contains_all_terms,
    index_keys,
    leads_with_all_tokens,
    may_contain_terms,
    with_index_metadata,
)
from leadlake.operators.metrics import result_facets, timestamp
from leadlake.operators.suffixes import containing
from leadlake.operators.suggestions import related_queries
from leadlake.session import spread, stored
from leadlake.sources.tables import tenant_scan


@dataclass(frozen=True)
class SearchRequest:
    text: str | None = None
    filters: LeadFilters = field(default_factory=LeadFilters)
    sort_by: str = "relevance"
    limit: int = 20
    offset: int = 0


@dataclass(frozen=True)
class ParsedRequest:
    """A request after parsing: plain values, so that every predicate in the plan is a literal."""

    terms: list[str]
    phrases: list[str]
    filters: LeadFilters

    @property
    def search_terms(self) -> list[str]:
        return self.terms + self.phrases

    def wanted(self) -> Wanted:
        f = self.filters
        text = [F.lit(v).cast("string") for v in (f.industry, f.location, f.company_size)]
        return Wanted(str_array(self.terms), str_array(self.phrases), *text)


def parse_request(spark, request: SearchRequest) -> ParsedRequest:
    """Parse the request text with the same expressions a query log uses (one row, no data read)."""
    row = spark.range(1).select(parse_query(F.lit(request.text or "")).alias("q")).first()["q"]
    given = request.filters
    merged = LeadFilters(
        industry=given.industry or row["industry"],
        location=given.location or row["location"],
        company_size=given.company_size or row["company_size"],
        revenue_range=given.revenue_range,
        keywords=list(given.keywords or []),
    )
    return ParsedRequest(list(row["terms"]), list(row["phrases"]), merged)


def _text_tokens() -> Column:
    both = F.concat_ws(" ", clean_index_text(F.col("company")), clean_index_text(F.col("description")))
    return tokenize_cleaned(both)


def full_text_match(terms: Column, phrases: Column, mode: str = "any", tokens: Column | None = None) -> Column:
    """Word match in company or description, or the first term inside company or industry.

    Words are compared as written (no stemming). ``any``: one term, or all words of one phrase, is
    enough. ``all``: every term and phrase is needed.
    """
    tokens = _text_tokens() if tokens is None else tokens
    phrase_words = F.transform(phrases, lambda p: tokenize_cleaned(clean_index_text(p)))

    def phrase_hit(ws: Column) -> Column:
        return (F.size(ws) > 0) & (F.size(F.array_except(ws, tokens)) == 0)

    if mode == "any":
        words_hit = F.arrays_overlap(tokens, terms) | F.exists(phrase_words, phrase_hit)
    else:
        words_hit = (F.size(F.array_except(terms, tokens)) == 0) & F.forall(phrase_words, phrase_hit)
    first = F.get(F.concat(terms, phrases), F.lit(0))
    inside = ilike_contains(F.col("company"), first) | ilike_contains(F.col("industry"), first)
    return F.coalesce(words_hit, F.lit(False)) | inside


def candidates_full_text(leads: DataFrame, parsed: ParsedRequest, mode: str = "any") -> DataFrame:
    """Leads that match the text (all leads if there is none) and the filters."""
    found = leads.filter(matches_filters(parsed.filters))
    if parsed.search_terms:
        found = found.filter(full_text_match(str_array(parsed.terms), str_array(parsed.phrases), mode))
    return found


def _may_match(leads: DataFrame, parsed: ParsedRequest) -> Column:
    """Cheap necessary condition for any hit: some search word is a substring of the raw text."""
    words = sorted({w for t in parsed.search_terms for w in t.split()})
    first = F.lit(parsed.search_terms[0])
    inside = ilike_contains(F.col("company"), first) | ilike_contains(F.col("industry"), first)
    return any_of([inside] + [may_contain_terms(leads, [w]) for w in words])


def _with_tier(leads: DataFrame, parsed: ParsedRequest, mode: str, postings: DataFrame | None) -> DataFrame:
    """Filtered candidates; tier 1 = in the index under every term, tier 0 = full-text match only."""
    kept = leads.filter(matches_filters(parsed.filters))
    terms, phrases = str_array(parsed.terms), str_array(parsed.phrases)
    if not parsed.search_terms:
        return kept.withColumn("tier", F.lit(0))
    text_hit = full_text_match(terms, phrases, mode)
    if not parsed.terms:
        return kept.filter(text_hit).withColumn("tier", F.lit(0))
    if postings is not None:
        ids = leads_with_all_tokens(postings, parsed.terms).select(F.col("lead_id").alias("id"), F.lit(1).alias("in_index"))
        marked = kept.join(ids, "id", "left")
        # texts are split into words only where the index has no hit and the substring test passes
        tier = F.when(F.col("in_index") == 1, F.lit(1)).when(_may_match(kept, parsed) & text_hit, F.lit(0))
    else:
        # Tokens are only built for rows that pass the substring test.
        marked = with_index_metadata(kept.filter(_may_match(kept, parsed)))
        in_index = may_contain_terms(kept, parsed.terms) & contains_all_terms(terms)
        tier = F.when(in_index, F.lit(1)).when(text_hit, F.lit(0))
    return marked.withColumn("tier", tier).filter(F.col("tier").isNotNull())


_SHOWN = ["id", "company", "contact", "email", "phone", "website", "industry", "location", "revenue", "employees", "description"]


def _presentation(wanted: Wanted, score: Column) -> list[Column]:
    marks = [highlight(F.col(c), wanted.terms, wanted.phrases).alias(f"highlighted_{c}") for c in fv.HIGHLIGHT_FIELDS]
    return [
        F.floor(score * 100).cast("int").alias("score"),
        F.lit(fv.LEAD_STATUS_NEW).alias("status"),
        F.when(score > 0.8, F.lit(fv.PRIORITY_HIGH)).otherwise(F.lit(fv.PRIORITY_MEDIUM)).alias("priority"),
        *marks,
    ]


def search(
    leads: DataFrame,
    request: SearchRequest,
    as_of: datetime,
    taste: Taste | None = None,
    postings: DataFrame | None = None,
    mode: str = "any",
) -> DataFrame:
    """Ranked page of leads for a request, at any offset.

    Index hits win: full-text hits count only if the index has none. Sorting the tiers first lets
    one bounded top-k decide that, so the leads are read once and nothing is shuffled but the top
    rows of each partition.
    """
    parsed = parse_request(leads.sparkSession, request)
    wanted = parsed.wanted()
    score, reasons = relevance(wanted, taste or default_taste(), timestamp(as_of))
    scored = (
        _with_tier(leads, parsed, mode, postings)
        .withColumn("relevance_score", score)
        .select(*_SHOWN, "indexed_at", "created_at", "tier", "relevance_score")
    )
    if request.sort_by == "created_at":
        order = [F.col("indexed_at").desc_nulls_last(), F.col("id")]
    elif request.sort_by == "relevance":
        order = [F.col("relevance_score").desc(), F.col("id")]
    else:
        order = [F.col("id")]
    positive = F.col("relevance_score") > 0
    top = scored.orderBy(F.col("tier").desc(), positive.desc(), *order).limit(request.offset + request.limit)
    # From here on there are no more rows than the page ends at.
    best = top.withColumn("best", F.max("tier").over(Window.partitionBy())).filter((F.col("tier") == F.col("best")) & positive)
    placed = best.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(*order)))
    page = placed.filter((F.col("position") > request.offset) & (F.col("position") <= request.offset + request.limit))
    return page.select(
        "position",
        *_SHOWN,
        "indexed_at",
        "relevance_score",
        reasons.alias("match_reasons"),
        *_presentation(wanted, F.col("relevance_score")),
    )


def advanced_search(
    leads: DataFrame,
    request: SearchRequest,
    as_of: datetime,
    facet_choices: dict[str, list[str]] | None = None,
    taste: Taste | None = None,
    postings: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results under facet choices, facets of those results, and labels for the search as a whole."""
    choices = facet_choices or {}
    narrowed = SearchRequest(
        request.text, facet_selection(choices, request.filters), request.sort_by, request.limit, request.offset
    )
    results = search(leads, narrowed, as_of, taste, postings)
    complexity = "high" if len(choices) > 2 else "medium" if choices else "low"
    top = F.max_by("relevance_score", -F.col("position"))
    labels = results.agg(
        F.count(F.lit(1)).alias("total_results"),
        F.lit(complexity).alias("query_complexity"),
        F.when(top > 0.8, F.lit("high")).otherwise(F.lit("medium")).alias("result_quality"),
    )
    return results, result_facets(results), labels


# --- many requests at once -------------------------------------------------------------------


def parse_log(queries: DataFrame) -> DataFrame:
    """A query log (query_id, query_text and optional filter columns) with parsed terms and merged filters."""
    q = parse_query(F.col("query_text"))
    # parsing is all the work here: the few bytes of a log must not put it into one task
    parsed = spread(queries, "query_id", "query_text").withColumn("_q", q)

    def merged(name: str) -> Column:
        implied = F.col(f"_q.{name}")
        return merge_filter(F.col(name), implied) if name in queries.columns else implied

    return parsed.select(
        "query_id",
        "query_text",
        *(["user_id"] if "user_id" in queries.columns else []),
        F.col("_q.terms").alias("terms"),
        F.col("_q.phrases").alias("phrases"),
        merged("industry").alias("want_industry"),
        merged("location").alias("want_location"),
        merged("company_size").alias("want_size"),
    )


#: Leads of one posting block, about, and blocks of a query that are scored before its threshold is known.
BLOCK_LEADS, FIRST_BLOCKS = 256, 4
#: Terms and phrase words of a request, at most, that are told apart in the marks of a pair.
SLOTS = 8
_BLOCK = ["quality", "fresh", "shard"]


def _rarest_term(log: DataFrame, postings: DataFrame) -> DataFrame:
    """For each query the term with the fewest postings; queries with an unknown term drop out."""
    terms = log.select("query_id", F.explode("terms").alias("token"))
    known = postings.join(terms.select("token").distinct(), "token", "left_semi")
    frequency = known.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    counted = terms.join(frequency, "token", "left")
    least = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))
    return (
        counted.groupBy("query_id").agg(least.alias("t")).filter(F.col("t.df") > 0).select("query_id", F.col("t.token").alias("token"))
    )


def build_log_index(leads: DataFrame) -> DataFrame:
    """What a search over a query log looks up per lead: index keys and text words."""
    return with_index_metadata(leads, text_tokens=True).select("id", index_keys().alias("keys"), "text_tokens")


def _first_piece() -> Column:
    """The longest literal piece of a query's first search term; empty if it is made of wildcards only."""
    pieces = F.split(F.get(F.concat("terms", "phrases"), F.lit(0)), r"[^\p{L}\p{N}-]+")
    return F.array_max(F.transform(pieces, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]


def _phrase_words() -> Column:
    return F.transform("phrases", lambda p: tokenize_cleaned(clean_index_text(p)))


def _looked_up(log: DataFrame) -> DataFrame:
    """(query_id, term, role, nth): "term" for search terms, "word" for words of phrases, "piece" for that of the first term;
    ``nth`` numbers the terms and behind them the words of a query."""
    phrase_words = F.flatten(_phrase_words())

    def listed(values: Column, role: str, before: Column = F.lit(0)) -> Column:
        return F.transform(F.array_distinct(values), lambda v, i: F.struct(v.alias("term"), F.lit(role).alias("role"), (before + i).alias("nth")))

    first = F.when(F.length(_first_piece()) > 0, F.array(_first_piece())).otherwise(str_array([]))
    every = F.concat(listed(F.col("terms"), "term"), listed(phrase_words, "word", F.size("terms")), listed(first, "piece"))
    return log.select("query_id", F.inline(every))


def _field_words(name: str, bit: int) -> Column:
    """The different words of a text field, marked with its bit; and whether the text begins with the word."""
    listed = F.filter(F.split(clean_index_text(F.col(name)), " "), lambda w: w != "")

    def marked(field: Column) -> Column:
        head = F.get(field["words"], F.lit(0))
        first = F.when(F.startswith(field["text"], head), head)
        # each value is computed once for a text, not for each of its words
        return let(first, lambda f: F.transform(
            F.array_distinct(field["words"]), lambda w: F.struct(w.alias("word"), F.lit(bit).alias("field"), F.coalesce(w == f, F.lit(False)).alias("first"))
        ))

    return let(F.struct(listed.alias("words"), F.lower(F.col(name)).alias("text")), marked)


def impact_postings(leads: DataFrame, terms: DataFrame, as_of: datetime, block_leads: int = BLOCK_LEADS) -> DataFrame:
    """(term, quality, fresh, shard, id, impact, whole, in_name, fields, leading): every lead with a text field that contains a term.

    ``fields`` and ``leading`` have a bit for each text field that contains the term, and that begins with it. ``impact`` is what the term
    adds to the text score, exactly: a field contains a term if one of its words does. ``whole`` says
    that the term is a word of company or description, ``in_name`` that company or industry contains it. Leads of equal quality
    and freshness are a class, cut into shards of about ``block_leads``; so all leads of a block share these two parts of the score.
    """
    fields = [_field_words(name, 1 << k) for k, (name, _) in enumerate(fv.TEXT_FIELD_WEIGHTS)]
    size = leads.count()
    shards = max(1, size // (4 * block_leads))  # there are few classes, and the larger ones count
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")
    words = stored(leads.select("id", quality_score()[0].alias("quality"), freshness_score(timestamp(as_of))[0].alias("fresh"), shard, F.inline(F.concat(*fields))), "field-words")
    one = F.lit(0).cast("bigint").alias("scope")
    found = containing(words.select(one, F.col("word").alias("text")), terms.select(one, F.col("term").alias("piece")))
    # written first, so that its size tells whether all words have to move for it
    matched = stored(found.select(F.col("text").alias("word"), F.col("piece").alias("term")), "matched-terms")
    met = words.join(matched, "word")
    leading = F.col("first") & F.startswith("word", F.col("term"))
    both = met.groupBy("term", *_BLOCK, "id").agg(
        F.bit_or("field").alias("fields"), F.bit_or(F.when(leading, F.col("field")).otherwise(F.lit(0))).alias("leading"),
        F.max((F.col("word") == F.col("term")) & (F.col("field").bitwiseAND(F.lit(1 | 2)) != 0)).alias("whole"),
    )
    impact = F.lit(0.0)
    for k, (_, weight) in enumerate(fv.TEXT_FIELD_WEIGHTS):
        has = lambda c, k=k: F.col(c).bitwiseAND(F.lit(1 << k)) != 0
        impact = impact + F.when(has("leading"), F.lit(weight * 0.8)).when(has("fields"), F.lit(weight * 0.5)).otherwise(F.lit(0.0))
    in_name = F.col("fields").bitwiseAND(F.lit(1 | 4)) != 0
    return both.select("term", *_BLOCK, "id", impact.alias("impact"), "whole", in_name.alias("in_name"), "fields", "leading")


def _block_bounds(postings: DataFrame, lookups: DataFrame, log: DataFrame, taste: Taste) -> DataFrame:
    """(query_id, block, bound): no lead of the block scores higher for the query."""
    best = postings.groupBy("term", *_BLOCK).agg(F.max("impact").alias("impact"), F.max("whole").alias("whole"), F.max("in_name").alias("in_name"))
    met = best.join(lookups, "term")
    adds = F.when(F.col("role") == "term", F.col("impact")).otherwise(F.lit(0.0))
    can = F.when(F.col("role") == "piece", F.col("in_name")).otherwise(F.col("whole"))
    per_block = met.groupBy("query_id", *_BLOCK).agg(F.sum(adds).alias("text"), F.max(can).alias("can")).filter("can")
    bound = _at_best(F.least(F.col("text") + F.size("phrases"), F.lit(1.0)), taste)
    return per_block.join(log, "query_id").select("query_id", *_BLOCK, bound.alias("bound"))


def _at_best(text: Column, taste: Taste) -> Column:
    """The score of a lead with this text score whose industry, location and size are what the query asks for, if it asks."""
    best = lambda want, liked: (filled(F.col(want)) | (F.size(liked) > 0)).cast("double")
    parts = [best("want_industry", taste.industries), best("want_location", taste.locations), best("want_size", F.array())]
    return weighted_sum(text, *parts, F.col("quality"), F.col("fresh"), taste)


def _pairs_in(blocks: DataFrame, postings: DataFrame, lookups: DataFrame) -> DataFrame:
    """(query_id, id) of the leads of some blocks that a query's words or first term can match."""
    asked = blocks.select("query_id", *_BLOCK).join(lookups, "query_id")
    can = F.when(F.col("role") == "piece", F.col("in_name")).otherwise(F.col("whole"))
    return asked.join(postings, ["term", *_BLOCK]).filter(can).select("query_id", "id").distinct()


def _marked(log: DataFrame) -> DataFrame:
    """Requests with the number (``nth`` of :func:`_looked_up`) of each word of each phrase, with ``exact``: whether postings tell what each
    term and word adds, and ``sure``: whether they alone answer the request, which has no phrase and no wildcard in its first term."""
    words = F.array_distinct(F.flatten(_phrase_words()))
    numbers = F.transform(_phrase_words(), lambda ws: F.transform(ws, lambda w: (F.size("terms") + F.array_position(words, w) - 1).cast("int")))
    alone = F.count(F.lit(1)).over(Window.partitionBy("query_id")) == 1  # postings are met by the id of a request
    wild = F.contains(F.get(F.concat("terms", "phrases"), F.lit(0)), F.lit("_"))
    marked = log.withColumns({"phrase_words": numbers, "wild": wild, "alone": alone, "exact": alone & (F.size("terms") + F.size(words) <= SLOTS)})
    return marked.withColumn("sure", F.col("exact") & (F.size("phrases") == 0) & ~F.col("wild"))


def _held(marks: str, bit: int) -> Column:
    return F.size(F.filter(marks, lambda m: m.bitwiseAND(F.lit(bit)) != 0))


def _rated_pairs(blocks: DataFrame, postings: DataFrame, lookups: DataFrame, log: DataFrame, taste: Taste) -> DataFrame:
    """(query_id, block, id, text, bound, sure) of the leads of some blocks that may match a query: what postings tell of them.

    ``text`` is the text score of a ``sure`` query, summed in the order of :func:`text_score`; else it is not below it, as a phrase counts
    in every field that holds all its words. ``bound`` is what the lead can score at most. All leads of a ``sure`` query match.
    """
    # few bytes that become many pairs
    asked = spread(blocks.select("query_id", *_BLOCK), "query_id", *_BLOCK).join(lookups, "query_id")
    marks = F.col("fields").bitwiseOR(F.shiftleft("leading", 4)).bitwiseOR(F.shiftleft(F.col("whole").cast("int"), 8))
    piece = F.col("role") == "piece"
    slots = [F.coalesce(F.max(F.when(~piece & (F.col("nth") == i), marks)), F.lit(0)).alias(f"slot_{i}") for i in range(SLOTS)]
    met = asked.join(postings, ["term", *_BLOCK]).groupBy("query_id", *_BLOCK, "id")
    pairs = met.agg(*slots, F.coalesce(F.max(piece & F.col("in_name")), F.lit(False)).alias("named"), F.max(~piece & F.col("whole")).alias("worded"))
    pairs = pairs.filter("named or worded").join(log.dropDuplicates(["query_id"]), "query_id")

    def has(marks: Column, bit: int) -> Column:
        return marks.bitwiseAND(F.lit(bit)) != 0

    terms = [(F.lit(i) < F.size("terms"), F.col(f"slot_{i}")) for i in range(SLOTS)]
    every = F.array(*[f"slot_{i}" for i in range(SLOTS)])
    # the marks that all words of a phrase share; a phrase without words may be anywhere, but words do not match it
    shared = F.transform("phrase_words", lambda ws: F.when(F.size(ws) == 0, F.lit(15)).otherwise(F.aggregate(ws, F.lit(511), lambda a, i: a.bitwiseAND(F.get(every, i)))))
    pairs = pairs.withColumn("shared", F.when(F.size("phrases") > 0, shared).otherwise(F.array().cast("array<int>")))
    text = F.lit(0.0)
    for k, (_, weight) in enumerate(fv.TEXT_FIELD_WEIGHTS):
        for is_term, slot in terms:
            share = F.when(has(slot, 16 << k), F.lit(weight * 0.8)).when(has(slot, 1 << k), F.lit(weight * 0.5)).otherwise(F.lit(0.0))
            text = text + F.when(is_term, share).otherwise(F.lit(0.0))
        text = text + _held("shared", 1 << k) * F.lit(weight)
    text = F.when(F.col("exact"), F.least(text, F.lit(1.0))).otherwise(F.lit(1.0)).alias("text")
    # the first phrase is in company or industry only if all its words are
    first = F.col("wild") | (F.size("terms") > 0) | has(F.get("shared", F.lit(0)), 1 | 4)
    worded = any_of(is_term & has(slot, 256) for is_term, slot in terms) | F.exists("shared", lambda m: m.bitwiseAND(F.lit(256)) != 0)
    can = ~F.col("exact") | worded | (F.col("named") & first)
    rated = pairs.filter(can).select("*", text)
    bound = F.when(F.col("alone"), _at_best(F.col("text"), taste)).otherwise(F.lit(1.0))
    return rated.select("query_id", *_BLOCK, "id", "text", bound.alias("bound"), "sure")


def search_log(
    leads: DataFrame,
    queries: DataFrame,
    as_of: datetime,
    limit: int = 20,
    index: DataFrame | None = None,
    taste: Taste | None = None,
    full_text: bool = True,
    tastes: DataFrame | None = None,
) -> DataFrame:
    """The top ``limit`` leads of every query of a log, by the same rules as :func:`search`.

    Texts are split into index keys once, into a table (pass ``index``, made by :func:`build_log_index`, to reuse one). The rarest term of a query looks up its
    index hits. Queries without any are answered by full text, in blocks of postings: each block has a bound of what its
    leads can score. The most promising blocks of a query are scored first; the score of its last place then rules
    out all blocks that cannot reach it, and only the others are read. Postings alone give the scores of queries of plain terms; those with
    phrases or a wildcard have the leads that can score most looked up first, and only those that can reach the last place after. A query without any search word is a listing under its
    filters; equal requests are searched once, and every one of them is answered.

    ``tastes`` (user_id, preferred_industries, preferred_locations, scoring_weights) ranks each query by the taste of its own
    user (column ``user_id`` of the log); users without a row have ``taste``.
    """
    request = ["query_text", "want_industry", "want_location", "want_size", *(["user_id"] if tastes is not None else [])]
    entries = stored(parse_log(queries), "query-log")
    alike = entries.groupBy(*request).agg(F.min("query_id").alias("query_id"), F.first("terms").alias("terms"), F.first("phrases").alias("phrases"))
    base = taste or default_taste()
    if tastes is not None:
        own = tastes.select("user_id", *[F.col(c).alias(f"taste_{i}") for i, c in enumerate(["preferred_industries", "preferred_locations", "scoring_weights"])])
        alike = alike.join(own.withColumn("known", F.lit(True)), "user_id", "left")
        chosen = [F.when(F.col("known"), F.col(f"taste_{i}")).otherwise(c) for i, c in enumerate((base.industries, base.locations, base.weights))]
        alike = alike.select(*request, "query_id", "terms", "phrases", *[F.coalesce(c, empty).alias(f"taste_{i}") for i, (c, empty) in enumerate(zip(chosen, (str_array([]), str_array([]), default_taste().weights)))])
        base = Taste(F.col("taste_0"), F.col("taste_1"), F.col("taste_2"))
    every = stored(alike, "requests")
    log = every.filter(F.size(F.concat("terms", "phrases")) > 0)
    given = index
    if index is None:
        index = stored(with_index_metadata(leads).select("id", index_keys().alias("keys")), "log-index")
    wanted = Wanted(F.col("terms"), F.col("phrases"), F.col("want_industry"), F.col("want_location"), F.col("want_size"))
    filters_hold = matches_filter_columns(wanted.industry, wanted.location, wanted.company_size)
    score, _ = relevance(wanted, base, timestamp(as_of))
    filter_fields = leads.select("id", "industry", "location", "employees")

    def scored(pairs: DataFrame) -> DataFrame:
        met = spread(pairs, "id").join(log, "query_id").join(leads.drop("user_id"), "id")
        return met.select("query_id", "query_text", "id", "company", score.alias("relevance_score")).filter(F.col("relevance_score") > 0)

    order = Window.partitionBy("query_id").orderBy(F.col("relevance_score").desc(), "id")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)

    keys = index.select(F.explode("keys").alias("token"), F.col("id").alias("lead_id"))
    # written first, so that its size tells whether all keys have to move for it
    rarest = stored(_rarest_term(log, keys), "rarest-terms")
    hits = keys.join(rarest, "token").select("query_id", F.col("lead_id").alias("id"))
    known = spread(hits, "id").join(index.select("id", "keys"), "id").join(log, "query_id").join(filter_fields, "id")
    # as contains_all_terms, which would make a set of a lead's keys for every hit; a lead has many keys, a query few terms
    has_all = F.forall("terms", lambda t: F.array_contains(F.col("keys"), t))
    found = stored(known.filter(has_all & filters_hold).select("query_id", "id"), "index-hits")
    ranked = best(scored(found))
    if full_text:
        open_log = stored(_marked(log.join(found.select("query_id").distinct(), "query_id", "left_anti")), "open-requests")
        matched = full_text_match(wanted.terms, wanted.phrases, tokens=F.col("text_tokens"))
        fields = leads.select("id", "company", "industry", "location", "employees")
        repeated = stored(leads.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "repeated-ids")
        any_repeated = not repeated.isEmpty()

        def words_of(pairs: DataFrame | None = None) -> DataFrame:
            """(id, text_tokens) of the index, or, once for each lead of the pairs, from its texts."""
            if given is not None:
                return given.select("id", "text_tokens")
            own = leads if pairs is None else leads.join(pairs.select("id").distinct(), "id", "left_semi")
            return own.select("id", _text_tokens().alias("text_tokens"))

        def answered(pairs: DataFrame) -> DataFrame:
            met = spread(pairs, "id").join(words_of(pairs), "id").join(open_log, "query_id").join(fields, "id")
            return scored(met.filter(matched & filters_hold).select("query_id", "id"))

        def rated(blocks: DataFrame) -> DataFrame:
            pairs = _rated_pairs(blocks, postings, lookups, open_log, base)
            # postings do not tell apart the leads of one id: these are looked up in the texts
            return pairs.join(repeated, "id", "left_anti") if any_repeated else pairs

        def exact(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
            """Scores of ``sure`` queries by postings, and of leads that share their id by their texts."""
            indexed = fields if given is None else fields.join(given.select("id"), "id")
            met = pairs.filter("sure").drop("sure").join(open_log, "query_id").join(indexed, "id").filter(filters_hold)
            parts = [industry_score(wanted, base)[0], location_score(wanted, base)[0], size_score(wanted)[0], F.col("quality"), F.col("fresh")]
            total = weighted_sum(F.col("text"), *parts, base)
            rows = met.select("query_id", "query_text", "id", "company", total.alias("relevance_score")).filter(F.col("relevance_score") > 0)
            if not any_repeated:
                return rows
            return rows.unionByName(answered(_pairs_in(blocks, postings, lookups).join(repeated, "id", "left_semi")))

        def reached_by(rows: DataFrame) -> DataFrame:
            return rows.filter(F.col("position") == limit).select("query_id", F.col("relevance_score").alias("reached"))

        # sums of fractions may differ in their last digits
        near = F.coalesce(F.col("bound") + 1e-9 >= F.col("reached"), F.lit(True))
        lookups = stored(_looked_up(open_log), "lookups")
        postings = stored(impact_postings(leads, lookups.select("term"), as_of), "impacts")
        bounds = stored(_block_bounds(postings, lookups, open_log, base), "bounds")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), *_BLOCK))
        # the first of a query are cut off in every task; its other blocks are never put in order
        first = stored(bounds.withColumn("place", place).filter(F.col("place") <= FIRST_BLOCKS).select("query_id", *_BLOCK), "leading-blocks")
        first_pairs = stored(rated(first), "first-pairs")
        leading = stored(best(exact(first_pairs, first)), "first-blocks")
        reached = reached_by(leading)
        may = bounds.join(first, ["query_id", *_BLOCK], "left_anti").join(reached, "query_id", "left").filter(near).select("query_id", *_BLOCK)
        rest_pairs = stored(rated(may).join(reached, "query_id", "left").filter(near).drop("reached"), "other-pairs")
        # phrases and wildcards are looked for in the texts, first of the leads that can score most
        unsure = first_pairs.unionByName(rest_pairs).filter("not sure").select("query_id", "id", "bound")
        ahead = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "id"))
        front = stored(unsure.withColumn("place", ahead).filter(F.col("place") <= FIRST_BLOCKS * limit).select("query_id", "id"), "leading-pairs")
        in_front = stored(best(answered(front)), "first-leads")
        behind = unsure.join(front, ["query_id", "id"], "left_anti").join(reached_by(in_front), "query_id", "left").filter(near)
        behind = stored(behind.select("query_id", "id"), "later-pairs")
        rows = [leading.drop("position"), exact(rest_pairs, may), in_front.drop("position"), answered(behind)]
        ranked = ranked.unionByName(best(functools.reduce(DataFrame.unionByName, rows)))
        # a first term of wildcards only may be in any name: such requests read all leads
        odd = open_log.filter(F.length(_first_piece()) == 0)
        if not odd.isEmpty():
            texts = leads.drop("user_id").join(words_of(), "id")
            met = texts.join(odd, matched & filters_hold)
            rows = met.select("query_id", "query_text", "id", "company", score.alias("relevance_score")).filter(F.col("relevance_score") > 0)
            ranked = ranked.join(odd.select("query_id"), "query_id", "left_anti").unionByName(best(rows))
        ranked = ranked.unionByName(best(_listings(leads, every.filter(F.size(F.concat("terms", "phrases")) == 0), wanted, base, as_of, limit)))
    same = [F.col(f"entry.{c}").eqNullSafe(F.col(f"searched.{c}")) for c in request]
    asked = entries.alias("entry").join(every.alias("searched"), same).select(F.col("entry.query_id").alias("entry_id"), F.col("searched.query_id").alias("query_id"))
    return asked.join(ranked, "query_id").drop("query_id").withColumnRenamed("entry_id", "query_id").select(*ranked.columns)


def _listings(leads: DataFrame, requests: DataFrame, wanted: Wanted, taste: Taste, as_of: datetime, limit: int) -> DataFrame:
    """Scored leads of requests without search words, which differ by filters alone.

    Their scores hang on industry, location, size, quality and freshness only. So the first ``limit`` ids of each such class stand
    for it, and requests meet the classes, not the leads.
    """
    parts = leads.select("id", "company", "industry", "location", "employees", quality_score()[0].alias("quality"), freshness_score(timestamp(as_of))[0].alias("fresh"))
    alike = Window.partitionBy("industry", "location", "employees", "quality", "fresh").orderBy("id")
    first = parts.withColumn("nth", F.row_number().over(alike)).filter(F.col("nth") <= limit).drop("nth")
    met = first.join(requests, matches_filter_columns(wanted.industry, wanted.location, wanted.company_size))
    score = weighted_sum(
        F.lit(0.0), industry_score(wanted, taste)[0], location_score(wanted, taste)[0], size_score(wanted)[0], F.col("quality"), F.col("fresh"), taste
    )
    return met.select("query_id", "query_text", "id", "company", score.alias("relevance_score")).filter(F.col("relevance_score") > 0)


# --- query analysis ---------------------------------------------------------------------------


def _word_bitmaps(words: DataFrame, matched: DataFrame) -> DataFrame:
    """(word, range, bits): the leads of each matched word as bitmaps over ranges of ids."""
    some = words.join(matched.select("word").distinct(), "word", "left_semi")
    by_range = some.groupBy("word", F.expr("bitmap_bucket_number(lead_id)").alias("range"))
    return by_range.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(lead_id))").alias("bits"))


def estimated_results(leads: DataFrame, queries: DataFrame, user_id: int | None = None) -> DataFrame:
    """For each query the largest number of leads any one of its terms occurs in (of one user, if ``user_id`` is given).

    Terms are tested inside the texts (not as whole words): the distinct words that contain a term are looked up in a table of
    suffixes. The leads of a word are bitmaps over ranges of ids, and the leads of a term are the union of the bitmaps of its
    words, so what is joined and counted are bitmaps and not lead rows.
    """
    own = tenant_scan(leads, user_id)
    log = stored(parse_log(queries), "query-log")
    # "_" in a term is a wildcard: such terms are looked up by their longest literal piece, if they have one.
    literal = F.array_max(F.transform(F.split("term", "_"), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    terms = log.select(F.explode("terms").alias("term")).distinct().withColumn("piece", literal)
    raw = F.concat_ws(" ", *[clean_index_text(F.col(c)) for c in ("company", "industry", "description")])
    words = stored(own.select(F.col("id").alias("lead_id"), F.explode(F.array_distinct(F.split(raw, " "))).alias("word")), "words")
    one = F.lit(0).cast("bigint").alias("scope")
    found = containing(words.select(one, F.col("word").alias("text")), terms.select(one, "piece"))
    matched = stored(found.select("piece", F.col("text").alias("word")), "matched-words")
    plain = terms.filter(~F.contains("term", F.lit("_")))
    bitmaps = _word_bitmaps(words, matched).join(matched.join(plain.select("piece"), "piece"), "word")
    united = bitmaps.groupBy("piece", "range").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    counts = united.groupBy(F.col("piece").alias("term")).agg(F.sum(F.bitmap_count("bits")).alias("n"))
    # Wildcards need the texts again: those of leads with a word that holds the piece, or lengths, if there is no piece.
    some = terms.filter(F.contains("term", F.lit("_")))
    texts = own.select(F.col("id").alias("lead_id"), "company", "industry", "description")
    hit = any_of(ilike_contains(F.col(c), F.col("term")) for c in ("company", "industry", "description"))
    met = some.filter(F.length("piece") > 0).join(matched, "piece").join(words, "word").select("term", "lead_id").distinct()
    wild = met.join(texts, "lead_id").filter(hit).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    longest = F.greatest(*[F.coalesce(F.length(c), F.lit(0)) for c in ("company", "industry", "description")])
    lengths = own.groupBy(longest.alias("longest")).agg(F.count(F.lit(1)).alias("leads"))
    blank = some.filter(F.length("piece") == 0).join(lengths, F.col("longest") >= F.length("term"))
    blank = blank.groupBy("term").agg(F.sum("leads").alias("n"))
    counts = counts.unionByName(wild).unionByName(blank)
    asked = log.select("query_id", "query_text", F.explode_outer("terms").alias("term"))
    return (
        asked.join(counts, "term", "left")
        .groupBy("query_id", "query_text")
        .agg(F.coalesce(F.max("n"), F.lit(0)).alias("estimated_results"))
    )


def query_analysis(queries: DataFrame) -> DataFrame:
    """Score, labels and advice for each query of a log."""
    log = parse_log(queries)
    n_terms, n_phrases = F.size("terms"), F.size("phrases")
    wanted = [F.col(c).isNotNull().cast("int") for c in ("want_industry", "want_location", "want_size")]
    n_filters = wanted[0] + wanted[1] + wanted[2]
    raw = F.lit(50) + F.least(n_terms * 10, F.lit(30)) + n_phrases * 15 + n_filters * 10
    score = F.least(raw, F.lit(100))
    analysed = log.withColumns({"n_terms": n_terms, "n_phrases": n_phrases, "n_filters": n_filters, "optimization_score": score})
    s = F.col("optimization_score")
    speed = F.when(s > 70, F.lit("fast")).when(s > 40, F.lit("medium")).otherwise(F.lit("slow"))
    cached = F.when((F.col("n_terms") <= 3) & (F.col("n_phrases") == 0), F.lit("high")).otherwise(F.lit("medium"))
    advice = flags(
        ((F.col("n_terms") == 1) & (F.col("n_phrases") == 0) & (F.col("n_filters") == 0), "specificity"),
        (F.col("n_terms") > 5, "simplification"),
    )
    values = [F.coalesce(F.lower(c), F.lit("")) for c in ("want_industry", "want_location", "want_size")]
    no_location = ~any_of(F.contains(v, F.lit("location")) for v in values)
    no_industry = ~any_of(F.contains(v, F.lit("industry")) for v in values)
    more = flags((no_location, "location_filter"), (no_industry, "industry_filter"))
    return analysed.select(
        "query_id",
        "query_text",
        "terms",
        "phrases",
        "n_filters",
        "optimization_score",
        speed.alias("expected_speed"),
        cached.alias("cache_likelihood"),
        F.when(s > 60, F.lit("high")).otherwise(F.lit("medium")).alias("result_quality"),
        F.concat(advice, more).alias("suggestions"),
    )


def query_report(leads: DataFrame, queries: DataFrame, popular: DataFrame, user_id: int | None = None, pool: int | None = None) -> DataFrame:
    """:func:`query_analysis` with an example for each piece of advice, the estimated results and the related queries in the row.

    Examples for location and industry name the most frequent ones among the leads (of one user, if ``user_id`` is given); without
    any, that advice is not given.
    """
    own = tenant_scan(leads, user_id)

    def most_frequent(column: str) -> Column:
        counts = own.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return counts.orderBy(F.col("n").desc(), column).limit(1).select(column).scalar()

    text = F.coalesce(F.col("query_text"), F.lit(""))
    kinds = {
        "specificity": (F.concat_ws(" ", text, F.lit(fv.BROAD_QUERY_EXAMPLE)), "high"),
        "simplification": (F.array_join(F.slice("terms", 1, 3), " "), "medium"),
        "location_filter": (F.concat(text, F.lit(" "), F.col("top_location")), "medium"),
        "industry_filter": (F.concat(text, F.lit(" "), F.col("top_industry")), "medium"),
    }
    listed = [
        F.when(F.array_contains("suggestions", kind) & example.isNotNull(), F.struct(F.lit(kind).alias("type"), example.alias("example"), F.lit(impact).alias("impact")))
        for kind, (example, impact) in kinds.items()
    ]
    analysed = query_analysis(queries).withColumns({"top_location": most_frequent("location"), "top_industry": most_frequent("industry")})
    advised = analysed.withColumn("advice", F.array_compact(F.array(*listed))).drop("suggestions", "top_location", "top_industry")
    estimates = estimated_results(leads, queries, user_id).select("query_id", "estimated_results")
    related = related_queries(queries, popular, pool).select("query_id", "related_queries")
    return advised.join(estimates, "query_id", "left").join(related, "query_id", "left")
