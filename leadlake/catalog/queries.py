"""The registered queries: each maps (session, folder of the sample tables) to a DataFrame.

Arrays and maps are shown as joined text so that results can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake import fixed_values as fv
from leadlake.catalog import derived as d
from leadlake.functions import contact as ct
from leadlake.functions import text as tx
from leadlake.functions.scoring import Taste, weight_map
from leadlake.functions.validation import validate_lead
from leadlake.operators import changes as ch
from leadlake.operators import duplicates as du
from leadlake.operators import events as ev
from leadlake.operators import filters as fl
from leadlake.operators import index as ix
from leadlake.operators import metrics as m
from leadlake.operators import preferences as pr
from leadlake.operators import suggestions as su
from leadlake.operators import summaries as sm
from leadlake.functions import predicates as p
from leadlake.plans import ingest as ing
from leadlake.plans import reports as rp
from leadlake.plans import search as se
from leadlake.session import stored
from leadlake.sources.sinks import read_postings, write_posting_blocks, write_postings
from leadlake.streaming import counters as sc
from leadlake.streaming import sinks as ss
from leadlake.streaming import upkeep as up
from leadlake.streaming import windows as sw

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LEADS_AT, EVENTS_AT = d.LEADS_AS_OF, d.EVENTS_AS_OF
SEARCH_TEXT = "small ring"
SEARCH_FILTERS = fl.LeadFilters(industry="BUILDING")

def joined(col: Column | str) -> Column:
    return F.array_join(F.col(col) if isinstance(col, str) else col, "|")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _metric(name: str, fn: Callable[..., DataFrame], *args, description: bool = False) -> None:
    QUERIES[name] = lambda spark, sf: fn(d.leads(spark, sf, description), *args)


# --- lead metrics -----------------------------------------------------------------------------
_metric("dashboard_metrics", m.dashboard_metrics, LEADS_AT)
_metric("average_roi", m.average_roi)
_metric("search_conversion", m.search_conversion)
_metric("leads_by_month", m.leads_by_month, LEADS_AT)
_metric("leads_by_month_sparse", m.leads_by_month, LEADS_AT.replace(month=12, day=30), 6)
_metric("period_trend", m.period_trend, LEADS_AT, "90d")
_metric("industry_breakdown", m.industry_breakdown)
_metric("source_metrics", m.source_metrics, description=True)
_metric("quality_scores", m.quality_scores, description=True)
_metric("score_bands", m.score_bands)
_metric("insights_industry", m.insights, "industry")
_metric("insights_location", m.insights, "location")
_metric("conversion_by_query_type", m.conversion_by_query_type, description=True)
_metric("conversion_by_industry", m.conversion_by_industry)
_metric("top_converting_filters", m.top_converting_filters)
_metric("top_converting_filters_variant", m.top_converting_filters_variant)
_metric("indexing_status", m.indexing_status, LEADS_AT)
_metric("indexing_coverage", m.indexing_coverage)
_metric("hourly_trend", m.hourly_trend, LEADS_AT.replace(day=1))
_metric("missing_fields", m.missing_fields, description=True)
_metric("contact_performance", m.contact_performance)
_metric("facets", m.facets)
_metric("facets_q", m.facets_for_text, "ring", description=True)


@query
def lead_flags(spark, sf):
    """Every lead with its yes/no predicates."""
    return d.leads(spark, sf).select(
        "id",
        p.is_qualified().alias("qualified"),
        p.is_high_quality().alias("high_quality"),
        p.is_blank_lead().alias("blank"),
        p.is_hard_to_find().alias("hard_to_find"),
        p.is_contacted().alias("contacted"),
    )


# --- filters ----------------------------------------------------------------------------------
@query
def lead_listing(spark, sf):
    page = fl.list_leads(d.leads(spark, sf, False), 10, 50, industry="build", status="Contatado", location="a")
    return page.select("id", "company", "industry", "location", "created_at")


@query
def filter_search(spark, sf):
    wanted = fl.LeadFilters("machinery", "asia", "51-200", "R$ 5M")
    return fl.filter_leads(d.leads(spark, sf, False), wanted).select("id", "company", "industry", "location", "employees", "revenue")


@query
def keyword_filter(spark, sf):
    wanted = fl.LeadFilters(keywords=["the", "r_ng"])
    return fl.filter_leads(d.leads(spark, sf), wanted).select("id", "company", "industry")


@query
def text_filter(spark, sf):
    return fl.text_filter(d.leads(spark, sf), "widget").select("id", "company")


@query
def company_prefix(spark, sf):
    return fl.company_prefix(d.leads(spark, sf, False), "SMALL r").select("id", "company")


@query
def lead_lookup(spark, sf):
    return fl.get_lead(d.leads(spark, sf, False), 42).select("id", "user_id", "company", "email", "score")


@query
def scrape_filter(spark, sf):
    """New records with the verdict of the required-field and head-count filter."""
    new = d.incoming(spark, sf)
    fields = {c: F.col(c) for c in ("company", "email", "employees")}
    return new.select("id", p.should_skip(fields, ["company"], 10, 60).alias("skip"), ct.first_number(F.col("employees")).alias("head_count"))


# --- index ------------------------------------------------------------------------------------
@query
def index_metadata(spark, sf):
    return ix.with_index_metadata(d.leads(spark, sf)).select(
        "id",
        "searchable_text",
        joined("company_tokens").alias("company_tokens"),
        joined("industry_tokens").alias("industry_tokens"),
        joined("location_tokens").alias("location_tokens"),
        joined("lead_keywords").alias("keywords"),
        joined("all_tokens").alias("all_tokens"),
    )


@query
def postings(spark, sf):
    return ix.build_postings(d.leads(spark, sf))


@query
def posting_lists(spark, sf):
    lists = ix.posting_lists(ix.build_postings(d.leads(spark, sf)))
    return lists.select("token", "chunk", F.size("lead_ids").alias("n_leads"), F.array_min("lead_ids").alias("first_id"), F.array_max("lead_ids").alias("last_id"))


@query
def token_intersection(spark, sf):
    return ix.leads_with_all_tokens(ix.build_postings(d.leads(spark, sf)), ["small", "ring", "industry:building"])


@query
def token_intersection_blocks(spark, sf):
    """The same from compressed posting blocks that were stored."""
    path, tokens = ss.work_folder(spark, "posting-blocks"), ["small", "ring", "industry:building"]
    write_posting_blocks(ix.posting_blocks(ix.build_postings(d.leads(spark, sf)), 1024), path, buckets=16)
    return ix.intersect_blocks(read_postings(spark, path, tokens, buckets=16), tokens)


@query
def index_stats(spark, sf):
    return ix.index_stats(d.leads(spark, sf))


@query
def incremental_index(spark, sf):
    found = ix.incremental_postings(d.leads(spark, sf))
    return found.groupBy("lead_id").agg(F.count(F.lit(1)).alias("n_tokens"))


@query
def index_removal(spark, sf):
    """Postings per token once the leads behind finished orders are gone."""
    gone = ch.latest_change(d.lead_changes(spark, sf), "id", "seq").filter(F.col("op") == "delete").select(F.col("id").alias("lead_id"))
    left = ix.remove_from_postings(ix.build_postings(d.leads(spark, sf)), gone)
    return left.groupBy("token").agg(F.count(F.lit(1)).alias("n_leads"))


# --- search -----------------------------------------------------------------------------------
def _request(**more) -> se.SearchRequest:
    return se.SearchRequest(SEARCH_TEXT, SEARCH_FILTERS, **more)


def _ranked(results: DataFrame) -> DataFrame:
    return results.select(
        "position", "id", "company", F.bround("relevance_score", 6).alias("relevance_score"), "score", "priority",
        joined("match_reasons").alias("match_reasons"),
    )


@query
def search_ranked(spark, sf):
    return _ranked(se.search(d.leads(spark, sf), _request(), LEADS_AT))


@query
def search_by_index_time(spark, sf):
    return _ranked(se.search(d.leads(spark, sf), _request(sort_by="created_at", limit=30, offset=5), LEADS_AT))


@query
def search_with_postings(spark, sf):
    """The same search answered from the inverted index."""
    data = d.leads(spark, sf)
    return _ranked(se.search(data, _request(), LEADS_AT, postings=ix.build_postings(data)))


@query
def search_stored_index(spark, sf):
    """The index is written once in token buckets; the search reads the buckets of its own terms."""
    data, path = d.leads(spark, sf), ss.work_folder(spark, "stored-index")
    write_postings(ix.build_postings(data), path, buckets=32)
    terms = se.parse_request(spark, _request()).terms
    return _ranked(se.search(data, _request(), LEADS_AT, postings=read_postings(spark, path, terms, buckets=32)))


@query
def candidates_by_index(spark, sf):
    """Lead rows by way of the index."""
    data = d.leads(spark, sf)
    found = ix.leads_with_all_tokens(ix.build_postings(data), ["small", "ring", "industry:building"])
    return ix.candidate_leads(data, found).select("id", "company", "industry")


@query
def stored_metadata(spark, sf):
    """Metadata of leads indexed before comes from a table, with a mark in its text; the rest is computed."""
    data = d.leads(spark, sf)
    before = ix.with_index_metadata(data.filter("id % 3 = 0")).withColumn("searchable_text", F.concat(F.lit("stored: "), "searchable_text"))
    found = ix.with_stored_metadata(data, before)
    return found.select("id", "searchable_text", joined("company_tokens").alias("company_tokens"), joined("all_tokens").alias("all_tokens"))


@query
def search_full_text(spark, sf):
    """No lead has every word, so full-text matching answers."""
    request = se.SearchRequest('widget "hot gear" unobtainable', fl.LeadFilters(location="europe"), limit=50)
    return _ranked(se.search(d.leads(spark, sf), request, LEADS_AT))


@query
def search_personal(spark, sf):
    """A search ranked with a user's favourites and weights."""
    taste = Taste(
        F.array(F.lit("BUILDING"), F.lit("MACHINERY")),
        F.array(F.lit("CHINA, ASIA"), F.lit("BRAZIL, AMERICA")),
        weight_map({"industry_match": 0.5, "text_relevance": 0.3, "location_proximity": 0.2}),
    )
    return _ranked(se.search(d.leads(spark, sf), se.SearchRequest("blue", limit=100), LEADS_AT, taste))


@query
def candidates_fts(spark, sf):
    data = d.leads(spark, sf)
    parsed = se.parse_request(spark, se.SearchRequest("red bolt", fl.LeadFilters(industry="auto")))
    return se.candidates_full_text(data, parsed).select("id", "company")


@query
def candidates_fts_all(spark, sf):
    data = d.leads(spark, sf)
    parsed = se.parse_request(spark, se.SearchRequest("red the bolt"))
    return se.candidates_full_text(data, parsed, mode="all").select("id", "company")


@query
def search_batch(spark, sf):
    """The top leads of every entry of the log. The leads are written first, as a log is searched over a table."""
    found = se.search_log(stored(d.leads(spark, sf), "leads"), d.query_log(spark, sf), LEADS_AT, limit=20)
    return found.select("query_id", "query_text", "position", "id", F.bround("relevance_score", 6).alias("relevance_score"))


@query
def highlights(spark, sf):
    terms, phrases = F.array(F.lit("mark"), F.lit("ring"), F.lit("small")), F.array(F.lit("the"))
    return d.leads(spark, sf).select(
        "id", *[tx.highlight(F.col(c), terms, phrases).alias(f"h_{c}") for c in fv.HIGHLIGHT_FIELDS]
    )


@query
def result_facets(spark, sf):
    return m.result_facets(se.search(d.leads(spark, sf), _request(limit=500), LEADS_AT))


@query
def advanced_search(spark, sf):
    choices = {"industries": ["MACHINERY", "BUILDING"], "company_sizes": ["11-50"]}
    results, _, _ = se.advanced_search(d.leads(spark, sf), se.SearchRequest("gear"), LEADS_AT, choices)
    return _ranked(results)


@query
def advanced_search_labels(spark, sf):
    choices = {"industries": ["MACHINERY"], "company_sizes": ["11-50"], "locations": ["ASIA"]}
    return se.advanced_search(d.leads(spark, sf), se.SearchRequest("gear"), LEADS_AT, choices)[2]


def _popular(spark, sf) -> DataFrame:
    """Popular searches: the part names, by number of parts."""
    parts = d.table(spark, sf, "part")
    return parts.groupBy(F.col("p_name").alias("query")).agg(F.count(F.lit(1)).alias("count"))


@query
def suggestions(spark, sf):
    return su.suggestions(d.leads(spark, sf, False), _popular(spark, sf), "Re", 12)


@query
def typed_suggestions(spark, sf):
    return su.typed_suggestions(d.leads(spark, sf, False), _popular(spark, sf), "in", 10)


@query
def related_queries(spark, sf):
    found = su.related_queries(d.raw_query_log(spark, sf), _popular(spark, sf), pool=10)
    return found.select("query_id", joined("related_queries").alias("related_queries"))


@query
def related_queries_all(spark, sf):
    """Related texts from all popular ones."""
    found = su.related_queries(d.raw_query_log(spark, sf), _popular(spark, sf))
    return found.select("query_id", joined("related_queries").alias("related_queries"))


@query
def estimated_results(spark, sf):
    return se.estimated_results(d.leads(spark, sf), d.raw_query_log(spark, sf))


@query
def parse_query_log(spark, sf):
    q = tx.parse_query(F.col("query_text"))
    return d.raw_query_log(spark, sf).withColumn("q", q).select(
        "query_id", joined("q.terms").alias("terms"), joined("q.phrases").alias("phrases"), "q.industry", "q.location", "q.company_size"
    )


@query
def query_analysis(spark, sf):
    found = se.query_analysis(d.raw_query_log(spark, sf))
    return found.select(
        "query_id", joined("terms").alias("terms"), "n_filters", "optimization_score", "expected_speed", "cache_likelihood",
        "result_quality", joined("suggestions").alias("suggestions"),
    )


@query
def query_report(spark, sf):
    """Analysis, advice with examples, estimate and related texts of each entry, in one row."""
    found = se.query_report(d.leads(spark, sf), d.raw_query_log(spark, sf), _popular(spark, sf))
    advice = F.transform("advice", lambda a: F.concat_ws(": ", a["type"], a["impact"], a["example"]))
    return found.select("query_id", "optimization_score", "estimated_results", joined("related_queries").alias("related_queries"), joined(advice).alias("advice"))


@query
def query_expansion(spark, sf):
    text = F.concat(F.col("query_text"), F.lit(" cont rest"))
    return d.raw_query_log(spark, sf).select("query_id", joined(tx.expand_query(text)).alias("expanded"))


@query
def query_dedup(spark, sf):
    """Equal requests of the log, found by their hash."""
    log = d.raw_query_log(spark, sf)
    keyed = log.withColumn("hash", tx.request_hash(F.lower("query_text"), F.lit("relevance"), F.lit(20)))
    return keyed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("query_id").alias("first_query")).drop("hash")


# --- events -----------------------------------------------------------------------------------
def _searches(spark, sf) -> DataFrame:
    return d.search_events(spark, sf)


@query
def search_summary(spark, sf):
    return ev.search_summary(_searches(spark, sf), EVENTS_AT, 30)


@query
def cache_hit_rate(spark, sf):
    return ev.cache_hit_rate(_searches(spark, sf))


@query
def popular_queries(spark, sf):
    return ev.popular_queries(_searches(spark, sf), EVENTS_AT)


@query
def popular_searches(spark, sf):
    return ev.popular_searches(_searches(spark, sf), 8)


@query
def realtime_activity(spark, sf):
    at = EVENTS_AT.replace(day=30, hour=23)
    return ev.realtime_activity(_searches(spark, sf), d.interactions(spark, sf), at)


@query
def todays_activity(spark, sf):
    at = EVENTS_AT.replace(day=30, hour=18)
    return ev.todays_activity(d.leads(spark, sf, False), _searches(spark, sf), at)


@query
def activity_feed(spark, sf):
    return ev.activity_feed(_searches(spark, sf), d.interactions(spark, sf))


@query
def lead_counters(spark, sf):
    counted = ev.update_lead_counters(d.leads(spark, sf, False), ev.lead_counters(d.interactions(spark, sf)))
    return counted.select("id", "view_count", "contact_count", "last_contact", F.bround("conversion_score", 6).alias("conversion_score"))


@query
def funnel(spark, sf):
    counted = ev.update_lead_counters(d.leads(spark, sf, False), ev.lead_counters(d.interactions(spark, sf)))
    return ev.conversion_funnel(counted)


@query
def click_attribution(spark, sf):
    clicks = d.clicks_from(d.table(spark, sf, "events"))
    return ev.attribute_clicks(_searches(spark, sf), clicks).select("id", "query_text", F.col("clicked_results").cast("long").alias("clicked_results"))


@query
def conversion_attribution(spark, sf):
    found = ev.attribute_conversions(_searches(spark, sf), d.conversions(spark, sf))
    return found.select("id", F.col("contacted_leads").cast("long").alias("contacted_leads"), F.col("converted_leads").cast("long").alias("converted_leads"))


@query
def event_defaults(spark, sf):
    """Events with gaps, completed for storage (the session id is random, so only its presence shows)."""
    gaps = _searches(spark, sf).withColumns(
        {
            "session_id": F.lit(None).cast("string"),
            "cache_hit": F.when(F.col("cache_hit") != "miss", F.col("cache_hit")),
            "clicked_results": F.when(F.col("clicked_results") > 0, F.col("clicked_results")),
        }
    )
    done = ev.with_event_defaults(gaps)
    return done.select("id", "cache_hit", "clicked_results", F.col("session_id").isNotNull().alias("has_session"))


@query
def interaction_defaults(spark, sf):
    """Interactions of which half come without data."""
    given = d.interactions_from(d.table(spark, sf, "events")).withColumn(
        "interaction_data", F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.col("lead_id").alias("lead"))))
    )
    return ev.with_interaction_defaults(given).select("id", "lead_id", "interaction_data")


@query
def session_counters(spark, sf):
    return ev.session_counters(_searches(spark, sf))


@query
def hourly_windows(spark, sf):
    return ev.window_counters(d.interactions(spark, sf), "interaction_type", 60)


@query
def counter_sums(spark, sf):
    keyed = d.table(spark, sf, "events").select("event_type", d._k().alias("amount"))
    return ev.sum_by_key(keyed, "event_type", "amount")


# --- preferences and changes ------------------------------------------------------------------
@query
def preferences_weights(spark, sf):
    found = pr.preferences_for(d.users(spark, sf), d.preferences(spark, sf))
    w = F.col("scoring_weights")
    return found.select(
        "user_id",
        joined("preferred_industries").alias("industries"),
        joined("preferred_locations").alias("locations"),
        F.try_element_at(w, F.lit("industry_match")).alias("industry_match"),
        F.try_element_at(w, F.lit("text_relevance")).alias("text_relevance"),
        F.try_element_at(w, F.lit("data_quality")).alias("data_quality"),
        "preferences_applied",
    )


@query
def preferences_applied(spark, sf):
    found = pr.applied_preferences(d.users(spark, sf), d.preferences(spark, sf))
    b = F.col("preference_boosts")
    return found.select(
        "user_id", "preferences_applied",
        joined(F.array_sort(F.map_keys(b))).alias("boosted"),
        joined(F.try_element_at(b, F.lit("industries"))).alias("industries"),
        F.size("custom_weights_used").alias("n_weights"),
    )


@query
def preference_filters(spark, sf):
    found = pr.preference_filters(d.users(spark, sf), d.preferences(spark, sf))
    return found.select(
        "user_id", joined("preferred_industries").alias("industries"), joined("preferred_locations").alias("locations"),
        "company_size_range", "revenue_range",
    )


@query
def weight_validation(spark, sf):
    return d.preferences(spark, sf).select("user_id", pr.weights_valid(F.col("scoring_weights")).alias("valid"))


@query
def apply_changes(spark, sf):
    base = d.leads(spark, sf, False).select("id", "company", "industry", "score", F.col("created_at").alias("updated_at"))
    changes = ch.latest_change(d.lead_changes(spark, sf), "id", "seq")
    return ch.apply_changes(base, changes, "id", LEADS_AT)


@query
def preferences_upsert(spark, sf):
    base = d.preferences(spark, sf).select("user_id", "company_size_range", "revenue_range")
    op = F.when(F.col("user_id") % 9 == 0, F.lit("delete")).when(F.col("user_id") % 2 == 0, F.lit("update")).otherwise(F.lit("create"))
    changes = d.users(spark, sf).select("user_id", op.alias("op"), F.when(F.col("user_id") % 4 == 0, F.lit("200+")).alias("company_size_range"))
    return ch.apply_changes(base, changes, "user_id", LEADS_AT)


# --- contact functions ------------------------------------------------------------------------
def _documents(spark, sf) -> DataFrame:
    return d.table(spark, sf, "documents")


@query
def email_extract(spark, sf):
    text = F.col("text")
    return _documents(spark, sf).select(
        "doc_id", ct.extract_email(text).alias("email"), ct.extract_email(text, fv.EMAIL_SKIP_WORDS_STRICT).alias("strict_email")
    )


@query
def phone_extract(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", ct.extract_phone(F.col("text")).alias("phone"), ct.extract_phone_br(F.col("text")).alias("phone_or_local")
    )


@query
def phone_normalize(spark, sf):
    return d.leads(spark, sf, False).select("id", ct.normalize_phone(F.col("phone")).alias("phone"))


@query
def email_checks(spark, sf):
    e = F.col("email")
    return d.leads(spark, sf, False).select(
        "id", ct.is_business_email(e).alias("business"), ct.is_valid_business_email(e).alias("valid_business"), ct.email_domain(e).alias("domain")
    )


@query
def company_normalize(spark, sf):
    c = F.col("company")
    return d.incoming(spark, sf).select(
        "id", ct.normalize_company(c).alias("normalized"), ct.clean_company(c).alias("cleaned"),
        F.bround(ct.company_similarity(c, F.concat("industry", F.lit(" Trading House "), F.col("id").cast("string"), F.lit(" Ltd"))), 6).alias("similarity"),
    )


@query
def url_domain(spark, sf):
    u = F.col("url")
    return d.table(spark, sf, "pages").select(
        "page_id", ct.url_domain(u).alias("domain"), ct.url_domain_bare(u).alias("bare_domain"), ct.is_valid_url(u).alias("valid"),
        ct.is_company_site(u).alias("company_site"), ct.is_company_result_link(u).alias("result_link"), ct.is_business_website(u).alias("business"),
    )


@query
def redirect_unwrap(spark, sf):
    """Page addresses packed into search-result redirects and unpacked again."""
    packed = F.concat(F.lit("//search.invalid/l/?kh=-1&uddg="), F.url_encode(F.url_encode("url")), F.lit("&rut=1"))
    return d.table(spark, sf, "pages").select("page_id", ct.unwrap_redirect(packed).alias("target"), ct.unwrap_redirect(F.col("url")).alias("plain"))


@query
def location_extract(spark, sf):
    """Locations in documents and in addresses built from customers."""
    places = [f"Rua A, 10, {c}" for c in fv.CITIES]
    states = fv.STATES
    spot = F.concat(
        F.get(F.array(*[F.lit(x) for x in places]), (F.col("c_custkey") % len(places)).cast("int")),
        F.lit(", "),
        F.get(F.array(*[F.lit(x) for x in states]), (F.col("c_custkey") % len(states)).cast("int")),
    )
    mixed = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Sede em "), F.get(F.array(*[F.lit(x) for x in states]), (F.col("c_custkey") % len(states)).cast("int")))).otherwise(spot)
    customers = d.table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), mixed.alias("text"))
    documents = _documents(spark, sf).select(F.lit("document").alias("kind"), F.col("doc_id").alias("key"), "text")
    both = customers.unionByName(documents)
    return both.select("kind", "key", ct.extract_location_br(F.col("text")).alias("location"), ct.extract_location_page(F.col("text")).alias("page_location"))


@query
def completeness_score(spark, sf):
    fields = {c: F.col(c) for c in ("company", "contact", "email", "phone", "website", "industry", "location", "description", "employees")}
    return d.leads(spark, sf).select(
        "id",
        F.bround(ct.completeness(fields), 6).alias("quality"),
        F.bround(ct.completeness(fields, last="employees"), 6).alias("confidence"),
    )


@query
def format_records(spark, sf):
    fields = {c: F.col(c) for c in ("company", "contact", "email", "phone", "website", "industry", "location", "description")}
    out = ct.format_record(fields)
    return d.leads(spark, sf).select("id", *[c.alias(n) for n, c in out.items() if n != "data_quality_score"], F.bround(out["data_quality_score"], 6).alias("data_quality_score"))


@query
def enhance_records(spark, sf):
    made = ing.make_leads(d.leads(spark, sf))
    return made.select("id", "company", "email", "phone", "website", F.bround("confidence", 6).alias("confidence"), joined("keywords").alias("keywords"))


@query
def frequency_keywords(spark, sf):
    return _documents(spark, sf).select("doc_id", joined(tx.frequent_words(F.col("text"))).alias("keywords"))


@query
def keyword_heuristics(spark, sf):
    return _documents(spark, sf).select("doc_id", joined(tx.keyword_candidates(F.col("text"))).alias("keywords"))


@query
def clean_texts(spark, sf):
    t = F.col("text")
    return _documents(spark, sf).select(
        "doc_id", F.md5(tx.clean_index_text(t)).alias("index_text"), F.md5(tx.clean_query_text(t)).alias("query_text"),
        F.md5(tx.clean_scrape_text(t)).alias("scrape_text"), F.md5(tx.squeeze_spaces(t)).alias("squeezed"),
    )


@query
def headcounts(spark, sf):
    text = F.concat(F.lit("About "), F.format_number(F.col("c_custkey") * 17, 0), F.when(F.col("c_custkey") % 2 == 0, F.lit(" Employees")).otherwise(F.lit(" people and staff")), F.lit(", rated 4."), (F.col("c_custkey") % 10).cast("string"))
    return d.table(spark, sf, "customer").select("c_custkey", ct.headcount(text).alias("employees"), ct.rating_number(F.regexp_extract(text, "rated (.*)", 1)).alias("rating"))


# --- ingestion --------------------------------------------------------------------------------
@query
def validate_leads(spark, sf):
    fields = {c: F.col(c) for c in ("company", "email", "phone", "website", "location")}
    found = d.leads(spark, sf, False).select("id", validate_lead(fields).alias("v"))
    facts = F.transform(F.array_sort(F.map_entries("v.enhanced")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select(
        "id", "v.is_valid", F.bround("v.confidence_score", 6).alias("confidence_score"), joined("v.issues").alias("issues"),
        joined("v.suggestions").alias("suggestions"), joined(facts).alias("facts"),
    )


@query
def page_extract(spark, sf):
    found = ing.extract_pages(d.table(spark, sf, "pages"))
    return found.select("page_id", "host", "company", "email", "phone", "location", joined("contact_pages").alias("contact_pages"), "description", "industry")


@query
def page_merge(spark, sf):
    merged = ing.merge_host_pages(ing.extract_pages(d.table(spark, sf, "pages")))
    return merged.select("host", "n_pages", "page_id", "company", "email", "phone", "location", "industry")


@query
def lead_pipeline(spark, sf):
    out = ing.lead_pipeline(d.table(spark, sf, "pages"), d.leads(spark, sf, False), d.BATCH_USER, ["company"])
    return out.select("page_id", "company", "industry", "score", "stage", joined("keywords").alias("keywords"))


@query
def import_leads(spark, sf):
    out = ing.import_leads(d.incoming(spark, sf), d.leads(spark, sf, False))
    return out.select("id", "user_id", "company", "score", "status", "priority", "outcome")


@query
def import_leads_deduped(spark, sf):
    """Names of the batch repeat across parts: the first of each name stays."""
    batch = d.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10 + 1).alias("user_id"), F.col("p_name").alias("company"))
    return ing.import_leads(batch, d.leads(spark, sf, False), dedupe_within_batch=True).select("id", "company", "outcome")


@query
def import_errors(spark, sf):
    return ing.import_errors(ing.import_leads(d.incoming(spark, sf), d.leads(spark, sf, False)))


@query
def import_report(spark, sf):
    return ing.import_report(ing.import_leads(d.incoming(spark, sf), d.leads(spark, sf, False)))


@query
def save_scraped(spark, sf):
    batch = d.incoming(spark, sf).filter(F.col("company") != "")
    fields = {c: F.col(c) for c in ("company", "email", "phone", "website", "industry", "employees")}
    scored = batch.drop("score").withColumn("confidence", ct.completeness(fields, last="employees"))
    return ing.save_scraped(scored, d.leads(spark, sf, False)).select("id", "user_id", "company", "score", "status", "priority")


@query
def job_summary(spark, sf):
    return ing.job_summary(d.import_jobs(spark, sf))


@query
def jobs_by_status(spark, sf):
    return ing.jobs_by(d.import_jobs(spark, sf), "status")


@query
def dedupe_exact(spark, sf):
    """Every new record with the reasons it duplicates a stored lead."""
    found = du.detect_duplicates(d.incoming(spark, sf), d.leads(spark, sf, False))
    return found.select("id", "similar_name", "same_email", "same_phone", "same_domain", "is_duplicate")


# --- reports ----------------------------------------------------------------------------------
@query
def dashboard_summary(spark, sf):
    row = rp.dashboard_summary(d.leads(spark, sf, False), _searches(spark, sf), LEADS_AT, search_as_of=EVENTS_AT.replace(day=30, hour=12))
    return row.withColumn("alerts", joined(F.transform("alerts", lambda a: a["message"])))


@query
def search_health(spark, sf):
    row = rp.search_health(d.leads(spark, sf), _popular(spark, sf))
    return row.withColumn("recommendations", joined("recommendations")).withColumn("optimization_tips", joined("optimization_tips"))


@query
def search_analytics_report(spark, sf):
    return rp.search_analytics_report(d.leads(spark, sf, False), ev.query_counts(_searches(spark, sf)))


@query
def comprehensive_report(spark, sf):
    return rp.comprehensive_report(d.leads(spark, sf), LEADS_AT)


# --- streams ----------------------------------------------------------------------------------
def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of files. The pattern makes a single file work like a folder."""
    schema = d.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")


@query
def stream_search_sessions(spark, sf):
    live = lambda events: sc.live_search_counter(sc.event_time(events))
    return ss.replay(spark, "search-sessions", live, d.search_events_from(_event_stream(spark, sf)))


@query
def stream_interaction_sessions(spark, sf):
    live = lambda events: sc.live_interaction_counter(sc.event_time(events))
    return ss.replay(spark, "interaction-sessions", live, d.interactions_from(_event_stream(spark, sf)))


@query
def stream_fixed_windows(spark, sf):
    live = lambda events: sc.fixed_window_counter(sc.event_time(events), "interaction_type", "30 minutes")
    return ss.replay(spark, "fixed-windows", live, d.interactions_from(_event_stream(spark, sf)))


@query
def stream_first_event_windows(spark, sf):
    """Half-hour windows that open at the first event of a kind."""
    live = lambda events: sw.first_event_windows(sc.event_time(events), "interaction_type", 1800)
    with sw.rocksdb_state(spark):
        return ss.replay(spark, "first-event-windows", live, d.interactions_from(_event_stream(spark, sf)))


@query
def stream_unique_events(spark, sf):
    """A source that sends every event twice; each is appended once."""
    folder = ss.work_folder(spark, "unique-events")
    sent = d.search_events_from(_event_stream(spark, sf)).unionByName(d.search_events_from(_event_stream(spark, sf)))
    ss.append_events_once(sc.unique_events(sent, late_by="60 days"), f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "user_id", "query_text", "results_count", "created_at")


@query
def popular_by_summaries(spark, sf):
    """The most popular texts from hourly summaries of each user."""
    return sm.popular_from_summaries(sm.query_summaries(_searches(spark, sf)), 5)


@query
def stream_popular_queries(spark, sf):
    live = lambda events: sc.popular_query_counts(sc.event_time(events))
    return ss.replay(spark, "popular-queries", live, d.search_events_from(_event_stream(spark, sf)))


@query
def stream_last_hour(spark, sf):
    live = lambda events: sc.last_hour_activity(sc.event_time(events), "30 minutes")
    return ss.replay(spark, "last-hour", live, d.search_events_from(_event_stream(spark, sf)))


@query
def stream_click_attribution(spark, sf):
    live = lambda searches, clicks: sc.attributed_searches(sc.event_time(searches), sc.event_time(clicks))
    return ss.replay(spark, "click-attribution", live, d.search_events_from(_event_stream(spark, sf)), d.clicks_from(_event_stream(spark, sf)))


@query
def stream_postings(spark, sf):
    """The leads arrive as files; their postings are appended as they come."""
    arriving = f"{ss.work_folder(spark, 'arriving-leads')}/leads"
    leads = d.leads(spark, sf)
    leads.write.parquet(arriving)
    return ss.drain(sc.new_postings(spark.readStream.schema(leads.schema).parquet(arriving)), spark, "postings")


@query
def stream_index_upkeep(spark, sf):
    """All leads arrive, then their changes; the index is folded once and follows."""
    folder = ss.work_folder(spark, "index-upkeep")
    base, changes = d.leads(spark, sf), ch.latest_change(d.lead_changes(spark, sf), "id", "seq")
    after = ch.apply_changes(base, changes, "id", LEADS_AT).join(changes.select("id"), "id", "left_semi")
    gone = changes.filter("op = 'delete'").select("id", "op", F.lit(2).alias("seq"))
    arriving = base.select("*", F.lit("create").alias("op"), F.lit(1).alias("seq"))
    for rows in (arriving, after.select("*", F.lit("update").alias("op"), F.lit(2).alias("seq")).unionByName(gone, allowMissingColumns=True)):
        rows.write.mode("append").parquet(f"{folder}/changes")
        stream = spark.readStream.schema(arriving.schema).parquet(f"{folder}/changes")
        up.keep_index(stream, f"{folder}/index", f"{folder}/checkpoint", once=True).awaitTermination()
        up.compact_index(spark, f"{folder}/index", 16)
    return up.read_index(spark, f"{folder}/index")


@query
def stream_lead_counters(spark, sf):
    folder = ss.work_folder(spark, "lead-counters")
    stream = d.interactions_from(_event_stream(spark, sf))
    ss.collect_lead_counters(stream, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    return ss.read_lead_counters(spark, f"{folder}/out")
