"""Inverted index of leads: metadata per lead, postings per token, lookups and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions.common import all_of, blank_to_null, str_array
from leadlake.functions.text import clean_index_text, description_keywords, tokenize_cleaned

# Ids per posting-list row: bounds every grouped list, however frequent the token.
POSTING_CHUNK = 4096


def _own_keywords(leads: DataFrame) -> Column:
    if "keywords" not in leads.columns:
        return str_array([])
    given = F.coalesce(F.col("keywords"), str_array([]))
    return F.transform(F.filter(given, lambda k: F.coalesce(k != "", F.lit(False))), clean_index_text)


def with_index_metadata(leads: DataFrame, text_tokens: bool = False) -> DataFrame:
    """Adds searchable text, token arrays and keywords to each lead; with ``text_tokens`` the words of company and description, too.

    Keywords found in the description come from its cleaned, lower-cased form.
    """
    texts = leads.withColumns(
        {
            "_own": _own_keywords(leads),
            "_company": clean_index_text(F.col("company")),
            "_description": clean_index_text(F.col("description")),
            "_industry": clean_index_text(F.col("industry")),
            "_location": clean_index_text(F.col("location")),
        }
    )
    found = texts.withColumn("_keywords", F.concat("_own", description_keywords(F.col("_description"))))
    parts = [F.col(c) for c in ("_company", "_description", "_industry", "_location")]
    parts.append(F.array_join("_keywords", " "))
    raw = [F.col("contact"), F.col("email"), F.col("website")]
    both = F.concat_ws(" ", F.col("_company"), F.col("_description"))
    return found.select(
        *leads.columns,
        F.concat_ws(" ", *[blank_to_null(x) for x in parts + raw]).alias("searchable_text"),
        tokenize_cleaned(F.col("_company")).alias("company_tokens"),
        tokenize_cleaned(F.col("_industry")).alias("industry_tokens"),
        tokenize_cleaned(F.col("_location")).alias("location_tokens"),
        F.array_sort(F.array_distinct("_keywords")).alias("lead_keywords"),
        # the words of the searchable text; only its raw parts can hold other spaces than plain ones
        tokenize_cleaned(F.concat_ws(" ", *parts), F.concat_ws(" ", *raw)).alias("all_tokens"),
        *([tokenize_cleaned(both).alias("text_tokens")] if text_tokens else []),
    )


def index_keys() -> Column:
    """Index keys of a lead with metadata: tokens, keywords and one exact key each for industry and location."""

    def exact(prefix: str, tokens: Column) -> Column:
        return F.when(F.size(tokens) > 0, F.array(F.concat(F.lit(prefix), F.array_min(tokens)))).otherwise(str_array([]))

    every = F.concat(F.col("all_tokens"), F.filter(F.col("lead_keywords"), lambda k: F.length(k) >= 2))
    keys = F.concat(
        F.transform(every, F.lower),
        exact("industry:", F.col("industry_tokens")),
        exact("location:", F.col("location_tokens")),
    )
    return F.array_distinct(keys)


def build_postings(leads: DataFrame) -> DataFrame:
    """One (token, lead_id) row per index key; needs no shuffle."""
    return with_index_metadata(leads).select(F.explode(index_keys()).alias("token"), F.col("id").alias("lead_id"))


def posting_lists(postings: DataFrame, chunk: int = POSTING_CHUNK) -> DataFrame:
    """Postings grouped into sorted lists of at most ``chunk`` ids each."""
    return (
        postings.groupBy("token", F.floor(F.col("lead_id") / F.lit(chunk)).alias("chunk"))
        .agg(F.sort_array(F.collect_set("lead_id")).alias("lead_ids"))
    )


def posting_blocks(postings: DataFrame, chunk: int = POSTING_CHUNK) -> DataFrame:
    """(token, chunk, first, last, n, gaps): posting lists as compressed blocks. A block covers ``chunk`` ids; it holds its first and last
    id and the distances of all ids from the first, as small numbers."""
    base = F.floor(F.col("lead_id") / F.lit(chunk))
    blocks = postings.groupBy("token", base.alias("chunk")).agg(F.sort_array(F.collect_set("lead_id")).alias("ids"))
    first = F.element_at("ids", 1)
    gaps = F.transform("ids", lambda i: (i - first).cast("smallint" if chunk <= 1 << 15 else "int"))
    return blocks.select("token", "chunk", first.alias("first"), F.element_at("ids", -1).alias("last"), F.size("ids").alias("n"), gaps.alias("gaps"))


def intersect_blocks(blocks: DataFrame, tokens: list[str]) -> DataFrame:
    """(lead_id) of the leads that have every token, from posting blocks.

    The first and last ids alone tell which blocks can hold common leads; the ids of other blocks are not read.
    """
    wanted = sorted(set(tokens))
    own = blocks.filter(F.col("token").isin(wanted))
    heads = own.groupBy("chunk").agg(F.count_distinct("token").alias("n"), F.max("first").alias("low"), F.min("last").alias("high"))
    live = heads.filter((F.col("n") == len(wanted)) & (F.col("low") <= F.col("high"))).select("chunk", "low", "high")
    ids = F.transform("gaps", lambda g: F.col("first") + g)
    within = own.join(live, "chunk").select("chunk", F.filter(ids, lambda i: (i >= F.col("low")) & (i <= F.col("high"))).alias("ids"))
    # one list of at most a chunk of ids for each token
    lists = within.groupBy("chunk").agg(F.collect_list("ids").alias("lists"))
    common = F.aggregate(F.slice("lists", 2, len(wanted)), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return lists.select(F.explode(common).alias("lead_id"))


def index_stats(leads: DataFrame) -> DataFrame:
    """Leads seen, leads that give at least one key, and the rest."""
    counted = with_index_metadata(leads).select((F.size(index_keys()) > 0).alias("ok")).agg(
        F.count(F.lit(1)).alias("total_leads"), F.count_if("ok").alias("indexed_leads")
    )
    return counted.withColumn("failed_leads", F.col("total_leads") - F.col("indexed_leads"))


def incremental_postings(leads: DataFrame) -> DataFrame:
    """Postings of the leads that were never indexed."""
    return build_postings(leads.filter(F.col("indexed_at").isNull()))


def remove_from_postings(postings: DataFrame, removed: DataFrame) -> DataFrame:
    """Postings without the leads in ``removed`` (column ``lead_id``)."""
    return postings.join(removed.select("lead_id").distinct(), "lead_id", "left_anti")


def leads_with_all_tokens(postings: DataFrame, tokens: list[str]) -> DataFrame:
    """Ids of the leads that have every token."""
    wanted = sorted(set(tokens))
    return (
        postings.filter(F.col("token").isin(wanted))
        .groupBy("lead_id")
        .agg(F.count_distinct("token").alias("n"))
        .filter(F.col("n") == len(wanted))
        .select("lead_id")
    )


def candidate_leads(leads: DataFrame, lead_ids: DataFrame) -> DataFrame:
    """The rows of the leads whose ids were found in the index."""
    return leads.join(lead_ids.select(F.col("lead_id").alias("id")), "id", "left_semi")


def with_stored_metadata(leads: DataFrame, stored: DataFrame) -> DataFrame:
    """Index metadata from a stored table (one row per id) where present; only other leads have theirs computed."""
    names = ["searchable_text", "company_tokens", "industry_tokens", "location_tokens", "lead_keywords", "all_tokens"]
    known = leads.join(stored.select("id", *names), "id").select(*leads.columns, *names)
    missing = leads.join(stored.select("id"), "id", "left_anti").select(*leads.columns)
    return known.unionByName(with_index_metadata(missing))


def contains_all_terms(terms: Column, keys: Column | None = None) -> Column:
    """True if the index keys of the lead row include every term (at least one)."""
    keys = index_keys() if keys is None else keys
    return (F.size(terms) > 0) & (F.size(F.array_except(terms, keys)) == 0)


def may_contain_terms(leads: DataFrame, terms: list[str]) -> Column:
    """Cheap necessary condition for :func:`contains_all_terms`: every term is a substring of the raw text."""
    parts = [F.col(f) for f in ("company", "description", "industry", "location", "contact", "email", "website")]
    if "keywords" in leads.columns:
        parts.append(F.array_join("keywords", "\n"))
    raw = F.lower(F.concat_ws("\n", *parts))
    return all_of(F.contains(raw, F.lit(t)) for t in terms)
