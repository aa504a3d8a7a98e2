"""SQL for the registered queries, written for DuckDB over the same sample tables.

Each statement states the rule directly (often by brute force) and shares no code with the Spark
plans beyond the fixed values.
"""

from __future__ import annotations

from leadlake import fixed_values as fv

ORACLES: dict[str, str] = {}

LEADS_AT = "TIMESTAMP '2001-08-02'"
EVENTS_AT = "TIMESTAMP '2024-01-31'"


# --- text building blocks ---------------------------------------------------------------------
def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(values) -> str:
    values = list(values)
    return "[" + ", ".join(lit(v) for v in values) + "]" if values else "CAST([] AS VARCHAR[])"


def dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def rnd(x: str, n: int) -> str:
    return f"round_even({dbl(x)}, {n})"


def pct(part: str, whole: str, n: int = 1) -> str:
    return rnd(f"CASE WHEN {whole} > 0 THEN {part} / {whole} * 100 ELSE 0 END", n)


def n_if(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def cleaned(x: str, keep: str = "_-") -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}{keep}]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return (
        f"list_sort(list_filter(list_distinct(string_split({x}, ' ')), "
        f"lambda t: length(t) >= 2 AND NOT list_contains({arr(fv.STOP_WORDS)}, t)))"
    )


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def has_any(x: str, choices) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(c)})" for c in choices) + ")"


def show(x: str) -> str:
    return f"array_to_string({x}, '|')"


def filled(x: str) -> str:
    return f"coalesce({x} <> '', false)"


# --- tables -----------------------------------------------------------------------------------
K = "CAST(props->>'$.k' AS INT)"

LEADS = """leads AS (
SELECT CAST(c.c_custkey AS BIGINT) AS id,
 CAST(c.c_custkey % 10 + 1 AS BIGINT) AS user_id,
 concat(p.p_name, ' ', CAST(c.c_custkey AS VARCHAR), CASE WHEN c.c_custkey % 6 = 0 THEN ' Ltda' ELSE '' END) AS company,
 CASE WHEN c.c_custkey % 8 = 0 THEN NULL ELSE c.c_name END AS contact,
 CASE WHEN c.c_custkey % 3 = 0 THEN NULL
      WHEN c.c_custkey % 7 = 0 THEN concat('user', CAST(c.c_custkey AS VARCHAR), '@gmail.com')
      WHEN c.c_custkey % 11 = 0 THEN concat('noreply@site', CAST(c.c_custkey AS VARCHAR), '.com')
      ELSE concat('c', CAST(c.c_custkey AS VARCHAR), '@', lower(c.c_mktsegment), '.com.br') END AS email,
 CASE WHEN c.c_custkey % 4 = 0 THEN NULL
      ELSE concat('(', CAST(11 + c.c_custkey % 89 AS VARCHAR), ') 9', lpad(CAST(c.c_custkey % 10000 AS VARCHAR), 4, '0'), '-', lpad(CAST((c.c_custkey * 7) % 10000 AS VARCHAR), 4, '0')) END AS phone,
 CASE WHEN c.c_custkey % 5 = 0 THEN NULL
      WHEN c.c_custkey % 13 = 0 THEN concat('https://facebook.com/p', CAST(c.c_custkey AS VARCHAR))
      ELSE concat('https://www.company', CAST(c.c_custkey % 500 AS VARCHAR), '.com.br') END AS website,
 CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE c.c_mktsegment END AS industry,
 CASE WHEN c.c_custkey % 19 = 0 THEN NULL ELSE concat(n.n_name, ', ', r.r_name) END AS location,
 CASE c.c_custkey % 5 WHEN 0 THEN '1-10' WHEN 1 THEN '11-50' WHEN 2 THEN '51-200' WHEN 3 THEN '200+' ELSE NULL END AS employees,
 CASE c.c_custkey % 4 WHEN 0 THEN 'R$ 1M - R$ 5M' WHEN 1 THEN 'R$ 5M - R$ 20M' WHEN 2 THEN 'R$ 20M - R$ 100M' ELSE NULL END AS revenue,
 d.text AS description,
 CAST(floor((c.c_acctbal + 1000) / 110) AS INT) AS score,
 o.last_order AS created_at, o.last_final AS last_contact,
 CASE WHEN c.c_custkey % 10 = 0 THEN NULL ELSE o.last_order END AS indexed_at,
 CASE WHEN o.last_final IS NOT NULL THEN 'Contatado' ELSE 'Novo' END AS status
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON p.p_partkey = c.c_custkey
LEFT JOIN documents d ON d.doc_id = c.c_custkey
JOIN (SELECT o_custkey, max(o_orderdate) AS last_order, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS last_final FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
)"""

SEARCHES = f"""searches AS (
SELECT event_id AS id, user_id,
 CASE WHEN {K} % 12 = 0 THEN NULL WHEN {K} % 12 = 1 THEN '' ELSE concat('query ', CAST({K} % 12 AS VARCHAR)) END AS query_text,
 {K} AS results_count, CAST(floor(value * 4) AS INT) AS response_time_ms,
 CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS clicked_results,
 CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS contacted_leads,
 CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS converted_leads,
 CASE event_type WHEN 'view' THEN 'hit' WHEN 'error' THEN 'partial' ELSE 'miss' END AS cache_hit, ts AS created_at
FROM events)"""

INTERACTIONS = f"""interactions AS (
SELECT event_id AS id, user_id, CAST({K} AS BIGINT) AS lead_id,
 CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'contact' WHEN 'signup' THEN 'email' WHEN 'error' THEN 'call' ELSE 'convert' END AS interaction_type,
 ts AS created_at
FROM events)"""

RAW_LOG = """raw_log AS (
SELECT p_partkey AS query_id, CASE p_size % 6 WHEN 0 THEN p_name
 WHEN 1 THEN '"' || p_name || '" ' || lower(p_type)
 WHEN 2 THEN 'Tech startup em São Paulo: ' || p_name
 WHEN 3 THEN p_name || ' & the BANK of ' || lower(p_type) || ' RJ'
 WHEN 4 THEN 'large health-care ' || p_name || ', Brasília!'
 ELSE p_name || ' for retail in minas mid-size' END AS query_text FROM part)"""

QUERY_LOG = """entries AS (
 SELECT p_partkey AS query_id, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN '"' || p_name || '"' ELSE p_name || ' unobtainable' END AS query_text FROM part),
query_log AS (SELECT min(query_id) AS query_id, query_text FROM entries GROUP BY query_text)"""

POPULAR = "popular AS (SELECT p_name AS query, count(*) AS cnt FROM part GROUP BY p_name)"

INCOMING = """incoming AS (
SELECT p_partkey AS id, p_partkey % 10 + 1 AS user_id,
 CASE WHEN p_size % 9 = 0 THEN '' WHEN p_size % 4 = 0 THEN p_name || ' ' || p_partkey || ' Inc.' WHEN p_size % 4 = 1 THEN p_name || ' ' || p_partkey
  ELSE p_brand || ' ' || p_name || ' ' || p_type || ' Trading House ' || p_partkey END AS company,
 CASE WHEN p_size % 5 = 0 THEN 'C' || p_partkey || '@building.com.br' WHEN p_size % 5 = 1 THEN 'new' || p_partkey || '@shop.net' END AS email,
 CASE WHEN p_size % 7 = 0 THEN concat('(', 11 + p_partkey % 89, ') 9', lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0'), '-', lpad(CAST((p_partkey * 7) % 10000 AS VARCHAR), 4, '0')) END AS phone,
 CASE WHEN p_size % 11 = 0 THEN 'http://company' || (p_partkey % 900) || '.com.br/contact' END AS website,
 p_type AS industry, CASE WHEN p_size % 2 = 0 THEN p_size || '-' || (p_size * 2) END AS employees,
 CASE WHEN p_size % 3 = 0 THEN p_size END AS score FROM part)"""

PREFERENCES = """prefs AS (
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS industries,
 CASE WHEN c_custkey % 7 = 0 THEN '' ELSE n_name || ', ' || r_name END AS locations,
 CASE WHEN c_custkey % 2 = 0 THEN '51-200' END AS company_size_range,
 CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 6 = 1 THEN 'R$ 5M - R$ 20M' END AS revenue_range,
 c_custkey % 4 AS kind
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 5 <> 0)"""

CHANGES = """raw_changes AS (
SELECT CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END AS id, o_orderkey AS seq,
 CASE o_orderstatus WHEN 'F' THEN 'delete' WHEN 'P' THEN 'create' ELSE 'update' END AS op,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Order ' || o_orderkey END AS company, CAST(floor(o_totalprice / 5000) AS INT) AS score FROM orders),
changes AS (SELECT * FROM raw_changes QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def leads_query(name: str, sql: str, *more: str) -> None:
    ORACLES[name] = with_(LEADS, *more) + sql


QUALIFIED = "(email IS NOT NULL OR phone IS NOT NULL)"


def all_set(*names: str) -> str:
    return "(" + " AND ".join(f"{n} IS NOT NULL" for n in names) + ")"


HIGH = f"(coalesce(score > 70, false) OR {all_set('email', 'phone', 'industry', 'location')})"
FULL = all_set("email", "phone", "industry")
HARD = "(industry IS NULL OR location IS NULL OR description IS NULL)"
ROI = f"CASE WHEN count(*) > 0 THEN ({n_if(FULL)} * 500 + ({n_if(QUALIFIED)} - {n_if(FULL)}) * 200 + (count(*) - {n_if(QUALIFIED)}) * 50) / count(*) ELSE 0 END"

# --- lead metrics -----------------------------------------------------------------------------
WEEK = f"created_at >= {LEADS_AT} - INTERVAL 7 DAY"
BEFORE = f"created_at >= {LEADS_AT} - INTERVAL 14 DAY AND created_at < {LEADS_AT} - INTERVAL 7 DAY"
GROWTH = rnd(f"CASE WHEN {n_if(BEFORE)} > 0 THEN ({n_if(WEEK)} - {n_if(BEFORE)}) / {n_if(BEFORE)} * 100 ELSE 0 END", 1)
leads_query(
    "dashboard_metrics",
    f"""SELECT count(*) AS total_leads, {n_if(QUALIFIED)} AS qualified_leads, {pct(n_if(QUALIFIED), 'count(*)')} AS conversion_rate,
 {rnd(ROI, 0)} AS average_roi, {n_if(HIGH)} AS high_quality_leads, {n_if(WEEK)} AS recent_leads, {GROWTH} AS growth_rate FROM leads""",
)
leads_query("average_roi", f"SELECT {dbl(ROI)} AS average_roi FROM leads")
leads_query(
    "search_conversion",
    f"""SELECT {pct(n_if('last_contact IS NOT NULL'), 'count(*)')} AS search_to_contact_rate,
 {pct(n_if(QUALIFIED), 'count(*)')} AS search_to_qualified_rate,
 {pct(n_if('company IS NULL AND email IS NULL AND phone IS NULL'), 'count(*)')} AS zero_results_rate FROM leads""",
)


def months_sql(at: str, months: int) -> str:
    start = f"({at} - INTERVAL {months * 30} DAY)"
    return f"""found AS (SELECT CAST(year(created_at) AS INT) AS y, CAST(month(created_at) AS INT) AS mo, count(*) AS leads, {n_if(QUALIFIED)} AS qualified
 FROM leads WHERE created_at >= {start} GROUP BY 1, 2),
spine AS (SELECT CAST(year({start}) AS INT) AS y, CAST(month({start}) AS INT) AS mo
 UNION SELECT CAST(year(d) AS INT), CAST(month(d) AS INT) FROM (SELECT unnest(generate_series(date_trunc('month', {start} + INTERVAL 32 DAY), {at}, INTERVAL 1 MONTH)) AS d)),
series AS (SELECT y, mo, leads, qualified FROM found
 UNION ALL SELECT y, mo, 0, 0 FROM spine ANTI JOIN found USING (y, mo) WHERE (SELECT count(*) FROM found) < {months})"""


MONTH = f"({arr(fv.MONTH_NAMES)})[mo]"
for name, at, n in (("leads_by_month", LEADS_AT, 6), ("leads_by_month_sparse", "TIMESTAMP '2001-12-30'", 6)):
    leads_query(name, f"SELECT y AS year, {MONTH} AS month, mo AS month_number, leads, qualified FROM series", months_sql(at, n))
leads_query("period_trend", "SELECT '90d' AS period, CAST(coalesce(sum(leads), 0) AS BIGINT) AS total_period FROM series", months_sql(LEADS_AT, 6))
leads_query("industry_breakdown", "SELECT industry, count(*) AS count FROM leads WHERE industry IS NOT NULL GROUP BY industry ORDER BY 2 DESC, 1 LIMIT 10")
for by in ("industry", "location"):
    leads_query(
        f"insights_{by}",
        f"SELECT {by}, count(*) AS lead_count, {rnd('coalesce(avg(score), 0)', 1)} AS avg_quality_score FROM leads WHERE {by} IS NOT NULL GROUP BY {by} ORDER BY 2 DESC, 1 LIMIT 10",
    )
SOURCES = [
    ("LinkedIn", n_if(all_set("industry", "location", "description"))),
    ("Google Search", n_if("website IS NOT NULL")),
    ("Website", n_if("email IS NOT NULL AND phone IS NULL")),
]
REST = "greatest(0, count(*) - " + " - ".join(s for _, s in SOURCES) + ")"
leads_query(
    "source_metrics",
    " UNION ALL ".join(
        f"SELECT {lit(s)} AS source, {e} AS leads, {pct(e, 'count(*)')} AS percentage FROM leads" for s, e in [*SOURCES, ("Referências", REST)]
    ),
)
TIER1 = n_if(all_set("email", "phone", "industry", "location", "description"))
TIER2 = n_if(f"{QUALIFIED} AND {all_set('industry', 'location')}")
TIERS = [
    ("high_quality", "90-100", "Alta Prioridade", TIER1),
    ("good_quality", "70-89", "Boa Qualidade", f"{TIER2} - {TIER1}"),
    ("medium_quality", "50-69", "Média Qualidade", f"{n_if(QUALIFIED)} - {TIER2}"),
    ("low_quality", "0-49", "Baixa Prioridade", f"greatest(0, count(*) - {n_if(QUALIFIED)})"),
]
leads_query(
    "quality_scores",
    " UNION ALL ".join(f"SELECT {lit(t)} AS tier, {lit(r)} AS range, {lit(lb)} AS label, {e} AS count FROM leads" for t, r, lb, e in TIERS),
)
BANDS = [("high_quality", "score >= 80"), ("medium_quality", "score >= 50 AND score < 80"), ("low_quality", "score < 50")]
leads_query("score_bands", " UNION ALL ".join(f"SELECT {lit(b)} AS band, {n_if(c)} AS count FROM leads" for b, c in BANDS))
FACETS = {"industries": "industry", "locations": "location", "company_sizes": "employees", "revenue_ranges": "revenue"}


def facets_sql(source: str, limits: dict[str, int], where: str = "true") -> str:
    parts = [
        f"""SELECT {lit(f)} AS facet, {FACETS[f]} AS value, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, {FACETS[f]}) AS INT) AS rank
 FROM {source} WHERE {FACETS[f]} IS NOT NULL AND {where} GROUP BY {FACETS[f]} QUALIFY rank <= {n}"""
        for f, n in limits.items()
    ]
    return " UNION ALL ".join(f"({x})" for x in parts)


leads_query("facets", facets_sql("leads", {"industries": 20, "locations": 20, "company_sizes": 10, "revenue_ranges": 10}))
leads_query(
    "facets_q",
    facets_sql("leads", {f: 10 for f in FACETS}, "(company ILIKE '%ring%' OR industry ILIKE '%ring%' OR description ILIKE '%ring%')"),
)
TYPES = [("Company Name", all_set("company", "description")), ("Industry + Location", all_set("industry", "location"))]
leads_query(
    "conversion_by_query_type",
    " UNION ALL ".join(
        f"SELECT {lit(t)} AS type, {n_if(c)} AS searches, {n_if(c + ' AND ' + QUALIFIED)} AS conversions, {pct(n_if(c + ' AND ' + QUALIFIED), n_if(c))} AS rate FROM leads HAVING {n_if(c)} > 0"
        for t, c in TYPES
    ),
)
CONTACTED = n_if("last_contact IS NOT NULL")
leads_query(
    "conversion_by_industry",
    f"""SELECT 'Industry: ' || industry AS query_type, count(*) AS total_searches, {CONTACTED} AS conversions, {pct(CONTACTED, 'count(*)')} AS conversion_rate
 FROM leads WHERE industry IS NOT NULL GROUP BY industry HAVING count(*) >= 5 ORDER BY 2 DESC, industry LIMIT 5""",
)
leads_query(
    "top_converting_filters",
    f"""SELECT filter, usage, conversion_rate FROM (
 (SELECT 0 AS k, 'industry:' || industry AS filter, count(*) AS usage, {pct(n_if(QUALIFIED), 'count(*)')} AS conversion_rate FROM leads WHERE industry IS NOT NULL GROUP BY industry ORDER BY 3 DESC, industry LIMIT 3)
 UNION ALL (SELECT 1, 'location:' || location, count(*), {pct(n_if(QUALIFIED), 'count(*)')} FROM leads WHERE location IS NOT NULL GROUP BY location ORDER BY 3 DESC, location LIMIT 2))
 ORDER BY k, usage DESC, filter LIMIT 4""",
)
leads_query(
    "top_converting_filters_variant",
    f"""(SELECT 'location' AS filter_type, location AS filter_value, {pct(CONTACTED, 'count(*)')} AS conversion_rate, count(*) AS total_leads FROM leads WHERE location IS NOT NULL GROUP BY location HAVING count(*) >= 3 ORDER BY 4 DESC, 2 LIMIT 3)
 UNION ALL (SELECT 'company_size', employees, {pct(CONTACTED, 'count(*)')}, count(*) FROM leads WHERE employees IS NOT NULL GROUP BY employees HAVING count(*) >= 3 ORDER BY 4 DESC, 2 LIMIT 2)""",
)
COVERAGE = "CASE WHEN count(*) > 0 THEN count(indexed_at) / count(*) * 100 ELSE 0 END"
leads_query(
    "indexing_status",
    f"""SELECT count(*) AS total_leads, count(indexed_at) AS indexed_leads, {rnd(COVERAGE, 1)} AS coverage_percent,
 {n_if(f"indexed_at >= {LEADS_AT} - INTERVAL 24 HOUR")} AS recent_indexed_24h, CASE WHEN {COVERAGE} > 90 THEN 'healthy' ELSE 'needs_attention' END AS status FROM leads""",
)
leads_query(
    "indexing_coverage",
    f"""SELECT count(*) AS total_leads, count(indexed_at) AS indexed_leads, count(*) - count(indexed_at) AS unindexed_leads, {rnd(COVERAGE, 1)} AS indexing_coverage,
 max(indexed_at) AS last_index_update, CASE WHEN {COVERAGE} > 95 THEN 'healthy' ELSE 'needs_attention' END AS status FROM leads""",
)
leads_query(
    "hourly_trend",
    """SELECT lpad(CAST(h AS VARCHAR), 2, '0') || ':00' AS hour, 2 * (SELECT count(*) FROM leads WHERE CAST(created_at AS DATE) = DATE '2001-08-01' AND hour(created_at) = h) AS searches
 FROM (SELECT unnest(range(24)) AS h)""",
)
leads_query(
    "missing_fields",
    f"""SELECT count(*) AS total_leads, {n_if('industry IS NULL')} AS without_industry, {n_if('location IS NULL')} AS without_location,
 {n_if(HARD)} AS incomplete_leads, {n_if(HARD)} > count(*) * 0.2 AS needs_completion FROM leads""",
)
leads_query(
    "contact_performance",
    f"""SELECT count(*) AS total_leads, {n_if(QUALIFIED)} AS qualified_leads, CAST(floor({n_if(QUALIFIED)} * {dbl(0.8)}) AS BIGINT) AS emails_sent,
 CAST(floor({n_if(QUALIFIED)} * {dbl(0.3)}) AS BIGINT) AS calls_made FROM leads""",
)
leads_query(
    "lead_flags",
    f"""SELECT id, {QUALIFIED} AS qualified, {HIGH} AS high_quality, (company IS NULL AND email IS NULL AND phone IS NULL) AS blank,
 {HARD} AS hard_to_find, last_contact IS NOT NULL AS contacted FROM leads""",
)

# --- filters ----------------------------------------------------------------------------------
leads_query(
    "lead_listing",
    """SELECT id, company, industry, location, created_at FROM leads WHERE industry ILIKE '%build%' AND status = 'Contatado' AND location ILIKE '%a%'
 ORDER BY created_at DESC, id LIMIT 50 OFFSET 10""",
)
leads_query(
    "filter_search",
    """SELECT id, company, industry, location, employees, revenue FROM leads WHERE industry ILIKE '%machinery%' AND location ILIKE '%asia%'
 AND employees ILIKE '%51-200%' AND revenue ILIKE '%R$ 5M%'""",
)


def text_like(pattern: str) -> str:
    return "(" + " OR ".join(f"coalesce({c} ILIKE '%{pattern}%', false)" for c in ("company", "description", "industry")) + ")"


leads_query("keyword_filter", f"SELECT id, company, industry FROM leads WHERE {text_like('the')} AND {text_like('r_ng')}")
leads_query("text_filter", f"SELECT id, company FROM leads WHERE {text_like('widget')}")
leads_query("company_prefix", "SELECT id, company FROM leads WHERE company ILIKE 'SMALL r%'")
leads_query("lead_lookup", "SELECT id, user_id, company, email, score FROM leads WHERE id = 42")
HEADS = "TRY_CAST(regexp_extract(employees, '([0-9]+)', 1) AS BIGINT)"
ORACLES["scrape_filter"] = with_(INCOMING) + (
    f"SELECT id, (company = '' OR coalesce({HEADS} < 10, false) OR coalesce({HEADS} > 60, false)) AS skip, {HEADS} AS head_count FROM incoming"
)

# --- index ------------------------------------------------------------------------------------
META = rf"""meta0 AS (SELECT *, {cleaned('company')} AS c1, {cleaned('description')} AS c2, {cleaned('industry')} AS c3, {cleaned('location')} AS c4 FROM leads),
meta1 AS (SELECT *, list_sort(list_distinct(list_filter(regexp_extract_all(c2, '[\p{{L}}\p{{N}}_]*[0-9][\p{{L}}\p{{N}}_]*'),
  lambda t: length(t) >= 3 AND NOT list_contains({arr(fv.STOP_WORDS)}, t))))[1:10] AS kw FROM meta0),
meta2 AS (SELECT *, array_to_string(list_filter([c1, c2, c3, c4, array_to_string(kw, ' '), contact, email, website], lambda x: x IS NOT NULL AND x <> ''), ' ') AS searchable_text FROM meta1),
meta AS (SELECT *, {tokens('c1')} AS ct, {tokens('c3')} AS it, {tokens('c4')} AS lt, {tokens('searchable_text')} AS toks FROM meta2),
keyed AS (SELECT *, list_distinct(list_concat(list_transform(toks, lambda t: lower(t)), kw,
  CASE WHEN len(it) > 0 THEN ['industry:' || it[1]] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN len(lt) > 0 THEN ['location:' || lt[1]] ELSE CAST([] AS VARCHAR[]) END)) AS keys FROM meta)"""
POSTINGS = "postings AS (SELECT unnest(keys) AS token, id AS lead_id FROM keyed)"
leads_query(
    "index_metadata",
    f"SELECT id, searchable_text, {show('ct')} AS company_tokens, {show('it')} AS industry_tokens, {show('lt')} AS location_tokens, {show('kw')} AS keywords, {show('toks')} AS all_tokens FROM meta",
    META,
)
leads_query(
    "stored_metadata",
    f"SELECT id, CASE WHEN id % 3 = 0 THEN 'stored: ' ELSE '' END || searchable_text AS searchable_text, {show('ct')} AS company_tokens, {show('toks')} AS all_tokens FROM meta",
    META,
)
leads_query("candidates_by_index", "SELECT id, company, industry FROM keyed WHERE list_has_all(keys, ['small', 'ring', 'industry:building'])", META)
leads_query("postings", "SELECT token, lead_id FROM postings", META, POSTINGS)
leads_query(
    "posting_lists",
    "SELECT token, lead_id // 4096 AS chunk, CAST(count(*) AS INT) AS n_leads, min(lead_id) AS first_id, max(lead_id) AS last_id FROM postings GROUP BY 1, 2",
    META,
    POSTINGS,
)
leads_query("token_intersection", "SELECT id AS lead_id FROM keyed WHERE list_has_all(keys, ['small', 'ring', 'industry:building'])", META)
ORACLES["token_intersection_blocks"] = ORACLES["token_intersection"]
leads_query(
    "index_stats", f"SELECT count(*) AS total_leads, {n_if('len(keys) > 0')} AS indexed_leads, {n_if('len(keys) = 0')} AS failed_leads FROM keyed", META
)
leads_query("incremental_index", "SELECT id AS lead_id, CAST(len(keys) AS BIGINT) AS n_tokens FROM keyed WHERE indexed_at IS NULL", META)
leads_query(
    "index_removal",
    "SELECT token, count(*) AS n_leads FROM postings WHERE lead_id NOT IN (SELECT id FROM changes WHERE op = 'delete') GROUP BY token",
    META,
    POSTINGS,
    CHANGES,
)

# --- search -----------------------------------------------------------------------------------
FIELD_WEIGHTS = fv.TEXT_FIELD_WEIGHTS
QUALITY = "(" + " + ".join(f"CASE WHEN coalesce(trim({c}) <> '', false) THEN 1 ELSE 0 END" for c in fv.QUALITY_FIELDS) + ")"
AGE = f"floor((epoch_us({LEADS_AT}) - epoch_us(created_at)) / 86400000000)"
FRESH = f"CASE WHEN created_at IS NULL THEN 0.0 WHEN {AGE} <= 7 THEN 1.0 WHEN {AGE} <= 30 THEN 0.8 WHEN {AGE} <= 90 THEN 0.5 ELSE 0.2 END"
FTS_TOKENS = tokens("(c1 || ' ' || c2)")


def text_sum(terms: list[str], phrases: list[str]) -> str:
    parts = [dbl(0)]
    for name, w in FIELD_WEIGHTS:
        text = f"lower(coalesce({name}, ''))"
        for t in terms:
            parts.append(
                f"CASE WHEN contains({text}, {lit(t)}) THEN {dbl(w)} * CASE WHEN starts_with({text}, {lit(t)}) THEN {dbl(0.8)} ELSE {dbl(0.5)} END ELSE {dbl(0)} END"
            )
        for p in phrases:
            parts.append(f"CASE WHEN contains({text}, {lit(p)}) THEN {dbl(w)} ELSE {dbl(0)} END")
    return "least(" + " + ".join(parts) + f", {dbl(1)})"


def text_why(terms: list[str], phrases: list[str]) -> list[str]:
    out = []
    for name, _ in FIELD_WEIGHTS:
        text = f"lower(coalesce({name}, ''))"
        out += [f"CASE WHEN contains({text}, {lit(t)}) THEN {lit(f'''Term '{t}' found in {name}''')} END" for t in terms]
        out += [f"CASE WHEN contains({text}, {lit(p)}) THEN {lit(f'''Phrase '{p}' found in {name}''')} END" for p in phrases]
    return out


def search_sql(
    terms=(), phrases=(), industry=None, location=None, size=None, limit=20, offset=0, order="relevance", liked=((), ()), weights=None
) -> str:
    """Brute-force ranking; rows (position, lead columns, relevance_score, why) in CTE "page"."""
    weights = weights or fv.PREFERENCE_WEIGHTS
    terms, phrases = sorted(terms), list(phrases)
    w = {c: dbl(weights.get(c, d)) for c, d in fv.COMPONENT_WEIGHTS.items()}
    conds = [f"coalesce({c} ILIKE '%{v}%', false)" for c, v in (("industry", industry), ("location", location), ("employees", size)) if v]
    where = " AND ".join(conds) or "true"
    ind = f"CASE WHEN NOT {filled('industry')} THEN 0"
    ind_why = f"CASE WHEN NOT {filled('industry')} THEN NULL"
    loc = f"CASE WHEN NOT {filled('location')} THEN 0"
    loc_why = f"CASE WHEN NOT {filled('location')} THEN NULL"
    siz, siz_why = f"CASE WHEN NOT {filled('employees')} THEN 0", f"CASE WHEN NOT {filled('employees')} THEN NULL"
    if industry:
        ind += f" WHEN lower(industry) = {lit(industry.lower())} THEN 1 WHEN contains(lower(industry), {lit(industry.lower())}) THEN 0.7"
        ind_why += f" WHEN lower(industry) = {lit(industry.lower())} THEN 'Exact industry match: ' || industry WHEN contains(lower(industry), {lit(industry.lower())}) THEN 'Partial industry match: ' || industry"
    if location:
        shared = has_any("lower(location)", location.lower().split())
        loc += f" WHEN lower(location) = {lit(location.lower())} THEN 1 WHEN {shared} THEN 0.8"
        loc_why += f" WHEN lower(location) = {lit(location.lower())} THEN 'Exact location match: ' || location WHEN {shared} THEN 'Location proximity: ' || location"
    if size:
        part = f"(contains(employees, {lit(size)}) OR contains({lit(size)}, employees))"
        siz += f" WHEN employees = {lit(size)} THEN 1 WHEN {part} THEN 0.7"
        siz_why += f" WHEN employees = {lit(size)} THEN 'Exact size match: ' || employees WHEN {part} THEN 'Size range match: ' || employees"
    if liked[0]:
        ind += f" WHEN list_contains({arr(liked[0])}, industry) THEN 0.6"
        ind_why += f" WHEN list_contains({arr(liked[0])}, industry) THEN 'User preferred industry: ' || industry"
    if liked[1]:
        loc += f" WHEN list_contains({arr(liked[1])}, location) THEN 0.6"
        loc_why += f" WHEN list_contains({arr(liked[1])}, location) THEN 'User preferred location: ' || location"
    every = terms + phrases
    score = f"least({dbl(0)} + {text_sum(terms, phrases)} * {w['text_relevance']}"
    score += f" + {dbl(ind + ' ELSE 0 END')} * {w['industry_match']} + {dbl(loc + ' ELSE 0 END')} * {w['location_proximity']}"
    score += f" + {dbl(siz + ' ELSE 0 END')} * {w['company_size']} + {QUALITY} / 7 * {w['data_quality']} + {dbl(FRESH)} * {w['freshness']}, {dbl(1)})"
    why = text_why(terms, phrases) + [ind_why + " END", loc_why + " END", siz_why + " END"]
    why.append(f"CASE WHEN {QUALITY} / 7 > 0.8 THEN 'High data completeness' WHEN {QUALITY} / 7 > 0.5 THEN 'Good data completeness' END")
    why.append(f"CASE WHEN {AGE} <= 7 THEN 'Very recent lead' WHEN {AGE} <= 30 THEN 'Recent lead' WHEN {AGE} <= 90 THEN 'Moderately recent lead' END")
    tier = "0"
    if every:
        phrase_hit = " OR ".join(f"list_has_all({FTS_TOKENS}, {arr(p.split())})" for p in phrases)
        hit = [f"list_has_any({FTS_TOKENS}, {arr(terms)})"] if terms else []
        hit += [phrase_hit] if phrases else []
        hit += [f"coalesce(company ILIKE '%{every[0]}%', false)", f"coalesce(industry ILIKE '%{every[0]}%', false)"]
        index = f"WHEN list_has_all(keys, {arr(terms)}) THEN 1" if terms else ""
        tier = f"CASE {index} WHEN {' OR '.join(hit)} THEN 0 END"
    by = "indexed_at DESC NULLS LAST, id" if order == "created_at" else "relevance_score DESC, id"
    return with_(
        LEADS,
        META,
        f"cand AS (SELECT *, {tier} AS tier FROM keyed WHERE {where})",
        f"ranked AS (SELECT *, {score} AS relevance_score, list_filter([{', '.join(why)}], lambda x: x IS NOT NULL) AS why FROM cand WHERE tier = (SELECT max(tier) FROM cand))",
        f"capped AS (SELECT *, CAST(row_number() OVER (ORDER BY {by}) AS INT) AS position FROM ranked WHERE relevance_score > 0)",
        f"page AS (SELECT * FROM capped WHERE position > {offset} AND position <= {offset + limit})",
    )


SHOW_PAGE = f"""SELECT position, id, company, {rnd('relevance_score', 6)} AS relevance_score, CAST(floor(relevance_score * 100) AS INT) AS score,
 CASE WHEN relevance_score > 0.8 THEN 'Alta' ELSE 'Média' END AS priority, {show('why')} AS match_reasons FROM page"""
# "small" in the text also implies the company size 1-10.
SMALL_RING = dict(terms=["small", "ring"], industry="BUILDING", size="1-10")
ORACLES["search_ranked"] = search_sql(**SMALL_RING) + SHOW_PAGE
ORACLES["search_with_postings"] = ORACLES["search_stored_index"] = ORACLES["search_ranked"]
ORACLES["search_by_index_time"] = search_sql(**SMALL_RING, limit=30, offset=5, order="created_at") + SHOW_PAGE
ORACLES["search_full_text"] = search_sql(["widget", "unobtainable"], ["hot gear"], location="europe", limit=50) + SHOW_PAGE
ORACLES["search_personal"] = (
    search_sql(
        ["blue"],
        limit=100,
        liked=(["BUILDING", "MACHINERY"], ["CHINA, ASIA", "BRAZIL, AMERICA"]),
        weights={"industry_match": 0.5, "text_relevance": 0.3, "location_proximity": 0.2},
    )
    + SHOW_PAGE
)
ORACLES["result_facets"] = search_sql(**SMALL_RING, limit=500) + facets_sql("page", {"industries": 5, "locations": 5, "company_sizes": 5})
ORACLES["advanced_search"] = search_sql(["gear"], industry="MACHINERY", size="11-50") + SHOW_PAGE
ORACLES["advanced_search_labels"] = (
    search_sql(["gear"], industry="MACHINERY", size="11-50", location="ASIA")
    + "SELECT count(*) AS total_results, 'high' AS query_complexity, CASE WHEN max_by(relevance_score, -position) > 0.8 THEN 'high' ELSE 'medium' END AS result_quality FROM page"
)


def fts_sql(cond: str, where: str = "true") -> str:
    return with_(LEADS, META) + f"SELECT id, company FROM keyed WHERE {where} AND ({cond})"


ORACLES["candidates_fts"] = fts_sql(
    f"list_has_any({FTS_TOKENS}, ['red', 'bolt']) OR coalesce(company ILIKE '%bolt%', false) OR coalesce(industry ILIKE '%bolt%', false)",
    "coalesce(industry ILIKE '%auto%', false)",
)
ORACLES["candidates_fts_all"] = fts_sql(
    f"list_has_all({FTS_TOKENS}, ['red', 'bolt']) OR coalesce(company ILIKE '%bolt%', false) OR coalesce(industry ILIKE '%bolt%', false)"
)


def word_case(groups, text: str) -> str:
    cases = " ".join(
        rf"WHEN regexp_matches({text}, '(^|[^\p{{L}}\p{{N}}_])({'|'.join(ws)})($|[^\p{{L}}\p{{N}}_])') THEN {lit(v)}" for v, ws in groups
    )
    return f"CASE {cases} END"


def parsed(source: str) -> str:
    return rf"""log0 AS (SELECT query_id, query_text, {cleaned('query_text', '_"-')} AS q FROM {source}),
log AS (SELECT query_id, query_text, {tokens('''regexp_replace(q, '"[^"]*"', '', 'g')''')} AS terms, regexp_extract_all(q, '"([^"]*)"', 1) AS phrases,
 {word_case(fv.IMPLICIT_INDUSTRIES, 'q')} AS industry, {word_case(fv.IMPLICIT_LOCATIONS, 'q')} AS location, {word_case(fv.IMPLICIT_SIZES, 'q')} AS company_size FROM log0)"""


ORACLES["parse_query_log"] = with_(RAW_LOG, parsed("raw_log")) + (
    f"SELECT query_id, {show('terms')} AS terms, {show('phrases')} AS phrases, industry, location, company_size FROM log"
)
N_FILTERS = "(CAST(industry IS NOT NULL AS INT) + CAST(location IS NOT NULL AS INT) + CAST(company_size IS NOT NULL AS INT))"
OPT = f"CAST(least(50 + least(len(terms) * 10, 30) + len(phrases) * 15 + {N_FILTERS} * 10, 100) AS INT)"
ORACLES["query_analysis"] = with_(RAW_LOG, parsed("raw_log"), f"scored AS (SELECT *, {N_FILTERS} AS n_filters, {OPT} AS s FROM log)") + (
    f"""SELECT query_id, {show('terms')} AS terms, n_filters, s AS optimization_score,
 CASE WHEN s > 70 THEN 'fast' WHEN s > 40 THEN 'medium' ELSE 'slow' END AS expected_speed,
 CASE WHEN len(terms) <= 3 AND len(phrases) = 0 THEN 'high' ELSE 'medium' END AS cache_likelihood,
 CASE WHEN s > 60 THEN 'high' ELSE 'medium' END AS result_quality,
 array_to_string(list_filter([CASE WHEN len(terms) = 1 AND len(phrases) = 0 AND n_filters = 0 THEN 'specificity' END,
  CASE WHEN len(terms) > 5 THEN 'simplification' END, 'location_filter', 'industry_filter'], lambda x: x IS NOT NULL), '|') AS suggestions FROM scored"""
)
SUM_TEXT = "list_reduce(list_concat([{zero}], {parts}), lambda a, b: a + b)"
_parts = []
for _name, _w in FIELD_WEIGHTS:
    _t = f"lower(coalesce({_name}, ''))"
    _parts.append(
        f"list_transform(terms, lambda t: CASE WHEN contains({_t}, t) THEN {dbl(_w)} * CASE WHEN starts_with({_t}, t) THEN {dbl(0.8)} ELSE {dbl(0.5)} END ELSE {dbl(0)} END)"
    )
    _parts.append(f"list_transform(phrases, lambda t: CASE WHEN contains({_t}, t) THEN {dbl(_w)} ELSE {dbl(0)} END)")
BATCH_TEXT = f"least(list_reduce(list_concat([{dbl(0)}], {', '.join(_parts)}), lambda a, b: a + b), {dbl(1)})"
WEIGHTS = {c: dbl(fv.PREFERENCE_WEIGHTS.get(c, x)) for c, x in fv.COMPONENT_WEIGHTS.items()}
BATCH_SIZE = "CASE WHEN company_size IS NULL OR NOT coalesce(employees <> '', false) THEN 0 WHEN employees = company_size THEN 1 WHEN contains(employees, company_size) OR contains(company_size, employees) THEN 0.7 ELSE 0 END"
BATCH_SCORE = (
    f"least({dbl(0)} + {BATCH_TEXT} * {WEIGHTS['text_relevance']} + {dbl(0)} * {WEIGHTS['industry_match']} + {dbl(0)} * {WEIGHTS['location_proximity']}"
    f" + {dbl(BATCH_SIZE)} * {WEIGHTS['company_size']} + {QUALITY} / 7 * {WEIGHTS['data_quality']} + {dbl(FRESH)} * {WEIGHTS['freshness']}, {dbl(1)})"
)
ORACLES["search_batch"] = with_(
    LEADS,
    META,
    QUERY_LOG,
    parsed("query_log"),
    f"stored AS (SELECT * EXCLUDE (location, industry), location AS lead_location, industry AS lead_industry, {FTS_TOKENS} AS fts FROM keyed)",
    """pairs AS (SELECT log.query_id, log.query_text, log.terms, log.phrases, log.company_size, stored.*, stored.lead_industry AS industry, stored.lead_location AS location,
 CASE WHEN len(terms) > 0 AND list_has_all(keys, terms) THEN 1
  WHEN list_has_any(fts, terms) OR len(list_filter(phrases, lambda p: list_has_all(fts, string_split(p, ' ')))) > 0
   OR coalesce(company ILIKE '%' || list_concat(terms, phrases)[1] || '%', false) OR coalesce(lead_industry ILIKE '%' || list_concat(terms, phrases)[1] || '%', false) THEN 0 END AS tier
 FROM log, stored WHERE company_size IS NULL OR coalesce(employees ILIKE '%' || company_size || '%', false))""",
    "best AS (SELECT * FROM pairs WHERE tier IS NOT NULL QUALIFY tier = max(tier) OVER (PARTITION BY query_id))",
    f"ranked AS (SELECT query_id, query_text, id, {BATCH_SCORE} AS s FROM best)",
) + f"""SELECT entries.query_id, query_text, CAST(row_number() OVER (PARTITION BY entries.query_id ORDER BY s DESC, id) AS INT) AS position, id, {rnd('s', 6)} AS relevance_score
 FROM ranked JOIN entries USING (query_text) WHERE s > 0 QUALIFY position <= 20"""


def marked(col: str) -> str:
    text = col
    for t in ("mark", "ring", "small", "the"):
        text = f"CASE WHEN contains(lower({col}), '{t}') THEN regexp_replace({text}, '{t}', '<mark>{t}</mark>', 'gi') ELSE {text} END"
    return f"CASE WHEN contains({text}, '<mark>') THEN {text} END"


leads_query("highlights", "SELECT id, " + ", ".join(f"{marked(c)} AS h_{c}" for c in fv.HIGHLIGHT_FIELDS) + " FROM leads")
TOP_POPULAR = "SELECT query FROM popular ORDER BY cnt DESC, query DESC LIMIT {n}"
SUGGEST = """sug AS (SELECT CAST(row_number() OVER (ORDER BY src, w, text) AS INT) AS position, text FROM (
 SELECT text, min(src) AS src, min_by(w, src) AS w FROM (
  SELECT 0 AS src, -cnt AS w, query AS text FROM (SELECT * FROM popular WHERE starts_with(lower(query), '{low}') ORDER BY cnt DESC, query LIMIT {n})
  UNION ALL (SELECT DISTINCT 1, 0, company FROM leads WHERE company ILIKE '{low}%' ORDER BY company LIMIT {n})
  UNION ALL (SELECT DISTINCT 2, 0, industry FROM leads WHERE industry ILIKE '{low}%' ORDER BY industry LIMIT {n})) GROUP BY text)
 QUALIFY position <= {n})"""
leads_query("suggestions", "SELECT position, text FROM sug", POPULAR, SUGGEST.format(low="re", n=12))
leads_query(
    "typed_suggestions",
    """SELECT CAST(row_number() OVER (ORDER BY b, n) AS INT) AS position, text, type, description FROM (
 SELECT 0 AS b, position AS n, text, 'text' AS type, 'Buscar por: ' || text AS description FROM sug WHERE position <= 5
 UNION ALL SELECT 1, n, text, type, description FROM (
  SELECT *, row_number() OVER (ORDER BY k, text) AS n FROM (
   (SELECT DISTINCT 0 AS k, industry AS text, 'industry' AS type, 'Buscar por indústria: ' || industry AS description FROM leads WHERE industry ILIKE '%in%' ORDER BY text LIMIT 3)
   UNION ALL (SELECT DISTINCT 1, location, 'location', 'Buscar por localização: ' || location FROM leads WHERE location ILIKE '%in%' ORDER BY location LIMIT 3)
   UNION ALL (SELECT DISTINCT 2, company, 'company', 'Empresa: ' || company FROM leads WHERE company ILIKE '%in%' ORDER BY company LIMIT 3))
  WHERE text NOT IN (SELECT text FROM sug)) WHERE n <= 5) QUALIFY position <= 10""",
    POPULAR,
    SUGGEST.format(low="in", n=10),
)
ORACLES["related_queries"] = with_(RAW_LOG, parsed("raw_log"), POPULAR, "pool AS (SELECT list(query ORDER BY cnt DESC, query) AS qs FROM (SELECT * FROM popular ORDER BY cnt DESC, query DESC LIMIT 10))") + (
    """SELECT query_id, array_to_string(list_filter(qs, lambda p: len(list_filter(terms, lambda t: contains(lower(p), t))) > 0)[1:5], '|') AS related_queries FROM log, pool"""
)
ORACLES["related_queries_all"] = with_(RAW_LOG, parsed("raw_log"), POPULAR, "pool AS (SELECT list(query ORDER BY cnt DESC, query) AS qs FROM popular)") + (
    """SELECT query_id, array_to_string(list_filter(qs, lambda p: len(list_filter(terms, lambda t: contains(lower(p), t))) > 0)[1:5], '|') AS related_queries FROM log, pool"""
)
ORACLES["estimated_results"] = with_(
    LEADS,
    RAW_LOG,
    parsed("raw_log"),
    "terms AS (SELECT DISTINCT unnest(terms) AS term FROM log)",
    """counted AS (SELECT term, (SELECT count(*) FROM leads WHERE coalesce(company ILIKE '%' || term || '%', false) OR coalesce(industry ILIKE '%' || term || '%', false)
 OR coalesce(description ILIKE '%' || term || '%', false)) AS n FROM terms)""",
    "asked AS (SELECT query_id, query_text, unnest(CASE WHEN len(terms) > 0 THEN terms ELSE [NULL] END) AS term FROM log)",
) + """SELECT query_id, query_text, coalesce(max(n), 0) AS estimated_results FROM asked LEFT JOIN counted USING (term) GROUP BY 1, 2"""
_TOP = "(SELECT {c} FROM leads WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
ORACLES["query_report"] = with_(
    LEADS, RAW_LOG, parsed("raw_log"), f"scored AS (SELECT *, {N_FILTERS} AS n_filters, {OPT} AS s FROM log)",
    f"estimates AS ({ORACLES['estimated_results']})", f"related AS ({ORACLES['related_queries_all']})",
) + f"""SELECT query_id, s AS optimization_score, estimated_results, related_queries, array_to_string(list_filter([
 CASE WHEN len(terms) = 1 AND len(phrases) = 0 AND n_filters = 0 THEN 'specificity: high: ' || scored.query_text || ' ' || {lit(fv.BROAD_QUERY_EXAMPLE)} END,
 CASE WHEN len(terms) > 5 THEN 'simplification: medium: ' || array_to_string(terms[1:3], ' ') END,
 'location_filter: medium: ' || scored.query_text || ' ' || {_TOP.format(c='location')}, 'industry_filter: medium: ' || scored.query_text || ' ' || {_TOP.format(c='industry')}],
 lambda x: x IS NOT NULL), '|') AS advice FROM scored JOIN estimates USING (query_id) JOIN related USING (query_id)"""
_EXPAND = []
for _stem, _extra in fv.QUERY_EXPANSIONS:
    _EXPAND.append(
        f"CASE WHEN contains(lower(q), {lit(_stem)}) THEN list_transform(list_filter({arr(_extra)}, lambda t: NOT contains(lower(q), t)), lambda t: q || ' ' || t) ELSE CAST([] AS VARCHAR[]) END"
    )
_EXPAND.append(f"CASE WHEN {has_any('lower(q)', fv.EXPANSION_CITIES)} THEN [q || ' centro', q || ' zona sul'] ELSE CAST([] AS VARCHAR[]) END")
ORACLES["query_expansion"] = with_(RAW_LOG, "texts AS (SELECT query_id, query_text || ' cont rest' AS q FROM raw_log)") + (
    f"SELECT query_id, array_to_string(list_concat({', '.join(_EXPAND)})[1:5], '|') AS expanded FROM texts"
)
ORACLES["query_dedup"] = with_(RAW_LOG) + "SELECT count(*) AS n, min(query_id) AS first_query FROM raw_log GROUP BY lower(query_text)"

# --- events -----------------------------------------------------------------------------------


def events_query(name: str, sql: str, *more: str) -> None:
    ORACLES[name] = with_(SEARCHES, INTERACTIONS, *more) + sql


SINCE30 = f"created_at >= {EVENTS_AT} - INTERVAL 30 DAY"
events_query(
    "search_summary",
    f"""SELECT count(*) AS total_searches, CAST({rnd('sum(response_time_ms) / count(*)', 0)} AS BIGINT) AS avg_response_time_ms,
 {pct(n_if("cache_hit = 'hit'"), 'count(*)')} AS cache_hit_rate, {rnd('sum(results_count) / count(*)', 1)} AS avg_results_per_search,
 CAST(sum(clicked_results) AS BIGINT) AS total_clicks, CAST(sum(converted_leads + contacted_leads) AS BIGINT) AS total_conversions,
 {pct('sum(clicked_results)', 'count(*)')} AS click_through_rate, {pct('sum(converted_leads + contacted_leads)', 'count(*)')} AS conversion_rate FROM searches WHERE {SINCE30}""",
)
HIT, MISS = n_if("cache_hit = 'hit'"), n_if("cache_hit = 'miss'")
events_query("cache_hit_rate", f"SELECT {HIT} AS hits, {MISS} AS misses, {pct(HIT, f'({HIT} + {MISS})')} AS cache_hit_rate FROM searches")
events_query(
    "popular_queries",
    f"""SELECT query_text AS query, count(*) AS count, {rnd('avg(results_count)', 1)} AS avg_results, CAST({rnd('avg(response_time_ms)', 0)} AS BIGINT) AS avg_response_time_ms
 FROM searches WHERE {SINCE30} AND query_text <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
events_query("popular_searches", "SELECT query_text AS query, count(*) AS count FROM searches WHERE query_text <> '' GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 8")
LAST_HOUR = "created_at >= TIMESTAMP '2024-01-30 22:00:00'"
events_query(
    "realtime_activity",
    f"""SELECT (SELECT count(*) FROM searches WHERE {LAST_HOUR}) AS searches_last_hour, (SELECT count(DISTINCT user_id) FROM searches WHERE {LAST_HOUR}) AS active_users,
 (SELECT count(*) FROM interactions WHERE {LAST_HOUR}) AS interactions_last_hour""",
)
events_query(
    "todays_activity",
    """SELECT a AS leads_added_today, b AS searches_today, CASE WHEN a > 0 THEN 'up' ELSE 'stable' END AS trend FROM
 (SELECT count(*) AS a FROM leads WHERE created_at >= TIMESTAMP '2024-01-30'), (SELECT count(*) AS b FROM searches WHERE created_at >= TIMESTAMP '2024-01-30')""",
    LEADS,
)
events_query(
    "activity_feed",
    """SELECT * FROM (
 (SELECT 'search' AS type, created_at AS timestamp, id, 'Busca por ''' || CASE WHEN query_text <> '' THEN query_text ELSE 'filtros' END || ''' retornou ' || results_count || ' resultados' AS description
  FROM searches ORDER BY created_at DESC, id DESC LIMIT 10)
 UNION ALL (SELECT 'interaction', created_at, id, 'Lead ' || lead_id || ' - ' || interaction_type FROM interactions ORDER BY created_at DESC, id DESC LIMIT 10))""",
)
IS_CONTACT = "interaction_type IN ('contact', 'email', 'call')"
COUNTERS = f"""counters AS (SELECT lead_id, {n_if("interaction_type = 'view'")} AS views, {n_if(IS_CONTACT)} AS contacts,
 max(created_at) FILTER (WHERE {IS_CONTACT}) AS contacted_at, {n_if("interaction_type = 'convert'")} AS conversions FROM interactions GROUP BY lead_id)"""
COUNTED = f"""counted AS (SELECT leads.* EXCLUDE (last_contact), coalesce(views, 0) AS view_count, coalesce(contacts, 0) AS contact_count,
 coalesce(contacted_at, last_contact) AS last_contact, least({dbl(0)} + {dbl(0.1)} * coalesce(conversions, 0), {dbl(1)}) AS conversion_score
 FROM leads LEFT JOIN counters ON lead_id = id)"""
events_query(
    "lead_counters",
    f"SELECT id, view_count, contact_count, last_contact, {rnd('conversion_score', 6)} AS conversion_score FROM counted",
    LEADS,
    COUNTERS,
    COUNTED,
)
STAGES = [
    ("discovered", "Descobertos", "count(*)"),
    ("viewed", "Visualizados", n_if("view_count > 0")),
    ("contacted", "Contatados", n_if("contact_count > 0")),
    ("qualified", "Qualificados", n_if(QUALIFIED)),
    ("converted", "Convertidos", n_if("conversion_score > 0.5")),
]
events_query(
    "funnel",
    f"""SELECT stage_order, stage, label, n AS count, {pct('n', 'first_value(n) OVER (ORDER BY stage_order)')} AS conversion_rate, drop_off_rate,
 stage = (SELECT stage FROM dropped WHERE stage_order > 0 ORDER BY drop_off_rate DESC, stage_order LIMIT 1) AS is_biggest_drop_off FROM dropped""",
    LEADS,
    COUNTERS,
    COUNTED,
    "staged AS (" + " UNION ALL ".join(f"SELECT {i} AS stage_order, '{s}' AS stage, '{lb}' AS label, {e} AS n FROM counted" for i, (s, lb, e) in enumerate(STAGES)) + ")",
    f"""dropped AS (SELECT *, {rnd('CASE WHEN stage_order > 0 AND lag(n) OVER w > 0 THEN (lag(n) OVER w - n) / lag(n) OVER w * 100 ELSE 0 END', 1)} AS drop_off_rate
 FROM staged WINDOW w AS (ORDER BY stage_order))""",
)
events_query(
    "click_attribution",
    f"""SELECT s.id, query_text, CAST(clicked_results + coalesce(n, 0) AS BIGINT) AS clicked_results FROM searches s
 LEFT JOIN (SELECT event_id - {K} % 5 AS sid, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) ON sid = s.id""",
)
events_query(
    "conversion_attribution",
    f"""SELECT s.id, CAST(contacted_leads + coalesce(a, 0) AS BIGINT) AS contacted_leads, CAST(converted_leads + coalesce(b, 0) AS BIGINT) AS converted_leads FROM searches s
 LEFT JOIN (SELECT event_id - {K} AS sid, {n_if("event_type = 'signup'")} AS a, {n_if("event_type IN ('purchase', 'error')")} AS b FROM events GROUP BY 1) ON sid = s.id""",
)
events_query("event_defaults", "SELECT id, cache_hit, clicked_results, true AS has_session FROM searches")
events_query("interaction_defaults", "SELECT id, lead_id, CASE WHEN id % 2 = 0 THEN concat('{\"lead\":', CAST(lead_id AS VARCHAR), '}') ELSE '{}' END AS interaction_data FROM interactions")


def bursts(source: str, gap: str = ">") -> str:
    return f"""marked AS (SELECT *, CASE WHEN epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY user_id ORDER BY created_at) {gap} 300000000 OR lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) IS NULL THEN 1 ELSE 0 END AS starts FROM {source}),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY created_at) AS burst FROM marked)"""


events_query(
    "session_counters",
    f"""SELECT user_id, CAST(min(created_at) AS TIMESTAMPTZ) AS started_at, CAST(max(created_at) AS TIMESTAMPTZ) AS ended_at, count(*) AS total_searches, CAST(sum(response_time_ms) AS BIGINT) AS total_response_time,
 {HIT} AS cache_hits FROM numbered GROUP BY user_id, burst""",
    bursts("searches"),
)
events_query("hourly_windows", "SELECT date_trunc('hour', created_at) AS window_start, interaction_type, count(*) AS n FROM interactions GROUP BY 1, 2")
ORACLES["counter_sums"] = f"SELECT event_type, CAST(sum({K}) AS BIGINT) AS value FROM events GROUP BY 1"

# --- preferences and changes ------------------------------------------------------------------
USERS = "users AS (SELECT c_custkey AS user_id FROM customer)"


def weight_case(values: dict) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {dbl(v) if v is not None else 'NULL'}" for c, v in values.items()) + " END"


STORED = "p.user_id IS NOT NULL AND kind IN (1, 2)"
ORACLES["preferences_weights"] = with_(PREFERENCES, USERS) + (
    f"""SELECT u.user_id, coalesce(industries, '') AS industries, coalesce(locations, '') AS locations,
 CASE WHEN kind = 1 THEN {dbl(0.5)} WHEN kind = 2 THEN {dbl(1.5)} ELSE {dbl(0.25)} END AS industry_match,
 CASE WHEN kind IN (1, 2) THEN {dbl(0.5)} ELSE {dbl(0.4)} END AS text_relevance,
 CASE WHEN kind IN (1, 2) THEN NULL ELSE {dbl(0.1)} END AS data_quality, p.user_id IS NOT NULL AS preferences_applied
 FROM users u LEFT JOIN prefs p ON u.user_id = p.user_id"""
)
ORACLES["preferences_applied"] = with_(PREFERENCES, USERS) + (
    """SELECT u.user_id, p.user_id IS NOT NULL AS preferences_applied,
 array_to_string(list_filter([CASE WHEN industries <> '' THEN 'industries' END, CASE WHEN locations <> '' THEN 'locations' END], lambda x: x IS NOT NULL), '|') AS boosted,
 nullif(industries, '') AS industries, CAST(CASE WHEN kind IN (1, 2) THEN 2 ELSE 5 END AS INT) AS n_weights FROM users u LEFT JOIN prefs p ON u.user_id = p.user_id"""
)
ORACLES["preference_filters"] = with_(PREFERENCES, USERS) + (
    """SELECT u.user_id, nullif(industries, '') AS industries, nullif(locations, '') AS locations, nullif(company_size_range, '') AS company_size_range,
 nullif(revenue_range, '') AS revenue_range FROM users u LEFT JOIN prefs p ON u.user_id = p.user_id"""
)
ORACLES["weight_validation"] = with_(PREFERENCES) + "SELECT user_id, kind <> 2 AS valid FROM prefs"
ORACLES["apply_changes"] = with_(LEADS, CHANGES) + (
    f"""SELECT coalesce(l.id, c.id) AS id, CASE WHEN l.id IS NULL OR op = 'update' THEN coalesce(c.company, l.company) ELSE l.company END AS company, l.industry,
 CASE WHEN l.id IS NULL OR op = 'update' THEN coalesce(c.score, l.score) ELSE l.score END AS score,
 CASE WHEN l.id IS NULL OR op = 'update' THEN {LEADS_AT} ELSE l.created_at END AS updated_at
 FROM leads l FULL JOIN changes c ON l.id = c.id WHERE (l.id IS NOT NULL AND coalesce(op, '') <> 'delete') OR (l.id IS NULL AND op = 'create')"""
)
ORACLES["preferences_upsert"] = with_(PREFERENCES, USERS) + (
    """SELECT u.user_id, CASE WHEN (p.user_id IS NULL OR u.user_id % 2 = 0) AND u.user_id % 4 = 0 THEN '200+' ELSE company_size_range END AS company_size_range, revenue_range
 FROM users u LEFT JOIN prefs p ON u.user_id = p.user_id WHERE u.user_id % 9 <> 0 AND (p.user_id IS NOT NULL OR u.user_id % 2 = 1)"""
)

# --- contact functions ------------------------------------------------------------------------
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"


def first_email(x: str, skip) -> str:
    return f"lower(list_filter(regexp_extract_all({x}, '{EMAIL}'), lambda e: NOT {has_any('lower(e)', skip)})[1])"


def first_of(x: str, *patterns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '{p}'), '')" for p in patterns) + ")"


PHONES = [r"\+55\s*[0-9]{2}\s*[0-9]{4,5}-?[0-9]{4}", r"\([0-9]{2}\)\s*[0-9]{4,5}-?[0-9]{4}", r"[0-9]{2}\s*[0-9]{4,5}-?[0-9]{4}"]
ORACLES["email_extract"] = (
    f"SELECT doc_id, {first_email('text', fv.EMAIL_SKIP_WORDS)} AS email, {first_email('text', fv.EMAIL_SKIP_WORDS_STRICT)} AS strict_email FROM documents"
)
ORACLES["phone_extract"] = (
    f"SELECT doc_id, {first_of('text', *PHONES)} AS phone, regexp_replace({first_of('text', *PHONES, '[0-9]{4,5}-?[0-9]{4}')}, '\\s+', ' ', 'g') AS phone_or_local FROM documents"
)


def normal_phone(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9+]', '', 'g')"
    return f"CASE WHEN coalesce({x}, '') = '' THEN NULL WHEN starts_with({d}, '+55') THEN {d} WHEN length({d}) IN (10, 11) AND left({d}, 2) IN ('11', '21', '31', '41', '51') THEN '+55' || {d} ELSE {x} END"


PERSONAL = "(" + ", ".join(lit(x) for x in fv.PERSONAL_EMAIL_DOMAINS) + ")"
leads_query("phone_normalize", f"SELECT id, {normal_phone('phone')} AS phone FROM leads")
BUSINESS = f"(coalesce(email <> '', false) AND NOT coalesce(lower(split_part(email, '@', -1)) IN {PERSONAL}, false))"
WHOLE = r"'^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$'"
leads_query(
    "email_checks",
    f"SELECT id, {BUSINESS} AS business, (coalesce(regexp_matches(email, {WHOLE}), false) AND {BUSINESS}) AS valid_business, lower(split_part(email, '@', -1)) AS domain FROM leads",
)


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def without_suffixes(x: str, suffixes, flags: str) -> str:
    """Legal suffixes cut where they stand as whole words of any alphabet. A suffix takes the border before it along, as
    a marked space, so that neighbours can both be cut."""
    spaced = rf"regexp_replace({x}, '([^\p{{L}}\p{{M}}\p{{N}}_]+)', chr(1) || '\1' || chr(1), 'g')"
    bounded = f"chr(1) || {spaced} || chr(1)"
    cut = rf"regexp_replace({bounded}, '\x01(?:{'|'.join(suffixes)})\x01(\.?)', chr(1) || chr(1), '{flags}')"
    return f"replace({cut}, chr(1), '')"


def normal_company(x: str) -> str:
    return squeezed(without_suffixes(f"lower({x})", fv.LEGAL_SUFFIXES, "g"))


def clean_company(x: str) -> str:
    return squeezed(without_suffixes(x, fv.LEGAL_SUFFIXES_LONG, "gi"))


OTHER = "(industry || ' Trading House ' || id || ' Ltd')"
WA, WB = f"list_distinct({words(normal_company('company'))})", f"list_distinct({words(normal_company(OTHER))})"
ORACLES["company_normalize"] = with_(INCOMING, f"pairs AS (SELECT *, {WA} AS wa, {WB} AS wb FROM incoming)") + (
    f"""SELECT id, {normal_company('company')} AS normalized, {clean_company('company')} AS cleaned,
 {rnd('CASE WHEN len(wa) > 0 AND len(wb) > 0 THEN len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) ELSE 0 END', 6)} AS similarity FROM pairs"""
)


def host(x: str) -> str:
    return rf"nullif(lower(regexp_extract({x}, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '')"


def scheme(x: str) -> str:
    return rf"nullif(lower(regexp_extract({x}, '^\s*([A-Za-z][A-Za-z0-9+.-]*):', 1)), '')"


VALID = f"({scheme('url')} IS NOT NULL AND {host('url')} IS NOT NULL)"
ENDS = "(" + " OR ".join(f"ends_with({host('url')}, {lit(t)})" for t in fv.COMPANY_SITE_ENDINGS) + ")"
ORACLES["url_domain"] = f"""SELECT page_id, {host('url')} AS domain, replace({host('url')}, 'www.', '') AS bare_domain, {VALID} AS valid,
 ({VALID} AND NOT {has_any(host('url'), fv.LISTING_DOMAINS)}) AS company_site,
 coalesce(NOT {has_any(host('url'), fv.NON_COMPANY_DOMAINS)} AND length({host('url')}) >= 4 AND {ENDS}, false) AS result_link,
 coalesce({scheme('url')} IN ('http', 'https') AND NOT {has_any(host('url'), fv.SOCIAL_DOMAINS)}, false) AS business FROM pages"""
ORACLES["redirect_unwrap"] = "SELECT page_id, url AS target, url AS plain FROM pages"


def location_br(x: str) -> str:
    up = f"upper({x})"
    states = "|".join(fv.STATES)
    tries = []
    for city in fv.CITIES:
        found = rf"list_filter({arr(fv.STATES)}, lambda s: list_contains(regexp_extract_all({up}, '{city.upper()}[,\s]*({states})', 1), s))[1]"
        tries.append(f"WHEN contains({up}, {lit(city.upper())}) THEN {lit(city)} || coalesce(', ' || {found}, '')")
    bare = f"list_filter({arr(fv.STATES)}, lambda s: list_contains(regexp_extract_all({up}, '[ ,]({states})', 1), s))[1]"
    return "CASE " + " ".join(tries) + f" ELSE {bare} END"


def location_page(x: str) -> str:
    pair = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),\s*([A-Z]{2})"
    cities = " ".join(f"WHEN contains({x}, {lit(c)}) THEN {lit(c)}" for c in fv.MAJOR_CITIES)
    return rf"""coalesce(CASE WHEN regexp_extract({x}, '{pair}', 1) <> '' THEN regexp_extract({x}, '{pair}', 1) || ', ' || regexp_extract({x}, '{pair}', 2) END,
 nullif(regexp_extract({x}, 'Rua\s+[^,]+,\s*[^,]+,\s*([^,]+)', 1), ''), nullif(regexp_extract({x}, 'Av\.\s+[^,]+,\s*[^,]+,\s*([^,]+)', 1), ''), CASE {cities} END)"""


ORACLES["location_extract"] = f"""WITH texts AS (SELECT 'customer' AS kind, c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'Sede em ' || ({arr(fv.STATES)})[c_custkey % {len(fv.STATES)} + 1]
 ELSE 'Rua A, 10, ' || ({arr(fv.CITIES)})[c_custkey % {len(fv.CITIES)} + 1] || ', ' || ({arr(fv.STATES)})[c_custkey % {len(fv.STATES)} + 1] END AS text FROM customer
 UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT kind, key, {location_br('text')} AS location, {location_page('text')} AS page_location FROM texts"""


def complete(last: str, **fields: str) -> str:
    parts = [f"CASE WHEN {filled(fields.get(c, c))} THEN {dbl(w)} ELSE {dbl(0)} END" for c, w in fv.COMPLETENESS_WEIGHTS + [(last, 0.05)]]
    return rnd(f"least({dbl(0)} + " + " + ".join(parts) + f", {dbl(1)})", 6)


leads_query("completeness_score", f"SELECT id, {complete('contact')} AS quality, {complete('employees')} AS confidence FROM leads")


def scrape_clean(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN {cleaned(x, '_.,()-')} END"


SITE_OK = f"({scheme('website')} IS NOT NULL AND {host('website')} IS NOT NULL AND NOT {has_any(host('website'), fv.LISTING_DOMAINS)})"
STRICT = first_email("email", fv.EMAIL_SKIP_WORDS_STRICT)
leads_query(
    "format_records",
    f"SELECT id, company, contact, description, industry, location, email, phone, website, {complete('contact')} AS data_quality_score FROM formatted",
    f"""formatted AS (SELECT id, {', '.join(f'{scrape_clean(c)} AS {c}' for c in ('company', 'contact', 'description', 'industry', 'location'))},
 CASE WHEN lower(split_part({STRICT}, '@', -1)) NOT IN {PERSONAL} THEN {STRICT} END AS email, {first_of('phone', *PHONES)} AS phone, CASE WHEN {SITE_OK} THEN website END AS website FROM leads)""",
)


def frequent(key: str, source: str, text: str) -> str:
    """CTE "frequent": the ten most frequent long words of each text, first seen first."""
    return rf"""seen AS (SELECT {key} AS k, unnest(list_filter(list_zip(ws, range(len(ws))), lambda p: length(p[1]) > 3 AND NOT list_contains({arr(fv.FREQUENCY_STOP_WORDS)}, p[1]))) AS p
 FROM (SELECT {key}, list_transform(list_filter(regexp_extract_all(lower({text}), '[a-z\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{3,}}$')), lambda w: w) AS ws FROM {source} WHERE length({text}) >= 10)),
counted AS (SELECT k, p[1] AS w, count(*) AS n, min(p[2]) AS first FROM seen GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, first) <= 10),
frequent AS (SELECT k, list(w ORDER BY n DESC, first) AS ws FROM counted GROUP BY k)"""


ORACLES["frequency_keywords"] = with_(frequent("doc_id", "documents", "text")) + (
    "SELECT doc_id, coalesce(array_to_string(ws, '|'), '') AS keywords FROM documents LEFT JOIN frequent ON k = doc_id"
)
SITE_WEB = f"coalesce({scheme('website')} IN ('http', 'https') AND NOT {has_any(host('website'), fv.SOCIAL_DOMAINS)}, false)"
MAIL_OK = f"(coalesce(regexp_matches(email, {WHOLE}), false) AND {BUSINESS})"
ENHANCED = f"""enhanced AS (SELECT id, {clean_company('company')} AS company, CASE WHEN {MAIL_OK} THEN email END AS email, {normal_phone('phone')} AS phone,
 CASE WHEN {SITE_WEB} THEN website END AS website, industry, location, description, employees FROM leads)"""
leads_query(
    "enhance_records",
    f"""SELECT id, company, email, phone, website, {complete('employees')} AS confidence,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(ws, CAST([] AS VARCHAR[])), list_filter(string_split(lower(company), ' '), lambda w: length(w) > 2))))[1:10], '|') AS keywords
 FROM enhanced LEFT JOIN frequent ON k = id""",
    ENHANCED,
    frequent("id", "enhanced", "description"),
)
ORACLES["keyword_heuristics"] = rf"""WITH runs AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS ws FROM documents),
found AS (SELECT doc_id, list_filter(list_transform(list_filter(ws, lambda w: regexp_matches(w, '^([A-Z][a-z]+|[A-Z]{{2,}})$') OR regexp_matches(w, '[0-9]')), lambda w: lower(w)),
 lambda w: length(w) >= 3 AND NOT list_contains({arr(fv.STOP_WORDS)}, w)) AS ks FROM runs)
SELECT doc_id, array_to_string(list_sort(list_distinct(ks))[1:10], '|') AS keywords FROM found"""
ORACLES["clean_texts"] = f"""SELECT doc_id, md5({cleaned('text')}) AS index_text, md5({cleaned('text', '_"-')}) AS query_text,
 md5({cleaned('text', '_.,()-')}) AS scrape_text, md5({squeezed('text')}) AS squeezed FROM documents"""
ORACLES["headcounts"] = "SELECT c_custkey, (c_custkey * 17) || '+' AS employees, CAST('4.' || (c_custkey % 10) AS DOUBLE) AS rating FROM customer"

# --- ingestion --------------------------------------------------------------------------------
LOW = "lower(trim(company))"
C_BASE = f"CASE WHEN {LOW} IN ('test', 'example', 'sample', 'demo') THEN {dbl(0.1)} WHEN length(trim(company)) > 100 THEN {dbl(0.5)} ELSE {dbl(0.8)} END"
C_SCORE = f"CASE WHEN coalesce(company, '') = '' OR length(trim(company)) < 2 THEN 0 ELSE least({C_BASE} + CASE WHEN {has_any(LOW, fv.BUSINESS_SUFFIXES)} THEN {dbl(0.2)} ELSE 0 END, 1) END"
E_OK = f"(coalesce(email <> '', false) AND coalesce(regexp_matches(lower(email), {WHOLE}), false))"
E_DOM, E_BOX = "split_part(lower(email), '@', 2)", "split_part(lower(email), '@', 1)"
E_PERS = "(" + E_DOM + " IN (" + ", ".join(lit(x) for x in fv.VALIDATOR_PERSONAL_DOMAINS) + "))"
E_SYS = has_any(E_BOX, fv.SYSTEM_MAILBOX_WORDS)
E_SCORE = f"CASE WHEN NOT {E_OK} THEN 0 WHEN {E_SYS} THEN 0.2 WHEN {E_PERS} THEN 0.3 ELSE 1 END"
DIG = "regexp_replace(phone, '[^0-9]', '', 'g')"
P_OK = f"coalesce(phone <> '' AND length({DIG}) BETWEEN 8 AND 15, false)"
P_FORM = "(" + " OR ".join(f"regexp_matches(phone, '^(?:{p})')" for p in PHONES) + ")"
P_AREA = f"({DIG})[1:2]"
P_KNOWN = f"list_contains({arr(fv.AREA_CODES)}, {P_AREA})"
P_SCORE = f"CASE WHEN {P_OK} THEN least({dbl(0.6)} + CASE WHEN {P_FORM} THEN {dbl(0.4)} ELSE 0 END + CASE WHEN {P_KNOWN} THEN {dbl(0.2)} ELSE 0 END, 1) ELSE 0 END"
W_OK = f"(coalesce(website <> '', false) AND coalesce({scheme('website')} IN ('http', 'https'), false) AND {host('website')} IS NOT NULL)"
BARE = f"replace({host('website')}, 'www.', '')"
W_BIZ, W_SOC, W_SEC = f"coalesce({has_any(BARE, fv.BUSINESS_TLDS)}, false)", f"coalesce({has_any(BARE, fv.SOCIAL_DOMAINS)}, false)", f"coalesce({scheme('website')} = 'https', false)"
W_SCORE = f"CASE WHEN {W_OK} THEN least(CASE WHEN {W_SOC} THEN {dbl(0.2)} ELSE {dbl(0.6)} + CASE WHEN {W_BIZ} THEN {dbl(0.3)} ELSE 0 END END + CASE WHEN {W_SEC} THEN {dbl(0.1)} ELSE 0 END, 1) ELSE 0 END"
L_SCORE = f"""CASE WHEN coalesce(location, '') = '' OR length(location) < 2 THEN 0 ELSE least({dbl(0.5)} + CASE WHEN {has_any('upper(location)', fv.STATES)} THEN {dbl(0.3)} ELSE 0 END
 + CASE WHEN {has_any('lower(location)', [c.lower() for c in fv.MAJOR_CITIES])} THEN {dbl(0.2)} ELSE 0 END, 1) END"""
CONF = f"({dbl(C_SCORE)} * {dbl(0.3)} + {dbl(E_SCORE)} * {dbl(0.25)} + {dbl(P_SCORE)} * {dbl(0.2)} + {dbl(W_SCORE)} * {dbl(0.15)} + {dbl(L_SCORE)} * {dbl(0.1)})"


def when_list(*pairs: tuple[str, str]) -> str:
    inner = ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in pairs)
    return f"list_filter([{inner}], lambda x: x IS NOT NULL)"


ISSUES = when_list(
    ("coalesce(company, '') = ''", "'Missing company name'"),
    ("length(trim(company)) > 100", "'Company name unusually long'"),
    (f"coalesce(email <> '', false) AND NOT {E_OK}", "'Invalid email format'"),
    (f"{E_OK} AND {E_PERS}", "'Personal email domain detected'"),
    (f"{E_OK} AND {E_SYS}", "'Email appears to be system/admin email'"),
    (f"length({DIG}) < 8", "'Phone number too short'"),
    (f"length({DIG}) > 15", "'Phone number too long'"),
    (f"{P_OK} AND NOT {P_KNOWN}", f"'Invalid Brazilian area code: ' || {P_AREA}"),
    (f"{W_OK} AND {W_SOC}", "'Website appears to be social media or search engine'"),
)
FACTS = when_list(
    (P_OK, f"'area_code=' || {P_AREA}"),
    (f"{W_OK} AND {W_BIZ}", "'business_domain=true'"),
    (E_OK, f"'email_domain=' || {E_DOM}"),
    (f"{E_OK} AND NOT {E_PERS}", "'is_business_email=true'"),
    (f"{P_OK} AND {P_FORM}", "'phone_format=brazilian'"),
    (f"{W_OK} AND {W_SEC}", "'secure_website=true'"),
    (f"{P_OK} AND {P_KNOWN}", "'valid_area_code=true'"),
    (W_OK, f"'website_domain=' || {host('website')}"),
)
ADVICE = when_list(
    (f"{E_OK} AND {E_PERS}", "'Look for alternative business email on company website'"),
    (f"coalesce(email <> '', false) AND NOT {E_OK}", "'Verify email format and try alternative extraction methods'"),
    (f"coalesce(phone <> '' AND NOT {P_OK}, false)", "'Validate phone number format and try alternative extraction'"),
    ("coalesce(email, '') = '' AND coalesce(phone, '') = ''", "'Lead has no contact information - consider skipping or finding alternative sources'"),
)
leads_query(
    "validate_leads",
    f"""SELECT id, {CONF} >= 0.4 AND length(trim(company)) >= 2 AS is_valid, {rnd(f'least({CONF}, 1)', 6)} AS confidence_score,
 {show(ISSUES)} AS issues, {show(ADVICE)} AS suggestions, {show(FACTS)} AS facts FROM leads""",
)
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<![^>]*>"
TAG = r"""(?s)</?[A-Za-z][^<>"'']*(?:"[^"]*"[^<>"'']*|''[^'']*''[^<>"'']*)*>"""


def decoded(x: str) -> str:
    """The references that occur in the sample pages, the ampersand last."""
    for ref, char in (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, {lit(ref)}, {lit(char)})"
    return x


def first_case(groups, text: str) -> str:
    return "CASE " + " ".join(f"WHEN {has_any(text, ws)} THEN {lit(v)}" for v, ws in groups) + " END"


TITLE = squeezed(decoded(r"regexp_extract(markup, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)"))
H1 = squeezed(decoded(rf"regexp_replace(regexp_extract(markup, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '{TAG}', '', 'g')"))
PAGES = rf"""read0 AS (SELECT page_id, url, regexp_replace(html, '{HIDDEN}', '', 'g') AS markup FROM pages),
read1 AS (SELECT *, {decoded(f"regexp_replace(markup, '{TAG}', '', 'g')")} AS text,
 regexp_replace({TITLE}, '(?i)\s*[-|]\s*(Home|Início|Welcome).*$', '') AS title, {H1} AS h1 FROM read0),
extracted AS (SELECT page_id, {host('url')} AS host, url AS website,
 CASE WHEN length(title) > 2 AND length(title) < 100 THEN title WHEN length(h1) > 2 AND length(h1) < 100 THEN h1 ELSE
  array_to_string(list_transform(regexp_extract_all(replace(replace({host('url')}, 'www.', ''), '.com', ''), '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1:1]) || lower(w[2:])), '') END AS company,
 {first_email('text', fv.EMAIL_SKIP_WORDS)} AS email, {first_of('text', *PHONES)} AS phone, {location_page('text')} AS location,
 {first_case(fv.PAGE_INDUSTRIES, 'lower(text)')} AS industry, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS employees FROM read1)"""
# The sample pages have no contact links, meta descriptions or about sections.
ORACLES["page_extract"] = with_(PAGES) + "SELECT page_id, host, company, email, phone, location, '' AS contact_pages, description, industry FROM extracted"
FIRST = "{c} FILTER (WHERE {c} IS NOT NULL)"
ORACLES["page_merge"] = with_(PAGES, "ranked AS (SELECT *, page_id AS n FROM extracted)") + (
    "SELECT host, count(*) AS n_pages, min(page_id) AS page_id, arg_min(company, n) AS company, "
    + ", ".join(f"arg_min({c}, n) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("email", "phone", "location"))
    + ", arg_min_null(industry, n) AS industry FROM ranked GROUP BY host"
)


def exists_like(new: str, stored: str) -> str:
    return f"EXISTS (SELECT 1 FROM {stored} s WHERE s.user_id = {new}.user_id AND s.company ILIKE '%' || {new}.company || '%')"


PIPE = f"""made AS (SELECT page_id, 1 AS user_id, {clean_company('company')} AS company, CASE WHEN {MAIL_OK} THEN email END AS email, {normal_phone('phone')} AS phone,
 CASE WHEN {SITE_WEB} THEN website END AS website, location, industry, description FROM extracted WHERE company <> ''),
judged AS (SELECT *, {CONF} AS conf FROM made),
valid AS (SELECT * FROM judged WHERE conf >= 0.4 AND length(company) >= 2),
staged AS (SELECT *, CASE WHEN page_id NOT IN (SELECT page_id FROM valid) THEN 'invalid' WHEN {exists_like('judged', 'leads')} THEN 'exists'
 WHEN EXISTS (SELECT 1 FROM valid v WHERE v.page_id < judged.page_id AND v.company ILIKE '%' || judged.company || '%') THEN 'exists' ELSE 'saved' END AS stage FROM judged)"""
ORACLES["lead_pipeline"] = with_(PAGES, LEADS, PIPE) + (
    """SELECT page_id, company, industry, CAST(floor(least(conf, 1) * 100) AS INT) AS score, stage,
 array_to_string(list_sort(list_distinct(list_filter(string_split(lower(company), ' '), lambda w: length(w) > 2)))[1:10], '|') AS keywords FROM staged"""
)
OUTCOME = f"CASE WHEN coalesce(company, '') = '' THEN 'rejected' WHEN {exists_like('incoming', 'leads')} THEN 'exists' ELSE 'imported' END"
ORACLES["import_leads"] = with_(INCOMING, LEADS) + (
    f"SELECT id, user_id, company, coalesce(score, 75) AS score, 'Novo' AS status, 'Média' AS priority, {OUTCOME} AS outcome FROM incoming"
)
ORACLES["import_errors"] = with_(INCOMING) + (
    f"SELECT id, {lit(fv.IMPORT_ERROR)} || coalesce(company, 'lead') || ': no company name' AS error FROM incoming WHERE coalesce(company, '') = ''"
)
ORACLES["import_report"] = with_(INCOMING, LEADS, f"done AS (SELECT {OUTCOME} AS outcome FROM incoming)") + (
    f"SELECT {n_if("outcome = 'imported'")} AS imported_count, {n_if("outcome = 'rejected'")} AS error_count FROM done"
)
ORACLES["import_leads_deduped"] = with_(
    LEADS, "batch AS (SELECT p_partkey AS id, p_partkey % 10 + 1 AS user_id, p_name AS company FROM part)"
) + (
    f"""SELECT id, company, CASE WHEN {exists_like('batch', 'leads')} OR EXISTS (SELECT 1 FROM batch b WHERE b.id < batch.id AND b.user_id = batch.user_id AND b.company ILIKE '%' || batch.company || '%')
 THEN 'exists' ELSE 'imported' END AS outcome FROM batch"""
)
ORACLES["save_scraped"] = with_(INCOMING, LEADS, "batch AS (SELECT *, NULL AS location, NULL AS description FROM incoming WHERE company <> '')") + (
    f"""SELECT id, user_id, company, CAST(floor({complete('employees').replace('round_even(', '(').rsplit(', 6)', 1)[0]}) * 100) AS INT) AS score, 'Novo' AS status, 'Média' AS priority FROM batch
 WHERE NOT {exists_like('batch', 'leads')} AND NOT EXISTS (SELECT 1 FROM batch b WHERE b.id < batch.id AND b.user_id = batch.user_id AND b.company ILIKE '%' || batch.company || '%')"""
)
JOBS = f"jobs AS (SELECT source, lang AS status, count(*) AS found, {n_if('n_chars > 1000')} AS saved FROM documents GROUP BY 1, 2)"
ORACLES["job_summary"] = with_(JOBS) + (
    f"SELECT count(*) AS jobs, CAST(sum(found) AS BIGINT) AS total_leads_found, CAST(sum(saved) AS BIGINT) AS total_leads_saved, {rnd('avg(CASE WHEN found > 0 THEN saved / found * 100 END)', 4)} AS average_success_rate FROM jobs"
)
ORACLES["jobs_by_status"] = with_(JOBS) + "SELECT status, count(*) AS jobs FROM jobs GROUP BY status"
NAME_WORDS = f"list_distinct({words(clean_company('lower(company)'))})"
ORACLES["dedupe_exact"] = with_(
    INCOMING,
    LEADS,
    f"fresh AS (SELECT *, {NAME_WORDS} AS w, replace({host('website')}, 'www.', '') AS dom FROM incoming)",
    f"known AS (SELECT *, {NAME_WORDS} AS w, replace({host('website')}, 'www.', '') AS dom FROM leads)",
    """judged AS (SELECT id, EXISTS (SELECT 1 FROM known k WHERE len(list_intersect(k.w, fresh.w)) * 5 > len(list_distinct(list_concat(k.w, fresh.w))) * 4) AS similar_name,
 EXISTS (SELECT 1 FROM known k WHERE lower(k.email) = lower(fresh.email) AND k.email <> '') AS same_email,
 EXISTS (SELECT 1 FROM known k WHERE k.phone = fresh.phone AND k.phone <> '') AS same_phone,
 EXISTS (SELECT 1 FROM known k WHERE k.dom = fresh.dom AND k.dom <> '') AS same_domain FROM fresh)""",
) + "SELECT *, similar_name OR same_email OR same_phone OR same_domain AS is_duplicate FROM judged"

# --- reports ----------------------------------------------------------------------------------
ORACLES["dashboard_summary"] = with_(
    LEADS,
    SEARCHES,
    f"d AS ({ORACLES['dashboard_metrics'].split(LEADS, 1)[1].strip()})",
    f"""s AS (SELECT CAST({rnd('avg(response_time_ms)', 0)} AS BIGINT) AS avg_response_time, {pct(HIT, f'({HIT} + {MISS})')} AS cache_hit_rate,
 {n_if("created_at >= TIMESTAMP '2024-01-30'")} AS searches_today FROM searches)""",
    f"a AS (SELECT {n_if(f'created_at >= {LEADS_AT}')} AS leads_added_today FROM leads)",
) + """SELECT *, CASE WHEN avg_response_time < 200 AND cache_hit_rate > 70 THEN 'excellent' WHEN avg_response_time < 500 AND cache_hit_rate > 50 THEN 'good'
 WHEN avg_response_time < 1000 THEN 'fair' ELSE 'poor' END AS system_health, CASE WHEN leads_added_today > 0 THEN 'up' ELSE 'stable' END AS trend,
 array_to_string(list_filter([CASE WHEN avg_response_time > 500 THEN 'Tempo médio de resposta: ' || avg_response_time || 'ms' END,
  CASE WHEN cache_hit_rate < 50 THEN 'Taxa de acerto do cache: ' || cache_hit_rate || '%' END,
  CASE WHEN conversion_rate < 20 THEN 'Taxa de conversão: ' || conversion_rate || '%' END], lambda x: x IS NOT NULL), '|') AS alerts FROM d, s, a"""
leads_query(
    "search_health",
    f"""SELECT count(*) AS total_leads, count(indexed_at) AS indexed_leads, {n_if(HARD)} AS incomplete_leads, {rnd(COVERAGE, 2)} AS index_coverage_percent,
 CASE WHEN {COVERAGE} < 90 THEN 'reindex_leads' ELSE '' END AS recommendations,
 CASE WHEN {n_if(HARD)} > count(*) * 0.2 THEN 'popular_queries|incomplete_data' ELSE 'popular_queries' END AS optimization_tips,
 CASE WHEN {COVERAGE} < 90 THEN 'needs_attention' ELSE 'good' END AS overall_health FROM leads""",
)


def report_rows(*rows: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {lit(s)} AS section, {lit(n)} AS name, {dbl(v)} AS value FROM leads" for s, n, v in rows)


ORACLES["search_analytics_report"] = with_(
    LEADS,
    SEARCHES,
    "totals AS ("
    + report_rows(
        ("coverage", "total_leads", "count(*)"),
        ("coverage", "indexed_leads", "count(indexed_at)"),
        ("coverage", "search_coverage_percent", rnd(COVERAGE, 2)),
        *[("quality", b, n_if(c)) for b, c in BANDS],
        ("quality", "total_scored_leads", "count(score)"),
    )
    + ")",
) + (
    "SELECT section, name, value, CAST(NULL AS DOUBLE) AS extra FROM totals"
    + "".join(
        f" UNION ALL (SELECT '{c}', {c}, {dbl('count(*)')}, {rnd('coalesce(avg(score), 0)', 1)} FROM leads WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 10)"
        for c in ("industry", "location")
    )
    + f" UNION ALL (SELECT 'popular', query_text, {dbl('count(*)')}, NULL FROM searches WHERE query_text <> '' GROUP BY 2 ORDER BY count(*) DESC, query_text DESC LIMIT 5)"
)
leads_query(
    "comprehensive_report",
    "SELECT * FROM ("
    + report_rows(
        ("dashboard", "total_leads", "count(*)"),
        ("dashboard", "qualified_leads", n_if(QUALIFIED)),
        ("dashboard", "conversion_rate", pct(n_if(QUALIFIED), "count(*)")),
        ("dashboard", "average_roi", rnd(ROI, 0)),
        ("dashboard", "high_quality_leads", n_if(HIGH)),
        ("dashboard", "recent_leads", n_if(WEEK)),
        ("dashboard", "growth_rate", GROWTH),
        ("conversion", "search_to_contact_rate", pct(CONTACTED, "count(*)")),
        ("conversion", "search_to_qualified_rate", pct(n_if(QUALIFIED), "count(*)")),
        ("conversion", "zero_results_rate", pct(n_if("company IS NULL AND email IS NULL AND phone IS NULL"), "count(*)")),
        *[("source", s, e) for s, e in [*SOURCES, ("Referências", REST)]],
        *[("quality", t, e) for t, _, _, e in TIERS],
    )
    + f""") UNION ALL SELECT 'month_leads', printf('%04d-%02d', y, mo), {dbl('leads')} FROM series
 UNION ALL SELECT 'month_qualified', printf('%04d-%02d', y, mo), {dbl('qualified')} FROM series
 UNION ALL (SELECT 'industry', industry, {dbl('count(*)')} FROM leads WHERE industry IS NOT NULL GROUP BY 2 ORDER BY count(*) DESC, industry LIMIT 10)""",
    months_sql(LEADS_AT, 6),
)

# --- streams, replayed to their end -----------------------------------------------------------
TZ = "CAST({} AS TIMESTAMPTZ)"
events_query(
    "stream_search_sessions",
    f"""SELECT user_id, {TZ.format('min(created_at)')} AS started_at, {TZ.format('max(created_at) + INTERVAL 5 MINUTE')} AS closed_at, count(*) AS total_searches,
 CAST(sum(response_time_ms) AS BIGINT) AS total_response_time, {HIT} AS cache_hits FROM numbered GROUP BY user_id, burst""",
    bursts("searches"),
)
events_query(
    "stream_interaction_sessions",
    f"""SELECT user_id, {TZ.format('min(created_at)')} AS started_at, {TZ.format('max(created_at) + INTERVAL 5 MINUTE')} AS closed_at, count(*) AS total_interactions,
 {n_if("interaction_type = 'view'")} AS views, {n_if(IS_CONTACT)} AS contacts, {n_if("interaction_type = 'convert'")} AS conversions FROM numbered
 GROUP BY user_id, burst""",
    bursts("interactions"),
)
events_query(
    "stream_fixed_windows",
    f"SELECT {TZ.format('time_bucket(INTERVAL 30 MINUTE, created_at)')} AS window_start, interaction_type, count(*) AS n FROM interactions GROUP BY 1, 2",
)
ORACLES["stream_first_event_windows"] = with_(
    INTERACTIONS,
    """opened AS (SELECT interaction_type, min(created_at) AS start FROM interactions GROUP BY 1
 UNION ALL SELECT o.interaction_type, min(i.created_at) FROM opened o JOIN interactions i ON i.interaction_type = o.interaction_type
 AND i.created_at >= o.start + INTERVAL 30 MINUTE GROUP BY 1)""",
).replace("WITH", "WITH RECURSIVE", 1) + (
    f"""SELECT {TZ.format('start')} AS window_start, interaction_type, count(*) AS n FROM opened JOIN interactions USING (interaction_type)
 WHERE created_at >= start AND created_at < start + INTERVAL 30 MINUTE GROUP BY 1, 2"""
)
events_query("stream_unique_events", f"SELECT id, user_id, query_text, results_count, {TZ.format('created_at')} AS created_at FROM searches")
events_query(
    "popular_by_summaries",
    "SELECT query_text AS query, count(*) AS count FROM searches WHERE query_text <> '' GROUP BY 1 ORDER BY count(*) DESC, query_text LIMIT 5",
)
events_query(
    "stream_popular_queries",
    f"SELECT {TZ.format("date_trunc('hour', created_at)")} AS window_start, query_text AS query, count(*) AS count FROM searches WHERE query_text <> '' GROUP BY 1, 2",
)
events_query(
    "stream_last_hour",
    f"""SELECT {TZ.format('time_bucket(INTERVAL 30 MINUTE, created_at) + INTERVAL 30 MINUTE * step')} AS as_of, count(*) AS searches, count(DISTINCT user_id) AS active_users
 FROM searches, (VALUES (1), (2)) steps(step) GROUP BY 1""",
)
events_query(
    "stream_click_attribution",
    f"""SELECT s.id AS search_event_id, {TZ.format('s.created_at')} AS searched_at, k.lead_id FROM searches s
 LEFT JOIN (SELECT event_id - {K} % 5 AS search_event_id, CAST({K} AS BIGINT) AS lead_id, ts AS created_at FROM events WHERE event_type = 'click') k
 ON k.search_event_id = s.id AND k.created_at BETWEEN s.created_at AND s.created_at + INTERVAL 30 MINUTE""",
)
leads_query("stream_postings", "SELECT token, lead_id FROM postings", META, POSTINGS)
ORACLES["stream_index_upkeep"] = with_(
    LEADS.replace("leads AS (", "base AS (", 1),
    CHANGES,
    """leads AS (SELECT l.* EXCLUDE (id, company), coalesce(l.id, c.id) AS id,
 CASE WHEN l.id IS NULL OR op = 'update' THEN coalesce(c.company, l.company) ELSE l.company END AS company
 FROM base l FULL JOIN changes c ON l.id = c.id WHERE (l.id IS NOT NULL AND coalesce(op, '') <> 'delete') OR (l.id IS NULL AND op = 'create'))""",
    META,
    POSTINGS,
) + "SELECT token, lead_id FROM postings"
events_query("stream_lead_counters", "SELECT lead_id, CAST(views AS BIGINT) AS views, CAST(contacts AS BIGINT) AS contacts, contacted_at, CAST(conversions AS BIGINT) AS conversions FROM counters", COUNTERS)
