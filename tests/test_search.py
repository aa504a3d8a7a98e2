"""Ranking and search against a plain Python loop over a small fixture."""

import re

import pytest
from lead_samples import NOW
from pyspark.sql import functions as F

from leadlake import fixed_values as fv
from leadlake.functions.scoring import Taste, text_score, weight_map
from leadlake.operators import index as ix
from leadlake.operators import suggestions as su
from leadlake.operators.filters import LeadFilters, facet_selection
from leadlake.plans import search as se


def low_words(text):
    return [w for w in re.sub(r"[^\w-]+", " ", (text or "").lower()).split()]


def keep(ws):
    return sorted({w for w in ws if len(w) >= 2 and w not in fv.STOP_WORDS})


def plain_score(lead, terms, phrases, industry=None, location=None, size=None, weights=None, liked=((), ())):
    weights = weights or fv.PREFERENCE_WEIGHTS
    text = 0.0
    for name, w in fv.TEXT_FIELD_WEIGHTS:
        value = (lead[name] or "").lower()
        if value:
            text += sum(w * (0.8 if value.startswith(t) else 0.5) for t in terms if t in value)
            text += sum(w for p in phrases if p in value)
    ind = loc = siz = 0.0
    if lead["industry"]:
        mine = lead["industry"].lower()
        ind = 1.0 if industry and mine == industry.lower() else 0.7 if industry and industry.lower() in mine else 0.6 if lead["industry"] in liked[0] else 0.0
    if lead["location"]:
        mine = lead["location"].lower()
        near = location and any(p in mine for p in location.lower().split())
        loc = 1.0 if location and mine == location.lower() else 0.8 if near else 0.6 if lead["location"] in liked[1] else 0.0
    if size and lead["employees"]:
        siz = 1.0 if lead["employees"] == size else 0.7 if size in lead["employees"] or lead["employees"] in size else 0.0
    quality = sum(bool(lead[f] and lead[f].strip()) for f in fv.QUALITY_FIELDS) / 7
    age = (NOW - lead["created_at"]).days
    fresh = 1.0 if age <= 7 else 0.8 if age <= 30 else 0.5 if age <= 90 else 0.2
    parts = dict(text_relevance=min(text, 1.0), industry_match=ind, location_proximity=loc, company_size=siz, data_quality=quality, freshness=fresh)
    return min(sum(v * weights.get(k, fv.COMPONENT_WEIGHTS[k]) for k, v in parts.items()), 1.0)


def plain_keys(lead):
    own = [" ".join(low_words(k)) for k in lead["keywords"] or []]
    found = sorted({w for w in re.findall(r"\w*[0-9]\w*", " ".join(low_words(lead["description"]))) if len(w) >= 3})[:10]
    parts = [" ".join(low_words(lead[f])) for f in ("company", "description", "industry", "location")]
    parts += [" ".join(own + found), lead["contact"], lead["email"], lead["website"]]
    tokens = keep(" ".join(p for p in parts if p).split())
    keys = {t.lower() for t in tokens} | set(own) | set(found)
    for prefix, field in (("industry:", "industry"), ("location:", "location")):
        ws = keep(low_words(lead[field]))
        if ws:
            keys.add(prefix + ws[0])
    return keys


def ilike(text, needle):
    pattern = re.escape(needle).replace("%", ".*").replace("_", ".")
    return bool(text) and re.search(pattern, text, re.I | re.S) is not None


def plain_search(rows, terms, phrases, industry=None, location=None, size=None, **more):
    def fits(r):
        return all(not v or ilike(r[c], v) for c, v in (("industry", industry), ("location", location), ("employees", size)))

    kept = [r for r in rows if fits(r)]
    hits = [r for r in kept if terms and set(terms) <= plain_keys(r)]
    if not hits:
        first = (terms + phrases)[:1]

        def text_hit(r):
            tokens = set(keep(low_words(r["company"])) + keep(low_words(r["description"])))
            by_phrase = any(keep(p.split()) and set(keep(p.split())) <= tokens for p in phrases)
            return bool(tokens & set(terms)) or by_phrase or ilike(r["company"], first[0]) or ilike(r["industry"], first[0])

        hits = [r for r in kept if not first or text_hit(r)]
    scored = [(round(plain_score(r, terms, phrases, industry, location, size, **more), 9), r["id"]) for r in hits]
    return sorted(scored, key=lambda x: (-x[0], x[1]))


CASES = [
    ("software", ["software"], [], dict(industry="Tecnologia")),
    ('"machine learning"', [], ["machine learning"], {}),
    ("software nowhere", ["nowhere", "software"], [], dict(industry="Tecnologia")),
    ("virtual realidade", ["realidade", "virtual"], [], {}),
    ("gps2", ["gps2"], [], {}),
    ("saúde", ["saúde"], [], {}),
    ("ana@school.org", ["ana", "org", "school"], [], dict(industry="Educação")),
    ("", [], [], {}),
    ("zzz", ["zzz"], [], {}),
]


@pytest.mark.parametrize("text,terms,phrases,filters", CASES)
def test_search_matches_plain_loop(spark, sample, sample_rows, text, terms, phrases, filters):
    expected = plain_search(sample_rows, terms, phrases, **filters)
    for postings in (None, ix.build_postings(sample)):
        got = se.search(sample, se.SearchRequest(text), NOW, postings=postings).orderBy("position").collect()
        assert [(round(r["relevance_score"], 9), r["id"]) for r in got] == expected


def test_search_log_matches_single_searches(spark, sample, sample_rows):
    texts = [(i, c[0]) for i, c in enumerate(CASES)]
    log = spark.createDataFrame([*texts, (90, "soft_are"), (91, "ologi")], "query_id int, query_text string")
    got = {}
    for r in se.search_log(sample, log, NOW).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((round(r["relevance_score"], 9), r["id"]))
    for i, (_text, terms, phrases, filters) in enumerate(CASES):
        assert got.get(i, []) == plain_search(sample_rows, terms, phrases, **filters), i
    assert got.get(90, []) == plain_search(sample_rows, ["soft_are"], [])
    assert got.get(91, []) == plain_search(sample_rows, ["ologi"], [])


def test_search_log_answers_every_entry_as_a_single_search(spark, sample):
    """Wildcards alone, listings under filters, words inside words: with few leads a page, so that blocks are ruled out."""
    many = sample.drop("id").crossJoin(spark.range(40)).withColumn("id", F.xxhash64("id", "company").bitwiseAND(F.lit(0xFFFFF)))
    many = many.withColumn("company", F.when(F.col("id") % 3 == 0, F.concat("company", F.lit(" software"))).otherwise(F.col("company")))
    texts = ["_", "__", "", None, '"_"', "software unknownword", "soft ech", '"software for" zzz', "of", "platform solar zzz", "saas tech in São Paulo", "São Paulo", "large"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(50, "", "Saúde", None), (51, "", None, "paulo"), (52, None, "nothing", None), (53, "software zz", None, "campinas")]
    log = spark.createDataFrame(rows, "query_id int, query_text string, industry string, location string")
    got = {}
    for r in se.search_log(many, log, NOW, limit=7).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["relevance_score"]))
    for i, text, industry, location in rows:
        single = se.search(many, se.SearchRequest(text, LeadFilters(industry=industry, location=location), limit=7), NOW).orderBy("position").collect()
        assert got.get(i, []) == [(r["id"], r["relevance_score"]) for r in single], (i, text)


def test_search_log_ranks_by_the_taste_of_each_user(spark, sample, sample_rows):
    rows = [(1, ["Saúde"], ["São Paulo, SP"], {"industry_match": 0.7, "text_relevance": 0.3}), (2, None, [], None)]
    tastes = spark.createDataFrame(rows, "user_id int, preferred_industries array<string>, preferred_locations array<string>, scoring_weights map<string,double>")
    log = spark.createDataFrame([(10, "telemedicine", 1), (11, "telemedicine", 2), (12, "telemedicine", 3), (13, "solar", 1), (14, "", 1)], "query_id int, query_text string, user_id int")
    got = {}
    for r in se.search_log(sample, log, NOW, tastes=tastes).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((round(r["relevance_score"], 9), r["id"]))
    mine = dict(weights=rows[0][3], liked=(rows[0][1], rows[0][2]))
    assert got[10] == plain_search(sample_rows, ["telemedicine"], [], **mine) and got[13] == plain_search(sample_rows, ["solar"], [], **mine)
    assert got[11] == got[12] == plain_search(sample_rows, ["telemedicine"], []) != got[10]
    assert got[14] == plain_search(sample_rows, [], [], **mine)


def test_blocks_bound_what_their_leads_score(spark, sample):
    """No lead of a block scores higher than the block's bound."""
    log = spark.createDataFrame([(1, "software online"), (2, "tech zz"), (3, 'mach "learning for"')], "query_id int, query_text string")
    parsed = se.parse_log(log)
    lookups = se._looked_up(parsed)
    postings = se.impact_postings(sample, lookups.select("term"), NOW, block_leads=1)
    bounds = se._block_bounds(postings, lookups, parsed, se.default_taste())
    pairs = postings.join(lookups, "term").select("query_id", "id", *se._BLOCK).distinct()
    wanted = se.Wanted(F.col("terms"), F.col("phrases"), F.col("want_industry"), F.col("want_location"), F.col("want_size"))
    score, _ = se.relevance(wanted, se.default_taste(), se.timestamp(NOW))
    rows = pairs.join(bounds, ["query_id", *se._BLOCK]).join(parsed, "query_id").join(sample.drop("user_id"), "id").select("bound", score.alias("s")).collect()
    assert len(rows) >= 5 and all(r["s"] <= r["bound"] + 1e-9 for r in rows)


def test_postings_alone_give_the_score_of_plain_terms(spark, sample):
    """The text score of plain terms is that of the texts to the last digit, of phrases not below it; every match is found."""
    texts = ["software online", "tech ana zz", "soft mach solar learning", "soft_are tech", 'mach "learning for"', '"software for" "in"', "a b c d e f g h i tech solar ana soft online for mach learn ing cloud"]
    log = spark.createDataFrame(list(enumerate(texts)), "query_id int, query_text string")
    parsed = se._marked(se.parse_log(log))
    lookups, taste = se._looked_up(parsed), se.default_taste()
    postings = se.impact_postings(sample, lookups.select("term"), NOW, block_leads=1)
    blocks = postings.join(lookups, "term").select("query_id", *se._BLOCK).distinct()
    rated = {(r["query_id"], r["id"]): r for r in se._rated_pairs(blocks, postings, lookups, parsed, taste).collect()}
    wanted = se.Wanted(F.col("terms"), F.col("phrases"), F.col("want_industry"), F.col("want_location"), F.col("want_size"))
    score, _ = se.relevance(wanted, taste, se.timestamp(NOW))
    met = sample.drop("user_id").join(parsed.filter("query_id != 3"), se.full_text_match(wanted.terms, wanted.phrases))
    rows = met.select("query_id", "id", "sure", text_score(wanted).alias("text"), score.alias("s")).collect()
    assert {r["query_id"] for r in rows} >= {0, 1, 2, 4, 5, 6} and {r["query_id"] for r in rows if r["sure"]} == {0, 1, 2}
    for r in rows:
        own = rated[r["query_id"], r["id"]]
        assert (own["text"] == r["text"] if r["sure"] else own["text"] >= r["text"] - 1e-9) and own["bound"] >= r["s"] - 1e-9 and own["sure"] == r["sure"]
    assert {k for k, r in rated.items() if r["sure"]} == {(r["query_id"], r["id"]) for r in rows if r["sure"]}


def test_search_log_finds_leads_that_share_an_id_by_their_texts(spark, sample):
    """Leads of one id with different texts, which postings put together, and requests of one id."""
    other = sample.withColumn("company", F.concat(F.lit("Telemedicine of "), "company")).withColumn("description", F.lit("solar online"))
    log = spark.createDataFrame([(0, "telemedicine zz"), (1, "solar zz"), (2, '"of solar" zz'), (3, '"solar online" zz')], "query_id int, query_text string")
    alone = se.search_log(sample.unionByName(other.withColumn("id", F.col("id") + 1000)), log, NOW, limit=500).collect()
    both = se.search_log(sample.unionByName(other), log, NOW, limit=500).collect()
    found = lambda rows: {(r["query_id"], r["id"] % 1000, r["company"], r["relevance_score"]) for r in rows}
    assert found(alone) <= found(both) and len(found(alone)) > 10
    twice = se.search_log(sample, log.withColumn("query_id", F.lit(7)), NOW, limit=500).collect()
    apart = se.search_log(sample, log, NOW, limit=500).collect()
    assert {(r["query_text"], r["id"], r["relevance_score"]) for r in twice} >= {(r["query_text"], r["id"], r["relevance_score"]) for r in apart}


def test_preferences_change_the_ranking(spark, sample, sample_rows):
    weights = {"industry_match": 0.7, "text_relevance": 0.3}
    liked = (["Saúde"], ["São Paulo, SP"])
    taste = Taste(F.array(F.lit("Saúde")), F.array(F.lit("São Paulo, SP")), weight_map(weights))
    got = se.search(sample, se.SearchRequest("telemedicine"), NOW, taste).collect()
    assert [(round(r["relevance_score"], 9), r["id"]) for r in got] == plain_search(sample_rows, ["telemedicine"], [], weights=weights, liked=liked)
    assert "User preferred industry: Saúde" in got[0]["match_reasons"]


def test_paging_order_and_presentation(spark, sample):
    every = [r["id"] for r in se.search(sample, se.SearchRequest("", limit=50), NOW).orderBy("position").collect()]
    page = [r["id"] for r in se.search(sample, se.SearchRequest("", limit=3, offset=4), NOW).orderBy("position").collect()]
    assert page == every[4:7] and len(every) == 10
    by_time = se.search(sample, se.SearchRequest("", sort_by="created_at", limit=50), NOW).orderBy("position").collect()
    times = [r["indexed_at"] for r in by_time]
    assert times[-2:] == [None, None] and times[:-2] == sorted(times[:-2], reverse=True)
    top = se.search(sample, se.SearchRequest("software", LeadFilters(location="São Paulo", company_size="51-200")), NOW).first()
    assert top["id"] == 1 and top["priority"] == ("Alta" if top["relevance_score"] > 0.8 else "Média")
    assert top["score"] == int(top["relevance_score"] * 100)
    assert top["highlighted_description"].startswith("<mark>software</mark>")


def test_advanced_search(spark, sample):
    results, facets, labels = se.advanced_search(sample, se.SearchRequest("software"), NOW, {"industries": ["Tecnologia", "Saúde"]})
    assert {r["industry"] for r in results.collect()} == {"Tecnologia"}
    assert {(r["facet"], r["value"], r["count"]) for r in facets.collect()} >= {("industries", "Tecnologia", 2)}
    assert labels.first()["query_complexity"] == "medium"
    assert facet_selection({"locations": ["a", "b"]}, LeadFilters(industry="x")) == LeadFilters(industry="x", location="a")


def test_index(spark, sample, sample_rows):
    got = {}
    for r in ix.build_postings(sample).collect():
        got.setdefault(r["lead_id"], set()).add(r["token"])
    assert got == {r["id"]: plain_keys(r) for r in sample_rows}
    lists = ix.posting_lists(ix.build_postings(sample), chunk=3).collect()
    assert max(len(r["lead_ids"]) for r in lists) <= 3
    assert sum(len(r["lead_ids"]) for r in lists) == sum(map(len, got.values()))
    assert ix.index_stats(sample).first().asDict() == {"total_leads": 10, "indexed_leads": 10, "failed_leads": 0}
    assert {r["lead_id"] for r in ix.incremental_postings(sample).collect()} == {4, 8}
    left = ix.remove_from_postings(ix.build_postings(sample), spark.createDataFrame([(1,)], "lead_id long"))
    assert {r["lead_id"] for r in left.collect()} == set(range(2, 11))


def test_stored_metadata_wins(spark, sample):
    stored = ix.with_index_metadata(sample).filter("id = 1").withColumn("searchable_text", F.lit("kept"))
    rows = {r["id"]: r["searchable_text"] for r in ix.with_stored_metadata(sample, stored).collect()}
    assert rows[1] == "kept" and rows[2].startswith("feira em casa")


def test_postings_on_disk(spark, sample, tmp_path):
    from leadlake.sources.sinks import read_postings, write_postings

    write_postings(ix.build_postings(sample), str(tmp_path / "p"), buckets=8)
    back = read_postings(spark, str(tmp_path / "p"), ["software", "tecnologia"], buckets=8)
    assert {r["lead_id"] for r in ix.leads_with_all_tokens(back, ["software", "tecnologia"]).collect()} == {1, 8}
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "token_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_suggestions(spark, sample):
    popular = spark.createDataFrame([("tech sp", 5), ("Technology", 9), ("other", 99)], "query string, count long")
    got = [r["text"] for r in su.suggestions(sample, popular, "tec").orderBy("position").collect()]
    assert got == ["Technology", "tech sp", "TechMaré Sistemas", "Tecnologia"]
    assert su.suggestions(sample, popular, "t").count() == 0
    typed = su.typed_suggestions(sample, popular, "tec", 8).orderBy("position").collect()
    assert [(r["type"], r["text"]) for r in typed] == [
        ("text", "Technology"), ("text", "tech sp"), ("text", "TechMaré Sistemas"), ("text", "Tecnologia"),
        ("company", "HealthTech Labs"), ("company", "the tech machine learning shop"),
    ]
