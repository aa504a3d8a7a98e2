"""Events, metrics, change sets, pages and streams on small hand-made tables."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from lead_samples import NOW
from pyspark.sql import functions as F

from leadlake.operators import changes as ch
from leadlake.operators import events as ev
from leadlake.operators import metrics as m
from leadlake.operators import preferences as pr
from leadlake.plans import ingest as ing
from leadlake.plans import reports as rp
from leadlake.session import work_folder
from leadlake.sources.sinks import append_events
from leadlake.sources.tables import read_lead_records, read_table, scan_since
from leadlake.streaming import counters as sc
from leadlake.streaming import sinks as ss

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    """A third of all events belong to one user; gaps of exactly five minutes occur."""
    rows, at = [], T0
    for i in range(900):
        at += timedelta(seconds=[1, 20, 300, 301, 90, 0][i % 6])
        user = 1 if i % 3 == 0 else 2 + i % 40
        rows.append((i, user, f"q{i % 7}" if i % 5 else ("" if i % 2 else None), i % 11, i % 13, i % 4 == 0, 0, 0, ["hit", "miss", "partial"][i % 3], at))
    schema = "id long, user_id long, query_text string, results_count int, response_time_ms int, c boolean, contacted_leads int, converted_leads int, cache_hit string, created_at timestamp"
    return spark.createDataFrame(rows, schema).withColumn("clicked_results", F.col("c").cast("int")).drop("c").cache()


def plain_sessions(rows):
    done, open_ = [], {}
    for r in sorted(rows, key=lambda r: (r["created_at"], r["id"])):
        s = open_.get(r["user_id"])
        if s is None or r["created_at"] - s["end"] > timedelta(minutes=5):
            s = open_[r["user_id"]] = dict(user=r["user_id"], start=r["created_at"], n=0, ms=0, hits=0)
            done.append(s)
        s["end"] = r["created_at"]
        s["n"] += 1
        s["ms"] += r["response_time_ms"]
        s["hits"] += r["cache_hit"] == "hit"
    return Counter((s["user"], s["start"], s["end"], s["n"], s["ms"], s["hits"]) for s in done)


def test_sessions(events):
    got = Counter(
        (r["user_id"], r["started_at"], r["ended_at"], r["total_searches"], r["total_response_time"], r["cache_hits"])
        for r in ev.session_counters(events).collect()
    )
    assert got == plain_sessions(events.collect())


def test_summary_of_nothing(events):
    row = ev.search_summary(events, T0 - timedelta(days=900), 30).first()
    assert row["total_searches"] == 900
    empty = ev.search_summary(events.filter("id < 0"), NOW, 30).first()
    assert (empty["total_searches"], empty["total_clicks"], empty["cache_hit_rate"], empty["avg_response_time_ms"]) == (0, 0, 0.0, 0)


def test_stream_equals_batch(spark, events, tmp_path):
    """Late sentinel events close every window; the stream then gives what the batch gives."""
    last = events.agg(F.max("created_at")).first()[0] + timedelta(days=2)
    sentinel = events.limit(1).withColumn("created_at", F.lit(last)).withColumn("user_id", F.lit(-1).cast("long"))
    path = str(tmp_path / "events")
    events.unionByName(sentinel).coalesce(1).write.parquet(path)
    stream = lambda: sc.event_time(spark.readStream.schema(events.schema).parquet(path))

    live = ss.drain(sc.live_search_counter(stream()), spark, "t1").filter("user_id > 0").collect()
    batch = {(r["user_id"], r["started_at"]): r for r in ev.session_counters(events).collect()}
    assert {(r["user_id"], r["started_at"], r["total_searches"], r["cache_hits"]) for r in live} == {
        (u, s, r["total_searches"], r["cache_hits"]) for (u, s), r in batch.items()
    }
    counted = ss.drain(sc.fixed_window_counter(stream(), "user_id", "60 minutes"), spark, "t2").filter("user_id > 0")
    expected = ev.window_counters(events, "user_id", 60)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, expected.collect()))

    active = {r["as_of"]: (r["searches"], r["active_users"]) for r in ss.drain(sc.last_hour_activity(stream(), "30 minutes"), spark, "t3").collect()}
    rows = events.collect()
    for end, (searches, users) in active.items():
        inside = [r for r in rows if end - timedelta(hours=1) <= r["created_at"] < end]
        if inside:
            assert searches == len(inside)
            assert users == len({r["user_id"] for r in inside})


def test_replay_ends_with_the_last_session(spark, events, tmp_path):
    path = str(tmp_path / "events")
    events.repartition(5).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    live = ss.replay(spark, "r1", lambda e: sc.live_search_counter(sc.event_time(e)), stream).collect()
    assert sum(r["total_searches"] for r in live) == events.count()
    assert len(live) == ev.session_counters(events).count()


def test_top_queries_over_many_batches(spark, events, tmp_path):
    path, folder = str(tmp_path / "events"), work_folder(spark, "t4")
    events.repartition(6, "id").write.parquet(path)
    stream = sc.event_time(spark.readStream.option("maxFilesPerTrigger", 1).schema(events.schema).parquet(path), "3650 days")
    counts = sc.popular_query_counts(stream, "3650 days")
    ss.keep_top_queries(counts, f"{folder}/out", f"{folder}/cp", 3, once=True).awaitTermination()
    plain = events.filter("trim(query_text) <> ''").groupBy(F.window("created_at", "3650 days")["start"].alias("s"), F.trim("query_text").alias("q")).count().collect()
    newest = max(r["s"] for r in plain)
    expected = sorted(((r["count"], r["q"]) for r in plain if r["s"] == newest), reverse=True)[:3]
    assert sorted(((r["count"], r["query"]) for r in ss.read_top_queries(spark, f"{folder}/out").collect()), reverse=True) == expected


def test_click_stream(spark, tmp_path):
    searches = [(i, T0 + timedelta(minutes=i)) for i in range(50)] + [(999, T0 + timedelta(days=3))]
    clicks = [(i, 7, T0 + timedelta(minutes=i + 5)) for i in range(0, 50, 2)] + [(1, 8, T0 + timedelta(minutes=40)), (999, 9, T0 + timedelta(days=3))]
    s = spark.createDataFrame(searches, "id long, created_at timestamp")
    c = spark.createDataFrame(clicks, "search_event_id long, lead_id long, created_at timestamp")
    s.coalesce(1).write.parquet(str(tmp_path / "s"))
    c.coalesce(1).write.parquet(str(tmp_path / "c"))
    live = sc.attributed_searches(
        sc.event_time(spark.readStream.schema(s.schema).parquet(str(tmp_path / "s"))),
        sc.event_time(spark.readStream.schema(c.schema).parquet(str(tmp_path / "c"))),
    )
    got = {(r["search_event_id"], r["lead_id"]) for r in ss.drain(live, spark, "clicks").collect() if r["search_event_id"] < 900}
    # The click on search 1 came 39 minutes later: too late to count.
    assert got == {(i, 7 if i % 2 == 0 else None) for i in range(50)}


def test_lead_counters_are_repeatable(spark, sample, tmp_path):
    rows = [(i, 1, 1 + i % 3, ["view", "contact", "email", "call", "convert"][i % 5], T0 + timedelta(hours=i)) for i in range(100)]
    log = spark.createDataFrame(rows, "id long, user_id long, lead_id long, interaction_type string, created_at timestamp")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    for _ in range(2):  # the second run finds nothing new
        q = ss.collect_lead_counters(
            spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True
        )
        q.awaitTermination()
    streamed = ss.read_lead_counters(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, ev.lead_counters(log).collect()))
    after = {r["id"]: r for r in ev.update_lead_counters(sample, streamed).collect()}
    mine = [r for r in rows if r[2] == 1]
    assert after[1]["view_count"] == sum(r[3] == "view" for r in mine)
    assert after[1]["last_contact"] == max(r[4] for r in mine if r[3] in ("contact", "email", "call"))
    assert after[1]["conversion_score"] == pytest.approx(min(0.1 * sum(r[3] == "convert" for r in mine), 1.0))
    assert after[9]["view_count"] == 0


def test_funnel_and_report_invariants(sample):
    funnel = ev.conversion_funnel(sample).orderBy("stage_order").collect()
    assert [r["count"] for r in funnel] == [10, 0, 0, 9, 0]
    # Stages are independent, so the drop from none to nine counts as zero; ties take the earliest stage.
    assert [r["stage"] for r in funnel if r["is_biggest_drop_off"]] == ["viewed"]
    facets = m.facets(sample).groupBy("facet").agg(F.sum("count").alias("n")).collect()
    assert all(r["n"] <= 10 for r in facets)
    report = {(r["section"], r["name"]): r["value"] for r in rp.comprehensive_report(sample, NOW).collect()}
    row = m.dashboard_metrics(sample, NOW).first()
    assert report["dashboard", "total_leads"] == row["total_leads"] and report["dashboard", "average_roi"] == row["average_roi"]
    tiers = {r["tier"]: r["count"] for r in m.quality_scores(sample).collect()}
    assert sum(tiers.values()) == 10 and all(report["quality", t] == n for t, n in tiers.items())
    assert m.dashboard_metrics(sample.filter("id < 0"), NOW).first()["conversion_rate"] == 0.0


def test_change_set(spark):
    base = spark.createDataFrame([(1, "a", 10, T0), (2, "b", 20, T0), (3, "c", 30, T0)], "id int, name string, n int, updated_at timestamp_ntz")
    changes = spark.createDataFrame(
        [(1, "update", None, 11), (2, "delete", None, None), (3, "create", "x", 99), (4, "create", "d", 40), (5, "update", "e", 1), (6, "delete", None, None)],
        "id int, op string, name string, n int",
    )
    got = sorted(map(tuple, ch.apply_changes(base, changes, "id", NOW).collect()))
    assert got == [(1, "a", 11, NOW), (3, "c", 30, T0), (4, "d", 40, NOW)]


def test_default_preferences(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    stored = spark.createDataFrame([(1, ["A"], [], "1-10", "", {"text_relevance": 1.0})], "user_id long, preferred_industries array<string>, preferred_locations array<string>, company_size_range string, revenue_range string, scoring_weights map<string,double>")
    rows = {r["user_id"]: r for r in pr.applied_preferences(users, stored).collect()}
    assert rows[1]["preference_boosts"] == {"industries": ["A"]} and rows[1]["custom_weights_used"] == {"text_relevance": 1.0}
    assert not rows[2]["preferences_applied"] and len(rows[2]["custom_weights_used"]) == 5


PAGE = """<!DOCTYPE html><html><head><title>Acme &amp; Filhos Ltda - Home page</title>
<meta charset="utf-8"><meta name="description" content="We build solar &eacute;quipment for houses"></head>
<body><header><img alt="Acme logo" src="x"></header><a href="/contato">Fale</a> <a href='https://www.acme.com.br/sobre?x=1'>Quem</a>
<a href="https://other.com/contact">Contact</a> <a href="https://LinkedIn.com/acme">in</a> <a href="https://facebook.com/acme">f</a>
<p>Rua das Flores, 10, Olinda</p><script>var mail="bad@script.com"</script></body></html>"""


def test_page_extraction(spark):
    bare = "<html><title>x</title><body><img class='big-logo' alt='Bare Shop'><h1>Other</h1><div class='box about'>" + "Long text about us. " * 5 + "</div></body></html>"
    empty = "<html><body>nothing</body></html>"
    heading = "<body><h1> The <b>Heading</b> </h1></body>"
    rows = [
        (1, "https://www.acme.com.br/", PAGE), (2, "https://www.acme.com.br/contato", "<title>Contato</title> sales@acme.com.br (81) 3333-4444"),
        (3, "https://bare.org", bare), (4, "http://www.my-shop2go.com/x", empty), (5, "http://h.com", heading),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in ing.merge_linked_pages(ing.extract_pages(pages)).collect()}
    assert got[1]["company"] == "Acme & Filhos Ltda"
    assert got[1]["contact_pages"] == ["https://www.acme.com.br/contato", "https://www.acme.com.br/sobre?x=1"]
    assert (got[1]["linkedin_url"], got[1]["facebook_url"], got[1]["twitter_url"]) == ("https://LinkedIn.com/acme", "https://facebook.com/acme", None)
    assert got[1]["description"] == "We build solar équipment for houses"
    assert (got[1]["email"], got[1]["phone"]) == ("sales@acme.com.br", "(81) 3333-4444")
    assert got[3]["company"] == "Bare Shop" and got[3]["description"].startswith("Long text about us.")
    assert got[4]["company"] == "My-Shop2Go" and got[5]["company"] == "The Heading"
    leads = spark.createDataFrame([(1, "ACME & Filhos Group")], "user_id long, company string")
    stages = {r["page_id"]: r["stage"] for r in ing.lead_pipeline(pages, leads, 1, ["company"]).collect()}
    assert stages[1] == "exists" and stages[2] == "saved" and set(stages) == {1, 2, 3, 4, 5}
    assert stages[4] == "invalid" or stages[4] == "saved"


def test_sources(spark, events, tmp_path):
    append_events(events, str(tmp_path / "ev"))
    since = m.timestamp(T0 + timedelta(hours=12))
    assert scan_since(read_table(spark, str(tmp_path / "ev")), since).count() == events.filter(F.col("created_at") >= since).count()
    (tmp_path / "in.json").write_text('{"company": "A", "score": 3}\nnot json\n')
    rows = read_lead_records(spark, str(tmp_path / "in.json")).collect()
    assert rows[0]["company"] == "A" and rows[1]["_bad_record"] == "not json"
