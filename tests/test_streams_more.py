"""Windows that open at a first event, events sent twice, and summaries of popular texts."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leadlake.operators import summaries as sm
from leadlake.session import work_folder
from leadlake.streaming import counters as sc
from leadlake.streaming import sinks as ss
from leadlake.streaming import windows as sw

T0 = datetime(2024, 3, 1)


def plain_windows(rows, seconds):
    out, times = Counter(), {}
    for key, at in rows:
        times.setdefault(key, []).append(at)
    for key, found in times.items():
        start = None
        for at in sorted(found):
            if start is None or at >= start + timedelta(seconds=seconds):
                start = at
            out[key, start] += 1
    return sorted((s, k, n) for (k, s), n in out.items())


def test_windows_open_at_the_first_event_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"k{rng.randrange(5)}", T0 + timedelta(milliseconds=rng.randrange(4 * 3_600_000))) for _ in range(400)]
    rows += [("k0", T0 + timedelta(minutes=7))] * 5 + [("k1", T0), ("k1", T0 + timedelta(seconds=900))]
    # files arrive one batch at a time; events are late by up to ten minutes
    by_arrival = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(500)))
    schema = "kind string, created_at timestamp"
    for i in range(4):
        part = by_arrival[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with sw.rocksdb_state(spark):
        out = ss.replay(spark, "first", lambda e: sw.first_event_windows(sc.event_time(e), "kind", 900), stream)
    assert spark.conf.get(sw.PROVIDER, None) != sw.ROCKSDB
    got = sorted((r.window_start, r.kind, r.n) for r in out.collect())
    assert got == plain_windows(rows, 900)


def test_events_sent_twice_are_appended_once(spark, tmp_path):
    rows = [(i, i % 3, T0 + timedelta(minutes=i)) for i in range(50)] + [(None, 9, T0), (None, 9, T0)]
    schema = "id long, user_id long, created_at timestamp"
    for _ in range(2):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folder = work_folder(spark, "once")
    for _ in range(2):  # the second run finds nothing new
        ss.append_events_once(sc.unique_events(stream, late_by="1 day"), f"{folder}/out", f"{folder}/cp", once=True).awaitTermination()
    got = spark.read.parquet(f"{folder}/out").collect()
    assert sorted(r.id for r in got if r.id is not None) == list(range(50)) and sum(r.id is None for r in got) == 4
    assert {str(r.event_date) for r in got} == {"2024-03-01"}


def test_summaries_merge_to_the_popular_texts(spark):
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        text = f"hot {rng.randrange(5)}" if rng.random() < 0.5 else rng.choice([None, " ", f"rare {rng.randrange(3000)}"])
        rows.append((i, i % 7, text, T0 + timedelta(minutes=i)))
    events = spark.createDataFrame(rows, "id long, user_id long, query_text string, created_at timestamp")
    counts = Counter(r[2] for r in rows if r[2] and r[2].strip())
    few = sm.query_summaries(events, tracked=400)
    assert few.count() == 7 * 67  # one per hour and tenant
    for tracked, slack in ((400, len(rows) / 300), (10_000, 0)):
        got = {r.query: r["count"] for r in sm.popular_from_summaries(sm.query_summaries(events, tracked), 5, tracked).collect()}
        assert got.keys() == {f"hot {k}" for k in range(5)}
        assert all(abs(got[t] - counts[t]) <= slack for t in got)
    own = sm.popular_from_summaries(sm.query_summaries(events), 1, by=["user_id"]).collect()
    for r in own:
        mine = Counter(x[2] for x in rows if x[1] == r.user_id and x[2] and x[2].strip())
        assert r["count"] == max(mine.values()) == mine[r.query]
    assert sm.popular_from_summaries(sm.query_summaries(events.filter(F.lit(False))), 3, by=["user_id"]).count() == 0
