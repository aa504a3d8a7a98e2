"""Windows that open at the first event of a key, as a stateful operator with timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which operators with timers need; the session's own setting returns."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def first_event_windows(events: DataFrame, key: str, seconds: int = 300, time: str = "created_at") -> DataFrame:
    """(key, window_start, n): events per key in windows of fixed length, each opened by the first event behind the last one.

    Events wait, counted by their time, until the watermark has passed them; then they are taken in order, whatever order they
    came in; those older than the watermark are dropped. A window comes out when the watermark has passed its end. State per key:
    the open window and the times waiting.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Windows(StatefulProcessor):  # defined here, so that executors need not have this package
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("window", "start bigint, n bigint, at array<bigint>, many array<bigint>")

        def handleInputRows(self, key, rows, timerValues):
            passed, fresh = timerValues.getCurrentWatermarkInMs() * 1000, {}
            for part in rows:
                for at, n in part["at"][part["at"] >= passed].value_counts().items():  # others are too late
                    fresh[int(at)] = fresh.get(int(at), 0) + int(n)
            yield from self._advance(key, passed, fresh)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000, {})

        def _advance(self, key, passed, waiting):
            import pandas as pd

            start, n, at, many = self.state.get() if self.state.exists() else (None, 0, [], [])
            for x, k in zip(at, many):
                waiting[x] = waiting.get(x, 0) + k
            done, length = [], seconds * 1_000_000
            for x in sorted(waiting):
                if x > passed:
                    break
                if start is not None and x >= start + length:
                    done.append((start, n))
                    start, n = None, 0
                start, n = (x if start is None else start), n + waiting.pop(x)
            if start is not None and start + length <= passed:
                done.append((start, n))
                start, n = None, 0
            if start is None and not waiting:
                self.state.clear()
            else:
                at = sorted(waiting)
                self.state.update((start, n, at, [waiting[x] for x in at]))
                due = min([*at[:1], *([] if start is None else [start + length])])
                self.handle.registerTimer(due // 1000 + 1)
            if done:
                keys = pd.Series([key[0]] * len(done), dtype=object)
                yield pd.DataFrame({"key": keys, "start": [s for s, _ in done], "n": [n for _, n in done]})

        def close(self):
            pass

    kind = events.schema[key].dataType.simpleString()
    rows = events.filter(F.col(time).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(time).alias("at"))
    found = rows.groupBy("key").transformWithStateInPandas(Windows(), f"key {kind}, start bigint, n bigint", "append", "EventTime")
    return found.select(F.timestamp_micros("start").alias("window_start"), F.col("key").alias(key), "n")
