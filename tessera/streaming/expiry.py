"""Fixed-window counters as keyed state with timers: a window's counter goes a day after its begin.

On a stream, each key holds a map of its windows' counts and one timer, for the oldest of them. The watermark moves time on:
when it passes a window's begin by ``keep``, the counter is removed, and events that late find none and are not counted. On a table
the counters are those that the stream would still hold at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how long a window's counter is kept from its begin on, in seconds.
KEEP_SECONDS = 86_400


def _processor(name: str, limit: int, keep_ms: int):
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class WindowCounters(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.counts = handle, handle.getMapState("counts", "window long", "n long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            now, fresh = timerValues.getCurrentWatermarkInMs(), {}
            for frame in rows:
                for window, n in frame.groupby("window_ms").size().items():
                    if window + keep_ms > now:
                        fresh[window] = fresh.get(window, 0) + int(n)
            for window, n in sorted(fresh.items()):
                had = self.counts.getValue((window,)) if self.counts.containsKey((window,)) else None
                fresh[window] = n + (had[0] if had else 0)
                self.counts.updateValue((window,), (fresh[window],))
                if not had:
                    self.handle.registerTimer(window + keep_ms)
            yield self._out(key, fresh, "counted")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            window = expiredTimerInfo.getExpiryTimeInMs() - keep_ms
            gone = {}
            if self.counts.containsKey((window,)):
                gone[window] = self.counts.getValue((window,))[0]
                self.counts.removeKey((window,))
            yield self._out(key, gone, "expired")

        def _out(self, key, counts, what) -> pd.DataFrame:
            at = sorted(counts)
            return pd.DataFrame({name: [str(key[0])] * len(at), "window_start": pd.to_datetime(at, unit="ms"), "n": [counts[w] for w in at], "rejected": [counts[w] > limit for w in at], "what": [what] * len(at)})

        def close(self) -> None:
            pass

    return WindowCounters()


def _windows(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    return events.withColumn("window_ms", ms - F.pmod(ms, F.lit(1000 * seconds)))


def expiring_counters(events: DataFrame, key: str, ts: str, seconds: int, limit: int, keep_seconds: int = KEEP_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """A stream of (key, window_start, n, rejected, what): ``counted`` whenever a window's count changes, ``expired`` when its state goes.

    Keys are given as text. The session needs the RocksDB provider of state stores.
    """
    rows = _windows(events.withWatermark(ts, delay), key, ts, seconds).select(F.col(key).cast("string").alias(key), ts, "window_ms")
    schema = f"{key} string, window_start timestamp, n long, rejected boolean, what string"
    return rows.groupBy(key).transformWithStateInPandas(_processor(key, limit, 1000 * keep_seconds), schema, "Update", "EventTime")


def live_counters(events: DataFrame, key: str, ts: str, seconds: int, limit: int, keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """(key, window_start, n, rejected) of the windows that are kept at the time of the last event of the table."""
    now = events.agg(F.max(F.unix_millis(F.col(ts).cast("timestamp"))).alias("_now"))
    counts = _windows(events, key, ts, seconds).groupBy(key, "window_ms").agg(F.count("*").alias("n"))
    kept = counts.join(F.broadcast(now), F.col("window_ms") + 1000 * keep_seconds > F.col("_now"))
    return kept.select(key, F.timestamp_millis("window_ms").alias("window_start"), "n", (F.col("n") > limit).alias("rejected"))
