"""Fixed-window counters and idempotent ingestion, for batch frames and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, key: str, ts: str, width: str, limit: int, delay: str | None = "1 day") -> DataFrame:
    """(key, window_start, n, rejected): events per key and fixed window; a window over ``limit`` is rejected.

    On a stream the state of a window ends ``delay`` after its end; None keeps the watermark that the stream has.
    """
    if not events.schema[ts].dataType.typeName().startswith("timestamp"):
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))  # a cast would lose the watermark of a time column
    if events.isStreaming and delay:
        events = events.withWatermark(ts, delay)
    g = events.groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("rejected"))


def ingest_once(events: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """One row a key. On a stream, repeats within the watermark are dropped."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def timeouts(events: DataFrame, key: str, ts: str, status: str, open_status: str, ttl_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(key, due) of keys whose last status is still ``open_status`` after ``ttl_seconds``.

    On a stream one row a key comes when the watermark passes the due time; what closes a key, or opens it anew, before that
    moves or ends its timer. Its state is two numbers a key, and none once it is closed. On a table all open keys come, with
    the time when each is due.
    """
    rows = events.select(F.col(key).cast("string").alias(key), F.col(ts).cast("timestamp").alias(ts) if events.schema[ts].dataType.typeName() != "timestamp" else F.col(ts), F.col(status).cast("string").alias(status))
    if not events.isStreaming:
        last = rows.groupBy(key).agg(F.max(ts).alias("_at"), F.max_by(status, ts).alias("_status"))
        return last.where(F.col("_status") == open_status).select(key, (F.col("_at") + F.make_interval(secs=F.lit(ttl_seconds))).alias("due"))
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, frames, state):
        if state.hasTimedOut:
            _, due = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "due": [pd.Timestamp(due, unit="ms")]})
            return
        at, due = state.get if state.exists else (-1, -1)
        for frame in frames:
            last = frame.sort_values(ts, kind="stable").iloc[-1]
            ms = int(last[ts].timestamp() * 1000)
            if ms >= at:
                at, due = ms, ms + 1000 * ttl_seconds if last[status] == open_status else -1
        if due < 0:
            if state.exists:
                state.remove()
        elif due <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [k[0]], "due": [pd.Timestamp(due, unit="ms")]})
        else:
            state.update((at, due))
            state.setTimeoutTimestamp(due)

    return rows.withWatermark(ts, delay).groupBy(key).applyInPandasWithState(step, f"{key} string, due timestamp", "at long, due long", "append", GroupStateTimeout.EventTimeTimeout)
