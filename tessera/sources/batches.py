"""Imports in batches that are committed one by one and go on where a broken run ended.

The key ranges of a snapshot are fixed before its first batch and written beside the table. A batch writes its own folder, over
what a broken try left there, and is committed by a marker; readers see committed batches only. A run that is started again for
the same snapshot takes the ranges without a marker, so no row is lost or taken twice, wherever it ended.

Odd input: rows with a null key are in the first batch; equal keys are in one batch, so one key's rows are never parted; an
empty source is one empty batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import Folder

#: Sampled keys a range, from which its bounds are taken.
SAMPLED = 40


def key_bounds(source: DataFrame, key: str, batch_rows: int) -> list:
    """Keys that part ``source`` into ranges of about ``batch_rows`` rows; the driver reads ``SAMPLED`` keys a range at most twice over."""
    rows = source.count()
    ranges = -(-rows // batch_rows)
    if ranges < 2:
        return []
    keys = source.select(key).where(F.col(key).isNotNull())
    picked = keys.sample(min(1.0, ranges * SAMPLED / rows), seed=7).sort(key).limit(2 * ranges * SAMPLED).collect()
    at = sorted({picked[len(picked) * i // ranges][0] for i in range(1, ranges)}) if picked else []
    return at


def _range(source: DataFrame, key: str, low, high) -> DataFrame:
    k = F.col(key)
    if low is None and high is None:
        return source
    if low is None:
        return source.where(k.isNull() | (k < F.lit(high)))
    return source.where(k >= F.lit(low)) if high is None else source.where((k >= F.lit(low)) & (k < F.lit(high)))


def import_batches(source: DataFrame, target: str, key: str, snapshot: str, batch_rows: int, build: Callable[[DataFrame], DataFrame] = lambda df: df, most: int | None = None) -> dict[str, int]:
    """Write ``build`` of each range of ``source`` that is not committed yet; {ranges, committed, skipped}.

    ``snapshot`` names the state of the source, by its fingerprint; another snapshot is another table. ``key`` is a number, a text
    or any other column that JSON can hold. ``most`` ends the run after so many batches.
    """
    home = Folder(source.sparkSession, f"{target}/{snapshot}")
    plan = home.get("plan.json")
    if plan is None:
        plan = json.dumps(key_bounds(source, key, batch_rows))
        home.put("plan.json", plan)
    bounds = [None, *json.loads(plan), None]
    done = set(home.names("commits"))
    stats = {"ranges": len(bounds) - 1, "committed": 0, "skipped": 0}
    for n, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if str(n) in done:
            stats["skipped"] += 1
            continue
        if most is not None and stats["committed"] >= most:
            break
        build(_range(source, key, low, high)).write.mode("overwrite").parquet(f"{home.path}/batch={n}")
        home.put(f"commits/{n}")
        stats["committed"] += 1
    return stats


def committed(spark: SparkSession, target: str, snapshot: str) -> DataFrame | None:
    """The rows of the committed batches, with their number as ``batch``; None before the first."""
    home = Folder(spark, f"{target}/{snapshot}")
    done = sorted(map(int, home.names("commits")))
    if not done:
        return None
    return spark.read.option("basePath", home.path).parquet(*[f"{home.path}/batch={n}" for n in done])


def is_complete(spark: SparkSession, target: str, snapshot: str) -> bool:
    home = Folder(spark, f"{target}/{snapshot}")
    plan = home.get("plan.json")
    return plan is not None and len(home.names("commits")) == len(json.loads(plan)) + 1
