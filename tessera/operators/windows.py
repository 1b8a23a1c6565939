"""Ordered idioms: latest row, greedy fill with skips, stacked periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest ``order`` per key, by a partial aggregation rather than a sort."""
    rest = [x for x in df.columns if x not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_top"))
    return top.select(*keys, *[F.col("_top")[x].alias(x) for x in rest])


def greedy_fill(units: DataFrame, pool: list[str], unit: str, size: str, order: list[str], budget: int) -> DataFrame:
    """Units taken in ``order`` while they fit; one that does not fit is skipped and later ones may still fit.

    A unit larger than the budget can never be taken and leaves before the fold. Since each unit has a size of at least
    one, no more than ``budget`` units of each size can be taken, which bounds the list of a pool by budget squared.
    """
    from pyspark.sql import Window

    units = units.where((F.col(size) >= 1) & (F.col(size) <= budget))
    r = F.row_number().over(Window.partitionBy(*pool, size).orderBy(*order))
    units = units.withColumn("_r", r).where(F.col("_r") * F.col(size) <= budget)
    item = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(unit).alias("u"), F.col(size).cast("long").alias("s"))
    lists = units.groupBy(*pool).agg(F.array_sort(F.collect_list(item)).alias("us"))
    kind = units.schema[unit].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("taken"))
    step = lambda a, x: F.when(a["used"] + x["s"] <= budget, F.struct((a["used"] + x["s"]).alias("used"), F.concat(a["taken"], F.array(x["u"])).alias("taken"))).otherwise(a)
    return lists.select(*pool, F.explode(F.aggregate("us", start, step)["taken"]).alias(unit))


def stack_periods(events: DataFrame, owner: str, event: str, ts: str, days: int) -> DataFrame:
    """Periods of equal length that start at their event or at the end of the period before, whichever is later.

    With k-th start s_k = max(t_k, s_{k-1} + d), s_k = k d + max over j <= k of (t_j - j d): a running maximum, no fold.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(owner).orderBy(ts, event)
    d = days * 86_400_000_000
    k = F.row_number().over(w)
    rows = events.withColumn("_k", k).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")) - F.col("_k") * d)
    start = F.max("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_k") * d
    rows = rows.withColumn("_s", start)
    return rows.select(owner, event, F.timestamp_micros("_s").alias("starts_at"), F.timestamp_micros(F.col("_s") + d).alias("expires_at"))
