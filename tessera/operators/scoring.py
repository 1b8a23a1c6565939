"""Scoring of answers: fractions by kind, outcomes, session roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import round_even

#: Credit for 0 to 4 right statements of four.
STEP_TABLE = {0: 0.0, 1: 0.1, 2: 0.25, 3: 0.5, 4: 1.0}


def choice_fraction(want: Column, got: Column, partial: bool = False) -> Column:
    want, got = F.array_distinct(want), F.array_distinct(F.coalesce(got, F.array().cast("array<string>")))
    extra, missing = F.size(F.array_except(got, want)), F.size(F.array_except(want, got))
    full = F.when((extra == 0) & (missing == 0), 1.0)
    if partial:
        full = full.when((F.size(want) > 1) & (F.size(got) > 0) & (extra == 0), F.size(got) / F.size(want))
    return full.otherwise(0.0)


def numeric_fraction(want: Column, got: Column, tolerance: float = 1e-6) -> Column:
    """Relative tolerance with a floor of one."""
    return F.when(F.abs(got - want) <= tolerance * F.greatest(F.lit(1.0), F.abs(want)), 1.0).otherwise(0.0)


def statements_fraction(want: Column, got: Column, rule: str = "all_or_nothing") -> Column:
    right = F.size(F.filter(F.zip_with(want, got, lambda w, g: g.isNotNull() & (g == w)), lambda x: x))
    n = F.size(want)
    if rule == "per_statement":
        rest = right / n
    elif rule == "steps":
        table = F.create_map(*[F.lit(x) for kv in STEP_TABLE.items() for x in kv])
        rest = F.when(n == 4, F.try_element_at(table, right)).otherwise(0.0)
    else:
        rest = F.lit(0.0)
    return F.when(right == n, 1.0).otherwise(rest)


def score(blank: Column, gradable: Column, fraction: Column, points: Column, correct: float = 1.0, incorrect: float = 0.0, unanswered: float = 0.0) -> Column:
    """struct<outcome, points, max_points>. Blank is tested before all else; ungraded items count towards no maximum."""
    made = lambda outcome, got, top: F.struct(F.lit(outcome).alias("outcome"), got.alias("points"), top.alias("max_points"))
    zero = F.lit(0.0)
    return (
        F.when(~gradable & blank, made("unanswered", zero, zero))
        .when(~gradable, made("ungraded", zero, zero))
        .when(blank, made("unanswered", unanswered * points, points))
        .when(fraction >= 1, made("correct", correct * points, points))
        .when(fraction > 0, made("partial", round_even(fraction * correct * points, 6), points))
        .otherwise(made("incorrect", incorrect * points, points))
    )


def session_totals(items: DataFrame, session: str, scale: float | None = None) -> DataFrame:
    """One row a session from items with ``outcome, points, max_points``."""
    out = items.groupBy(session).agg(F.sum("points").alias("points"), F.sum("max_points").alias("max_points"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "partial", "incorrect", "unanswered", "ungraded")])
    return out.withColumn("scaled", round_even(F.try_divide(F.col("points") * scale, F.col("max_points")), 4)) if scale else out


def is_blank(labels: Column | None = None, text: Column | None = None, values: Column | None = None) -> Column:
    tests = []
    if labels is not None:
        tests.append(F.size(F.coalesce(labels, F.array().cast("array<string>"))) == 0)
    if text is not None:
        tests.append(F.trim(F.coalesce(text, F.lit(""))) == "")
    if values is not None:
        tests.append(F.forall(F.coalesce(values, F.array().cast("array<boolean>")), lambda v: v.isNull()))
    out = tests[0]
    for x in tests[1:]:
        out = out & x
    return out


def autosave(events: DataFrame, keys: list[str], order: list[str], response: str, seconds: str, cap: int = 36_000) -> DataFrame:
    """Last response per key, and its time: negative steps count nothing, the sum is capped."""
    return events.groupBy(*keys).agg(F.max_by(response, F.struct(*order)).alias(response), F.least(F.sum(F.greatest(F.col(seconds), F.lit(0))), F.lit(cap)).alias(seconds))


def shuffled(labels: Column, *seed: Column) -> Column:
    """Option labels in the order of a seeded hash."""
    h = lambda x: F.struct(F.sha2(F.concat_ws("\u001f", *[s.cast("string") for s in seed], x), 256).alias("h"), x.alias("x"))
    return F.transform(F.array_sort(F.transform(labels, h)), lambda s: s["x"])


def fingerprint(df: DataFrame, pool: str, unit: str) -> DataFrame:
    """SHA-256 over a pool's sorted ids."""
    return df.groupBy(pool).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_set(unit)), lambda x: x.cast("string")), ","), 256).alias("fingerprint"))
