"""Optional-conjunct filters, keyset pages and set-like array predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "_none"


def all_of(*predicates: Column | None) -> Column:
    """Conjunction of the predicates that are given; true when none is."""
    given = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def equals(column: str, value) -> Column | None:
    """No predicate for None, IS NULL for the ``_none`` sentinel, equality otherwise."""
    if value is None:
        return None
    return F.col(column).isNull() if value == NONE else F.col(column) == F.lit(value)


def between(column: str, low=None, high=None) -> Column | None:
    parts = [F.col(column) >= F.lit(low)] * (low is not None) + [F.col(column) <= F.lit(high)] * (high is not None)
    return all_of(*parts) if parts else None


def day_range(column: str, first: str | None = None, last: str | None = None) -> Column | None:
    """Both days included: the upper bound is the start of the next day."""
    parts = [F.col(column) >= F.to_timestamp(F.lit(first))] if first else []
    parts += [F.col(column) < F.date_add(F.to_date(F.lit(last)), 1).cast("timestamp")] if last else []
    return all_of(*parts) if parts else None


def like_literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_text(column: str, text: str | None) -> Column | None:
    return F.col(column).ilike(f"%{like_literal(text)}%") if text else None


def contains_all(array: str, values: list) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, values)), F.col(array))) == 0


def contained_by(array: str, values: list) -> Column:
    return F.size(F.array_except(F.col(array), F.array(*map(F.lit, values)))) == 0


def overlaps(array: str, values: list) -> Column:
    return F.arrays_overlap(F.col(array), F.array(*map(F.lit, values)))


def search(term: str | None, id_col: str, text_col: str) -> Column | None:
    """Digits look an id up, ``#prefix`` matches the start of an id, other terms search the text."""
    if not term:
        return None
    if term.isdigit():
        return F.col(id_col) == int(term)
    if term.startswith("#"):
        return F.col(id_col).cast("string").startswith(term[1:])
    return contains_text(text_col, term)


def page(df: DataFrame, order: list, number: int, size: int, largest: int = 200) -> DataFrame:
    """One page of an ordering that ends in a unique key; number and size are clamped."""
    size = max(1, min(size, largest))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def after(keys: list[tuple[str, object, bool]]) -> Column:
    """Rows behind a keyset position: (column, value, descending) in sort order."""
    out, same = F.lit(False), F.lit(True)
    for name, value, down in keys:
        c = F.col(name)
        out = out | (same & ((c < F.lit(value)) if down else (c > F.lit(value))))
        same = same & (c == F.lit(value))
    return out
