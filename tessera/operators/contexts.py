"""Placeholders matched with drawings of the same document by the text around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import nfc

SIZE, LEAST = 16, 8
#: A question's label, which a drawing's text may still hold.
LABEL = r"^(?:câu|question|bài)?\p{Nd}{1,3}[.:)]"


def squeeze(c: Column) -> Column:
    """NFC, no white space, lower case."""
    return F.lower(F.regexp_replace(nfc(F.coalesce(c, F.lit(""))), r"[\s\x0B\x1C-\x1F\x85\p{Z}]+", ""))


def match_contexts(places: DataFrame, drawings: DataFrame, on: str = "doc_id", place: str = "place", drawing: str = "drawing") -> DataFrame:
    """Rows (on, place, drawing) of ``places`` and ``drawings`` (on, id, before, after) whose surrounding texts agree.

    The last 16 characters before and the first 16 after, normalised, agree over their common length; an empty side passes;
    one side agrees on 8 characters or more. That side's 8 next characters are equal, so they are joined on.
    """
    head = lambda c: F.left(c, F.lit(SIZE))
    p = places.select(on, place, F.right(squeeze(F.col("before")), F.lit(SIZE)).alias("pa"), head(squeeze(F.col("after"))).alias("pb"))
    d = drawings.select(on, drawing, F.right(squeeze(F.col("before")), F.lit(SIZE)).alias("da"), squeeze(F.col("after")).alias("t"))
    d = d.select(on, drawing, "da", F.explode(F.array_distinct(F.array(head(F.col("t")), head(F.regexp_replace("t", LABEL, ""))))).alias("db"))
    na, nb = F.least(F.length("pa"), F.length("da")), F.least(F.length("pb"), F.length("db"))
    agree = (F.right("pa", na) == F.right("da", na)) & (F.left("pb", nb) == F.left("db", nb)) & (F.greatest(na, nb) >= LEAST)
    sides = []
    for one, other, key in (("pa", "da", F.right), ("pb", "db", F.left)):
        left = p.where(F.length(one) >= LEAST).withColumn("k", key(F.col(one), F.lit(LEAST)))
        right = d.where(F.length(other) >= LEAST).withColumn("k", key(F.col(other), F.lit(LEAST)))
        sides.append(left.join(right, [on, "k"]).where(agree).select(on, place, drawing))
    return sides[0].union(sides[1]).distinct()
