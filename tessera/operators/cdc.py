"""Change-data capture: hashes, three-way diff, versions, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


def hash_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by U+001F; a null part is the word None."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("None")) for p in parts]
    return F.sha2(F.concat_ws(SEPARATOR, *cols), 256)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], overwrite: bool = True) -> DataFrame:
    """Rows of both, one a key: the change wins, or with ``overwrite=False`` the row that was there."""
    win, lose = (changes, target) if overwrite else (target, changes)
    return win.select(*target.columns).union(lose.join(win, keys, "left_anti").select(*target.columns))


def snapshot_diff(state: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """(key, change): created, changed, unchanged, removed or restored. ``state``: key, hash, removed; ``snapshot``: key, hash.

    A key that is gone and was removed before is not reported.
    """
    s = state.select(key, F.col("hash").alias("h0"), "removed", F.lit(True).alias("known"))
    n = snapshot.select(key, F.col("hash").alias("h1"), F.lit(True).alias("seen"))
    change = (
        F.when(F.col("known").isNull(), "created")
        .when(F.col("seen").isNull(), F.when(~F.col("removed"), "removed"))
        .when(F.col("removed"), "restored")
        .when(F.col("h0").eqNullSafe(F.col("h1")), "unchanged")
        .otherwise("changed")
    )
    return s.join(n, key, "full").select(key, change.alias("change")).where("change is not null")


def append_versions(versions: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(all versions, pointers). ``versions``: key, hash, version_no; ``incoming``: key, hash.

    An unseen hash appends the next number; a seen one only moves the pointer back to it.
    """
    top = versions.groupBy(key).agg(F.max("version_no").alias("_top"))
    new = incoming.join(versions, [key, "hash"], "left_anti").join(top, key, "left").select(key, "hash", (F.coalesce("_top", F.lit(0)) + 1).alias("version_no"))
    every = versions.select(key, "hash", "version_no").unionByName(new)
    return every, incoming.join(every, [key, "hash"]).select(key, "version_no")


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new), one a field that differs, nulls compared safely."""
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("old"), F.col(f"a.{f}").cast("string").alias("new")) for f in fields]
    joined = before.alias("b").join(after.alias("a"), key)
    changed = F.filter(F.array(*pairs), lambda x: ~x["old"].eqNullSafe(x["new"]))
    return joined.select(key, F.explode(changed).alias("x")).select(key, "x.*")


def pending(source: DataFrame, runs: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Rows of ``source`` that an import still has to take: all, or those after the last key that was committed.

    ``runs`` has (fingerprint, last_key) of each committed batch; only those of the same snapshot count.
    """
    last = runs.where(F.col("fingerprint") == fingerprint).agg(F.max("last_key")).first()[0]
    return source if last is None else source.where(F.col(key) > F.lit(last))


def changed_flags(df: DataFrame, key: str, stored: str, computed: Column) -> DataFrame:
    """(key, stored, flags) of the rows whose content gives other flags than the stored ones, whatever their order."""
    rows = df.select(key, F.array_sort(F.coalesce(stored, F.array().cast("array<string>"))).alias(stored), F.array_sort(computed).alias("flags"))
    return rows.where(F.col(stored) != F.col("flags"))
