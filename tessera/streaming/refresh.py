"""Dirty-key refresh of a table from a stream, once for each epoch however often it is tried.

Each epoch writes its keys and its new rows into folders of its own, over what a broken try left, and ends with a marker. The
table is, for each key, the rows of the last marked epoch that refreshed it: old rows of a key are replaced, also by none.
Every ``snapshot_every`` epochs all live rows are written as one epoch and the folders before it go.

Odd input: rows with a null key refresh nothing; a batch without keys is an epoch without rows; a target belongs to one
checkpoint, as epochs are numbered by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import Folder


def latest_rows(rows: DataFrame, refreshed: DataFrame, keys: list[str], epoch: str = "epoch") -> DataFrame:
    """``rows`` (keys, epoch, ...) of the last epoch in which ``refreshed`` (keys, epoch) has their key."""
    last = refreshed.dropna(subset=keys).groupBy(*keys).agg(F.max(epoch).alias(epoch))
    return rows.join(last, [*keys, epoch], "left_semi")


def _marked(home: Folder) -> int:
    return max((int(n) for n in home.names("marks")), default=-1)


def current(spark: SparkSession, target: str, keys: list[str]) -> DataFrame | None:
    """The live rows, with the epoch that wrote them; None before the first epoch."""
    home = Folder(spark, target)
    last = _marked(home)
    if last < 0:
        return None
    seen = lambda inner: spark.read.parquet(f"{home.path}/{inner}").where(F.col("epoch") <= last)
    return latest_rows(seen("rows"), seen("keys"), keys)


def write_epoch(batch: DataFrame, epoch: int, keys: list[str], recompute: Callable[[DataFrame], DataFrame], target: str, snapshot_every: int = 50) -> None:
    """One epoch: recompute the keys of ``batch``. A second call for an epoch that is marked only cleans up."""
    spark = batch.sparkSession
    home = Folder(spark, target)
    whole = snapshot_every > 0 and epoch % snapshot_every == snapshot_every - 1
    if _marked(home) < epoch:
        at = f"{home.path}/keys/epoch={epoch}"
        batch.select(*keys).dropna().distinct().write.mode("overwrite").parquet(at)
        dirty = spark.read.parquet(at).select(*keys)
        rows = recompute(dirty)
        live = current(spark, target, keys) if whole else None
        if live is not None:  # what this epoch does not touch goes along
            rest = live.join(dirty, keys, "left_anti").drop("epoch")
            rows = rows.unionByName(rest)
        rows.write.mode("overwrite").parquet(f"{home.path}/rows/epoch={epoch}")
        if live is not None:
            spark.read.parquet(f"{home.path}/rows/epoch={epoch}").select(*keys).distinct().write.mode("append").parquet(at)
        home.put(f"marks/{epoch}")
    if whole:
        for name in home.names("marks"):
            if int(name) < epoch:
                for inner in (f"rows/epoch={name}", f"keys/epoch={name}", f"marks/{name}"):
                    home.delete(inner)


def refresh_changed(stream: DataFrame, keys: list[str], recompute: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, snapshot_every: int = 50):
    """Start a refresh: each micro-batch recomputes the keys that it names and replaces their rows in ``target``."""
    home = Folder(stream.sparkSession, target)
    owner = home.get("owner")
    if owner is None:
        home.put("owner", checkpoint)
    elif owner != checkpoint:
        raise ValueError(f"{target} belongs to the checkpoint {owner}")
    write = lambda df, epoch: write_epoch(df, epoch, keys, recompute, target, snapshot_every)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
