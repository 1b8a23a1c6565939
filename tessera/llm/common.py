"""Shared pieces: table reads, materialised intermediates, connected components."""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Settings while rows are written. Once they are, nobody reads the shuffles behind them.
_CLEANUP, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch on its way to Python: those of texts take memory beside the heap, those of ranks do not.
TEXT_ROWS, RANK_ROWS = 1_000, 10_000


def _shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A local folder stands in for it only where all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


_scratch: list[str] = []
_open = threading.local()  # the scopes that a thread is in


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        while _scratch:
            _drop(spark, _scratch.pop())


def materialize(df: DataFrame, rows: int | None = None, per_task: int = 250_000, batch_rows: int = TEXT_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    With ``rows`` (about how many it has) the last stage runs in one task per ``per_task`` rows, 12 at least.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(12, rows // per_task))
    path = f"{_shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in (_CLEANUP, _BATCH)}
    spark.conf.set(_CLEANUP, True)
    spark.conf.set(_BATCH, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _scratch.append(path)
    for made in getattr(_open, "scopes", [])[-1:]:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete materialised intermediates that no later plan reads."""
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        if path in _scratch:
            _scratch.remove(path)
            _drop(df.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Intermediates written inside go when it ends, by an error too, but those put into the list that it gives: the result
    reads them, and they go when the session ends."""
    stack = _open.scopes = getattr(_open, "scopes", [])
    stack.append([])
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        made = stack.pop()
        stay = {getattr(df, "_tessera_path", None) for df in kept}
        for path in made:
            if path in _scratch and path not in stay:
                _scratch.remove(path)
                _drop(spark, path)
        if stack:  # an outer scope deletes what the inner one kept
            stack[-1].extend(p for p in made if p in stay)


#: Ids up to which a list of them is sent to the rows; beyond it both sides are shuffled.
BROADCAST_IDS = 4_000_000


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows of ``ids``, which keep their place where the ids are few enough to go to them."""
    ids = materialize(ids)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, id_col, "left_anti")


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with one row an id, that of its smallest text; only the rows of ids that repeat move."""
    again = materialize(docs.groupBy("id").count().where("count > 1").select("id"))
    if again.isEmpty():
        release(again)
        return docs
    once = materialize(docs.join(again, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    return docs.join(again, "id", "left_anti").union(once)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id per node of ``edges(a, b)`` (longs): rows (id, component_id), isolated nodes absent.

    Alternates large-star and small-star contraction, so the rounds grow with the logarithm of the longest chain; every
    round is two aggregations on the edge list and is materialised; it ends when the edges are disjoint stars.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        hooked = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        return hooked.union(low.select("a", F.col("m").alias("b"))).distinct()

    rows = edges.count()
    now, last = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), None
    while True:
        now = materialize(small(large(now).coalesce(max(12, rows // 250_000))), rows)
        release(*[last] * (last is not None))
        last = now
        ends = now.select("a", F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("a").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf + centre > 1").isEmpty():
            break  # no leaf has two centres and no centre is a leaf: the edges are disjoint stars
    star = now.groupBy("a").agg(F.min("b").alias("c"))
    return star.select(F.col("a").alias("id"), F.col("c").alias("component_id")).union(star.select(F.col("c").alias("id"), F.col("c").alias("component_id"))).distinct()
