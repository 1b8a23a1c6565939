"""Written intermediates of operators that work in rounds: each cuts the lineage and survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; on one machine a local one stands in where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediates of one call: all but those named in ``keep`` are deleted when it ends, also by an error."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/tessera-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """A written frame that the result reads: it goes when the session ends."""
        self.kept.append(df._scratch)
        return df

    def drop(self, df: DataFrame | None) -> None:
        if df is not None:
            self.paths.remove(df._scratch)
            delete(self.spark, df._scratch)

    def __exit__(self, *_) -> None:
        for path in self.paths:
            if path in self.kept:
                _kept.append(path)
            else:
                delete(self.spark, path)


@atexit.register
def _clear() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        while _kept:
            delete(spark, _kept.pop())
