"""Small files beside tables, through the file system that Spark reads them with."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by any path that Spark can read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, inner: str = "") -> list[str]:
        p = self._path(f"{self.path}/{inner}" if inner else self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def delete(self, inner: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{inner}"), True)

    def put(self, inner: str, text: str = "") -> None:
        """Write a file whole: it appears under its name once all of it is there."""
        whole, part = self._path(f"{self.path}/{inner}"), self._path(f"{self.path}/{inner}.part")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._fs.delete(whole, False)
        if not self._fs.rename(part, whole):
            raise OSError(f"could not write {self.path}/{inner}")

    def get(self, inner: str) -> str | None:
        p = self._path(f"{self.path}/{inner}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
