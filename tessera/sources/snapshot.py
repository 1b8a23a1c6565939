"""Identity of a snapshot of files, and report files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession


def fingerprint(spark: SparkSession, paths: list[str], version: str) -> str:
    """16 hex digits over size and modification second of each path in the order given ("-" where it is missing), @ ``version``.

    Only metadata is read, through Hadoop, so the paths may be in any store that Spark reads.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            st = fs.getFileStatus(p)
            parts.append(f"{st.getLen()}:{st.getModificationTime() // 1000}")
        else:
            parts.append("-")
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16] + f"@{version}"


def write_report(report: DataFrame, path: str, title: str, limit: int = 1000) -> None:
    """A report of at most ``limit`` rows (an error beyond) as ``path``.json and as a Markdown table, ``path``.md."""
    rows = report.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = [f"| {' | '.join(report.columns)} |", f"|{' --- |' * len(report.columns)}"]
    table = "\n".join([f"# {title}", "", *head, *(f"| {' | '.join(cell(v) for v in r)} |" for r in rows), ""])
    spark = report.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for end, text in ((".json", json.dumps([r.asDict(True) for r in rows], ensure_ascii=False, default=str)), (".md", table)):
        p = jvm.org.apache.hadoop.fs.Path(path + end)
        out = p.getFileSystem(conf).create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
