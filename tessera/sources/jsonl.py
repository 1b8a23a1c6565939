"""JSONL, JSON manifests and record validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of a JSONL file or folder, blank lines skipped; a missing path is an empty table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema if isinstance(schema, StructType) else StructType.fromDDL(schema))
    return spark.read.schema(schema).json(path)


def read_manifests(spark: SparkSession, pattern: str, row_schema: str, key: str) -> DataFrame:
    """Rows of all manifest files {rows: [...]}; of a key in several files the one of the last file name wins.

    Unreadable files leave no rows.
    """
    schema = f"rows array<struct<{row_schema}>>, _corrupt_record string"
    files = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("_file", F.input_file_name())
    rows = files.where("rows is not null").select("_file", F.posexplode("rows").alias("_i", "r"))
    return rows.groupBy(F.col("r")[key].alias("_k")).agg(F.max_by("r", F.struct("_file", "_i")).alias("r")).select("r.*")


def split_records(lines: DataFrame, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good rows with the parsed fields, bad rows): one unreadable line never fails the load."""
    parsed = lines.where(F.trim(value) != "").withColumn("_r", F.from_json(value, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt_record").isNotNull()
    return parsed.where(~bad).select(*lines.columns, "_r.*").drop("_corrupt_record"), parsed.where(bad).select(*lines.columns)


def validate_records(df: DataFrame, required: list[str], allowed: dict[str, list], known: dict[str, DataFrame]) -> DataFrame:
    """``errors`` in a fixed order: required fields, allowed values, references into single-column dimensions."""
    checks = [F.when(F.col(n).isNull() | (F.trim(n) == ""), F.lit(f"{n} missing")) for n in required]
    checks += [F.when(~F.col(n).isin(*v), F.lit(f"{n} not allowed")) for n, v in allowed.items()]
    for i, (n, dim) in enumerate(known.items()):
        df = df.join(dim.select(F.col(dim.columns[0]).alias(f"_k{i}")).distinct(), F.col(n) == F.col(f"_k{i}"), "left")
        checks.append(F.when(F.col(f"_k{i}").isNull(), F.lit(f"{n} unknown")))
    return df.withColumn("errors", F.array_compact(F.array(*checks))).drop(*[f"_k{i}" for i in range(len(known))])
