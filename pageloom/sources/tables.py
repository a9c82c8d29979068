"""Stored tables as numbered versions, and plain exports.

A version is a directory ``v=<n>`` written in one job. A reader takes the
highest version that was finished (it holds ``_SUCCESS``), so a writer that
dies half-way changes nothing, and a micro-batch that is run again writes the
same version again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def finished_versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    jvm = spark._jvm
    return sorted(
        int(s.getPath().getName()[2:])
        for s in fs.listStatus(path)
        if s.getPath().getName().startswith("v=")
        and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    )


def write_version(
    df: DataFrame, root: str, version: int, partition_by: Sequence[str] = ()
) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/v={version}")


def read_latest(
    spark: SparkSession, root: str, schema: str | None = None, before: int | None = None
) -> DataFrame:
    """The latest finished version, or an empty table of ``schema``."""
    versions = [v for v in finished_versions(spark, root) if before is None or v < before]
    if not versions:
        if schema is None:
            raise FileNotFoundError(f"no finished version below {root}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{root}/v={versions[-1]}")


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, in as many files as the plan has tasks."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def as_json_lines(df: DataFrame, out: str = "line") -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(out))


def append_search_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").partitionBy("day").parquet(path)
