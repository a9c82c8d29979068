"""Change history of a URL: version numbers and timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

ORDER = ["created_at", "seq"]


def _bucket(bucket: Column | None) -> Column:
    return F.date_trunc("day", "created_at") if bucket is None else bucket


def timeline(history: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Each sighting with the hash seen before it."""
    return ordered.with_previous(
        history, ["url"], ORDER, _bucket(bucket), {"prev_content_hash": "content_hash"}
    )


def version_numbers(history: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Version 1 at the first sighting, one more at every change of the hash."""
    changed = F.when(F.col("prev_content_hash") != F.col("content_hash"), 1).otherwise(0)
    run = ordered.with_running_sum(
        timeline(history, bucket), ["url"], ORDER, _bucket(bucket), changed.cast("bigint"), "_changes"
    )
    return run.withColumn("version", F.col("_changes") + 1).drop("_changes")
