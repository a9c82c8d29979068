"""Keyed tables as logs of changes that are merged in rounds.

A micro-batch appends the rows that changed, with ``live`` false where a key
went. A key counts as its rows of the last batch. So that readers never meet
more than a few versions of a key, batches are merged: every ``fan`` batches to
one run, every ``fan`` runs to a larger one, and so on. After n batches a reader
meets at most ``(fan - 1) * log_fan(n)`` runs, and a row is rewritten
``log_fan(n)`` times. A run that reaches back to the first batch is a snapshot:
it holds no dead keys, so its size is that of what lives.

Runs are dealt to ``buckets`` folders by a hash of their key; a look-up of some
keys reads the folders of these keys alone. All is decided by batch numbers: a
batch that is run again writes the same folders again, and reads only what
earlier batches wrote.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

#: buckets of a look-up are listed up to this many keys of a batch; beyond it nearly all are met anyway
LISTED = 256


@dataclass(frozen=True)
class LogTable:
    """``key``: columns whose last batch counts. ``bucket``: the column that deals runs to folders."""

    root: str
    schema: str
    key: tuple[str, ...]
    bucket: str
    buckets: int = 16
    fan: int = 4

    def _stored(self) -> str:
        return f"{self.schema}, live boolean, batch int"

    def _names(self) -> list[str]:
        return [c.strip().split(" ")[0] for c in self.schema.split(",")]

    def _bucket_of(self, column: str | Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def write(self, changed: DataFrame, batch_id: int, gone: DataFrame | None = None) -> None:
        """Append the changed rows of a batch; ``gone`` holds keys that went."""
        rows = changed.withColumn("live", F.lit(True))
        if gone is not None:
            rows = rows.unionByName(gone.withColumn("live", F.lit(False)), allowMissingColumns=True)
        rows.select(*self._names(), "live").write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")

    def _runs(self, spark: SparkSession) -> dict[int, list[int]]:
        """Ends of the finished runs by their first batch."""
        fs, path = tables._fs(spark, self.root)
        found: dict[int, list[int]] = {}
        if fs.exists(path):
            done = spark._jvm.org.apache.hadoop.fs.Path
            for entry in fs.listStatus(path):
                name = entry.getPath().getName()
                if name.startswith(("run=", "batch=")) and fs.exists(done(entry.getPath(), "_SUCCESS")):
                    ends = name.split("=")[1].split("-")
                    found.setdefault(int(ends[0]), []).append(int(ends[-1]))
        return found

    def cover(
        self, spark: SparkSession, before: int | None = None, start: int = 0, below: int | None = None
    ) -> list[tuple[int, int]]:
        """The fewest runs, first batch to last batch, that hold the batches from ``start`` up to ``before``.

        With ``below`` only runs of fewer batches than that.
        """
        found, out, at = self._runs(spark), [], start
        last = max((e for ends in found.values() for e in ends), default=-1) if before is None else before - 1
        while at <= last:
            ends = [e for e in found.get(at, []) if e <= last and (below is None or e - at + 1 < below)]
            if ends:
                out.append((at, max(ends)))
            at = max(ends, default=at) + 1
        return out

    def _read(self, spark: SparkSession, run: tuple[int, int], buckets: Sequence[int] | None) -> DataFrame:
        first, last = run
        if first == last:
            return spark.read.schema(f"{self.schema}, live boolean").parquet(f"{self.root}/batch={first}").withColumn("batch", F.lit(first))
        rows = spark.read.schema(f"{self._stored()}, bucket int").parquet(f"{self.root}/run={first}-{last}")
        return (rows if buckets is None else rows.filter(F.col("bucket").isin(list(buckets)))).drop("bucket")

    def log(self, spark: SparkSession, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows of the covering runs, dead and outdated ones included."""
        parts = [self._read(spark, run, buckets) for run in self.cover(spark, before)]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], self._stored())

    def _last(self, log: DataFrame) -> DataFrame:
        """Rows of each key's last batch; only keys and batches are grouped."""
        last = log.groupBy(*self.key).agg(F.max("batch").alias("batch"))
        return log.join(last, [*self.key, "batch"], "left_semi")

    def current(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Rows of all living keys."""
        return self._last(self.log(spark, before)).filter("live").drop("live", "batch")

    def find(self, keys: DataFrame, before: int, columns: Sequence[str] | None = None) -> DataFrame:
        """``columns`` (default: all) of the living keys whose bucket column is in ``keys``, a table of that column.

        For tables with one row a key. Reads the folders of these keys alone while the keys are few.
        """
        spark = keys.sparkSession
        buckets = None
        if any(first != last for first, last in self.cover(spark, before)):
            few = keys.select(self._bucket_of(self.bucket).alias("b")).limit(LISTED + 1).collect()
            buckets = None if len(few) > LISTED else sorted({r.b for r in few})
        names = list(columns) if columns is not None else self._names()
        others = [c for c in names if c not in self.key]
        met = self.log(spark, before, buckets).select(*self.key, *others, "live", "batch").join(
            keys.select(self.bucket).distinct(), self.bucket, "left_semi")
        last = met.groupBy(*self.key).agg(F.max_by(F.struct("live", *others), "batch").alias("_row")).filter("_row.live")
        return last.select(*[c if c in self.key else F.col(f"_row.{c}").alias(c) for c in names])

    def merge(self, spark: SparkSession, batch_id: int) -> None:
        """The merges that are due after a batch."""
        width = self.fan
        while (batch_id + 1) % width == 0:
            first = batch_id + 1 - width
            parts = self.cover(spark, batch_id + 1, first, width)  # also when the batch was merged before and runs again
            rows = self._last(reduce(DataFrame.unionByName, [self._read(spark, r, None) for r in parts]))
            if first == 0:
                rows = rows.filter("live")
            rows = rows.withColumn("bucket", self._bucket_of(self.bucket))
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/run={first}-{batch_id}")
            width *= self.fan
