"""Ordered work per key that stays parallel when one key holds most rows.

A plain window hands all rows of a key to one task. Here a key is cut into
buckets that follow the order (an hour, a run of ids). The window runs inside
a bucket, one summary row per bucket is carried over to the next one, and both
are put together by a join on the bucket, which keeps the partitioning of the
window. The result equals that of the plain window; NULL keys are a key and
NULL orders come first, as they do there.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _carry(rows: DataFrame, carried: DataFrame, names: Sequence[str]) -> DataFrame:
    """Join the carried rows on ``names``; NULL equals NULL."""
    there = carried.withColumnsRenamed({n: f"_of_{n}" for n in names})
    same = reduce(and_, [rows[n].eqNullSafe(there[f"_of_{n}"]) for n in names])
    return rows.join(there, same)


def with_previous(
    df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column, columns: dict[str, str]
) -> DataFrame:
    """Add, for each ``out: col`` of ``columns``, the value of the row before."""
    key, order = list(key), list(order)
    rows = df.withColumn("_bucket", bucket)
    inside = W.partitionBy(*key, "_bucket").orderBy(*order)
    local = rows.withColumns(
        {
            "_at": F.row_number().over(inside),
            **{f"_local_{out}": F.lag(col).over(inside) for out, col in columns.items()},
        }
    )
    tails = rows.groupBy(*key, "_bucket").agg(
        F.max_by(
            F.struct(*[F.col(c).alias(out) for out, c in columns.items()]), F.struct(*order)
        ).alias("_tail")
    )
    carried = tails.withColumn(
        "_before", F.lag("_tail").over(W.partitionBy(*key).orderBy("_bucket"))
    ).drop("_tail")
    return (
        _carry(local, carried, [*key, "_bucket"])
        .withColumns(
            {
                out: F.when(F.col("_at") == 1, F.col("_before")[out]).otherwise(
                    F.col(f"_local_{out}")
                )
                for out in columns
            }
        )
        .select(*df.columns, *columns)
    )


def with_running_sum(
    df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column, value: Column, out: str
) -> DataFrame:
    """Add the sum of ``value`` over all rows up to and with this one."""
    key, order = list(key), list(order)
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inside = (
        W.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    totals = rows.groupBy(*key, "_bucket").agg(F.sum("_value").alias("_total"))
    before = W.partitionBy(*key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.withColumn(
        "_before", F.coalesce(F.sum("_total").over(before), F.lit(0))
    ).drop("_total")
    return (
        _carry(rows.withColumn("_run", F.sum("_value").over(inside)), carried, [*key, "_bucket"])
        .withColumn(out, F.col("_run") + F.col("_before"))
        .select(*df.columns, out)
    )


def with_row_number(
    df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column, out: str
) -> DataFrame:
    return with_running_sum(df, key, order, bucket, F.lit(1).cast("bigint"), out)


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, numbered.

    Filtering on ``row_number`` lets Spark keep only ``k`` rows per key in
    every task before the shuffle, so a hot key sends k rows per task.
    """
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def only_keys(big: DataFrame, few: DataFrame, key: str, limit: int = 200_000) -> DataFrame:
    """Rows of ``big`` whose key is in ``few``, without a shuffle of ``big``.

    A checked number of keys goes to every task. Beyond the limit the semi
    join shuffles both sides; the rows are the same.
    """
    keys = few.select(key).filter(F.col(key).isNotNull()).distinct()
    small = keys.limit(limit + 1).count() <= limit
    return big.join(F.broadcast(keys) if small else keys, key, "left_semi")


def bounded_rows(df: DataFrame, limit: int):
    """The rows of ``df`` when there are at most ``limit``, else None.

    The check that must come before anything is sent to every task.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
