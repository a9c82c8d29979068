"""Counts and reports over store, index and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def store_totals(docs: DataFrame, membership: DataFrame, approximate: bool = False) -> DataFrame:
    """Documents, indexed, pending and sites, as one row."""
    n_sites = F.approx_count_distinct("site_id") if approximate else F.count_distinct("site_id")
    sites = membership.agg(n_sites.alias("sites"))
    totals = docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("is_indexed")).alias("indexed"),
        F.count_if(~F.col("is_indexed")).alias("pending"),
    )
    return totals.withColumn("sites", sites.scalar())


def index_stats(docs: DataFrame, by: str = "site_id", text: str = "content", membership: DataFrame | None = None) -> DataFrame:
    """Documents, white-space tokens and mean tokens per document of each site.

    With ``membership`` (site_id, document_id) a text is counted once, however
    many sites it is in, and only its number of tokens meets the sites.
    """
    counted = docs.withColumn("_n", tx.word_count(F.col(text)).cast("bigint"))
    if membership is not None:
        counted = counted.select("document_id", "_n").join(membership.select(by, "document_id"), "document_id")
    n = F.col("_n")
    return counted.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.sum(n).alias("total_tokens"),
        (F.sum(n) / F.count(F.lit(1))).alias("average_length"),
    )
