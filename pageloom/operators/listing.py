"""Lists, look-ups, full-text search, sorting and paging."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels
from ..functions import text as tx
from ..session import materialize
from . import ordered

SORTABLE = ("created_at", "updated_at", "timestamp", "title")


def members_of(docs: DataFrame, membership: DataFrame, site_id: str | None) -> DataFrame:
    if site_id is None:
        return docs
    mine = membership.filter(F.col("site_id") == site_id).select("document_id")
    return docs.join(mine, "document_id", "left_semi")


def filter_documents(
    docs: DataFrame, mimetype: str | None = None, search: str = "", is_indexed: bool | None = None
) -> DataFrame:
    if mimetype:
        docs = docs.filter(F.col("mimetype") == mimetype)
    if search:
        docs = docs.filter(
            tx.contains_ci(F.col("title"), search)
            | tx.contains_ci(F.col("description"), search)
            | tx.contains_ci(F.col("url"), search)
        )
    if is_indexed is not None:
        docs = docs.filter(F.col("is_indexed") == is_indexed)
    return docs


def sort_columns(sort_by: str, direction: str = "desc", tie: str = "document_id") -> list[Column]:
    """Order of a document list; an unknown key means newest first."""
    if sort_by not in SORTABLE:
        sort_by, direction = "created_at", "desc"
    key = F.col("updated_at" if sort_by == "timestamp" else sort_by)
    return [key.desc() if direction.lower() == "desc" else key.asc(), F.col(tie).asc()]


def search_order(sort_by: str, custom: Column | None = None) -> list[Column]:
    if sort_by == "date":
        return [F.col("created_at").desc(), F.col("document_id").asc()]
    if sort_by == "title":
        return [F.col("title").asc(), F.col("document_id").asc()]
    return [custom, F.col("document_id").asc()] if custom is not None else [F.col("document_id").asc()]


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page with total_count, total_pages and the page that was served.

    The total comes from one aggregate over the pruned scan; a window without
    a key would pull all rows into one task.
    """
    total = df.count()
    pages = max(1, math.ceil(total / size))
    page = min(max(1, page), pages)
    return (
        df.orderBy(*order)
        .offset((page - 1) * size)
        .limit(size)
        .withColumns(
            {
                "total_count": F.lit(total).cast("bigint"),
                "page": F.lit(page),
                "total_pages": F.lit(pages),
            }
        )
    )


def page_after(df: DataFrame, last: tuple | None, size: int, key=("created_at", "document_id")) -> DataFrame:
    """Next page after the given key, newest first: the way for deep pages."""
    if last is not None:
        first, tie = (F.lit(v) for v in last)
        df = df.filter(
            (F.col(key[0]) < first) | ((F.col(key[0]) == first) & (F.col(key[1]) > tie))
        )
    return df.orderBy(F.col(key[0]).desc(), F.col(key[1]).asc()).limit(size)


def full_text(
    docs: DataFrame,
    membership: DataFrame,
    query: str,
    site_id: str | None = None,
    mimetype: str | None = None,
    created_from=None,
    created_to=None,
    condition: Column | None = None,
    result: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Documents whose title, description or cleaned content holds the query."""
    if not query:
        return docs.limit(0)
    hits = docs.filter(
        tx.contains_ci(F.col("title"), query)
        | tx.contains_ci(F.col("description"), query)
        | tx.contains_ci(F.col("clean_content"), query)
    )
    if mimetype:
        hits = hits.filter(F.col("mimetype") == mimetype)
    if created_from is not None:
        hits = hits.filter(F.col("created_at") >= F.lit(created_from).cast("timestamp"))
    if created_to is not None:
        hits = hits.filter(F.col("created_at") <= F.lit(created_to).cast("timestamp"))
    if condition is not None:
        hits = hits.filter(condition)
    hits = members_of(hits, membership, site_id)
    return hits.transform(result) if result is not None else hits


def as_results(hits: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Result columns of full-text search: default title, 300-character snippet."""
    out = hits.select(
        "document_id", "url",
        F.coalesce(F.nullif("title", F.lit("")), F.lit(labels.NO_TITLE)).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        tx.preview(F.col("clean_content"), 300).alias("content"),
        "mimetype", "content_hash", "created_at",
        F.lit(1.0).alias("score"),
    )
    return out.join(sites, "document_id", "left") if sites is not None else out


def document_detail(
    docs: DataFrame, membership: DataFrame, site_id: str | None = None, *,
    url: str | None = None, content_hash: str | None = None, document_id: int | None = None,
    with_content: bool = False,
) -> DataFrame:
    """Point look-up by URL, hash (the first by id) or id, within a site."""
    found = members_of(docs, membership, site_id)
    if url is not None:
        found = found.filter(F.col("url") == url)
    if content_hash is not None:
        found = found.filter(F.col("content_hash") == content_hash).orderBy("document_id").limit(1)
    if document_id is not None:
        found = found.filter(F.col("document_id") == document_id)
    return found if with_content else found.drop("content")


def filter_sites(sites: DataFrame, enabled: bool | None = None, search: str = "") -> DataFrame:
    if enabled is not None:
        sites = sites.filter(F.col("enabled") == enabled)
    if search:
        sites = sites.filter(
            tx.contains_ci(F.col("name"), search) | tx.contains_ci(F.col("description"), search)
        )
    return sites


def with_document_count(sites: DataFrame, membership: DataFrame) -> DataFrame:
    counts = membership.groupBy("site_id").agg(F.count(F.lit(1)).alias("total_documents"))
    return sites.join(counts, "site_id", "left").withColumn(
        "total_documents", F.coalesce("total_documents", F.lit(0).cast("bigint"))
    )


def documents_of_site(docs: DataFrame, membership: DataFrame, site_id: str) -> DataFrame:
    """Documents of a site with the time they joined it."""
    mine = membership.filter(F.col("site_id") == site_id).select(
        "site_id", "document_id", F.col("created_at").alias("joined_at")
    )
    return docs.join(mine, "document_id")


def history_of_site(
    history: DataFrame, membership: DataFrame, site_id: str | None = None, start=None, end=None
) -> DataFrame:
    """History rows of the documents of a site, optionally within a time range."""
    if start is not None:
        history = history.filter(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        history = history.filter(F.col("created_at") <= F.lit(end).cast("timestamp"))
    sites = membership.select("site_id", "document_id")
    if site_id is not None:
        sites = sites.filter(F.col("site_id") == site_id)
    return history.join(sites, "document_id")


def pending_documents(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents not yet indexed, oldest first."""
    pending = docs.filter(~F.col("is_indexed"))
    order = [F.col("created_at").asc(), F.col("document_id").asc()]
    return pending.orderBy(*order).limit(limit) if limit is not None else pending


def index_tasks(docs: DataFrame, membership: DataFrame) -> DataFrame:
    """One index task per pending document and site."""
    return pending_documents(docs).join(membership.select("site_id", "document_id"), "document_id")


def refresh_batches(
    docs: DataFrame, membership: DataFrame, size: int = 200, bucket: Column | None = None
) -> DataFrame:
    """Number the documents of each site in batches of ``size``, in one pass."""
    rows = docs.select("document_id", "url", "created_at").join(
        membership.select("site_id", "document_id"), "document_id"
    )
    bucket = F.date_trunc("hour", "created_at") if bucket is None else bucket
    numbered = ordered.with_row_number(
        rows, ["site_id"], ["created_at", "document_id"], bucket, "position"
    )
    return numbered.withColumn("batch", F.floor((F.col("position") - 1) / size))


def with_labels(results: DataFrame, now: Column) -> DataFrame:
    return results.withColumn("date_label", labels.relative_date(F.col("created_at"), now))


def numbered(df: DataFrame, order: list[Column], columns: list[str], name: str = "row_no") -> DataFrame:
    """``columns`` of all rows with their place (from 1) in a total order.

    The sort is by ranges and no task sees all rows: places within a range are
    counted up from the sizes of the ranges before it.
    """
    place = F.monotonically_increasing_id()  # range in the upper bits, place within it in the lower 33
    rows = materialize(df.orderBy(*order).select(*columns, place.alias("_at")), "ordered")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    sizes = sizes.select("_part", before.alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(sizes), part == F.col("_part")).select(
        *columns, (F.col("_before") + inside + 1).cast("bigint").alias(name))
