"""The document store: classify, apply, history, delete, membership.

A batch is a set, while pages arrive one by one. So a batch is first reduced
to the last record per URL, and among new records with the same content the
smallest URL comes first; the others then find that document by its hash.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as u

NEW, NEW_SITE, EDIT, SKIP, DELETE = "new", "new_site", "edit", "skip", "delete"


def new_id(url: Column) -> Column:
    """A non-negative id that depends on the URL alone."""
    return F.xxhash64(url).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def latest_per_url(incoming: DataFrame, order: str = "ts") -> DataFrame:
    """The last record per URL. Only the narrow keys are grouped."""
    tie = [c for c in ("content_hash", "site_id") if c in incoming.columns]
    last = incoming.groupBy("url").agg(F.max(F.struct(order, *tie)).alias("_last"))
    names = ("url", order, *tie)
    keyed = last.select(F.col("url").alias("_of_url"), *[F.col("_last")[c].alias(f"_of_{c}") for c in (order, *tie)])
    # a record with a NULL among these is still the last one of its URL
    same = reduce(and_, [incoming[c].eqNullSafe(keyed[f"_of_{c}"]) for c in names])
    return incoming.join(keyed, same, "left_semi").dropDuplicates(["url"])


def newest_per_hash(docs: DataFrame, keep: str = "document_id") -> DataFrame:
    """One row per content hash, the one updated last.

    The winner's id is found by an aggregate that combines before the shuffle,
    so a hash shared by a third of the table is no hot spot.
    """
    winners = docs.groupBy("content_hash").agg(
        F.max_by(keep, F.struct("updated_at", keep)).alias(keep)
    )
    return docs.join(winners.select(keep), keep, "left_semi")


def newest_per_url(docs: DataFrame) -> DataFrame:
    winners = docs.groupBy("url").agg(
        F.max_by("document_id", F.struct("updated_at", "document_id")).alias("document_id")
    )
    return docs.join(winners.select("document_id"), "document_id", "left_semi")


def find_existing(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Match by URL, else by content hash (the oldest document with it).

    Rows that need no second look-up get a key of their own instead of NULL:
    NULL keys would all go to one task.
    """
    by_url = store.select(
        "url",
        F.col("document_id").alias("_url_id"),
        F.col("content_hash").alias("_url_hash"),
        F.lit(True).alias("_url_hit"),
    )
    by_hash = (
        store.filter(F.col("content_hash") != "")
        .groupBy(F.col("content_hash").alias("_key"))
        .agg(F.min_by("document_id", F.struct("created_at", "document_id")).alias("_hash_id"))
    )
    needs_hash = F.col("_url_hit").isNull() & (F.coalesce(F.col("content_hash"), F.lit("")) != "")
    return (
        incoming.join(by_url, "url", "left")
        .withColumn(
            "_key", F.when(needs_hash, F.col("content_hash")).otherwise(F.concat(F.lit("-"), "url"))
        )
        .join(by_hash, "_key", "left")
        .withColumn("document_id", F.coalesce("_url_id", "_hash_id"))
        .withColumn(
            "prev_content_hash",
            F.coalesce("_url_hash", F.when(F.col("_hash_id").isNotNull(), F.col("content_hash"))),
        )
        .drop("_key", "_url_id", "_url_hash", "_url_hit", "_hash_id")
    )


def in_site(rows: DataFrame, membership: DataFrame, flag: str = "in_site") -> DataFrame:
    """Flag rows whose (document_id, site_id) pair is a membership."""
    pairs = membership.select(
        F.col("site_id"), F.col("document_id").alias("_member"), F.lit(True).alias("_in")
    ).dropDuplicates(["site_id", "_member"])
    own_key = -1 - F.pmod(F.xxhash64("url"), F.lit(1 << 40))
    return (
        rows.withColumn("_member", F.coalesce("document_id", own_key))
        .join(pairs, ["site_id", "_member"], "left")
        .withColumn(flag, F.coalesce("_in", F.lit(False)))
        .drop("_member", "_in")
    )


def classify(incoming: DataFrame, store: DataFrame, membership: DataFrame) -> DataFrame:
    """Add document_id, prev_content_hash and operation to (url, site_id, content_hash).

    A known document that is not in the site is ``new_site`` even when its
    content changed; a missing site or hash leaves that test out.
    """
    found = in_site(find_existing(incoming, store), membership)
    site_given = F.coalesce(F.col("site_id"), F.lit("")) != ""
    hash_given = F.coalesce(F.col("content_hash"), F.lit("")) != ""
    operation = (
        F.when(F.col("document_id").isNull(), F.lit(NEW))
        .when(site_given & ~F.col("in_site"), F.lit(NEW_SITE))
        .when(hash_given & (F.col("content_hash") != F.col("prev_content_hash")), F.lit(EDIT))
        .otherwise(F.lit(SKIP))
    )
    return found.withColumn("operation", operation).drop("in_site")


def settle_copies(classified: DataFrame, id_of: Column | None = None) -> DataFrame:
    """Within one batch, later copies of new content join its first document."""
    id_of = new_id(F.col("url")) if id_of is None else id_of
    is_new = F.col("operation") == NEW
    rows = classified.withColumn(
        "document_id", F.when(is_new, id_of).otherwise(F.col("document_id"))
    ).withColumn(
        "_key",
        F.when(is_new & (F.coalesce(F.col("content_hash"), F.lit("")) != ""), F.col("content_hash"))
        .otherwise(F.concat(F.lit("-"), "url")),
    )
    first = (
        rows.filter(is_new & ~F.col("_key").startswith("-"))
        .groupBy("_key")
        .agg(F.min(F.struct("url", "site_id", "document_id")).alias("_first"))
    )
    later = is_new & F.col("_first").isNotNull() & (F.col("url") != F.col("_first")["url"])
    return (
        rows.join(first, "_key", "left")
        .withColumns(
            {
                "operation": F.when(
                    later & F.col("site_id").eqNullSafe(F.col("_first")["site_id"]), F.lit(SKIP)
                )
                .when(later, F.lit(NEW_SITE))
                .otherwise(F.col("operation")),
                "document_id": F.when(later, F.col("_first")["document_id"]).otherwise(
                    F.col("document_id")
                ),
            }
        )
        .drop("_key", "_first")
    )


def promoted(metadata: Column) -> dict[str, Column]:
    """title, description and keywords taken from a metadata map."""

    def first_of(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(metadata[k], F.lit("")) for k in keys])

    return {
        "title": first_of("title", "og_title"),
        "description": first_of("description", "meta_description", "og_description"),
        "keywords": first_of("keywords", "meta_keywords"),
    }


def document_rows(records: DataFrame, now: Column) -> DataFrame:
    """Crawl records as document rows, with the defaults of a first sighting."""
    have = set(records.columns)

    def col(name: str, default) -> Column:
        default = default if isinstance(default, Column) else F.lit(default)
        return F.coalesce(F.col(name), default) if name in have else default

    return records.select(
        "document_id",
        "url",
        F.coalesce(F.col("content_hash"), F.lit("")).alias("content_hash"),
        col("title", F.lit(None).cast("string")).alias("title"),
        col("description", F.lit(None).cast("string")).alias("description"),
        col("keywords", F.lit(None).cast("string")).alias("keywords"),
        col("source", "").alias("source"),
        col("mimetype", "text/html").alias("mimetype"),
        col("status_code", 200).cast("int").alias("status_code"),
        "content",
        col("clean_content", F.lit(None).cast("string")).alias("clean_content"),
        col("links", F.array().cast("array<string>")).alias("links"),
        F.lit(1).alias("version"),
        col("index_operation", NEW).alias("index_operation"),
        F.lit(False).alias("is_indexed"),
        col("ts", now).alias("created_at"),
        col("ts", now).alias("updated_at"),
    )


def apply_documents(store: DataFrame, records: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The store after a batch: edits in place with version + 1, new rows added.

    ``changes`` is the narrow outcome of ``classify`` and ``settle_copies``;
    ``records`` holds the wide columns and is shuffled once, without the rows
    that change nothing.
    """
    todo = changes.filter(F.col("operation").isin(NEW, EDIT)).select("url", "document_id", "operation")
    full = records.drop("document_id", "operation").join(todo, "url")
    edits = full.filter(F.col("operation") == EDIT)
    optional = ["status_code", "links", "mimetype", "title", "description", "keywords"]
    given = [c for c in optional if c in records.columns]
    patch = edits.select(
        "document_id",
        F.lit(True).alias("_edited"),
        F.col("content").alias("_content"),
        F.col("content_hash").alias("_content_hash"),
        (F.col("clean_content") if "clean_content" in records.columns else F.lit(None).cast("string"))
        .alias("_clean_content"),
        (F.coalesce(F.col("ts"), now) if "ts" in records.columns else now).alias("_updated_at"),
        *[F.col(c).alias(f"_{c}") for c in given],
    )
    replaced = F.coalesce(F.col("_edited"), F.lit(False))
    new_values = {
        "content": F.when(replaced, F.col("_content")).otherwise(F.col("content")),
        "content_hash": F.when(replaced, F.col("_content_hash")).otherwise(F.col("content_hash")),
        "clean_content": F.when(replaced, F.col("_clean_content")).otherwise(F.col("clean_content")),
        "version": F.col("version") + F.when(replaced, 1).otherwise(0),
        "index_operation": F.when(replaced, F.lit(EDIT)).otherwise(F.col("index_operation")),
        "is_indexed": F.when(replaced, F.lit(False)).otherwise(F.col("is_indexed")),
        "updated_at": F.when(replaced, F.col("_updated_at")).otherwise(F.col("updated_at")),
        **{c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in given},
    }
    kept = store.join(patch, "document_id", "left").select(
        *[new_values.get(c, F.col(c)).alias(c) for c in store.columns]
    )
    added = document_rows(full.filter(F.col("operation") == NEW), now)
    return kept.unionByName(added.select(*store.columns))


def apply_membership(membership: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Memberships after a batch; a pair that exists keeps its first time."""
    pairs = changes.filter(
        F.col("document_id").isNotNull() & (F.coalesce(F.col("site_id"), F.lit("")) != "")
    ).select("site_id", "document_id", now.alias("created_at"))
    return (
        membership.select("site_id", "document_id", "created_at")
        .unionByName(pairs)
        .groupBy("site_id", "document_id")
        .agg(F.min("created_at").alias("created_at"))
    )


def history_rows(before: DataFrame, after: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """One append-only history row per new, edited or deleted document."""
    changed = changes.filter(F.col("operation").isin(NEW, EDIT)).select(
        "document_id", F.col("operation").alias("change_type"), "site_id"
    )
    cols = ["document_id", "url", "content_hash", "version", "title", "description", "content", "clean_content"]
    live = after.select(*cols).join(changed, "document_id")
    gone = (
        before.select(*cols)
        .join(
            changes.filter(F.col("operation") == DELETE).select(
                "document_id", F.lit(DELETE).alias("change_type"), "site_id"
            ),
            "document_id",
        )
    )
    return live.unionByName(gone).select(
        "document_id", "url", "content_hash", "version", "change_type",
        now.alias("created_at"), "title", "description",
        F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("content_length"),
        F.coalesce(F.length("clean_content"), F.lit(0)).cast("bigint").alias("clean_content_length"),
        "site_id",
    )


def delete_documents(store: DataFrame, membership: DataFrame, requests: DataFrame):
    """Remove (url, site_id) requests; a NULL site removes the document everywhere.

    Returns (documents left, memberships left). A document goes when its last
    site went.
    """
    targets = requests.join(store.select("url", "document_id"), "url").select(
        "document_id", F.col("site_id").alias("_site")
    )
    everywhere = targets.filter(F.col("_site").isNull()).select("document_id").distinct()
    one_site = (
        targets.filter(F.col("_site").isNotNull())
        .select("document_id", F.col("_site").alias("site_id"))
        .distinct()
    )
    left = membership.join(everywhere, "document_id", "left_anti").join(
        one_site, ["document_id", "site_id"], "left_anti"
    )
    orphans = (
        targets.select("document_id").distinct()
        .join(left.select("document_id"), "document_id", "left_anti")
    )
    return store.join(orphans, "document_id", "left_anti"), left


def delete_report(membership: DataFrame, docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Per requested (site_id, document_id): success, or the reason why not."""
    return (
        requests.join(
            membership.select("site_id", "document_id", F.lit(True).alias("_member")),
            ["site_id", "document_id"],
            "left",
        )
        .join(docs.select("document_id", F.lit(True).alias("_doc")), "document_id", "left")
        .withColumn(
            "error",
            F.when(F.col("_member").isNull(), F.lit("not in site"))
            .when(F.col("_doc").isNull(), F.lit("no such document")),
        )
        .withColumn("success", F.col("error").isNull())
        .drop("_member", "_doc")
    )


def purge_site(store: DataFrame, membership: DataFrame, nodes: DataFrame, site_id: str):
    """Members, documents left without a site, and nodes of one site."""
    mine = membership.filter(F.col("site_id") == site_id).select("document_id").distinct()
    left = membership.filter(F.col("site_id") != site_id)
    orphans = mine.join(left.select("document_id"), "document_id", "left_anti")
    return (
        store.join(orphans, "document_id", "left_anti"),
        left,
        nodes.filter(F.col("site_id") != site_id),
    )


def add_members(membership: DataFrame, pairs: DataFrame) -> DataFrame:
    """Idempotent: an existing pair keeps its time."""
    return (
        membership.unionByName(pairs)
        .groupBy("site_id", "document_id")
        .agg(F.min("created_at").alias("created_at"))
    )


def remove_members(membership: DataFrame, pairs: DataFrame) -> DataFrame:
    return membership.join(pairs, ["site_id", "document_id"], "left_anti")


def copy_members(membership: DataFrame, source: str, target: str, now: Column) -> DataFrame:
    copied = membership.filter(F.col("site_id") == source).select(
        F.lit(target).alias("site_id"), "document_id", now.alias("created_at")
    )
    return add_members(membership, copied)


def mark_indexed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    done = ids.select("document_id").distinct().withColumn("_done", F.lit(True))
    return (
        docs.join(done, "document_id", "left")
        .withColumn("is_indexed", F.col("is_indexed") | F.coalesce("_done", F.lit(False)))
        .drop("_done")
    )


def reconcile_errors(errors: DataFrame, store: DataFrame, membership: DataFrame) -> DataFrame:
    """Failed fetches: a document of the site goes, anything else is skipped.

    Only 4xx and 5xx rows take part; other rows keep a NULL operation.
    """
    known = in_site(
        errors.withColumn("content_hash", F.lit(None).cast("string")).join(
            store.select("url", "document_id"), "url", "left"
        ),
        membership,
    ).drop("content_hash")
    failed = F.floor(F.col("status_code") / 100).isin(4, 5)
    return known.withColumn(
        "operation",
        F.when(failed & F.col("document_id").isNotNull() & F.col("in_site"), F.lit(DELETE)).when(
            failed, F.lit(SKIP)
        ),
    ).drop("in_site")


def adopt_redirects(records: DataFrame) -> DataFrame:
    return records.withColumn("url", F.coalesce(F.nullif("redirect_url", F.lit("")), "url"))


def site_union(first: Column, rest: Column) -> Column:
    """All site ids of a record, in order, each once."""
    return F.array_distinct(
        F.filter(F.concat(F.array(first), F.coalesce(rest, F.array().cast("array<string>"))),
                 lambda s: F.coalesce(s, F.lit("")) != "")
    )


def sites_per_document(membership: DataFrame) -> DataFrame:
    return membership.groupBy("document_id").agg(
        F.array_sort(F.collect_set("site_id")).alias("site_ids")
    )


def primary_site(membership: DataFrame) -> DataFrame:
    return membership.groupBy("document_id").agg(
        F.min_by("site_id", F.struct("created_at", "site_id")).alias("site_id")
    )


def precondition(records: DataFrame) -> DataFrame:
    """Route records: pass, or drop with the reason."""
    blank_url = F.coalesce(F.col("url"), F.lit("")) == ""
    return records.withColumn(
        "route",
        F.when(F.col("status") == "skipped", F.lit("drop"))
        .when(F.col("status") == "error", F.lit("drop"))
        .when(F.col("crawler_operation").isNotNull(), F.lit("pass"))
        .when(blank_url | F.col("content").isNull(), F.lit("error"))
        .when(F.coalesce(F.col("site_id"), F.lit("")) == "", F.lit("skip"))
        .otherwise(F.lit("process")),
    ).withColumn(
        "reason",
        F.when(F.col("status").isin("skipped", "error"), F.concat(F.lit("record "), "status"))
        .when(F.col("route") == "error", F.lit("url or content missing"))
        .when(F.col("route") == "skip", F.lit("site id missing")),
    )


def status_route(status_code: Column) -> Column:
    return F.when(F.floor(status_code / 100).isin(4, 5), F.lit("error")).otherwise(F.lit("ok"))


def preferred_content(formats: Column, record: dict[str, Column]) -> Column:
    """First requested and present of markdown, html, links, content, else all as JSON."""
    picks = [
        F.when(F.array_contains(formats, name) & (F.coalesce(record[name], F.lit("")) != ""), record[name])
        for name in ("markdown", "html", "links", "content")
        if name in record
    ]
    whole = F.to_json(F.struct(*[c.alias(n) for n, c in record.items()]))
    return F.coalesce(*picks, whole)


def crawl_records(pages: DataFrame, fetched_at: Column) -> DataFrame:
    """Stored pages as crawl records, without the HTML-derived metadata."""
    return pages.select(
        u.normalize(F.col("url")).alias("url"),
        F.col("html").alias("content"),
        F.lit(200).alias("status_code"),
        F.lit("text/html").alias("mimetype"),
        u.host(F.col("url")).alias("source"),
        tx.content_hash(F.col("html")).alias("content_hash"),
        fetched_at.alias("ts"),
    )
