"""Link graph and crawl plans over stored pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as h
from ..functions import urls as u
from ..session import materialize

BROADCAST_URLS = 100_000
ALREADY_CRAWLED, LIMIT_REACHED = "already_crawled", "limit_reached"


def page_edges(pages: DataFrame, drop_anchors: bool = False) -> DataFrame:
    """(src_url, pos, dst_url): the links of each page, absolute and normalised."""
    return (
        pages.select(F.col("url").alias("_base"), F.posexplode(h.hrefs(F.col("html"), drop_anchors)).alias("pos", "href"))
        .select(
            u.normalize(F.col("_base")).alias("src_url"),
            "pos",
            "href",
            u.absolute(F.col("_base"), F.col("href")).alias("dst_url"),
        )
    )


def undiscovered(candidates: DataFrame, visited: DataFrame) -> DataFrame:
    """Candidate URLs not visited yet, each once."""
    return (
        candidates.select("url").distinct().join(visited.select("url"), "url", "left_anti")
    )


def crawl_plan(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int,
    max_urls: int | None = None,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    failed: DataFrame | None = None,
    expand: bool = True,
) -> DataFrame:
    """(url, depth) of a breadth-first walk from ``seeds``.

    A round joins the frontier with the edges, keeps what is in scope and not
    visited, and is written, which cuts the lineage. Failed pages are visited
    but not expanded. With ``max_urls`` the smallest (depth, url) are kept,
    which takes the place of queue order.
    """
    frontier = materialize(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    reached = grown = frontier.count()

    def small(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= BROADCAST_URLS else df

    links = edges.select(F.col("src_url").alias("url"), "dst_url")
    if failed is not None:
        links = links.join(failed.select("url"), "url", "left_anti")
    # every round reads the edges again, so they are computed once
    links = materialize(links, "edges")
    for depth in range(1, max_depth + 1) if expand else ():
        if max_urls is not None and reached >= max_urls:
            break
        found = (
            small(frontier, grown).join(links, "url")
            .select(F.col("dst_url").alias("url"))
            .filter(u.in_scope(F.col("url"), include, exclude))
            .distinct()
        )
        frontier = materialize(
            found.join(small(visited.select("url"), reached), "url", "left_anti").withColumn("depth", F.lit(depth))
        )
        grown = frontier.count()
        if grown == 0:
            break
        reached += grown
        visited = visited.unionByName(frontier)
    if max_urls is not None:
        visited = visited.orderBy("depth", "url").limit(max_urls)
    return visited


def visit_cap(tasks: DataFrame, visited: DataFrame, cap: int) -> DataFrame:
    """Which (url, depth) tasks may run, and why others may not.

    The first task of a URL counts; it runs while fewer than ``cap`` URLs were
    visited, in (depth, url) order.
    """
    before = visited.select("url").distinct()
    room = max(0, cap - before.count())
    fresh = (
        tasks.groupBy("url").agg(F.min("task_no").alias("task_no"), F.min("depth").alias("depth"))
        .join(before, "url", "left_anti")
    )
    runs = fresh.orderBy("depth", "url").limit(room).select("url", F.lit(True).alias("_runs"))
    firsts = fresh.select("url", F.col("task_no").alias("_first")).join(runs, "url", "left")
    return (
        tasks.join(firsts, "url", "left")
        .withColumn(
            "reason",
            F.when(
                F.col("_first").isNull() | (F.col("task_no") != F.col("_first")), F.lit(ALREADY_CRAWLED)
            ).when(F.col("_runs").isNull(), F.lit(LIMIT_REACHED)),
        )
        .drop("_first", "_runs")
    )


def update_plan(urls: DataFrame) -> DataFrame:
    """A fixed list of URLs to fetch again: depth 0, nothing followed."""
    return urls.select("url").distinct().withColumn("depth", F.lit(0))


def policy_tasks(policies: DataFrame) -> DataFrame:
    """One task per start URL of each enabled policy, with caps and all patterns."""
    return policies.filter("enabled").select(
        "policy_id", "site_id", F.posexplode("start_urls").alias("start_no", "start_url"),
        "max_urls", "max_depth", "url_patterns", "exclude_patterns",
    )


def seed_union(base: DataFrame, sitemap: DataFrame, links: DataFrame) -> DataFrame:
    """(url, depth): base, sitemap and link URLs, the smallest depth of each."""
    return (
        base.select("url", "depth").unionByName(sitemap.select("url", "depth"))
        .unionByName(links.select("url", "depth"))
        .groupBy("url").agg(F.min("depth").alias("depth"))
    )


def known_documents(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Left join of URLs to the documents already stored under them."""
    return candidates.join(docs.select("url", "document_id", "content_hash"), "url", "left")


def in_domain(
    url: Column, site_host: Column, content_type: Column, allow_subdomains: Column,
    allow_external: Column, allowed_types: Column,
) -> Column:
    relation = u.host_relation(url, site_host)
    mime = F.lower(F.regexp_replace(content_type, r"\s*;.*\z", ""))
    return (
        ((relation == "same") | ((relation == "subdomain") & allow_subdomains) | ((relation == "external") & allow_external))
        & ((F.size(allowed_types) <= 0) | F.array_contains(allowed_types, mime))
    )
