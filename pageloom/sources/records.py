"""Crawl records from pages, payloads, mail and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as h
from ..functions import text as tx
from ..functions import urls as u
from ..session import materialize
from . import digests

#: bytes of the largest file that one task reads as a whole for its hash
WHOLE_FILE = 64 << 20


def page_records(pages: DataFrame, fetched_at: Column, with_metadata: bool = True) -> DataFrame:
    """Stored pages as crawl records; the metadata comes from the HTML itself."""
    url = u.normalize(F.col("url"))
    records = pages.select(
        *[c for c in pages.columns if c not in ("url", "html")],
        url.alias("url"),
        F.col("html").alias("content"),
        F.lit(200).alias("status_code"),
        F.lit("text/html").alias("mimetype"),
        u.host(url).alias("source"),
        tx.content_hash(F.col("html")).alias("content_hash"),
        fetched_at.alias("ts"),
    )
    if not with_metadata:
        return records
    body = F.col("content")
    meta = h.metadata(body)
    return records.withColumns({"metadata": meta, "headings": h.headings(body), "images": h.images(body)}).withColumn(
        "title",
        F.coalesce(F.nullif(F.col("metadata")["title"], F.lit("")), u.cap_title(u.title_from_url(F.col("url")))),
    )


def decode_payload(records: DataFrame) -> DataFrame:
    """Base64 payloads by MIME class: text decoded, binary as bytes, the rest marked."""
    kind = u.mime_class(F.col("mimetype"))
    raw = F.unbase64("content")
    return records.select(
        *[c for c in records.columns if c != "content"],
        kind.alias("kind"),
        F.when(kind == "text", F.decode(raw, "UTF-8")).alias("text"),
        F.when(kind == "binary", raw).alias("bytes"),
    )


def split_supported(records: DataFrame):
    """(supported, rejected) by MIME class."""
    marked = records.withColumn("kind", u.mime_class(F.col("mimetype")))
    return marked.filter(F.col("kind") != "unsupported"), marked.filter(F.col("kind") == "unsupported")


def mail_records(mail: DataFrame) -> DataFrame:
    """(sender, subject, sent_at, body, attachments[filename, content]) as records.

    The body and each attachment become one record, from a single pass.
    """
    body = F.struct(
        F.lit(-1).alias("part"),
        F.lit("text/plain").alias("mimetype"),
        F.col("subject").alias("title"),
        F.col("body").alias("content"),
    )
    files = F.transform(
        F.coalesce("attachments", F.array().cast("array<struct<filename:string,content:string>>")),
        lambda a, i: F.struct(
            i.alias("part"),
            u.mime_of_file(a["filename"]).alias("mimetype"),
            F.concat(F.col("subject"), F.lit(" - "), a["filename"]).alias("title"),
            a["content"].alias("content"),
        ),
    )
    keep = [c for c in mail.columns if c not in ("subject", "body", "attachments")]
    return mail.select(*keep, F.inline(F.concat(F.array(body), files))).withColumn(
        "content_hash", tx.content_hash(F.col("content"))
    )


def upload_records(files: DataFrame) -> DataFrame:
    """(filename, source, url, content) as records; content hashed, MIME by name."""
    return files.select(
        "*",
        u.mime_of_file(F.col("filename")).alias("mimetype"),
        F.col("filename").alias("title"),
        tx.content_hash(F.col("content")).alias("content_hash"),
    )


def unseen(records: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """Records whose content is not known yet, each content once.

    The first copy is chosen by an aggregate on narrow keys; a content that
    makes up much of the batch is combined before the shuffle.
    """
    fresh = records.join(known_hashes.select("content_hash").distinct(), "content_hash", "left_anti")
    first = fresh.groupBy("content_hash").agg(F.min("record_id").alias("record_id"))
    return fresh.join(first.select("record_id"), "record_id", "left_semi")


def binary_files(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """Office and PDF files as rows of bytes with MIME type and route."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return _routed(raw.select("path", "length", "content"))


def _routed(files: DataFrame) -> DataFrame:
    mime = u.mime_of_file(F.col("path"))
    return files.select("*", mime.alias("mimetype"), u.mime_class(mime).alias("kind"))


def file_hashes(spark: SparkSession, path: str, glob: str = "*", whole: int = WHOLE_FILE) -> DataFrame:
    """Files with MIME type, route and SHA-256; those above ``whole`` bytes are read block by block.

    The driver holds paths and hashes of those large files, no bytes. Large
    files with the ending of a compression codec are read whole.
    """
    def hashed(df):
        return df.select("path", "length", F.sha2("content", 256).alias("content_hash"))

    files = binary_files(spark, path, glob)
    large = [tuple(r) for r in files.filter(F.col("length") > whole).select("path", "length").collect()]
    split = [f for f in large if digests.can_split(spark, f[0])]
    rest = [digests.literal(p) for p, _ in set(large) - set(split)]
    out = hashed(files.filter(F.col("length") <= whole))
    if rest:
        out = out.unionByName(hashed(binary_files(spark, rest)))
    if split:
        out = out.unionByName(
            spark.createDataFrame(digests.block_hashes(spark, split), "path string, length long, content_hash string"))
    return _routed(out)


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Sitemap URLs named in robots.txt bodies (url, body)."""
    lines = F.transform(F.split("body", "\n"), tx.strip)
    named = F.filter(lines, lambda x: F.lower(x).startswith("sitemap:"))
    found = F.transform(named, lambda x: tx.strip(F.regexp_replace(x, r"\A[^:]*:", "")))
    return robots.select("url", F.explode(found).alias("sitemap_url")).filter(F.col("sitemap_url") != "")


def _locations(body: Column, element: str) -> Column:
    found = F.regexp_extract_all(
        body, F.lit(rf"(?s)<{element}(?:\s[^>]*)?>.*?<loc(?:\s[^>]*)?>(.*?)</loc\s*>.*?</{element}\s*>"), F.lit(1)
    )
    return F.filter(F.transform(found, lambda x: tx.unescape(x)), lambda x: x != "")


def sitemap_urls(sitemaps: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, page_url) reached from the root sitemaps through index files.

    ``sitemaps`` holds (url, body), ``roots`` (url). Each round follows one
    level of indexes; (root, sitemap) pairs seen before are not followed again,
    so a loop of indexes ends, and chains are followed to their end.
    """
    bodies = sitemaps.select(
        "url", _locations(F.col("body"), "url").alias("pages"), _locations(F.col("body"), "sitemap").alias("children")
    )
    bodies = materialize(bodies)
    frontier = roots.select(F.col("url").alias("root"), "url").distinct()
    seen = frontier
    while True:
        children = (
            frontier.join(bodies.select("url", "children"), "url")
            .select("root", F.explode("children").alias("url")).distinct()
        )
        frontier = materialize(children.join(seen, ["root", "url"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = materialize(seen.unionByName(frontier))
    return (
        seen.join(bodies.select("url", "pages"), "url")
        .select("root", F.explode("pages").alias("page_url")).distinct()
    )
