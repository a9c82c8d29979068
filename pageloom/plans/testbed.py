"""The engine's tables, derived from the given test tables.

Every mapping covers a whole table. ``SQL`` holds the same mappings as common
table expressions for DuckDB; they are written on their own, not generated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as u
from ..session import spread

NOW = "2024-02-01 00:00:00"
BASE_SECONDS = 1_700_000_000


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table of long texts, spread over all cores when it is small."""
    return spread(table(spark, sf_dir, name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its times without zone are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def now():
    return F.lit(NOW).cast("timestamp")


def _by_lang(en, fr, de, other):
    return (
        F.when(F.col("lang") == "en", en).when(F.col("lang") == "fr", fr)
        .when(F.col("lang") == "de", de).otherwise(other)
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as stored documents; MIME type and description by language."""
    return text_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id")).alias("url"),
        F.col("text").alias("content"),
        tx.content_hash(F.col("text")).alias("content_hash"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("text in "), "lang").alias("description"),
        F.lit(None).cast("string").alias("keywords"),
        "source",
        _by_lang("text/html", "text/plain", "application/pdf", "text/markdown").alias("mimetype"),
        F.lit(200).alias("status_code"),
        tx.tidy_lines(F.col("text")).alias("clean_content"),
        F.array().cast("array<string>").alias("links"),
        F.lit(1).alias("version"),
        F.lit("new").alias("index_operation"),
        F.timestamp_seconds(F.lit(BASE_SECONDS) + F.col("doc_id")).alias("created_at"),
        F.timestamp_seconds(F.lit(BASE_SECONDS) + F.col("doc_id") + F.col("n_chars")).alias("updated_at"),
        "lang", "n_chars",
    )


def indexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with is_indexed: those that carry a label."""
    done = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("document_id"), F.lit(True).alias("_labelled")
    )
    return (
        documents(spark, sf_dir).join(done, "document_id", "left")
        .withColumn("is_indexed", F.coalesce("_labelled", F.lit(False)))
        .drop("_labelled")
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is in the site of its source and, an hour later, of its language."""
    docs = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(BASE_SECONDS) + F.col("doc_id"))
    later = F.timestamp_seconds(F.lit(BASE_SECONDS + 3600) + F.col("doc_id"))
    return docs.select(
        F.inline(
            F.array(
                F.struct(F.col("source").alias("site_id"), F.col("doc_id").alias("document_id"), at.alias("created_at")),
                F.struct(F.col("lang").alias("site_id"), F.col("doc_id").alias("document_id"), later.alias("created_at")),
            )
        )
    )


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was stored before: labelled documents, low-quality ones as an older text."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("document_id"), "quality", "toxic"
    )
    docs = documents(spark, sf_dir).join(labels, "document_id")
    older = F.when(F.col("quality") == 0, F.concat("content", F.lit("\nolder"))).otherwise(F.col("content"))
    return docs.withColumn("content", older).withColumns(
        {"content_hash": tx.content_hash(F.col("content")), "is_indexed": F.col("quality") == 1}
    )


def store_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents are in the site of their source; toxic ones in ``held``."""
    return store(spark, sf_dir).select(
        F.when(F.col("toxic") == 1, F.lit("held")).otherwise(F.col("source")).alias("site_id"),
        "document_id", "created_at",
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as they are now, as crawl records for the site of their source."""
    return documents(spark, sf_dir).select(
        "url", "content", "content_hash", "clean_content", "mimetype", "title", "description",
        "source", F.col("source").alias("site_id"), F.col("document_id").alias("doc_no"),
        now().alias("ts"),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_task_events(table(spark, sf_dir, "events"))


def as_task_events(events: DataFrame) -> DataFrame:
    event = (
        F.when(F.col("event_type") == "signup", "enqueue")
        .when(F.col("event_type") == "view", "dequeue")
        .when(F.col("event_type") == "purchase", "complete")
        .when(F.col("event_type") == "error", "fail")
        .otherwise("retry")
    )
    return events.select(
        F.concat(F.lit("q"), F.pmod("user_id", F.lit(4))).alias("queue"),
        F.col("user_id").cast("string").alias("task_id"),
        event.alias("event"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("processing_time"),
    )


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        F.concat(F.lit("query "), "user_id").alias("query"),
        F.lit("semantic").alias("search_type"),
        F.concat(F.lit("site"), F.pmod("user_id", F.lit(10))).alias("site_id"),
        k.alias("results_count"),
        F.col("value").alias("execution_time_ms"),
        F.col("ts").alias("created_at"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings: the user stands for the URL, the type for the content."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://site.example/"), "user_id").alias("url"),
        F.col("event_type").alias("content_hash"),
        F.col("user_id").alias("document_id"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("seq"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "conversations")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "nation")
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("site_"), F.col("n_nationkey")).alias("site_id"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("description"),
            F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example")).alias("base_url"),
            (F.col("r_name") != "ASIA").alias("enabled"),
        )
    )


def crawl_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as crawl policies of the site of their nation."""
    c = table(spark, sf_dir, "customer")
    seg = F.lower("c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("policy_id"),
        F.concat(F.lit("site_"), F.col("c_nationkey")).alias("site_id"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") >= 0).alias("enabled"),
        F.array(
            F.concat(F.lit("https://"), seg, F.lit(".example/"), F.col("c_custkey")),
            F.concat(F.lit("https://www."), seg, F.lit(".example/")),
        ).alias("start_urls"),
        F.array(F.concat(F.lit("^https://(www[.])?"), seg, F.lit("[.]example/"))).alias("url_patterns"),
        F.array(F.lit("/private/")).alias("exclude_patterns"),
        (F.col("c_nationkey") * 10 + 100).cast("int").alias("max_urls"),
        (F.pmod("c_nationkey", F.lit(5)) + 1).cast("int").alias("max_depth"),
        F.when(F.col("c_acctbal") > 8000, F.lit(None).cast("timestamp"))
        .otherwise(F.lit("2000-06-01").cast("timestamp")).alias("last_executed"),
    )


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as schedules of the policy of their customer."""
    day = F.col("o_orderdate").cast("timestamp")
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "once")
        .when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "interval")
        .otherwise("cron")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("schedule_id"),
        F.col("o_custkey").alias("policy_id"),
        F.concat(F.lit("schedule "), F.col("o_orderkey")).alias("name"),
        kind.alias("schedule_type"),
        (F.col("o_orderstatus") != "F").alias("enabled"),
        F.when(kind == "interval", F.floor("o_totalprice")).cast("bigint").alias("interval_seconds"),
        F.when(kind == "once", day).alias("one_time_date"),
        F.when(kind == "cron", day + F.make_dt_interval(days=F.lit(30))).alias("next_run"),
        F.when(F.col("o_orderstatus") == "P", day).alias("last_run"),
        F.when(kind == "interval", day).alias("start_date"),
        F.lit(None).cast("timestamp").alias("end_date"),
        F.pmod("o_orderkey", F.lit(7)).cast("int").alias("run_count"),
        F.when(kind == "cron", F.lit(5)).cast("int").alias("max_runs"),
    )


def refresh_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One refresh policy per site, from the suppliers of its nation."""
    return (
        table(spark, sf_dir, "supplier")
        .groupBy("s_nationkey")
        .agg(
            F.min("s_suppkey").alias("refresh_id"),
            F.count(F.lit(1)).cast("int").alias("refresh_interval_days"),
            F.max("s_acctbal").alias("top"),
        )
        .select(
            "refresh_id",
            F.concat(F.lit("site_"), F.col("s_nationkey")).alias("site_id"),
            F.concat(F.lit("refresh "), F.col("refresh_id")).alias("name"),
            (F.col("top") > 0).alias("enabled"),
            "refresh_interval_days",
            F.when(F.col("top") < 9000, F.lit("2000-05-01").cast("timestamp")).alias("last_refresh"),
            F.when(F.pmod("refresh_id", F.lit(2)) == 0, F.lit("selective")).alias("strategy"),
        )
        .withColumn(
            "next_refresh",
            F.col("last_refresh") + F.make_dt_interval(days=F.col("refresh_interval_days")),
        )
    )


POLICY_NOW = "2000-07-01 00:00:00"


def policy_now():
    return F.lit(POLICY_NOW).cast("timestamp")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "pages")


def trade_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as pages that link to each other."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part = F.concat(F.lit("https://trade.example/part/"), F.col("l_partkey"))
    supp = F.concat(F.lit("https://trade.example/supplier/"), F.col("l_suppkey"))
    return li.select(
        F.inline(
            F.array(
                F.struct(part.alias("src_url"), supp.alias("dst_url")),
                F.struct(supp.alias("src_url"), part.alias("dst_url")),
            )
        )
    )


def host_of(url):
    return u.host(url)


SQL: dict[str, str] = {
    "docs": """
        docs AS (
          SELECT doc_id AS document_id, 'https://' || source || '.example/' || doc_id AS url,
                 text AS content,
                 CASE WHEN text IS NULL OR text = '' THEN '' ELSE sha256(text) END AS content_hash,
                 split_part(text, chr(10), 1) AS title, 'text in ' || lang AS description, source,
                 CASE lang WHEN 'en' THEN 'text/html' WHEN 'fr' THEN 'text/plain'
                           WHEN 'de' THEN 'application/pdf' ELSE 'text/markdown' END AS mimetype,
                 make_timestamp((1700000000 + doc_id) * 1000000) AS created_at,
                 make_timestamp((1700000000 + doc_id + n_chars) * 1000000) AS updated_at,
                 lang, n_chars,
                 array_to_string(list_filter(list_transform(string_split(text, chr(10)),
                   lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS clean_content
          FROM documents)""",
    "idocs": """
        idocs AS (
          SELECT d.*, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.document_id) AS is_indexed
          FROM docs d)""",
    "members": """
        members AS (
          SELECT source AS site_id, doc_id AS document_id,
                 make_timestamp((1700000000 + doc_id) * 1000000) AS created_at FROM documents
          UNION ALL
          SELECT lang, doc_id, make_timestamp((1700003600 + doc_id) * 1000000) FROM documents)""",
    "store": """
        store AS (
          SELECT d.document_id, d.url, d.title, d.description, d.source, d.mimetype, d.lang,
                 d.clean_content, d.created_at, d.updated_at, l.quality, l.toxic,
                 CASE WHEN l.quality = 0 THEN d.content || chr(10) || 'older' ELSE d.content END AS content,
                 CASE WHEN l.quality = 0 THEN sha256(d.content || chr(10) || 'older')
                      ELSE d.content_hash END AS content_hash,
                 l.quality = 1 AS is_indexed
          FROM docs d JOIN labels l ON l.doc_id = d.document_id)""",
    "smembers": """
        smembers AS (
          SELECT CASE WHEN toxic = 1 THEN 'held' ELSE source END AS site_id, document_id, created_at
          FROM store)""",
    "changes": """
        hash_index AS (
          SELECT content_hash AS h, min_by(document_id, document_id) AS hash_id FROM store
          WHERE content_hash <> '' GROUP BY 1),
        found AS (
          SELECT d.document_id AS doc_no, d.url, d.source AS site_id, d.content_hash,
                 coalesce(s.document_id, x.hash_id) AS document_id,
                 CASE WHEN s.document_id IS NOT NULL THEN s.content_hash
                      WHEN x.hash_id IS NOT NULL THEN d.content_hash END AS prev_content_hash
          FROM docs d LEFT JOIN store s ON s.url = d.url
          LEFT JOIN hash_index x ON s.document_id IS NULL AND x.h = d.content_hash),
        changes AS (
          SELECT f.*, CASE WHEN document_id IS NULL THEN 'new'
                 WHEN NOT EXISTS (SELECT 1 FROM smembers m WHERE m.document_id = f.document_id
                                  AND m.site_id = f.site_id) THEN 'new_site'
                 WHEN content_hash <> '' AND content_hash <> prev_content_hash THEN 'edit'
                 ELSE 'skip' END AS operation
          FROM found f)""",
    "settled": """
        first_copy AS (
          SELECT content_hash AS h, min(url) AS first_url, min_by(site_id, url) AS first_site,
                 min_by(doc_no, url) AS first_id
          FROM changes WHERE operation = 'new' AND content_hash <> '' GROUP BY 1),
        settled AS (
          SELECT c.url, c.site_id, c.content_hash, c.prev_content_hash, c.doc_no,
                 CASE WHEN operation <> 'new' THEN c.document_id
                      WHEN f.h IS NOT NULL THEN f.first_id ELSE c.doc_no END AS document_id,
                 CASE WHEN operation = 'new' AND f.first_url <> c.url THEN
                        CASE WHEN f.first_site = c.site_id THEN 'skip' ELSE 'new_site' END
                      ELSE operation END AS operation
          FROM changes c LEFT JOIN first_copy f ON f.h = c.content_hash AND c.operation = 'new')""",
    "tasks": """
        tasks AS (
          SELECT 'q' || (user_id % 4) AS queue, CAST(user_id AS VARCHAR) AS task_id,
                 CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'dequeue'
                      WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'retry' END AS event,
                 ts, event_id AS seq, value AS processing_time
          FROM events)""",
    "log": """
        log AS (
          SELECT event_id AS log_id, 'query ' || user_id AS query, 'semantic' AS search_type,
                 'site' || (user_id % 10) AS site_id,
                 CAST(json_extract_string(props, '$.k') AS BIGINT) AS results_count,
                 value AS execution_time_ms, ts AS created_at
          FROM events)""",
    "hist": """
        hist AS (
          SELECT 'https://site.example/' || user_id AS url, event_type AS content_hash,
                 user_id AS document_id, ts AS created_at, event_id AS seq FROM events)""",
    "sites": """
        sites AS (
          SELECT 'site_' || n_nationkey AS site_id, n_name AS name, r_name AS description,
                 'https://' || lower(n_name) || '.example' AS base_url, r_name <> 'ASIA' AS enabled
          FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "policies": """
        policies AS (
          SELECT c_custkey AS policy_id, 'site_' || c_nationkey AS site_id, c_name AS name,
                 c_acctbal >= 0 AS enabled, lower(c_mktsegment) AS seg, c_nationkey,
                 CASE WHEN c_acctbal > 8000 THEN NULL ELSE TIMESTAMP '2000-06-01' END AS last_executed
          FROM customer)""",
    "schedules": """
        schedules AS (
          SELECT o_orderkey AS schedule_id, o_custkey AS policy_id, 'schedule ' || o_orderkey AS name,
                 o_orderstatus <> 'F' AS enabled, kind AS schedule_type,
                 CASE WHEN kind = 'interval' THEN CAST(floor(o_totalprice) AS BIGINT) END AS interval_seconds,
                 CASE WHEN kind = 'once' THEN CAST(o_orderdate AS TIMESTAMP) END AS one_time_date,
                 CASE WHEN kind = 'cron' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY END AS next_run,
                 CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS TIMESTAMP) END AS last_run,
                 CASE WHEN kind = 'interval' THEN CAST(o_orderdate AS TIMESTAMP) END AS start_date,
                 CAST(o_orderkey % 7 AS INTEGER) AS run_count,
                 CASE WHEN kind = 'cron' THEN 5 END AS max_runs
          FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'once'
                      WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'interval'
                      ELSE 'cron' END AS kind FROM orders) o)""",
    "refresh": """
        refresh AS (
          SELECT *, last_refresh + to_days(refresh_interval_days) AS next_refresh FROM (
            SELECT min(s_suppkey) AS refresh_id, 'site_' || s_nationkey AS site_id,
                   'refresh ' || min(s_suppkey) AS name, max(s_acctbal) > 0 AS enabled,
                   CAST(count(*) AS INTEGER) AS refresh_interval_days,
                   CASE WHEN max(s_acctbal) < 9000 THEN TIMESTAMP '2000-05-01' END AS last_refresh,
                   CASE WHEN min(s_suppkey) % 2 = 0 THEN 'selective' END AS strategy
            FROM supplier GROUP BY s_nationkey) r)""",
    "links": """
        links AS (
          SELECT DISTINCT 'https://trade.example/part/' || l_partkey AS src_url,
                 'https://trade.example/supplier/' || l_suppkey AS dst_url FROM lineitem
          UNION
          SELECT DISTINCT 'https://trade.example/supplier/' || l_suppkey,
                 'https://trade.example/part/' || l_partkey FROM lineitem)""",
    # page links: absolute, normalised; links in these pages are root-relative
    "hrefs": """
        hrefs AS (
          SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root,
                 unnest(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1),
                                    lambda h: h <> '' AND h NOT LIKE 'javascript:%')) AS href,
                 generate_subscripts(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1),
                                    lambda h: h <> '' AND h NOT LIKE 'javascript:%'), 1) - 1 AS pos
          FROM pages)""",
    "edges": """
        edges AS (
          SELECT page_id, url, CAST(pos AS BIGINT) AS pos,
                 root || p || CASE WHEN regexp_matches(p, '/[^/.]+$') THEN '/' ELSE '' END AS link
          FROM (SELECT page_id, url, pos, root, url_decode(replace(href, '+', '%2B')) AS p FROM hrefs) x)""",
}

_NEEDS = {
    "idocs": ["docs"], "store": ["docs"], "smembers": ["store"], "changes": ["smembers"],
    "settled": ["changes"], "edges": ["hrefs"],
}


def sql(body: str, *ctes: str) -> str:
    """``body`` below the named table expressions and those they need."""
    names: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in names:
            names.append(name)

    for name in ctes:
        need(name)
    joined = ",\n".join(SQL[n].strip() for n in names)
    body = body.strip()
    if not names:
        return body
    if body.startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {joined},{body.removeprefix('WITH RECURSIVE')}"
    if body.startswith("WITH"):
        return f"WITH {joined},{body.removeprefix('WITH')}"
    return f"WITH {joined}\n{body}"
