"""Queries over stored pages: records, links, cleaning, link graph, intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as h
from ..functions import text as tx
from ..functions import urls as u
from ..operators import cleaning, linkgraph
from ..session import scratch_path
from ..sources import records, tables
from . import testbed as tb
from .registry import query
from .testbed import sql

# DuckDB text of page URLs after normalisation
_NORM = r"""regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '(/[^/.]+)$', '\1/') ||
            CASE WHEN contains(url, '?') THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END"""
_UNESC = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@query("flagship_host_links", r"""
    SELECT host, count(DISTINCT page_id) AS pages, count(*) AS links, count(DISTINCT link) AS targets FROM (
      SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, link FROM (""" + sql("SELECT * FROM edges", "edges") + r""") e) x
    GROUP BY host""")
def host_links(spark, sf):
    p = tb.pages(spark, sf)
    e = p.select("page_id", "url", F.explode(h.hrefs(F.col("html"))).alias("href")).select(
        "page_id", u.host(F.col("url")).alias("host"), u.absolute(F.col("url"), F.col("href")).alias("link"))
    return e.filter(u.in_scope(F.col("link"))).groupBy("host").agg(
        F.count_distinct("page_id").alias("pages"), F.count(F.lit(1)).alias("links"),
        F.count_distinct("link").alias("targets"))


@query("s1_page_records", f"""
    SELECT page_id, {_NORM} AS url, 200 AS status_code, 'text/html' AS mimetype,
           regexp_extract(url, '^https?://([^/?#]*)', 1) AS source, sha256(html) AS content_hash,
           {_UNESC.format("trim(regexp_extract(html, '<title>([^<]*)</title>', 1))")} AS title, length(html) AS n FROM pages""")
def page_records(spark, sf):
    r = records.page_records(tb.pages(spark, sf), tb.now())
    return r.select("page_id", "url", "status_code", "mimetype", "source", "content_hash", "title",
                    F.length("content").cast("bigint").alias("n"))


@query("p1_crawl_scope", r"""
    SELECT page_id, url FROM pages
    WHERE regexp_matches(url, '^https?://') AND (regexp_matches(regexp_replace(url, '#.*', ''), '/(en|fr)/') OR
          regexp_matches(regexp_replace(url, '#.*', ''), 'example\.org')) AND NOT regexp_matches(regexp_replace(url, '#.*', ''), '[?]page=|top')""")
def crawl_scope(spark, sf):
    return tb.pages(spark, sf).filter(
        u.in_scope(F.col("url"), [r"/(en|fr)/", r"example\.org"], ["[?]page=", "top"])).select("page_id", "url")


@query("p1_scope_by_policy_columns", r"""
    SELECT page_id FROM pages WHERE regexp_matches(regexp_replace(url, '#.*', ''), regexp_extract(url, '/([a-z]{2})/', 1) || '/[0-9]')
      AND NOT regexp_matches(regexp_replace(url, '#.*', ''), 'utm_')""")
def scope_by_policy_columns(spark, sf):
    own = F.array(F.concat(F.regexp_extract("url", "/([a-z]{2})/", 1), F.lit("/[0-9]")))
    return tb.pages(spark, sf).filter(u.in_scope_of(F.col("url"), own, F.array(F.lit("utm_")))).select("page_id")


@query("p2_task_pattern", r"""
    SELECT page_id, regexp_matches(url, '^(?:https://(blog|m)\.)') AS anchored, true AS any_url, true AS broken FROM pages""")
def task_pattern(spark, sf):
    c = F.col("url")
    return tb.pages(spark, sf).select(
        "page_id", u.matches_task(c, r"https://(blog|m)\.").alias("anchored"),
        u.matches_task(c, "*").alias("any_url"), u.matches_task(c, "(").alias("broken"))


@query("p3_normalized_urls", f"SELECT page_id, {_NORM} AS url FROM pages")
def normalized_urls(spark, sf):
    return tb.pages(spark, sf).select("page_id", u.normalize(F.col("url")).alias("url"))


@query("p4_resolved_links", sql("SELECT page_id, pos, link FROM edges", "edges"))
def resolved_links(spark, sf):
    p = tb.pages(spark, sf).select("page_id", "url", F.posexplode(h.hrefs(F.col("html"))).alias("pos", "href"))
    return p.select("page_id", F.col("pos").cast("bigint").alias("pos"),
                    u.absolute(F.col("url"), F.col("href")).alias("link"))


@query("p7_titles", rf"""
    SELECT page_id, {_UNESC.format("trim(regexp_extract(html, '<title>([^<]*)</title>', 1))")} AS title,
           replace(replace(regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1), '.html', ''), '.pdf', '') AS url_title
    FROM pages""")
def titles(spark, sf):
    return tb.pages(spark, sf).select(
        "page_id", u.cap_title(h.title(F.col("html"))).alias("title"), u.title_from_url(F.col("url")).alias("url_title"))


@query("p16_domain_scope", r"""
    WITH x AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages)
    SELECT page_id, CASE WHEN host = regexp_replace(host, '^(www|m|blog)[.]', '') THEN 'same' ELSE 'subdomain' END AS relation,
           host = regexp_replace(host, '^(www|m|blog)[.]', '') OR host LIKE 'm.%' AS allowed FROM x""")
def domain_scope(spark, sf):
    c = F.col("url")
    site = F.regexp_replace(u.host(c), "^(www|m|blog)[.]", "")
    ok = linkgraph.in_domain(c, site, F.lit("text/html; charset=utf-8"), u.host(c).startswith("m."),
                             F.lit(False), F.array(F.lit("text/html")))
    return tb.pages(spark, sf).select("page_id", u.host_relation(c, site).alias("relation"), ok.alias("allowed"))


_BARE = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '(?s)<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"""


@query("f7_page_text", rf"""
    WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_BARE}, '(?s)<nav.*?</nav>', '', 'g'), '(?s)<footer.*?</footer>', '', 'g'), '<[^>]*>', chr(10), 'g') AS t FROM pages),
    b AS (SELECT page_id, list_filter(list_transform(string_split({_UNESC.format('t')}, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM a)
    SELECT page_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: i = 1 OR l[i] <> l[i - 1]), lambda i: l[i]), chr(10)) AS text FROM b""")
def page_text(spark, sf):
    return tb.pages(spark, sf).select("page_id", h.page_text(F.col("html")).alias("text"))


@query("f8_main_region", r"""
    SELECT page_id, '<article id="main">' || regexp_extract(html, '(?s)<article>(.*?</article>)', 1) AS region FROM pages""")
def main_region(spark, sf):
    tagged = F.replace("html", F.lit("<article>"), F.lit('<article id="main"><p id="drop">x<p id="k">y</p></p>'))
    return tb.pages(spark, sf).select("page_id", h.main_region(tagged, ("main",), ("drop",)).alias("region"))


@query("f9_page_markdown", rf"""
    WITH a AS (SELECT page_id, regexp_replace(regexp_replace({_BARE}, '(?s)<head>.*?</head>|<![^>]*>', '', 'g'), '\s+', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(>\s*\d+)\.(\s)', '\1\\.\2', 'g'), '(>\s*)([-+])(\s)', '\1\\\2\3', 'g') AS t FROM a),
    c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(t, '<li>', chr(10) || '* '), '<h1>\s*', chr(10) || '# ', 'g'),
            '</?b>', '**', 'g'), '(?s)<a href="([^"]*)">(.*?)</a>', '[\2](\1)', 'g') AS t FROM b),
    d AS (SELECT page_id, regexp_replace(regexp_replace(t, '</?(p|br|div|article|footer|nav|ul|html|body|h1|li)( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM c)
    SELECT page_id, array_to_string(list_filter(list_transform(string_split({_UNESC.format('t')}, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS markdown FROM d""")
def page_markdown(spark, sf):
    return tb.pages(spark, sf).select("page_id", h.page_markdown(F.col("html")).alias("markdown"))


@query("f10_clean_records", rf"""
    SELECT page_id, 'markdown' AS strategy, true AS same FROM pages
    UNION ALL SELECT -1 - doc_id, CASE lang WHEN 'fr' THEN 'plain' WHEN 'de' THEN 'unchanged' ELSE 'unchanged' END, true FROM documents""")
def clean_records(spark, sf):
    p = tb.pages(spark, sf).select(
        "page_id", "url", F.lit("text/html").alias("mimetype"), F.col("html").alias("content"),
        h.page_markdown(F.col("html")).alias("expected"))
    d = tb.text_table(spark, sf, "documents").select(
        (-1 - F.col("doc_id")).alias("page_id"), F.lit("https://d.example/").alias("url"),
        F.when(F.col("lang") == "fr", "text/plain").otherwise("text/markdown").alias("mimetype"),
        F.col("text").alias("content"),
        F.when(F.col("lang") == "fr", tx.clean_plain(F.col("text"))).otherwise(F.col("text")).alias("expected"))
    out = cleaning.clean(p.unionByName(d))
    return out.select("page_id", "strategy", (F.col("clean_content") == F.col("expected")).alias("same"))


@query("f11_page_metadata", rf"""
    SELECT page_id, 'title' AS kind, {_UNESC.format("trim(regexp_extract(html, '<title>([^<]*)</title>', 1))")} AS value FROM pages
    UNION ALL SELECT page_id, 'h1', {_UNESC.format("trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1))")} FROM pages
    UNION ALL SELECT page_id, 'meta_description', 'd ' || page_id FROM pages
    UNION ALL SELECT page_id, 'og_type', 'article' FROM pages
    UNION ALL SELECT page_id, 'image', 'i' || page_id || '.png alt' FROM pages""")
def page_metadata(spark, sf):
    head = F.concat(F.lit('<head><meta content="d '), "page_id", F.lit('" name=description><meta property="og:type" content="article">'))
    body = F.replace(F.replace("html", F.lit("<head>"), head), F.lit("<article>"),
                     F.concat(F.lit("<article><img alt='alt' src=\"i"), "page_id", F.lit('.png">')))
    p = tb.pages(spark, sf).select("page_id", body.alias("body"))
    meta = p.select("page_id", F.explode(h.metadata(F.col("body"))).alias("kind", "value"))
    heads = p.select("page_id", F.inline(h.headings(F.col("body")))).select(
        "page_id", F.concat(F.lit("h"), "level").alias("kind"), F.col("text").alias("value"))
    imgs = p.select("page_id", F.inline(h.images(F.col("body")))).select(
        "page_id", F.lit("image").alias("kind"), F.concat_ws(" ", "src", "alt").alias("value"))
    return meta.unionByName(heads).unionByName(imgs)


@query("g1_edge_table", sql(f"SELECT {_NORM} AS src_url, pos, link AS dst_url FROM edges", "edges"))
def edge_table(spark, sf):
    return linkgraph.page_edges(tb.pages(spark, sf)).select("src_url", F.col("pos").cast("bigint").alias("pos"), "dst_url")


_SUPP_SEEDS = "SELECT 'https://trade.example/supplier/' || s_suppkey AS url FROM supplier WHERE s_nationkey = 0"


def _supplier_seeds(spark, sf):
    return tb.table(spark, sf, "supplier").filter("s_nationkey = 0").select(
        F.concat(F.lit("https://trade.example/supplier/"), F.col("s_suppkey")).alias("url"))


@query("g2_crawl_plan", sql(f"""
    WITH RECURSIVE walk AS (
      SELECT url, 0 AS depth FROM ({_SUPP_SEEDS}) s
      UNION
      SELECT l.dst_url, w.depth + 1 FROM walk w JOIN links l ON l.src_url = w.url
      WHERE w.depth < 3 AND NOT regexp_matches(l.dst_url, 'part/1[0-9]*7$'))
    SELECT url, min(depth) AS depth FROM walk GROUP BY url""", "links"))
def crawl_plan(spark, sf):
    return linkgraph.crawl_plan(tb.trade_links(spark, sf), _supplier_seeds(spark, sf), 3,
                                include=["trade[.]example"], exclude=["part/1[0-9]*7$"])


@query("g2_page_crawl_plan", sql(f"""
    SELECT url, min(depth) AS depth FROM (
      SELECT {_NORM} AS url, 0 AS depth FROM pages UNION ALL SELECT link, 1 FROM edges) x GROUP BY url""", "edges"))
def page_crawl_plan(spark, sf):
    p = tb.pages(spark, sf)
    return linkgraph.crawl_plan(linkgraph.page_edges(p), p.select(u.normalize(F.col("url")).alias("url")), 2)


@query("g2_capped_crawl_plan", sql(f"""
    WITH RECURSIVE walk AS (
      SELECT url, 0 AS depth FROM ({_SUPP_SEEDS}) s
      UNION
      SELECT l.dst_url, w.depth + 1 FROM walk w JOIN links l ON l.src_url = w.url
      WHERE w.depth < 2)
    SELECT url, depth FROM (SELECT url, min(depth) AS depth FROM walk GROUP BY url) x
    ORDER BY depth, url LIMIT 100""", "links"))
def capped_crawl_plan(spark, sf):
    return linkgraph.crawl_plan(tb.trade_links(spark, sf), _supplier_seeds(spark, sf), 2, max_urls=100)


@query("g3_visit_cap", sql("""
    WITH t AS (SELECT event_id AS task_no, 'https://site.example/' || (user_id * 31 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 7) AS url,
                      CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS INTEGER) AS depth FROM events),
    v AS (SELECT DISTINCT 'https://site.example/' || (user_id * 31) AS url FROM events WHERE event_type = 'purchase'),
    f AS (SELECT url, min(task_no) AS first_no, min(depth) AS depth FROM t WHERE url NOT IN (SELECT url FROM v) GROUP BY url),
    r AS (SELECT url FROM f ORDER BY depth, url LIMIT (SELECT greatest(0, 200 - count(*)) FROM v))
    SELECT t.task_no, t.url, CASE WHEN f.url IS NULL OR f.first_no <> t.task_no THEN 'already_crawled'
           WHEN r.url IS NULL THEN 'limit_reached' END AS reason
    FROM t LEFT JOIN f ON f.url = t.url LEFT JOIN r ON r.url = t.url"""))
def visit_cap(spark, sf):
    e = tb.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint") % 7
    t = e.select(F.col("event_id").alias("task_no"),
                 F.concat(F.lit("https://site.example/"), F.col("user_id") * 31 + k).alias("url"),
                 F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2).alias("depth"))
    v = e.filter("event_type = 'purchase'").select(F.concat(F.lit("https://site.example/"), F.col("user_id") * 31).alias("url"))
    return linkgraph.visit_cap(t, v, 200).select("task_no", "url", "reason")


@query("g4_update_plan", sql("SELECT DISTINCT url, 0 AS depth FROM hist", "hist"))
def update_plan(spark, sf):
    return linkgraph.update_plan(tb.history(spark, sf))


@query("g5_policy_tasks", sql("""
    SELECT policy_id, site_id, 0 AS start_no, 'https://' || seg || '.example/' || policy_id AS start_url,
           CAST(c_nationkey * 10 + 100 AS INTEGER) AS max_urls, CAST(c_nationkey % 5 + 1 AS INTEGER) AS max_depth,
           '^https://(www[.])?' || seg || '[.]example/' AS url_patterns FROM policies WHERE enabled
    UNION ALL SELECT policy_id, site_id, 1, 'https://www.' || seg || '.example/', CAST(c_nationkey * 10 + 100 AS INTEGER),
           CAST(c_nationkey % 5 + 1 AS INTEGER), '^https://(www[.])?' || seg || '[.]example/' FROM policies WHERE enabled""", "policies"))
def policy_tasks(spark, sf):
    t = linkgraph.policy_tasks(tb.crawl_policies(spark, sf))
    return t.select("policy_id", "site_id", "start_no", "start_url", "max_urls", "max_depth",
                    F.array_join("url_patterns", " ").alias("url_patterns"))


@query("j1_undiscovered_links", sql(f"""
    SELECT DISTINCT link AS url FROM edges WHERE link NOT IN (SELECT {_NORM} FROM pages)
      AND link NOT IN (SELECT min(link) FROM edges GROUP BY {_NORM})""", "edges"))
def undiscovered_links(spark, sf):
    p = tb.pages(spark, sf)
    e = linkgraph.page_edges(p)
    fetched = p.select(u.normalize(F.col("url")).alias("url"))
    queued = e.groupBy("src_url").agg(F.min("dst_url").alias("url")).select("url")
    return linkgraph.undiscovered(e.select(F.col("dst_url").alias("url")), fetched.unionByName(queued))


@query("u3_discovered_minus_visited", sql("""
    SELECT DISTINCT src_url AS url FROM links EXCEPT SELECT dst_url FROM links WHERE dst_url LIKE '%/part/1%'""", "links"))
def discovered_minus_visited(spark, sf):
    links = tb.trade_links(spark, sf)
    seen = links.filter(F.col("dst_url").contains("/part/1")).select(F.col("dst_url").alias("url"))
    return linkgraph.undiscovered(links.select(F.col("src_url").alias("url")), seen)


@query("j13_known_documents", sql(f"""
    WITH first_link AS (SELECT {_NORM} AS page, min(link) AS link FROM edges GROUP BY 1),
    hashes AS (SELECT {_NORM} AS page, min(sha256(html)) AS content_hash FROM pages GROUP BY 1)
    SELECT DISTINCT e.link AS url, h.content_hash FROM edges e LEFT JOIN first_link f ON f.link = e.link
    LEFT JOIN hashes h ON h.page = f.page""", "edges"))
def known_documents(spark, sf):
    p = tb.pages(spark, sf)
    e = linkgraph.page_edges(p)
    hashes = p.groupBy(u.normalize(F.col("url")).alias("src_url")).agg(F.min(F.sha2("html", 256)).alias("content_hash"))
    docs = (e.groupBy("src_url").agg(F.min("dst_url").alias("url")).join(hashes, "src_url")
            .select("url", F.col("src_url").alias("document_id"), "content_hash"))
    return linkgraph.known_documents(e.select(F.col("dst_url").alias("url")).distinct(), docs).select("url", "content_hash").distinct()


@query("u6_seed_union", sql(f"""
    SELECT url, min(depth) AS depth FROM (
      SELECT {_NORM} AS url, 0 AS depth FROM pages
      UNION ALL SELECT regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/sitemap/', 0 FROM pages
      UNION ALL SELECT link, 1 FROM edges) x GROUP BY url""", "edges"))
def seed_union(spark, sf):
    p = tb.pages(spark, sf)
    base = p.select(u.normalize(F.col("url")).alias("url"), F.lit(0).alias("depth"))
    site = p.select(u.absolute(F.col("url"), F.lit("/sitemap")).alias("url"), F.lit(0).alias("depth"))
    links = linkgraph.page_edges(p).select(F.col("dst_url").alias("url"), F.lit(1).alias("depth"))
    return linkgraph.seed_union(base, site, links)


@query("s3_sitemap_urls", sql("""
    SELECT DISTINCT 'https://maps.example/index-' || (page_id % 10) || '.xml' AS root,
           'https://s.example' || href AS page_url FROM hrefs""", "hrefs"))
def sitemap_urls(spark, sf):
    """Ten index files name one child index per page; that names a urlset with the page's links."""
    p = tb.pages(spark, sf)
    name = lambda kind, n: F.concat(F.lit(f"https://maps.example/{kind}-"), n, F.lit(".xml"))
    entry = lambda loc: F.concat(F.lit("\n<sitemap>\n <loc>"), loc, F.lit("</loc><lastmod>x</lastmod></sitemap>"))
    locs = F.transform(h.hrefs(F.col("html")), lambda x: F.concat(F.lit("<url><loc>https://s.example"), x, F.lit("</loc></url>")))
    n = F.col("page_id").cast("string")
    leaf = p.select(name("urls", n).alias("url"), F.concat(
        F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(locs, "\n"), F.lit("</urlset>")).alias("body"))
    # a child index also points back to its root: the loop must end
    root = name("index", (F.col("page_id") % 10).cast("string"))
    child = p.select(name("child", n).alias("url"), F.concat(
        F.lit("<sitemapindex>"), entry(name("urls", n)), entry(root), F.lit("</sitemapindex>")).alias("body"))
    index = p.select(root.alias("url"), F.concat(F.lit("<sitemapindex>"), entry(name("child", n)), F.lit("</sitemapindex>")).alias("body"))
    maps = leaf.unionByName(child).unionByName(index)
    return records.sitemap_urls(maps, index.select("url"))


@query("s4_robots_sitemaps", r"""
    SELECT page_id, 'https://h.example/s' || page_id || '.xml' AS sitemap_url FROM pages
    UNION ALL SELECT page_id, 'https://h.example/t.xml' FROM pages""")
def robots_sitemaps(spark, sf):
    body = F.concat(F.lit("User-agent: *\nDisallow: /sitemap: no\nSitemap: https://h.example/s"), F.col("page_id"),
                    F.lit(".xml \r\n  SITEMAP:https://h.example/t.xml\n# sitemap: x\nsitemap:\n"), F.lit("end"))
    p = tb.pages(spark, sf).select(F.col("page_id").alias("url"), body.alias("body"))
    return records.robots_sitemaps(p).select(F.col("url").alias("page_id"), "sitemap_url")


@query("s5_json_lines", """
    SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || ',"none":null}' AS line FROM events""")
def json_lines(spark, sf):
    e = tb.table(spark, sf, "events").select(
        "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), F.lit(None).cast("string").alias("none"))
    path = scratch_path(spark, "export")
    tables.export_json(e, path)
    return spark.read.text(path).select(
        F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), F.col("value").alias("line"))


@query("s9_mail_and_uploads", """
    WITH mail AS (SELECT conv_id, turn, 'subject ' || conv_id AS subject, text FROM conversations),
    parts AS (
      SELECT conv_id, turn, -1 AS part, 'text/plain' AS mimetype, subject AS title, text AS content FROM mail
      UNION ALL SELECT conv_id, turn, 0, 'text/csv', subject || ' - t' || turn || '.csv', 'csv ' || text FROM mail
      UNION ALL SELECT conv_id, turn, 1, 'application/octet-stream', subject || ' - blob', 'same' FROM mail),
    keyed AS (SELECT conv_id * 1000000 + turn * 10 + part AS record_id, *, CASE WHEN content = '' THEN '' ELSE sha256(content) END AS content_hash FROM parts)
    SELECT record_id, mimetype, title, content_hash FROM keyed
    WHERE content_hash NOT IN (SELECT sha256(text) FROM conversations WHERE role = 'system')
    QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY record_id) = 1""")
def mail_and_uploads(spark, sf):
    m = tb.messages(spark, sf).select(
        "conv_id", "turn", F.concat(F.lit("subject "), "conv_id").alias("subject"), F.col("text").alias("body"),
        F.array(
            F.struct(F.concat(F.lit("t"), "turn", F.lit(".csv")).alias("filename"), F.concat(F.lit("csv "), "text").alias("content")),
            F.struct(F.lit("blob").alias("filename"), F.lit("same").alias("content")),
        ).alias("attachments"))
    r = records.mail_records(m).withColumn("record_id", F.col("conv_id") * 1000000 + F.col("turn") * 10 + F.col("part"))
    known = tb.messages(spark, sf).filter("role = 'system'").select(F.sha2("text", 256).alias("content_hash"))
    return records.unseen(r, known).select("record_id", "mimetype", "title", "content_hash")


@query("s10_binary_files")
def binary_files(spark, sf):
    """The parquet files themselves as binary rows, whole; those above 64 MB block by block."""
    b = records.file_hashes(spark, sf, "*.parquet")
    return b.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("file"), "length", "mimetype", "kind", "content_hash")


@query("x9_page_links_function", sql("SELECT page_id, pos, href FROM hrefs", "hrefs"))
def page_links_function(spark, sf):
    from .. import hooks

    hooks.register_page_links(spark)
    tb.pages(spark, sf).createOrReplaceTempView("stored_pages")
    return spark.sql("SELECT p.page_id, CAST(l.pos AS BIGINT) AS pos, l.href FROM stored_pages p, LATERAL page_links(p.html) l")
