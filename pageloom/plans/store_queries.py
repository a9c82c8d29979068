"""Queries over the document store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as u
from ..operators import docstore as ds
from ..operators import listing as ls
from ..sources import tables
from . import testbed as tb
from .registry import query
from .testbed import sql


@query("f1_content_hash", """
    SELECT doc_id, CASE WHEN text = '' THEN '' ELSE sha256(text) END AS content_hash FROM documents
    UNION ALL SELECT -1 - page_id, sha256(html) FROM pages""")
def content_hash(spark, sf):
    docs = tb.text_table(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))
    pages = tb.pages(spark, sf).select((-1 - F.col("page_id")).alias("doc_id"), tx.content_hash(F.col("html")).alias("content_hash"))
    return docs.unionByName(pages)


@query("f2_markdown_links", r"""
    SELECT doc_id, CAST(i AS BIGINT) AS pos, target FROM (
      SELECT doc_id, unnest(l) AS target, generate_subscripts(l, 1) - 1 AS i FROM (
        SELECT doc_id, regexp_extract_all(
          '[' || split_part(text, chr(10), 1) || '](' || source || '/' || doc_id || ') ![i](img' || doc_id || '.png)' || chr(10) || text,
          '\[([^\n]*?)\]\(([^\n]*?)\)', 2) AS l FROM documents) a) b""")
def markdown_links(spark, sf):
    md = F.concat(
        F.lit("["), F.substring_index("text", "\n", 1), F.lit("]("), "source", F.lit("/"), F.col("doc_id"),
        F.lit(") ![i](img"), F.col("doc_id"), F.lit(".png)\n"), "text",
    )
    return tb.text_table(spark, sf, "documents").select(
        "doc_id", F.posexplode(tx.markdown_links(md)).alias("pos", "target")
    ).withColumn("pos", F.col("pos").cast("bigint"))


@query("f3_inline_images", r"""
    SELECT doc_id, '![' || lang || '](base64_image)' || chr(10) || '[f](data:image/gif;base64,' || sha256(text) || ')' || chr(10) || text AS text FROM documents""")
def inline_images(spark, sf):
    payload = F.sha2("text", 256)
    md = F.concat(
        F.lit("!["), "lang", F.lit("](data:image/png;base64,"), payload, F.lit(")\n[f](data:image/gif;base64,"),
        payload, F.lit(")\n"), "text",
    )
    return tb.text_table(spark, sf, "documents").select("doc_id", tx.replace_inline_images(md).alias("text"))


@query("f4_clean_markdown", r"""
    SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
      lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) || chr(10) || chr(10) || 'end' AS text
    FROM documents WHERE regexp_matches(text, '\S')
    UNION ALL SELECT doc_id, chr(10) || 'end' FROM documents WHERE NOT regexp_matches(text, '\S')""")
def clean_markdown(spark, sf):
    md = F.concat("text", F.lit("\n\n![i](data:image/jpeg;base64,"), F.sha2("text", 256), F.lit(")\n  end  "))
    return tb.text_table(spark, sf, "documents").select("doc_id", tx.clean_markdown(md).alias("text"))


@query("f5_clean_plain", r"""
    SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
      lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM documents""")
def clean_plain(spark, sf):
    return tb.text_table(spark, sf, "documents").select("doc_id", tx.clean_plain(F.col("text")).alias("text"))


@query("f6_flatten_tables", r"""
    WITH body AS (
      SELECT doc_id, '| k | lang |' || chr(10) || '|---|---|' || chr(10) || '| ' || doc_id || ' | ' || lang || ' |' || chr(10) || text AS t
      FROM documents),
    raw AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw_line,
                   generate_subscripts(string_split(t, chr(10)), 1) AS i FROM body),
    lines AS (SELECT doc_id, i, regexp_replace(raw_line, '^\s+|\s+$', '', 'g') AS line FROM raw),
    flagged AS (SELECT *, regexp_matches(line, '^\|.*\|') AS is_row FROM lines),
    islands AS (SELECT *, is_row AND NOT coalesce(lag(is_row) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM flagged),
    heads AS (SELECT *, max(CASE WHEN starts THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM islands),
    rows_ AS (SELECT a.doc_id, a.i, a.line, a.is_row, a.h, b.line AS head FROM heads a
              LEFT JOIN lines b ON b.doc_id = a.doc_id AND b.i = a.h),
    cells AS (
      SELECT doc_id, i, unnest(list_zip(
               string_split(regexp_replace(head, '^\|+|\|+$', '', 'g'), '|'),
               string_split(regexp_replace(line, '^\|+|\|+$', '', 'g'), '|'))) AS z,
             generate_subscripts(list_zip(
               string_split(regexp_replace(head, '^\|+|\|+$', '', 'g'), '|'),
               string_split(regexp_replace(line, '^\|+|\|+$', '', 'g'), '|')), 1) AS j
      FROM rows_ WHERE is_row AND i > h AND NOT (i = h + 1 AND regexp_matches(line, '^\|[\s\-:]+\|'))),
    out_lines AS (
      SELECT doc_id, i, 0 AS j, line FROM rows_ WHERE NOT is_row
      UNION ALL SELECT doc_id, i, j, trim(z[1]) || ': ' || trim(z[2]) FROM cells
                WHERE z[1] IS NOT NULL AND z[2] IS NOT NULL AND trim(z[2]) <> ''
      UNION ALL SELECT doc_id, i, 1000000, '' FROM rows_ WHERE is_row AND i > h
                AND NOT (i = h + 1 AND regexp_matches(line, '^\|[\s\-:]+\|')))
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i, j) AS text FROM out_lines GROUP BY doc_id""")
def flatten_tables(spark, sf):
    t = F.concat(
        F.lit("| k | lang |\n|---|---|\n| "), F.col("doc_id"), F.lit(" | "), "lang", F.lit(" |\n"), "text"
    )
    return tb.text_table(spark, sf, "documents").select("doc_id", tx.flatten_tables(t).alias("text"))


@query("f10_strategy_routing", r"""
    SELECT page_id, CASE
      WHEN url LIKE '%/en/%' AND html LIKE '%id="content"%' THEN 'search_page' ELSE 'markdown' END AS html_strategy,
      'plain' AS text_strategy, 'pdf' AS pdf_strategy, 'unchanged' AS csv_strategy FROM pages""")
def strategy_routing(spark, sf):
    from ..operators.cleaning import route

    p = tb.pages(spark, sf)
    r = lambda mime: route(F.col("url"), F.lit(mime), F.col("html"))
    return p.select(
        "page_id", r("text/html; charset=utf-8").alias("html_strategy"), r("text/plain").alias("text_strategy"),
        r("application/pdf").alias("pdf_strategy"), r("text/csv").alias("csv_strategy"),
    )


@query("f12_highlight", r"""
    SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN ''
      WHEN contains(text, '<em>') OR contains(text, '<strong>') THEN text
      ELSE regexp_replace(regexp_replace(text, '(?i)(the)', '<strong>\1</strong>', 'g'), '(?i)(que)', '<strong>\1</strong>', 'g') END AS text
    FROM documents""")
def highlight(spark, sf):
    return tb.text_table(spark, sf, "documents").select(
        "doc_id", tx.highlight(F.col("text"), F.lit("the a  que")).alias("text")
    )


@query("f16_sparse_keys", """
    SELECT event_id, CAST('69' AS INTEGER) - 69 + user_id AS term_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS weight FROM events""")
def sparse_keys(spark, sf):
    encoded = F.concat(F.lit('{"'), F.col("user_id"), F.lit('": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return tb.table(spark, sf, "events").select(
        "event_id", F.explode(tx.integer_keys(encoded)).alias("term_id", "weight")
    ).withColumn("term_id", F.col("term_id").cast("bigint"))


@query("p5_site_and_doc_keys", sql("""
    SELECT document_id, regexp_replace(source || '-' || lang, '[^a-zA-Z0-9_]', '_', 'g') AS site_key,
           source || '-' || lang || ':' || content_hash AS doc_key, source || '-' || lang AS site_id, content_hash
    FROM docs""", "docs"))
def keys(spark, sf):
    site = F.concat("source", F.lit("-"), "lang")
    d = tb.documents(spark, sf).select(
        "document_id", u.site_key(site).alias("site_key"), u.doc_key(site, F.col("content_hash")).alias("doc_key")
    )
    return d.withColumns({"site_id": u.key_site(F.col("doc_key")), "content_hash": u.key_hash(F.col("doc_key"))})


@query("p6_metadata_promotion", sql("""
    SELECT document_id, CASE WHEN lang = 'en' AND title <> '' THEN title ELSE 'og ' || lang END AS title,
           CASE WHEN lang = 'en' THEN description ELSE 'meta ' || source END AS description, source AS keywords
    FROM docs""", "docs"))
def metadata_promotion(spark, sf):
    d = tb.documents(spark, sf)
    english = F.col("lang") == "en"
    meta = F.create_map(
        F.lit("title"), F.when(english, F.col("title")).otherwise(F.lit("")),
        F.lit("og_title"), F.concat(F.lit("og "), "lang"),
        F.lit("description"), F.when(english, F.col("description")),
        F.lit("meta_description"), F.concat(F.lit("meta "), "source"),
        F.lit("og_description"), F.lit("unused"),
        F.lit("meta_keywords"), F.col("source"),
    )
    cols = ds.promoted(F.col("meta"))
    out = d.select("document_id", F.col("title").alias("given"), "lang", meta.alias("meta"))
    return out.select("document_id", *[c.alias(n) for n, c in cols.items()])


@query("p8_document_list_filter", sql("""
    SELECT document_id, url, title, mimetype FROM idocs
    WHERE mimetype = 'text/html' AND is_indexed
      AND document_id IN (SELECT document_id FROM members WHERE site_id = 'src3')
      AND (contains(lower(title), 'the') OR contains(lower(description), 'the') OR contains(lower(url), 'the'))""",
    "idocs", "members"))
def document_list_filter(spark, sf):
    d = ls.members_of(tb.indexed_documents(spark, sf), tb.membership(spark, sf), "src3")
    return ls.filter_documents(d, "text/html", "THE", True).select("document_id", "url", "title", "mimetype")


@query("p9_full_text_search", sql("""
    SELECT document_id, url, CASE WHEN title = '' THEN '无标题' ELSE title END AS title, description,
           substr(clean_content, 1, 300) AS content, mimetype, score, content_hash, created_at,
           (SELECT string_agg(site_id, ',' ORDER BY site_id) FROM members m WHERE m.document_id = d.document_id) AS site_ids
    FROM (SELECT *, CAST(1.0 AS DOUBLE) AS score FROM docs) d
    WHERE (contains(lower(title), 'tion') OR contains(lower(description), 'tion') OR contains(lower(clean_content), 'tion'))
      AND created_at >= TIMESTAMP '2023-11-14 22:13:30' AND created_at <= TIMESTAMP '2023-11-15 22:13:30'
      AND n_chars > 100 AND document_id IN (SELECT document_id FROM members WHERE site_id = 'fr')""",
    "docs", "members"))
def full_text_search(spark, sf):
    members = tb.membership(spark, sf)
    hits = ls.full_text(
        tb.documents(spark, sf), members, "Tion", "fr",
        created_from="2023-11-14 22:13:30", created_to="2023-11-15 22:13:30",
        condition=F.col("n_chars") > 100,
    )
    sites = ds.sites_per_document(members).withColumn("site_ids", F.array_join("site_ids", ","))
    return ls.as_results(hits, sites)


@query("p10_site_list_filter", sql("""
    SELECT s.site_id, s.name, s.description, s.base_url, s.enabled,
           (SELECT count(*) FROM supplier WHERE 'site_' || s_nationkey = s.site_id) AS total_documents
    FROM sites s WHERE enabled AND (contains(lower(name), 'a') AND contains(lower(description), 'america') OR contains(lower(name), 'america'))""",
    "sites"))
def site_list_filter(spark, sf):
    s = ls.filter_sites(tb.sites(spark, sf), True, "America")
    members = tb.table(spark, sf, "supplier").select(
        F.concat(F.lit("site_"), F.col("s_nationkey")).alias("site_id"), F.col("s_suppkey").alias("document_id")
    )
    return ls.with_document_count(s, members)


@query("p11_history_range", sql("""
    SELECT seq, url, content_hash, created_at FROM hist
    WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at <= TIMESTAMP '2024-01-12 12:00:00'""", "hist"))
def history_range(spark, sf):
    h = tb.history(spark, sf)
    return h.filter(F.col("created_at").between("2024-01-10", "2024-01-12 12:00:00")).select(
        "seq", "url", "content_hash", "created_at"
    )


@query("p17_preview_and_snippet", sql("""
    SELECT document_id, substr(content, 1, 200) AS preview, substr(coalesce(clean_content, ''), 1, 300) AS snippet,
           CASE WHEN title = '' THEN '无标题' ELSE title END AS title FROM docs""", "docs"))
def preview_and_snippet(spark, sf):
    return tb.documents(spark, sf).select(
        "document_id", tx.preview(F.col("content"), 200).alias("preview"),
        tx.preview(F.col("clean_content"), 300).alias("snippet"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit("无标题")).alias("title"),
    )


_STATUS = "CASE event_type WHEN 'error' THEN 400 + CAST(value AS BIGINT) % 200 ELSE 200 END"


@query("p19_status_routing", f"""
    SELECT route, count(*) AS n FROM (
      SELECT CASE WHEN {_STATUS.replace('CAST(value AS BIGINT)', 'CAST(floor(value) AS BIGINT)')} // 100 IN (4, 5)
             THEN 'error' ELSE 'ok' END AS route FROM events) x GROUP BY route""")
def status_routing(spark, sf):
    code = F.when(F.col("event_type") == "error", 400 + F.floor("value") % 200).otherwise(200)
    e = tb.table(spark, sf, "events").select(ds.status_route(code).alias("route"))
    return e.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("p21_preconditions", """
    SELECT route, reason, count(*) AS n FROM (
      SELECT CASE WHEN event_type = 'error' THEN 'drop' WHEN event_type = 'signup' THEN 'pass'
                  WHEN event_type = 'click' THEN 'error' WHEN user_id < 20 THEN 'skip' ELSE 'process' END AS route,
             CASE WHEN event_type = 'error' THEN 'record error' WHEN event_type = 'signup' THEN NULL
                  WHEN event_type = 'click' THEN 'url or content missing'
                  WHEN user_id < 20 THEN 'site id missing' END AS reason
      FROM events) x GROUP BY ALL""")
def preconditions(spark, sf):
    kind = F.col("event_type")
    e = tb.table(spark, sf, "events").select(
        F.when(kind == "error", "error").alias("status"),
        F.when(kind == "signup", "delete").alias("crawler_operation"),
        F.concat(F.lit("https://a.example/"), "event_id").alias("url"),
        F.when(kind != "click", F.col("props")).alias("content"),
        F.when(F.col("user_id") >= 20, F.lit("s")).alias("site_id"),
    )
    return ds.precondition(e).groupBy("route", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("p22_format_preference", """
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'md ' || page_id ELSE html END AS content FROM pages""")
def format_preference(spark, sf):
    p = tb.pages(spark, sf)
    return p.select(
        "page_id",
        ds.preferred_content(
            F.array(F.lit("html"), F.lit("markdown")),
            {"markdown": F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("md "), "page_id")), "html": F.col("html")},
        ).alias("content"),
    )


@query("p23_record_defaults", sql("""
    SELECT document_id, url, content_hash, 200 AS status_code, 'text/html' AS mimetype, 1 AS version, 'new' AS index_operation,
           false AS is_indexed, TIMESTAMP '2024-02-01' AS created_at, 0 AS n_links, source FROM docs""", "docs"))
def record_defaults(spark, sf):
    rec = tb.documents(spark, sf).select("document_id", "url", "content", "content_hash", "source")
    rows = ds.document_rows(rec, tb.now()).withColumn("n_links", F.size("links"))
    return rows.select("document_id", "url", "content_hash", "status_code", "mimetype", "version",
                       "index_operation", "is_indexed", "created_at", "n_links", "source")


@query("p24_point_lookup", sql("""
    SELECT 'url' AS by, document_id, url, title FROM docs WHERE url = (SELECT max(url) FROM docs WHERE source = 'src3')
    UNION ALL SELECT * FROM (SELECT 'hash', document_id, url, title FROM docs
      WHERE content_hash = (SELECT min(content_hash) FROM docs WHERE lang = 'en') AND lang = 'en' ORDER BY document_id LIMIT 1)
    UNION ALL SELECT 'id', document_id, url, title FROM docs WHERE document_id = (SELECT max(document_id) FROM docs WHERE lang = 'en')""",
    "docs"))
def point_lookup(spark, sf):
    d, m = tb.documents(spark, sf), tb.membership(spark, sf)
    keys = d.agg(
        F.max(F.when(F.col("source") == "src3", F.col("url"))).alias("url"),
        F.min(F.when(F.col("lang") == "en", F.col("content_hash"))).alias("h"),
        F.max(F.when(F.col("lang") == "en", F.col("document_id"))).alias("id"),
    ).first()
    cols = ["document_id", "url", "title"]
    return (
        ls.document_detail(d, m, "src3", url=keys.url).select(F.lit("url").alias("by"), *cols)
        .unionByName(ls.document_detail(d, m, "en", content_hash=keys.h).select(F.lit("hash").alias("by"), *cols))
        .unionByName(ls.document_detail(d, m, "en", document_id=keys.id).select(F.lit("id").alias("by"), *cols))
    )


@query("s2_mime_gate", sql("""
    SELECT document_id, mimetype, CASE WHEN mimetype IN ('text/html', 'text/plain', 'text/markdown') THEN 'text'
           WHEN mimetype = 'application/pdf' THEN 'binary' ELSE 'unsupported' END AS kind,
           CASE WHEN mimetype <> 'application/pdf' THEN content END AS text FROM docs
    UNION ALL SELECT -1 - page_id, 'image/png', 'unsupported', NULL FROM pages""", "docs"))
def mime_gate(spark, sf):
    from ..sources import records

    docs = tb.documents(spark, sf).select("document_id", "mimetype", F.base64(F.encode("content", "UTF-8")).alias("content"))
    imgs = tb.pages(spark, sf).select((-1 - F.col("page_id")).alias("document_id"), F.lit("image/png").alias("mimetype"), F.lit("").alias("content"))
    return records.decode_payload(docs.unionByName(imgs)).select("document_id", "mimetype", "kind", "text")


@query("s6_store_roundtrip", sql("""
    SELECT site_id, count(*) AS members, min(created_at) AS first_at FROM smembers GROUP BY site_id""", "smembers"))
def store_roundtrip(spark, sf):
    from ..session import scratch_path

    root = scratch_path(spark, "store")
    tables.write_version(tb.store_membership(spark, sf), root, 0, partition_by=["site_id"])
    return tables.read_latest(spark, root).groupBy("site_id").agg(
        F.count(F.lit(1)).alias("members"), F.min("created_at").alias("first_at")
    )


_CHANGE_COLS = ["url", "site_id", "document_id", "prev_content_hash", "operation"]


def _changes(spark, sf):
    return ds.classify(
        tb.incoming(spark, sf).select("url", "site_id", "content_hash", "doc_no"),
        tb.store(spark, sf).select("document_id", "url", "content_hash", "created_at"),
        tb.store_membership(spark, sf),
    )


def _settled(spark, sf):
    return ds.settle_copies(_changes(spark, sf), F.col("doc_no"))


@query("j2_two_key_match", sql("""
    SELECT url, document_id, prev_content_hash FROM found WHERE document_id IS NOT NULL""", "changes"))
def two_key_match(spark, sf):
    found = ds.find_existing(
        tb.incoming(spark, sf).select("url", "content_hash"),
        tb.store(spark, sf).select("document_id", "url", "content_hash", "created_at"),
    )
    return found.filter(F.col("document_id").isNotNull()).select("url", "document_id", "prev_content_hash")


@query("d1_classify", sql("""
    SELECT url, site_id, document_id, prev_content_hash, operation FROM changes""", "changes"))
def classify(spark, sf):
    return _changes(spark, sf).select(*_CHANGE_COLS)


@query("d2_apply", sql("""
    SELECT s.document_id, s.url, CASE WHEN c.operation = 'edit' THEN c.content_hash ELSE s.content_hash END AS content_hash,
           CASE WHEN c.operation = 'edit' THEN 2 ELSE 1 END AS version,
           CASE WHEN c.operation = 'edit' THEN 'edit' ELSE 'new' END AS index_operation,
           s.is_indexed AND c.operation <> 'edit' AS is_indexed,
           CASE WHEN c.operation = 'edit' THEN TIMESTAMP '2024-02-01' ELSE s.updated_at END AS updated_at,
           CASE WHEN c.operation = 'edit' THEN length(d.content) ELSE length(s.content) END AS n
    FROM store s JOIN settled c ON c.url = s.url JOIN docs d ON d.url = s.url
    UNION ALL
    SELECT c.doc_no, c.url, c.content_hash, 1, 'new', false, TIMESTAMP '2024-02-01', length(d.content)
    FROM settled c JOIN docs d ON d.url = c.url WHERE c.operation = 'new'""", "settled"))
def apply(spark, sf):
    after = ds.apply_documents(tb.store(spark, sf).drop("lang", "n_chars", "quality", "toxic"),
                               tb.incoming(spark, sf), _settled(spark, sf), tb.now())
    return after.select("document_id", "url", "content_hash", "version", "index_operation", "is_indexed",
                        "updated_at", F.length("content").cast("bigint").alias("n"))


@query("d2_membership", sql("""
    SELECT site_id, document_id, min(created_at) AS created_at FROM (
      SELECT site_id, document_id, created_at FROM smembers
      UNION ALL SELECT site_id, document_id, TIMESTAMP '2024-02-01' FROM settled) x GROUP BY ALL""",
    "settled", "smembers"))
def apply_membership(spark, sf):
    return ds.apply_membership(tb.store_membership(spark, sf), _settled(spark, sf), tb.now())


@query("d3_history", sql("""
    SELECT c.document_id, c.url, c.content_hash, CASE WHEN c.operation = 'edit' THEN 2 ELSE 1 END AS version,
           c.operation AS change_type, d.title, length(d.content) AS content_length,
           length(d.clean_content) AS clean_content_length, c.site_id
    FROM settled c JOIN docs d ON d.url = c.url WHERE c.operation IN ('new', 'edit')""", "settled"))
def history_append(spark, sf):
    store = tb.store(spark, sf).drop("lang", "n_chars", "quality", "toxic")
    changes = _settled(spark, sf)
    after = ds.apply_documents(store, tb.incoming(spark, sf), changes, tb.now())
    return ds.history_rows(store, after, changes, tb.now()).select(
        "document_id", "url", "content_hash", "version", "change_type", "title", "content_length",
        "clean_content_length", "site_id")


def _delete_requests(spark, sf):
    """Toxic documents leave everywhere; low-quality ones leave their source site."""
    l = tb.table(spark, sf, "labels").filter((F.col("toxic") == 1) | (F.col("quality") == 0))
    d = tb.documents(spark, sf).select("document_id", "url", "source")
    return d.join(l, d.document_id == l.doc_id).select(
        "url", F.when(F.col("toxic") == 0, F.col("source")).alias("site_id")
    )


@query("d4_delete", sql("""
    WITH t AS (SELECT l.doc_id, l.toxic FROM labels l WHERE toxic = 1 OR quality = 0),
    left_m AS (SELECT m.site_id, m.document_id FROM members m JOIN docs d USING (document_id)
               LEFT JOIN t ON t.doc_id = m.document_id
               WHERE t.doc_id IS NULL OR (t.toxic = 0 AND m.site_id <> d.source))
    SELECT d.document_id, coalesce(string_agg(m.site_id, ',' ORDER BY m.site_id), '') AS sites
    FROM docs d JOIN left_m m USING (document_id) GROUP BY 1""", "docs", "members"))
def delete(spark, sf):
    docs, left = ds.delete_documents(
        tb.documents(spark, sf).select("document_id", "url"), tb.membership(spark, sf), _delete_requests(spark, sf)
    )
    sites = ds.sites_per_document(left).withColumn("sites", F.array_join("site_ids", ",")).drop("site_ids")
    return docs.select("document_id").join(sites, "document_id", "left").withColumn("sites", F.coalesce("sites", F.lit("")))


@query("d5_membership_edits", sql("""
    SELECT site_id, document_id, min(created_at) AS created_at FROM (
      SELECT * FROM members WHERE NOT (site_id = 'de' AND document_id IN (SELECT doc_id FROM labels))
      UNION ALL SELECT 'copy', document_id, TIMESTAMP '2024-02-01' FROM members WHERE site_id = 'src1'
      UNION ALL SELECT 'labelled', doc_id, TIMESTAMP '2024-02-01' FROM labels) x GROUP BY ALL""", "members"))
def membership_edits(spark, sf):
    m = tb.membership(spark, sf)
    labelled = tb.table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    m = ds.copy_members(m, "src1", "copy", tb.now())
    m = ds.add_members(m, labelled.select(F.lit("labelled").alias("site_id"), "document_id", tb.now().alias("created_at")))
    return ds.remove_members(m, labelled.select(F.lit("de").alias("site_id"), "document_id"))


@query("d6_mark_indexed", sql("""
    SELECT document_id, is_indexed OR lang = 'en' AS is_indexed FROM idocs""", "idocs"))
def mark_indexed(spark, sf):
    d = tb.indexed_documents(spark, sf).select("document_id", "is_indexed")
    english = tb.documents(spark, sf).filter(F.col("lang") == "en").select("document_id")
    return ds.mark_indexed(d, english)


@query("d7_error_reconcile", sql("""
    WITH e AS (SELECT event_id, 'https://' || 'src' || (user_id % 20) || '.example/' || user_id AS url,
                      'src' || (user_id % 20) AS site_id,
                      CASE event_type WHEN 'error' THEN 404 WHEN 'click' THEN 503 ELSE 200 END AS status_code FROM events)
    SELECT e.event_id, e.status_code, s.document_id,
           CASE WHEN e.status_code = 200 THEN NULL
                WHEN EXISTS (SELECT 1 FROM smembers m WHERE m.document_id = s.document_id AND m.site_id = e.site_id)
                THEN 'delete' ELSE 'skip' END AS operation
    FROM e LEFT JOIN store s ON s.url = e.url""", "store", "smembers"))
def error_reconcile(spark, sf):
    site = F.concat(F.lit("src"), F.pmod("user_id", F.lit(20)))
    e = tb.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("https://"), site, F.lit(".example/"), "user_id").alias("url"), site.alias("site_id"),
        F.when(F.col("event_type") == "error", 404).when(F.col("event_type") == "click", 503).otherwise(200).alias("status_code"),
    )
    out = ds.reconcile_errors(e, tb.store(spark, sf), tb.store_membership(spark, sf))
    return out.select("event_id", "status_code", "document_id", "operation")


@query("d8_redirect_adoption", sql("""
    SELECT document_id, CASE WHEN lang = 'fr' THEN 'https://old.example/' || document_id ELSE url END AS url FROM docs""", "docs"))
def redirect_adoption(spark, sf):
    d = tb.documents(spark, sf).select(
        "document_id", "url",
        F.when(F.col("lang") == "fr", F.concat(F.lit("https://old.example/"), "document_id")).otherwise(F.lit("")).alias("redirect_url"),
    )
    return ds.adopt_redirects(d).select("document_id", "url")


@query("d12_purge_site", sql("""
    SELECT 'members' AS part, count(*) AS n FROM members WHERE site_id <> 'en'
    UNION ALL SELECT 'documents', count(*) FROM docs
    UNION ALL SELECT 'nodes', count(*) FROM docs WHERE lang <> 'en'""", "docs", "members"))
def purge_site(spark, sf):
    d = tb.documents(spark, sf).select("document_id", "lang")
    docs, members, nodes = ds.purge_site(d, tb.membership(spark, sf), d.withColumnRenamed("lang", "site_id"), "en")
    n = F.count(F.lit(1)).alias("n")
    return (
        members.agg(n).select(F.lit("members").alias("part"), "n")
        .unionByName(docs.agg(n).select(F.lit("documents").alias("part"), "n"))
        .unionByName(nodes.agg(n).select(F.lit("nodes").alias("part"), "n"))
    )


@query("w1_newest_per_hash", sql("""
    SELECT document_id, content_hash FROM docs
    QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY updated_at DESC, document_id DESC) = 1""", "docs"))
def newest_per_hash(spark, sf):
    return ds.newest_per_hash(tb.documents(spark, sf)).select("document_id", "content_hash")


@query("w2_newest_per_url", sql("""
    SELECT document_id, url, content_hash FROM (
      SELECT document_id, 'https://' || source || '.example/' || lang AS url, content_hash, updated_at FROM docs) d
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY updated_at DESC, document_id DESC) = 1""", "docs"))
def newest_per_url(spark, sf):
    d = tb.documents(spark, sf).withColumn("url", F.concat(F.lit("https://"), "source", F.lit(".example/"), "lang"))
    return ds.newest_per_url(d).select("document_id", "url", "content_hash")


@query("w6_version_numbers", sql("""
    SELECT seq, url, content_hash, CAST(1 + sum(changed) OVER (PARTITION BY url ORDER BY created_at, seq) AS BIGINT) AS version FROM (
      SELECT *, CASE WHEN lag(content_hash) OVER (PARTITION BY url ORDER BY created_at, seq) <> content_hash THEN 1 ELSE 0 END AS changed
      FROM hist) x""", "hist"))
def version_numbers(spark, sf):
    from ..operators.changes import version_numbers as number

    return number(tb.history(spark, sf)).select("seq", "url", "content_hash", "version")


@query("w7_primary_site", sql("""
    SELECT document_id, min_by(site_id, created_at) AS site_id FROM members GROUP BY document_id""", "members"))
def primary_site(spark, sf):
    return ds.primary_site(tb.membership(spark, sf))


@query("w8_repeated_lines", r"""
    SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: i = 1 OR l[i] <> l[i - 1]), lambda i: l[i]), chr(10)) AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) x""")
def repeated_lines(spark, sf):
    return tb.text_table(spark, sf, "documents").select("doc_id", tx.drop_repeated_lines(F.col("text")).alias("text"))


@query("w11_change_timeline", sql("""
    SELECT seq, url, created_at, content_hash,
           lag(content_hash) OVER (PARTITION BY url ORDER BY created_at, seq) AS prev_content_hash FROM hist""", "hist"))
def change_timeline(spark, sf):
    from ..operators.changes import timeline

    return timeline(tb.history(spark, sf)).select("seq", "url", "created_at", "content_hash", "prev_content_hash")


@query("j3_site_semi", sql("""
    SELECT document_id FROM docs WHERE document_id IN (SELECT document_id FROM members WHERE site_id = 'de')""", "docs", "members"))
def site_semi(spark, sf):
    return ls.members_of(tb.documents(spark, sf), tb.membership(spark, sf), "de").select("document_id")


@query("j4_documents_by_site", sql("""
    SELECT d.document_id, d.url, m.created_at AS joined_at FROM docs d JOIN members m USING (document_id)
    WHERE m.site_id = 'src2' ORDER BY m.created_at DESC, d.document_id LIMIT 20 OFFSET 5""", "docs", "members"))
def documents_by_site(spark, sf):
    d = ls.documents_of_site(tb.documents(spark, sf), tb.membership(spark, sf), "src2")
    return (d.orderBy(F.col("joined_at").desc(), "document_id").offset(5).limit(20)
            .select("document_id", "url", "joined_at"))


@query("j8_index_tasks", sql("""
    SELECT d.document_id, d.url, m.site_id FROM idocs d JOIN members m USING (document_id) WHERE NOT d.is_indexed""", "idocs", "members"))
def index_tasks(spark, sf):
    return ls.index_tasks(tb.indexed_documents(spark, sf), tb.membership(spark, sf)).select("document_id", "url", "site_id")


@query("j11_history_of_site", sql("""
    SELECT h.seq, h.url, h.content_hash, h.created_at FROM hist h JOIN members m USING (document_id)
    WHERE m.site_id = 'en' AND h.created_at >= TIMESTAMP '2024-01-05'""", "hist", "members"))
def history_of_site(spark, sf):
    return ls.history_of_site(tb.history(spark, sf), tb.membership(spark, sf), "en", start="2024-01-05").select(
        "seq", "url", "content_hash", "created_at")


@query("o1_whitelisted_sort", sql("""
    SELECT 'title' AS by, document_id, row_number() OVER (ORDER BY title, document_id) AS row_no FROM docs
    UNION ALL SELECT 'other', document_id, row_number() OVER (ORDER BY created_at DESC, document_id) FROM docs""", "docs"))
def whitelisted_sort(spark, sf):
    d = tb.documents(spark, sf)
    by = lambda name, order: ls.numbered(d, order, ["document_id"]).withColumn("by", F.lit(name))
    return by("title", ls.sort_columns("title", "asc")).unionByName(by("other", ls.sort_columns("n_chars", "asc")))


@query("o2_search_sort", sql("""
    SELECT 'date' AS by, document_id, row_number() OVER (ORDER BY created_at DESC, document_id) AS row_no FROM docs
    UNION ALL SELECT 'title', document_id, row_number() OVER (ORDER BY title, document_id) FROM docs
    UNION ALL SELECT 'custom', document_id, row_number() OVER (ORDER BY n_chars DESC, document_id) FROM docs
    UNION ALL SELECT 'default', document_id, row_number() OVER (ORDER BY document_id) FROM docs""", "docs"))
def search_sort(spark, sf):
    d = tb.documents(spark, sf)
    by = lambda name, order: ls.numbered(d, order, ["document_id"]).withColumn("by", F.lit(name))
    return (by("date", ls.search_order("date")).unionByName(by("title", ls.search_order("title")))
            .unionByName(by("custom", ls.search_order("custom", F.col("n_chars").desc())))
            .unionByName(by("default", ls.search_order("relevance"))))


@query("o3_page_with_total", sql("""
    SELECT document_id, title, (SELECT count(*) FROM docs) AS total_count,
           CAST(ceil((SELECT count(*) FROM docs) / 10.0) AS INTEGER) AS page,
           CAST(ceil((SELECT count(*) FROM docs) / 10.0) AS INTEGER) AS total_pages FROM docs
    ORDER BY created_at DESC, document_id
    LIMIT 10 OFFSET (SELECT CAST((ceil(count(*) / 10.0) - 1) * 10 AS BIGINT) FROM docs)""", "docs"))
def page_with_total(spark, sf):
    d = tb.documents(spark, sf).select("document_id", "title", "created_at")
    return ls.page_of(d, ls.sort_columns("created_at"), 10_000_000, 10).select(
        "document_id", "title", "total_count", "page", "total_pages")


@query("o3_keyset_page", sql("""
    SELECT document_id, created_at FROM docs WHERE created_at < (SELECT max(created_at) FROM docs)
    ORDER BY created_at DESC, document_id LIMIT 25""", "docs"))
def keyset_page(spark, sf):
    d = tb.documents(spark, sf).select("document_id", "created_at")
    first = ls.page_after(d, None, 1).first()
    return ls.page_after(d, (first.created_at, first.document_id), 25)


@query("o4_pending_queue", sql("""
    SELECT document_id, created_at FROM idocs WHERE NOT is_indexed ORDER BY created_at, document_id LIMIT 100""", "idocs"))
def pending_queue(spark, sf):
    return ls.pending_documents(tb.indexed_documents(spark, sf), 100).select("document_id", "created_at")


@query("o5_offset_batches", sql("""
    SELECT m.site_id, d.document_id, CAST((row_number() OVER (PARTITION BY m.site_id ORDER BY d.created_at, d.document_id) - 1) // 200 AS BIGINT) AS batch
    FROM docs d JOIN members m USING (document_id)""", "docs", "members"))
def offset_batches(spark, sf):
    return ls.refresh_batches(tb.documents(spark, sf), tb.membership(spark, sf)).select("site_id", "document_id", "batch")


@query("o8_capped_search", sql("""
    SELECT document_id, total_count FROM (
      SELECT document_id, count(*) OVER () AS total_count FROM (
        SELECT document_id FROM docs WHERE contains(lower(title), 'th') OR contains(lower(description), 'th')
            OR contains(lower(clean_content), 'th') ORDER BY document_id LIMIT 1000) a) b
    ORDER BY document_id LIMIT 20 OFFSET 20""", "docs"))
def capped_search(spark, sf):
    hits = ls.full_text(tb.documents(spark, sf), tb.membership(spark, sf), "th").select("document_id")
    capped = hits.orderBy("document_id").limit(1000)
    return ls.page_of(capped, [F.col("document_id").asc()], 2, 20).select("document_id", "total_count")


@query("u1_or_of_filters", sql("""
    SELECT document_id FROM docs WHERE mimetype = 'text/plain' OR contains(lower(title), 'the') OR n_chars > 2000""", "docs"))
def or_of_filters(spark, sf):
    d = tb.documents(spark, sf)
    return d.filter(u.any_of([F.col("mimetype") == "text/plain", tx.contains_ci(F.col("title"), "the"),
                              F.col("n_chars") > 2000])).select("document_id")


@query("u4_site_union", sql("""
    SELECT document_id, source || ',' || lang || ',extra' AS site_ids FROM docs""", "docs"))
def site_union(spark, sf):
    d = tb.documents(spark, sf)
    sites = ds.site_union(F.col("source"), F.array("lang", "source", F.lit(""), F.lit(None).cast("string"), F.lit("extra")))
    return d.select("document_id", F.array_join(sites, ",").alias("site_ids"))


@query("a1_store_totals", sql("""
    SELECT count(*) AS documents, count(*) FILTER (is_indexed) AS indexed, count(*) FILTER (NOT is_indexed) AS pending,
           (SELECT count(DISTINCT site_id) FROM members) AS sites FROM idocs""", "idocs", "members"))
def store_totals(spark, sf):
    from ..operators import reports

    return reports.store_totals(tb.indexed_documents(spark, sf), tb.membership(spark, sf))


@query("a2_documents_per_site", sql("SELECT site_id, count(*) AS documents FROM members GROUP BY 1", "members"))
def documents_per_site(spark, sf):
    return tb.membership(spark, sf).groupBy("site_id").agg(F.count(F.lit(1)).alias("documents"))


@query("a3_documents_per_type", sql("SELECT mimetype, count(*) AS documents FROM docs GROUP BY 1", "docs"))
def documents_per_type(spark, sf):
    return tb.documents(spark, sf).groupBy("mimetype").agg(F.count(F.lit(1)).alias("documents"))


@query("a4_index_stats", sql(r"""
    SELECT site_id, count(*) AS total_documents, CAST(sum(n) AS BIGINT) AS total_tokens, round(sum(n) / count(*), 6) AS average_length FROM (
      SELECT m.site_id, len(list_filter(regexp_split_to_array(d.content, '\s+'), lambda w: w <> '')) AS n
      FROM docs d JOIN members m USING (document_id)) x GROUP BY 1""", "docs", "members"))
def index_stats(spark, sf):
    from ..operators import reports

    stats = reports.index_stats(tb.documents(spark, sf), membership=tb.membership(spark, sf))
    return stats.withColumn("average_length", F.round("average_length", 6))


@query("a9_sites_per_document", sql("""
    SELECT document_id, string_agg(site_id, ',' ORDER BY site_id) AS site_ids FROM members GROUP BY 1""", "members"))
def sites_per_document(spark, sf):
    return ds.sites_per_document(tb.membership(spark, sf)).withColumn("site_ids", F.array_join("site_ids", ","))


@query("a10_bulk_delete_report", sql("""
    SELECT coalesce(error, 'deleted') AS outcome, count(*) AS n FROM (
      SELECT CASE WHEN d.source IS NULL OR d.source NOT IN ('src1', 'src2', 'src3') THEN 'not in site' END AS error
      FROM labels l LEFT JOIN documents d USING (doc_id)) x GROUP BY 1""", "docs", "members"))
def bulk_delete_report(spark, sf):
    docs = tb.documents(spark, sf).select("document_id", "source")
    m = tb.membership(spark, sf).filter(F.col("site_id").isin("src1", "src2", "src3"))
    m = m.withColumn("site_id", F.lit("bulk"))
    req = tb.table(spark, sf, "labels").select(F.lit("bulk").alias("site_id"), F.col("doc_id").alias("document_id"))
    rep = ds.delete_report(m, docs, req)
    return rep.groupBy(F.coalesce("error", F.lit("deleted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
