"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import hooks
from ..functions import html as h
from ..functions import urls as u
from ..operators import cleaning, embedding as em
from ..session import scratch_path
from ..streaming import stages as st
from . import testbed as tb
from .control_queries import SESSIONS_SQL, STATES_SQL, _SNAP
from .page_queries import _NORM
from .registry import query
from .testbed import sql


def _events(spark, sf):
    """The event table as a stream, its times as UTC."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    tb.table(spark, sf, "events")
    raw = st.file_stream(spark, sf, schema, glob="events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _tasks(spark, sf):
    return tb.as_task_events(_events(spark, sf))


def _written(spark, stream, schema, mode="append"):
    root, mark = scratch_path(spark, "sink"), scratch_path(spark, "mark")
    st.run_available(stream, st.batch_sink(root), mark, mode)
    return st.read_log(spark, root, schema)


@query("t1_stage_stream", f"""
    SELECT url, content_hash, 2 AS version, true AS indexed, hosts FROM (
      SELECT {_NORM} AS url, max(sha256(html)) AS content_hash, 1 AS hosts FROM pages GROUP BY 1) x
    WHERE length(url) % 5 <> 0""")
def stage_stream(spark, sf):
    """Every page comes twice, first as an older text: one version each. Then some are deleted, and images come."""
    pages = tb.pages(spark, sf)
    inbox, mark = scratch_path(spark, "inbox"), scratch_path(spark, "mark")
    site = st.Site(scratch_path(spark, "site"))
    base = pages.select(
        u.normalize(F.col("url")).alias("url"), u.host(F.col("url")).alias("site_id"), F.col("html").alias("content"),
        F.lit("text/html").alias("mimetype"), h.title(F.col("html")).alias("title"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("crawler_operation"))
    older = base.withColumn("content", F.concat("content", F.lit("<p>older</p>"))).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    newer = base.withColumn("ts", F.lit("2024-01-02").cast("timestamp"))
    third = base.withColumn("ts", F.lit("2024-01-03").cast("timestamp"))
    ends = third.filter(F.length("url") % 5 == 0).withColumns(
        {"content": F.lit(None).cast("string"), "crawler_operation": F.lit("delete")}).unionByName(
        third.withColumns({"url": F.concat("url", F.lit("/i.png")), "mimetype": F.lit("image/png")}))
    for records in (older, newer, ends):
        records.write.mode("append").parquet(inbox)
        st.ingest(st.file_stream(spark, inbox, records.schema), site, mark)
    docs = st.current_documents(spark, site)
    indexed = st.current_nodes(spark, site).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))
    members = st.current_members(spark, site).groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("hosts"))
    return docs.join(indexed, "content_hash", "left").join(members, "document_id").select(
        "url", "content_hash", "version", F.col("n").isNotNull().alias("indexed"), "hosts")


@query("t2_dead_letters", """
    SELECT 'https://a.example/' || event_id AS url, 'url or content missing' AS reason FROM events WHERE event_type = 'click'""")
def dead_letters(spark, sf):
    kind = F.col("event_type")
    e = _events(spark, sf).select(
        F.when(kind == "error", "error").alias("status"), F.when(kind == "signup", "delete").alias("crawler_operation"),
        F.concat(F.lit("https://a.example/"), "event_id").alias("url"), F.when(kind != "click", F.col("props")).alias("content"),
        F.when(F.col("user_id") >= 20, F.lit("s")).alias("site_id"), "ts")
    return _written(spark, st.dead_letters(e)[1], st.DEAD).select("url", "reason")


@query("t3_stream_dedupe", """
    SELECT DISTINCT user_id AS task, 'https://t.example/' || json_extract_string(props, '$.k') AS url FROM events""")
def stream_dedupe(spark, sf):
    e = _events(spark, sf).select(
        F.col("user_id").alias("task"), F.concat(F.lit("https://t.example/"), F.get_json_object("props", "$.k")).alias("url"), "ts")
    return _written(spark, st.distinct_tasks(e, ["task", "url"], "40 days").drop("ts"), "task bigint, url string").select("task", "url")


@query("t4_task_states_stream", STATES_SQL)
def task_states_stream(spark, sf):
    log = _written(spark, st.task_states(_tasks(spark, sf)), st.TASK_OUT, "update")
    times = ["created_at", "started_at", "completed_at", "updated_at"]
    return st.latest(log, ["task_id"]).drop("batch").withColumns({c: F.timestamp_micros(c) for c in times})


@query("t5_live_metrics", sql("""
    SELECT date_trunc('hour', ts) AS window_start, queue,
      CAST(sum(CASE event WHEN 'enqueue' THEN 1 WHEN 'dequeue' THEN -1 WHEN 'retry' THEN 1 ELSE 0 END) AS BIGINT) AS pending,
      CAST(sum(CASE event WHEN 'dequeue' THEN 1 WHEN 'complete' THEN -1 WHEN 'fail' THEN -1 WHEN 'retry' THEN -1 ELSE 0 END) AS BIGINT) AS processing,
      count(*) FILTER (event = 'complete') AS completed, count(*) FILTER (event = 'fail') AS failed, count(*) FILTER (event = 'retry') AS retries
    FROM tasks GROUP BY ALL""", "tasks"))
def live_metrics(spark, sf):
    schema = "window_start timestamp, queue string, pending bigint, processing bigint, completed bigint, failed bigint, retries bigint"
    log = _written(spark, st.live_metrics(_tasks(spark, sf)), schema, "update")
    return st.latest(log, ["window_start", "queue"]).drop("batch")


@query("t6_stall_alerts", f"""
    WITH {_SNAP}, p AS (SELECT *, lag(processing) OVER w AS pp, lag(ts) OVER w AS pt FROM snap WINDOW w AS (PARTITION BY queue ORDER BY ts, seq))
    SELECT queue, seq, round((epoch_us(ts) - epoch_us(pt)) / 1e6, 6) AS gap_seconds FROM p
    WHERE processing > 0 AND processing = pp AND (epoch_us(ts) - epoch_us(pt)) / 1e6 > 900""")
def stall_alerts(spark, sf):
    checks = _events(spark, sf).select(
        F.concat(F.lit("q"), F.pmod("user_id", F.lit(4))).alias("queue"), "ts", F.col("event_id").alias("seq"),
        (F.get_json_object("props", "$.k").cast("int") % 2).alias("processing"))
    return _written(spark, st.stall_alerts(checks, 900), st.STALL_OUT).select("queue", "seq", F.round("gap_seconds", 6).alias("gap_seconds"))


@query("t7_session_stream", SESSIONS_SQL)
def session_stream(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("session_id"), "ts")
    log = _written(spark, st.session_activity(e), "session_id bigint, last_activity timestamp, events bigint", "update")
    old = F.lit("2024-01-29").cast("timestamp")
    return st.latest(log, ["session_id"]).drop("batch").withColumn("expired", F.col("last_activity") < old)


@query("t7_session_windows", """
    WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM s)
    SELECT user_id AS session_id, min(ts) AS started_at, max(ts) AS last_activity, count(*) AS events FROM n GROUP BY user_id, no""")
def session_windows(spark, sf):
    e = tb.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "ts")
    return st.session_windows(e, "12 hours")


@query("t7_ended_sessions", """
    WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM s)
    SELECT user_id AS session_id, min(ts) AS started_at, max(ts) AS last_activity, count(*) AS events FROM n GROUP BY user_id, no
    HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def ended_sessions(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("session_id"), "ts")
    schema = "session_id bigint, started_at timestamp, last_activity timestamp, events bigint"
    ended = _written(spark, st.session_windows(e, "12 hours", "1 hour"), schema)
    return ended.select("session_id", "started_at", "last_activity", "events")


@query("t8_back_pressure", "SELECT count(*) AS rows, CAST(3 AS BIGINT) AS batches, max(event_id) AS last_id FROM events")
def back_pressure(spark, sf):
    """Five files, at most two per trigger."""
    inbox = scratch_path(spark, "inbox")
    events = tb.table(spark, sf, "events")
    events.repartitionByRange(5, "ts").write.parquet(inbox)
    root = scratch_path(spark, "sink")
    st.run_available(st.file_stream(spark, inbox, events.schema, max_files=2), st.batch_sink(root), scratch_path(spark, "mark"))
    log = st.read_log(spark, root, "event_id bigint")
    return log.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("batch").alias("batches"), F.max("event_id").alias("last_id"))


# ---- hooks

def _upper(text: str) -> str:
    """Full upper case, as ß gives SS. DuckDB has one letter for one, and none for letters that came with Unicode 16."""
    full = {c: c.upper() for c in map(chr, range(0xDF, 0xFB18)) if len(c.upper()) > 1}
    new = {"\u019b": "\ua7dc", "\u0264": "\ua7cb", "\u1c8a": "\u1c89", "\ua7cd": "\ua7cc", "\ua7db": "\ua7da",
           **{chr(i): chr(i - 0x20) for i in range(0x10D70, 0x10D86)}}
    for letter, capital in {**full, **new}.items():
        text = f"replace({text}, '{letter}', '{capital}')"
    return f"upper({text})"


@query("x1_custom_strategy", rf"""
    SELECT doc_id, CASE lang WHEN 'es' THEN 'shout' WHEN 'fr' THEN 'plain' ELSE 'unchanged' END AS strategy,
      CASE lang WHEN 'es' THEN {_upper('text')} WHEN 'fr' THEN array_to_string(list_filter(list_transform(string_split(text, chr(10)),
        lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) ELSE text END AS clean_content FROM documents""")
def custom_strategy(spark, sf):
    shout = cleaning.Strategy("shout", lambda url, mime, content: mime.startswith("text/x-es"), F.upper)
    d = tb.text_table(spark, sf, "documents").select(
        "doc_id", F.lit("https://d.example/").alias("url"), F.col("text").alias("content"),
        F.when(F.col("lang") == "es", "text/x-es").when(F.col("lang") == "fr", "text/plain").otherwise("text/x-none").alias("mimetype"))
    return cleaning.clean(d, hooks.add_strategy(shout)).select("doc_id", "strategy", "clean_content")


@query("x2_document_converter", """
    SELECT doc_id, CASE WHEN lang = 'de' AND length(text) > 200 THEN 'pdf ' || strlen(text) WHEN lang = 'fr' THEN 'kept' END AS clean_content,
      CASE WHEN lang = 'de' AND length(text) <= 200 THEN 'ValueError: too short' END AS convert_error FROM documents""")
def document_converter(spark, sf):
    def convert(data: bytes) -> str:
        if len(data.decode()) <= 200:
            raise ValueError("too short")
        return f"pdf {len(data)}"

    d = tb.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "de", "pdf").otherwise("other").alias("strategy"), F.encode("text", "UTF-8").alias("bytes"),
        F.when(F.col("lang") == "fr", F.lit("kept")).alias("clean_content"))
    return hooks.convert_documents(d, {"pdf": convert}).select("doc_id", "clean_content", "convert_error")


@query("x4_custom_embedder", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS a, CAST(length(lang) AS DOUBLE) AS b FROM documents")
def custom_embedder(spark, sf):
    def make():
        import numpy as np

        return lambda texts: np.array([[len(t.split("\x01", 1)[0]), len(t.split("\x01", 1)[1])] for t in texts], dtype="float32")

    d = tb.table(spark, sf, "documents").select("doc_id", F.concat_ws("\x01", "text", "lang").alias("text"))
    e = em.embed(d, make=make)
    return e.select("doc_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))


@query("x5_pair_scorer", """
    SELECT conv_id, turn, CASE WHEN contains(text, 'the') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM conversations""")
def custom_pair_scorer(spark, sf):
    import pandas as pd

    scorer = hooks.pair_scorer(lambda q, t: pd.Series([1.0 if a in b else 0.0 for a, b in zip(q, t)]))
    return tb.messages(spark, sf).select("conv_id", "turn", scorer(F.lit("the"), F.col("text")).alias("score"))


@query("x6_search_options", sql("""
    SELECT document_id, '> ' || substr(title, 1, 20) AS shown FROM docs
    WHERE (contains(lower(title), 'er') OR contains(lower(description), 'er') OR contains(lower(clean_content), 'er')) AND lang = 'de'""", "docs"))
def search_options(spark, sf):
    from ..operators import listing as ls

    return ls.full_text(
        tb.documents(spark, sf), tb.membership(spark, sf), "er", condition=F.col("lang") == "de",
        result=lambda df: df.select("document_id", F.concat(F.lit("> "), F.substring("title", 1, 20)).alias("shown")))


@query("x8_task_processor", """
    SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id * 2 END AS doubled, CASE WHEN event_type = 'error' THEN 'RuntimeError: bad task' END AS error FROM events""")
def task_processor(spark, sf):
    def work(row: dict) -> dict:
        if row["event_type"] == "error":
            raise RuntimeError("bad task")
        return {"doubled": row["user_id"] * 2}

    e = tb.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return hooks.process_tasks(e, work, "doubled bigint").select("event_id", "result.doubled", "error")


@query("x3_page_callback", "SELECT count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages")
def page_callback(spark, sf):
    """The callback runs on the executors; its two counters come back."""
    pages, chars = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def crawled(url: str, content: str, metadata: dict) -> None:
        pages.add(1)
        chars.add(len(content))

    p = tb.pages(spark, sf).select("url", F.col("html").alias("content"), h.metadata(F.col("html")).alias("metadata"))
    hooks.for_each_page(p, crawled)
    return tb.pages(spark, sf).agg(F.lit(pages.value).cast("bigint").alias("pages"), F.lit(chars.value).cast("bigint").alias("chars"))


@query("x7_alert_callback", f"""
    WITH {_SNAP}, p AS (SELECT *, lag(processing) OVER w AS pp, lag(ts) OVER w AS pt FROM snap WINDOW w AS (PARTITION BY queue ORDER BY ts, seq)),
    a AS (SELECT queue FROM p WHERE processing > 0 AND processing = pp AND (epoch_us(ts) - epoch_us(pt)) / 1e6 > 1800)
    SELECT queue, count(*) AS alerts, (SELECT count(*) FROM a) AS called FROM a GROUP BY queue""")
def alert_callback(spark, sf):
    called = spark.sparkContext.accumulator(0)
    checks = _events(spark, sf).select(
        F.concat(F.lit("q"), F.pmod("user_id", F.lit(4))).alias("queue"), "ts", F.col("event_id").alias("seq"),
        (F.get_json_object("props", "$.k").cast("int") % 2).alias("processing"))
    root = scratch_path(spark, "alerts")
    st.run_available(st.stall_alerts(checks, 1800), st.alert_sink(lambda alert: called.add(1), root), scratch_path(spark, "mark"))
    alerts = st.read_log(spark, root, st.STALL_OUT).groupBy("queue").agg(F.count(F.lit(1)).alias("alerts"))
    return alerts.withColumn("called", F.lit(called.value).cast("bigint"))
