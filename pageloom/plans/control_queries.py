"""Queries over control tables, queue events, glossary and display columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions import text as tx
from ..operators import glossary, policies as po, queues as qu
from ..session import scratch_path
from ..sources import tables
from . import testbed as tb
from .registry import query
from .testbed import sql

_N = "TIMESTAMP '2000-07-01'"
_DUE = f"""
    executed AS (SELECT policy_id, last_executed FROM policies WHERE enabled AND last_executed IS NOT NULL),
    hits AS (
      SELECT policy_id, min_by(reason, schedule_id) AS reason FROM (
        SELECT s.policy_id, schedule_id, CASE
          WHEN run_count >= coalesce(max_runs, 2147483647) OR coalesce(start_date, {_N}) > {_N} THEN NULL
          WHEN schedule_type = 'once' AND one_time_date <= {_N} AND last_run IS NULL THEN '单次执行时间已到'
          WHEN schedule_type = 'interval' AND epoch_us({_N}) - epoch_us(coalesce(last_run, last_executed)) >= interval_seconds * 1000000
            THEN '间隔执行时间已到 (间隔' || interval_seconds || '秒)'
          WHEN schedule_type = 'cron' AND next_run <= {_N} THEN 'Cron表达式执行时间已到' END AS reason
        FROM schedules s JOIN executed e ON e.policy_id = s.policy_id WHERE s.enabled) x
      WHERE reason IS NOT NULL GROUP BY policy_id),
    due AS (
      SELECT p.*, CASE WHEN last_executed IS NULL THEN '策略从未执行过' ELSE h.reason END AS reason
      FROM policies p LEFT JOIN hits h ON h.policy_id = p.policy_id
      WHERE p.enabled AND (last_executed IS NULL OR h.reason IS NOT NULL)),
    due_refresh AS (
      SELECT *, CASE WHEN last_refresh IS NULL THEN '刷新策略从未执行过' ELSE '刷新间隔时间已到' END AS reason
      FROM refresh WHERE enabled AND (last_refresh IS NULL OR next_refresh <= {_N})),
    all_due AS (
      SELECT s.site_id, s.name AS site_name, 'crawl' AS policy_type, d.policy_id, d.name, d.reason
      FROM due d JOIN sites s ON s.site_id = d.site_id
      UNION ALL SELECT s.site_id, s.name, 'refresh', r.refresh_id, r.name, r.reason
      FROM due_refresh r JOIN sites s ON s.site_id = r.site_id)"""
_POLICY_CTES = ("policies", "schedules", "refresh", "sites")


def _policy_tables(spark, sf):
    return tb.crawl_policies(spark, sf), tb.schedules(spark, sf), tb.refresh_policies(spark, sf), tb.sites(spark, sf)


@query("p15_due_crawl_policies", sql(f"WITH {_DUE} SELECT policy_id, site_id, reason FROM due", *_POLICY_CTES))
def due_crawl_policies(spark, sf):
    p, s, _, _ = _policy_tables(spark, sf)
    return po.due_crawls(p, s, tb.policy_now()).select("policy_id", "site_id", "reason")


@query("j9_due_by_site", sql(f"WITH {_DUE} SELECT * FROM all_due", *_POLICY_CTES))
def due_by_site(spark, sf):
    p, s, r, sites = _policy_tables(spark, sf)
    return po.due_by_site(sites, p, s, r, tb.policy_now())


@query("a14_execution_report", sql(f"""
    WITH {_DUE} SELECT site_id, site_name, count(*) FILTER (NOT (policy_type = 'crawl' AND reason = '策略从未执行过')) AS executed,
      count(*) FILTER (policy_type = 'crawl' AND reason = '策略从未执行过') AS failed FROM all_due GROUP BY ALL""", *_POLICY_CTES))
def execution_report(spark, sf):
    p, s, r, sites = _policy_tables(spark, sf)
    due = po.due_by_site(sites, p, s, r, tb.policy_now())
    failures = p.filter(F.col("last_executed").isNull()).select(
        "policy_id", F.lit("crawl").alias("policy_type"), F.lit("first run failed").alias("error"))
    return po.execution_report(due, failures)


@query("d11_executed_policies", sql(f"""
    WITH {_DUE} SELECT p.policy_id, CASE WHEN d.policy_id IS NOT NULL THEN {_N} ELSE p.last_executed END AS last_executed
    FROM policies p LEFT JOIN due d ON d.policy_id = p.policy_id""", *_POLICY_CTES))
def executed_policies(spark, sf):
    p, s, _, _ = _policy_tables(spark, sf)
    now = tb.policy_now()
    return po.mark_executed(p, po.due_crawls(p, s, now), now).select("policy_id", "last_executed")


@query("d11_executed_schedules", sql(f"""
    WITH {_DUE} SELECT s.schedule_id,
      CASE WHEN s.enabled AND d.policy_id IS NOT NULL THEN {_N} ELSE s.last_run END AS last_run,
      CASE WHEN s.enabled AND d.policy_id IS NOT NULL AND s.schedule_type = 'interval' AND interval_seconds > 0
           THEN {_N} + to_seconds(interval_seconds) ELSE s.next_run END AS next_run,
      CAST(s.run_count + CASE WHEN s.enabled AND d.policy_id IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS run_count
    FROM schedules s LEFT JOIN due d ON d.policy_id = s.policy_id""", *_POLICY_CTES))
def executed_schedules(spark, sf):
    p, s, _, _ = _policy_tables(spark, sf)
    now = tb.policy_now()
    return po.mark_scheduled(s, po.due_crawls(p, s, now), now).select("schedule_id", "last_run", "next_run", "run_count")


@query("d11_executed_refreshes", sql(f"""
    WITH {_DUE} SELECT r.refresh_id, CASE WHEN d.refresh_id IS NOT NULL THEN {_N} ELSE r.last_refresh END AS last_refresh,
      CASE WHEN d.refresh_id IS NOT NULL THEN {_N} + to_days(r.refresh_interval_days) ELSE r.next_refresh END AS next_refresh
    FROM refresh r LEFT JOIN due_refresh d ON d.refresh_id = r.refresh_id""", *_POLICY_CTES))
def executed_refreshes(spark, sf):
    r, now = tb.refresh_policies(spark, sf), tb.policy_now()
    return po.mark_refreshed(r, po.due_refreshes(r, now), now).select("refresh_id", "last_refresh", "next_refresh")


@query("j12_schedules_of_site", sql("""
    SELECT s.schedule_id, s.schedule_type, p.policy_id, p.name AS policy_name FROM schedules s
    JOIN policies p ON p.policy_id = s.policy_id WHERE p.site_id = 'site_3'""", "policies", "schedules"))
def schedules_of_site(spark, sf):
    p, s, _, _ = _policy_tables(spark, sf)
    return po.schedules_of_site(s, p, "site_3").select("schedule_id", "schedule_type", "policy_id", "policy_name")


@query("f17_next_run", sql(f"""
    SELECT schedule_id, CASE schedule_type WHEN 'once' THEN one_time_date WHEN 'interval' THEN greatest(start_date, {_N}) ELSE next_run END AS created,
      CASE WHEN schedule_type = 'once' THEN one_time_date
           WHEN schedule_type = 'interval' AND last_run IS NOT NULL THEN last_run + to_seconds(interval_seconds)
           WHEN schedule_type = 'interval' THEN greatest(start_date, {_N}) ELSE next_run END AS changed
    FROM schedules""", "schedules"))
def next_run(spark, sf):
    now = tb.policy_now()
    return tb.schedules(spark, sf).select(
        "schedule_id", po.first_next_run(now).alias("created"), po.changed_next_run(now).alias("changed"))


@query("f18_next_refresh", sql(f"""
    SELECT refresh_id, CASE WHEN enabled THEN {_N} + to_days(refresh_interval_days) ELSE next_refresh END AS next_refresh FROM refresh""", "refresh"))
def next_refresh(spark, sf):
    return tb.refresh_policies(spark, sf).select(
        "refresh_id",
        po.next_refresh(tb.policy_now(), F.col("refresh_interval_days"), F.col("enabled"), F.col("next_refresh")).alias("next_refresh"))


@query("d9_refresh_selection", sql("""
    SELECT 'all' AS strategy, document_id, CASE WHEN contains(url, 'src1.') THEN 0 ELSE 1 END AS priority FROM docs
    UNION ALL SELECT 'incremental', document_id, 1 FROM docs WHERE updated_at < TIMESTAMP '2023-11-14 22:20:00'
    UNION ALL SELECT 'selective', document_id, 1 FROM docs WHERE regexp_matches(url, 'src[0-5][.]') AND NOT regexp_matches(url, '7$')""", "docs"))
def refresh_selection(spark, sf):
    d = tb.documents(spark, sf).select("document_id", "url", "updated_at")
    now = F.lit("2023-12-14 22:20:00").cast("timestamp")
    pick = lambda name, **kw: po.select_refresh(d, name, **kw).select(F.lit(name).alias("strategy"), "document_id", "priority")
    return (pick("all", priority=["src1[.]"]).unionByName(pick("incremental", now=now, max_age_days=30))
            .unionByName(pick("selective", include=["src[0-5][.]"], exclude=["7$"])))


@query("d10_refresh_parameters", sql("""
    SELECT o_orderkey AS request_id, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'all' END, r.strategy, 'incremental') AS strategy,
           CAST(coalesce(CASE WHEN o_orderstatus = 'P' THEN 7 END, r.refresh_interval_days, 30) AS INTEGER) AS max_age_days
    FROM orders LEFT JOIN refresh r ON r.site_id = 'site_' || (o_custkey % 30)""", "refresh"))
def refresh_parameters(spark, sf):
    req = tb.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.concat(F.lit("site_"), F.col("o_custkey") % 30).alias("site_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("all")).alias("strategy"),
        F.when(F.col("o_orderstatus") == "P", F.lit(7)).alias("max_age_days"))
    r = tb.refresh_policies(spark, sf).withColumn("max_age_days", F.col("refresh_interval_days"))
    return po.resolve_refresh(req, r).select("request_id", "strategy", "max_age_days")


@query("d16_control_patches", sql("""
    SELECT s.schedule_id, CASE WHEN p.c_mktsegment = 'BUILDING' THEN 'patched ' || p.c_custkey ELSE s.name END AS name,
           CASE WHEN p.c_mktsegment = 'MACHINERY' THEN NOT s.enabled ELSE s.enabled END AS enabled
    FROM schedules s LEFT JOIN customer p ON p.c_custkey = s.schedule_id""", "schedules"))
def control_patches(spark, sf):
    s = tb.schedules(spark, sf)
    c = tb.table(spark, sf, "customer").withColumnRenamed("c_custkey", "schedule_id")
    patch = c.filter("c_mktsegment = 'BUILDING'").select(
        "schedule_id", F.concat(F.lit("patched "), "schedule_id").alias("name"), F.lit(None).cast("boolean").alias("enabled"))
    flipped = c.filter("c_mktsegment = 'MACHINERY'").select("schedule_id")
    return po.toggle(po.patch_rows(s, patch, "schedule_id"), flipped, "schedule_id").select("schedule_id", "name", "enabled")


@query("p20_control_validation", """
    SELECT 'schedule' AS kind, o_orderkey AS id, CASE
      WHEN o_orderpriority = '1-URGENT' THEN 'one_time_date missing' WHEN o_orderpriority = '5-LOW' THEN 'schedule_type invalid'
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'cron_expression missing' WHEN o_orderpriority = '2-HIGH' THEN 'interval_seconds missing' END AS errors
      FROM orders WHERE o_orderpriority <> '3-MEDIUM'
    UNION ALL SELECT 'site', c_custkey, 'base_url missing,site_id invalid' FROM customer
    UNION ALL SELECT 'feedback', event_id, 'feedback invalid' FROM events WHERE event_type IN ('error', 'click')""")
def control_validation(spark, sf):
    p = F.col("o_orderpriority")
    sched = tb.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), "o_orderkey").alias("name"),
        F.when(p == "1-URGENT", "once").when(p == "5-LOW", "weekly").when(p == "4-NOT SPECIFIED", "cron").otherwise("interval").alias("schedule_type"),
        F.lit(None).cast("timestamp").alias("one_time_date"),
        F.when(p == "3-MEDIUM", 60).when(p == "2-HIGH", 0).alias("interval_seconds"), F.lit("").alias("cron_expression"))
    site = tb.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("site_id"), F.col("c_name").alias("name"), F.lit("").alias("base_url"))
    fb = tb.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_id").alias("log_id"),
        F.when(F.col("event_type") == "error", 5).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "signup", -1)
        .when(F.col("event_type") == "purchase", 0).alias("feedback"))

    def rejected(kind, rows, errors):
        return po.split_valid(rows, errors)[1].select(F.lit(kind).alias("kind"), "id", F.array_join("errors", ",").alias("errors"))

    return (rejected("schedule", sched, po.schedule_errors()).unionByName(rejected("site", site, po.site_errors()))
            .unionByName(rejected("feedback", fb, po.feedback_errors())))


@query("d15_feedback_update", sql("""
    SELECT l.log_id, f.feedback FROM log l LEFT JOIN (
      SELECT user_id, max_by(CASE event_type WHEN 'signup' THEN 1 ELSE -1 END, ts) AS feedback FROM events
      WHERE event_type IN ('signup', 'click') GROUP BY user_id) f ON f.user_id = l.log_id""", "log"))
def feedback_update(spark, sf):
    log = tb.search_log(spark, sf).withColumn("feedback", F.lit(None).cast("int"))
    fb = tb.table(spark, sf, "events").select(
        F.col("user_id").alias("log_id"), "ts",
        F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "click", -1).otherwise(9).alias("feedback"))
    return po.apply_feedback(log, fb).select("log_id", "feedback")


@query("s7_search_log_sink", sql("""
    SELECT log_id, query, search_type, site_id, results_count, execution_time_ms, created_at FROM log""", "log"))
def search_log_sink(spark, sf):
    path = scratch_path(spark, "search-log")
    tables.append_search_log(tb.search_log(spark, sf).withColumn("day", F.to_date("created_at")), path)
    return spark.read.parquet(path).drop("day")


@query("s8_glossary_scan", """
    SELECT n_name AS term, 'nation ' || n_nationkey AS full_name, r_name AS translation, CAST('' AS VARCHAR) AS remarks
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def glossary_scan(spark, sf):
    """One glossary file per region, written and scanned back."""
    n = tb.table(spark, sf, "nation").join(tb.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct(F.concat(F.lit("nation "), "n_nationkey").alias("full_name"), F.col("r_name").alias("translation"), F.lit("").alias("remarks"))
    objects = n.groupBy("n_regionkey").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_name"), entry.alias("e"))))).alias("value"))
    path = scratch_path(spark, "glossary")
    objects.write.partitionBy("n_regionkey").text(path)
    return glossary.read_glossary(spark, path)


_TERMS = r"""
    terms AS (SELECT DISTINCT w AS term, 'full ' || w AS full_name, 'zh ' || w AS translation,
                     CASE WHEN length(w) % 2 = 0 THEN 'even' ELSE '' END AS remarks
              FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark) x)"""


def _terms(spark, sf):
    w = tb.table(spark, sf, "benchmark").select(F.explode(tx.terms(F.col("text"))).alias("term")).distinct()
    return w.select("term", F.concat(F.lit("full "), "term").alias("full_name"), F.concat(F.lit("zh "), "term").alias("translation"),
                    F.when(F.length("term") % 2 == 0, "even").otherwise("").alias("remarks"))


@query("j7_glossary_matches", f"""
    WITH {_TERMS} SELECT c.conv_id, c.turn, t.term FROM conversations c JOIN terms t ON contains(lower(c.text), t.term)""")
def glossary_matches(spark, sf):
    return glossary.matches(tb.messages(spark, sf), _terms(spark, sf), ["conv_id", "turn"]).select("conv_id", "turn", "term")


@query("f13_glossary_hints", f"""
    WITH {_TERMS} SELECT c.conv_id, c.turn, chr(10) || 'Hint for specific terms:' || chr(10) || string_agg('- ' || term || ' stands for ' || full_name || ' and ' || translation
       || ' in Chinese.' || CASE WHEN remarks <> '' THEN ' (' || remarks || ')' ELSE '' END, chr(10) ORDER BY term) || chr(10) AS hint
    FROM conversations c JOIN terms t ON contains(lower(c.text), t.term) GROUP BY ALL""")
def glossary_hints(spark, sf):
    return glossary.hints(glossary.matches(tb.messages(spark, sf), _terms(spark, sf), ["conv_id", "turn"]), ["conv_id", "turn"])


@query("w10_last_user_message", """
    SELECT conv_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def last_user_message(spark, sf):
    return glossary.last_message(tb.messages(spark, sf), "user")


@query("f14_flatten_content", "SELECT conv_id, turn, text || chr(10) || role AS text FROM conversations")
def flatten_content(spark, sf):
    parts = F.to_json(F.array(F.struct("text"), F.struct(F.col("role").alias("text"))))
    return tb.messages(spark, sf).select("conv_id", "turn", tx.flatten_content(parts).alias("text"))


@query("f15_rewrite_lines", r"""
    SELECT conv_id, turn, l AS line FROM (
      SELECT conv_id, turn, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS l
      FROM conversations) x""")
def rewrite_lines(spark, sf):
    return tb.messages(spark, sf).select("conv_id", "turn", F.explode(tx.rewrite_lines(F.col("text"))).alias("line"))


_COUNTS = """CAST(sum(CASE event WHEN 'enqueue' THEN 1 WHEN 'dequeue' THEN -1 WHEN 'retry' THEN 1 ELSE 0 END) AS BIGINT) AS pending,
    CAST(sum(CASE event WHEN 'dequeue' THEN 1 WHEN 'complete' THEN -1 WHEN 'fail' THEN -1 WHEN 'retry' THEN -1 ELSE 0 END) AS BIGINT) AS processing,
    count(*) FILTER (event = 'complete') AS completed, count(*) FILTER (event = 'fail') AS failed, count(*) FILTER (event = 'retry') AS retries"""


@query("a5a_counter_metrics", sql(f"""
    SELECT queue, {_COUNTS}, round(floor(sum(CASE WHEN event = 'complete' THEN processing_time ELSE 0 END)) / count(*) FILTER (event = 'complete'), 6) AS avg_processing_time
    FROM tasks GROUP BY queue""", "tasks"))
def counter_metrics(spark, sf):
    return qu.counter_metrics(tb.task_events(spark, sf)).withColumn("avg_processing_time", F.round("avg_processing_time", 6))


_RECENT = """recent AS (SELECT queue, avg(processing_time) AS a FROM (
      SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts DESC, seq DESC) AS r FROM tasks WHERE event = 'complete') x WHERE r <= 100 GROUP BY queue)"""


@query("a5b_list_metrics", sql(f"""
    WITH {_RECENT} SELECT t.*, round(r.a, 6) AS avg_processing_time FROM (
      SELECT queue, {_COUNTS}, max(ts) AS last_activity FROM tasks GROUP BY queue) t JOIN recent r ON r.queue = t.queue""", "tasks"))
def list_metrics(spark, sf):
    return qu.list_metrics(tb.task_events(spark, sf)).withColumn("avg_processing_time", F.round("avg_processing_time", 6))


@query("w3_recent_mean", sql(f"WITH {_RECENT} SELECT queue, round(a, 6) AS avg_processing_time FROM recent", "tasks"))
def recent_mean(spark, sf):
    e = tb.task_events(spark, sf).filter("event = 'complete'")
    return qu.recent_mean(e).withColumn("avg_processing_time", F.round("avg_processing_time", 6))


_SNAP = "snap AS (SELECT 'q' || (user_id % 4) AS queue, ts, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS processing FROM events)"


def _snapshots(spark, sf):
    return tb.table(spark, sf, "events").select(
        F.concat(F.lit("q"), F.pmod("user_id", F.lit(4))).alias("queue"), "ts", F.col("event_id").alias("seq"),
        (F.get_json_object("props", "$.k").cast("int") % 2).alias("processing"))


@query("w4_bounded_history", f"""
    WITH {_SNAP} SELECT queue, seq, processing, CAST(r AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts DESC, seq DESC) AS r FROM snap) x WHERE r <= 100""")
def bounded_history(spark, sf):
    return qu.history(_snapshots(spark, sf)).select("queue", "seq", "processing", "rank")


@query("w5_stalled", f"""
    WITH {_SNAP}, p AS (SELECT *, lag(processing) OVER w AS pp, lag(ts) OVER w AS pt FROM snap WINDOW w AS (PARTITION BY queue ORDER BY ts, seq))
    SELECT queue, seq, coalesce(processing > 0 AND processing = pp AND (epoch_us(ts) - epoch_us(pt)) / 1e6 > 900, false) AS stalled FROM p""")
def stalled(spark, sf):
    return qu.stalled(_snapshots(spark, sf), 900).select("queue", "seq", "stalled")


_HEALTH = f"""m AS (SELECT queue, {_COUNTS} FROM tasks GROUP BY queue),
    flags AS (SELECT *, pending > 10 AS backlog_warning, failed / (completed + failed) AS error_rate, failed / (completed + failed) > 0.5 AS error_rate_warning FROM m)"""


@query("a6_queue_health", sql(f"""
    WITH {_HEALTH} SELECT queue, pending, failed, backlog_warning, error_rate_warning, NOT (backlog_warning OR error_rate_warning) AS healthy,
      CASE WHEN backlog_warning THEN '队列积压任务过多 (' || pending || '>10). ' ELSE '' END ||
      CASE WHEN error_rate_warning THEN '队列错误率过高 (' || format('{{:.2f}}', error_rate * 100) || '%>50.00%). ' ELSE '' END AS message FROM flags""", "tasks"))
def queue_health(spark, sf):
    h = qu.health(qu.counter_metrics(tb.task_events(spark, sf)), 10, 0.5)
    return h.select("queue", "pending", "failed", "backlog_warning", "error_rate_warning", "healthy", "message")


@query("a7_health_summary", sql(f"""
    WITH {_HEALTH} SELECT count(*) AS total_queues, count(*) FILTER (backlog_warning OR error_rate_warning) AS unhealthy_queues,
      CAST(sum(pending) AS BIGINT) AS total_pending, CAST(sum(processing) AS BIGINT) AS total_processing, CAST(sum(failed) AS BIGINT) AS total_failed FROM flags""", "tasks"))
def health_summary(spark, sf):
    return qu.summary(qu.health(qu.counter_metrics(tb.task_events(spark, sf)), 10, 0.5))


@query("a7_unhealthy_details", sql(f"""
    WITH {_HEALTH}, {_SNAP},
    p AS (SELECT *, lag(processing) OVER w AS pp, lag(ts) OVER w AS pt FROM snap WINDOW w AS (PARTITION BY queue ORDER BY ts, seq)),
    still AS (SELECT queue, max((epoch_us(ts) - epoch_us(pt)) / 1e6) AS gap FROM p
      WHERE processing > 0 AND processing = pp AND (epoch_us(ts) - epoch_us(pt)) / 1e6 > 900 GROUP BY queue)
    SELECT f.queue, pending, f.processing, round(coalesce(error_rate, 0), 6) AS error_rate, gap IS NOT NULL AS stalled,
      CASE WHEN backlog_warning THEN '队列积压任务过多 (' || pending || '>10). ' ELSE '' END ||
      CASE WHEN error_rate_warning THEN '队列错误率过高 (' || format('{{:.2f}}', error_rate * 100) || '%>50.00%). ' ELSE '' END ||
      CASE WHEN gap IS NOT NULL THEN '队列处理活动长时间无变化 (' || CAST(floor(gap) AS BIGINT) || '秒). ' ELSE '' END AS message
    FROM flags f LEFT JOIN still s ON s.queue = f.queue WHERE backlog_warning OR error_rate_warning OR gap IS NOT NULL""", "tasks"))
def unhealthy_details(spark, sf):
    metrics = qu.counter_metrics(tb.task_events(spark, sf))
    listed = qu.unhealthy(qu.health(metrics, 10, 0.5, qu.longest_stalls(_snapshots(spark, sf), 900)))
    return listed.withColumn("error_rate", F.round("error_rate", 6))


@query("a8_run_summary", sql("""
    SELECT task_id, count(*) FILTER (event = 'complete') AS crawled, count(*) FILTER (event = 'fail') AS failed,
      count(*) FILTER (event = 'enqueue') AS queued, min(ts) AS started_at, max(ts) AS ended_at,
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration_seconds FROM tasks GROUP BY task_id""", "tasks"))
def run_summary(spark, sf):
    return qu.run_summary(tb.task_events(spark, sf)).withColumn("duration_seconds", F.round("duration_seconds", 6))


@query("a8_failure_reasons", """
    SELECT CAST(user_id AS VARCHAR) AS task_id, 'code ' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) AS error, count(*) AS n
    FROM events WHERE event_type = 'error' GROUP BY ALL""")
def failure_reasons(spark, sf):
    e = tb.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("task_id"), F.when(F.col("event_type") == "error", "fail").alias("event"),
        F.concat(F.lit("code "), F.get_json_object("props", "$.k").cast("bigint") % 5).alias("error"))
    return qu.failure_reasons(e)


@query("a11_stage_shares", """
    SELECT user_id AS query_id, round(sum(value), 6) AS total_ms,
      round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) / sum(value) * 100, 6) AS view_share,
      round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) / sum(value) * 100, 6) AS click_share FROM events GROUP BY user_id""")
def stage_shares(spark, sf):
    t = tb.table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    s = qu.stage_shares(t, ["view", "click"])
    return s.select("query_id", *[F.round(c, 6).alias(c) for c in ("total_ms", "view_share", "click_share")])


@query("a13_progress", sql(f"""
    SELECT task_id, round(least(100.0, completed / greatest(1, pending + processing + completed + failed) * 100), 6) AS progress
    FROM (SELECT task_id, {_COUNTS} FROM tasks GROUP BY task_id) x""", "tasks"))
def progress(spark, sf):
    m = qu.counter_metrics(tb.task_events(spark, sf), by=("task_id",))
    return qu.with_progress(m).select("task_id", F.round("progress", 6).alias("progress"))


@query("a15_throughput", sql("""
    SELECT date_trunc('hour', ts) AS window_start, count(*) FILTER (event = 'complete') AS completed, count(*) FILTER (event = 'fail') AS failed,
      CAST(sum(CASE event WHEN 'enqueue' THEN 1 WHEN 'dequeue' THEN -1 WHEN 'retry' THEN 1 ELSE 0 END) AS BIGINT) AS backlog_change,
      round(count(*) FILTER (event = 'complete') / 3600, 9) AS urls_per_second FROM tasks GROUP BY 1""", "tasks"))
def throughput(spark, sf):
    return qu.throughput(tb.task_events(spark, sf)).withColumn("urls_per_second", F.round("urls_per_second", 9))


@query("a15_recent_urls", sql("SELECT seq, task_id, ts FROM tasks ORDER BY ts DESC, seq DESC LIMIT 20", "tasks"))
def recent_urls(spark, sf):
    return qu.recent_urls(tb.task_events(spark, sf)).select("seq", "task_id", "ts")


@query("a16_task_completion", sql(f"""
    SELECT task_id, pending, processing, completed, failed, CASE WHEN pending <= 0 AND processing <= 0 THEN 'completed' ELSE 'running' END AS status,
      CASE WHEN pending <= 0 AND processing <= 0 THEN t END AS completed_at FROM (SELECT task_id, {_COUNTS}, max(ts) AS t FROM tasks GROUP BY task_id) x""", "tasks"))
def task_completion(spark, sf):
    return qu.task_status(tb.task_events(spark, sf)).select(
        "task_id", "pending", "processing", "completed", "failed", "status", "completed_at")


@query("j14_site_status", sql(f"""
    WITH s AS (SELECT *, 'site_' || (CAST(task_id AS BIGINT) % 20) AS site_id FROM tasks),
    c AS (SELECT site_id, {_COUNTS} FROM s GROUP BY site_id),
    r AS (SELECT site_id, bool_or(NOT (pending <= 0 AND processing <= 0)) AS active FROM (SELECT site_id, task_id, {_COUNTS} FROM s GROUP BY ALL) x GROUP BY site_id)
    SELECT t.site_id, t.name, t.enabled, coalesce(pending, 0) AS pending, coalesce(processing, 0) AS processing, coalesce(completed, 0) AS completed,
      coalesce(failed, 0) AS failed, coalesce(retries, 0) AS retries, CASE WHEN active THEN 'active' ELSE 'idle' END AS status
    FROM sites t LEFT JOIN c ON c.site_id = t.site_id LEFT JOIN r ON r.site_id = t.site_id""", "tasks", "sites"))
def site_status(spark, sf):
    site = F.concat(F.lit("site_"), F.col("task_id").cast("bigint") % 20)
    e = tb.task_events(spark, sf).withColumn("site_id", site)
    running = qu.task_status(e).withColumn("site_id", site)
    return qu.site_status(tb.sites(spark, sf), e, running)


_STATES = """seen AS (SELECT *, lag(event) OVER (PARTITION BY task_id ORDER BY ts, seq) AS prev FROM tasks),
    eff AS (SELECT *, CASE event WHEN 'enqueue' THEN 'pending' WHEN 'dequeue' THEN 'processing' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'retry' END AS st
            FROM seen WHERE event <> 'complete' OR prev = 'dequeue')"""
STATES_SQL = sql(f"""
    WITH {_STATES} SELECT task_id, arg_max(st, (ts, seq)) AS status, count(*) FILTER (event = 'retry') AS retry_count,
      min(ts) FILTER (event = 'enqueue') AS created_at, max(ts) FILTER (event = 'dequeue') AS started_at,
      max(ts) FILTER (event = 'complete') AS completed_at, max(ts) AS updated_at FROM eff GROUP BY task_id""", "tasks")


@query("t4_task_states_batch", STATES_SQL)
def task_states(spark, sf):
    return qu.task_states(tb.task_events(spark, sf))


SESSIONS_SQL = """
    SELECT user_id AS session_id, max(ts) AS last_activity, count(*) AS events, max(ts) < TIMESTAMP '2024-01-29' AS expired FROM events GROUP BY user_id"""


@query("t7_idle_sessions_batch", SESSIONS_SQL)
def idle_sessions(spark, sf):
    e = tb.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "ts")
    return qu.idle_sessions(e, F.lit("2024-01-30").cast("timestamp"), 24)


@query("f19_relative_dates", """
    SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN '今天 ' || strftime(ts, '%H:%M')
      WHEN ts >= TIMESTAMP '2024-01-19' THEN '昨天 ' || strftime(ts, '%H:%M') ELSE month(ts) || '/' || day(ts) END AS label,
      year(ts) || '/' || month(ts) || '/' || day(ts) AS older FROM events""")
def relative_dates(spark, sf):
    ts = F.col("ts")
    return tb.table(spark, sf, "events").select(
        "event_id", labels.relative_date(ts, F.lit("2024-01-20 12:00:00").cast("timestamp")).alias("label"),
        labels.relative_date(ts, F.lit("2025-06-01").cast("timestamp")).alias("older"))


@query("f20_duration_labels", """
    SELECT event_id, CASE WHEN value < 0.001 THEN format('{:.2f}µs', value * 1000000) WHEN value < 1 THEN format('{:.2f}ms', value * 1000)
      WHEN value < 60 THEN format('{:.2f}秒', value)
      ELSE CAST(floor(value / 60) AS BIGINT) || '分' || CAST(floor(value % 60 + 0.5) AS BIGINT) || '秒' END AS label FROM events""")
def duration_labels(spark, sf):
    return tb.table(spark, sf, "events").select("event_id", labels.duration(F.col("value")).alias("label"))


@query("f21_score_percent", """
    SELECT d.doc_id, CAST(floor(n_chars / 20000.0 * 100 + 0.5) AS BIGINT) AS percent, substr(text, 1, 200) || '...' AS shown FROM documents d""")
def score_percent(spark, sf):
    return tb.table(spark, sf, "documents").select(
        "doc_id", labels.score_percent(F.col("n_chars") / 20000.0).alias("percent"),
        F.concat(F.substring("text", 1, 200), F.lit("...")).alias("shown"))


@query("t9_retry_requeue", """
    SELECT event_id, CAST(user_id // 40 + 1 AS INTEGER) AS retry_count FROM events WHERE event_type = 'error' AND user_id // 40 < 3""")
def retry_requeue(spark, sf):
    failed = tb.table(spark, sf, "events").filter("event_type = 'error'").select(
        "event_id", F.floor(F.col("user_id") / 40).cast("int").alias("retry_count"))
    return qu.next_attempts(failed, 3)
