"""Queue metrics, health and task state, all derived from task events.

A task event table (queue, task_id, event, ts, seq, processing_time) only ever
grows; counts and states are aggregates over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from . import ordered

HOUR = 3600

# Parts of the health message.
BACKLOG_TEXT = "队列积压任务过多 (%d>%d). "
ERROR_TEXT = "队列错误率过高 (%.2f%%>%.2f%%). "
STALLED_TEXT = "队列处理活动长时间无变化 (%d秒). "

# event -> what it adds to each counter
DELTAS = {
    "pending": {"enqueue": 1, "dequeue": -1, "retry": 1},
    "processing": {"dequeue": 1, "complete": -1, "fail": -1, "retry": -1},
    "completed": {"complete": 1},
    "failed": {"fail": 1},
    "retries": {"retry": 1},
}


def delta(counter: str) -> Column:
    column = F.lit(0)
    for event, step in DELTAS[counter].items():
        column = F.when(F.col("event") == event, step).otherwise(column)
    return column


def _counters() -> list[Column]:
    return [F.sum(delta(c)).alias(c) for c in DELTAS]


def counter_metrics(events: DataFrame, by=("queue",)) -> DataFrame:
    """Counters per queue; the mean divides the whole seconds of the total."""
    total = F.sum(F.when(F.col("event") == "complete", F.col("processing_time")).otherwise(0.0))
    return events.groupBy(*by).agg(*_counters(), total.alias("_total")).withColumn(
        "avg_processing_time",
        F.when(F.col("completed") > 0, F.floor("_total") / F.col("completed")).otherwise(F.lit(0.0)),
    ).drop("_total")


def recent_mean(times: DataFrame, key: str = "queue", size: int = 100) -> DataFrame:
    """Mean of the most recent ``size`` processing times per key."""
    recent = ordered.top_per_key(times, [key], [F.col("ts").desc(), F.col("seq").desc()], size)
    return recent.groupBy(key).agg(F.avg("processing_time").alias("avg_processing_time"))


def list_metrics(events: DataFrame, key: str = "queue", size: int = 100) -> DataFrame:
    """Counters, mean of the last processing times, last activity."""
    counts = events.groupBy(key).agg(*_counters(), F.max("ts").alias("last_activity"))
    recent = recent_mean(events.filter(F.col("event") == "complete"), key, size)
    return counts.join(recent, key, "left").withColumn(
        "avg_processing_time", F.coalesce("avg_processing_time", F.lit(0.0))
    )


def history(snapshots: DataFrame, key: str = "queue", size: int = 100) -> DataFrame:
    """The last ``size`` snapshots of each queue."""
    return ordered.top_per_key(snapshots, [key], [F.col("ts").desc(), F.col("seq").desc()], size)


def stalled(snapshots: DataFrame, timeout_seconds: float, bucket: Column | None = None) -> DataFrame:
    """Snapshots with work in hand, unchanged since a check longer ago than the timeout."""
    bucket = F.date_trunc("hour", "ts") if bucket is None else bucket
    seen = ordered.with_previous(
        snapshots, ["queue"], ["ts", "seq"], bucket, {"prev_processing": "processing", "prev_ts": "ts"}
    )
    gap = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / 1e6
    return seen.withColumns(
        {
            "gap_seconds": gap,
            "stalled": F.coalesce(
                (F.col("processing") > 0) & (F.col("processing") == F.col("prev_processing")) & (gap > timeout_seconds),
                F.lit(False),
            ),
        }
    )


def health(
    metrics: DataFrame, max_pending: int = 1000, max_error_rate: float = 0.1, stall: DataFrame | None = None
) -> DataFrame:
    """Flags and message per queue; ``stall`` adds (queue, stalled, gap_seconds)."""
    rows = metrics if stall is None else metrics.join(stall.select("queue", "stalled", "gap_seconds"), "queue", "left")
    is_stalled = F.lit(False) if stall is None else F.coalesce("stalled", F.lit(False))
    ended = F.col("completed") + F.col("failed")
    rate = F.when(ended > 0, F.col("failed") / ended).otherwise(F.lit(0.0))
    rows = rows.withColumns(
        {
            "backlog_warning": F.col("pending") > max_pending,
            "error_rate": rate,
            "error_rate_warning": rate > max_error_rate,
            "stalled": is_stalled,
        }
    )
    message = F.concat(
        F.when(F.col("backlog_warning"), F.format_string(BACKLOG_TEXT, "pending", F.lit(max_pending))).otherwise(""),
        F.when(
            F.col("error_rate_warning"),
            F.format_string(ERROR_TEXT, F.col("error_rate") * 100, F.lit(max_error_rate * 100)),
        ).otherwise(""),
        F.when(
            F.col("stalled"),
            F.format_string(STALLED_TEXT, F.floor("gap_seconds") if stall is not None else F.lit(0)),
        ).otherwise(""),
    )
    return rows.withColumns(
        {
            "message": message,
            "healthy": ~(F.col("backlog_warning") | F.col("error_rate_warning") | F.col("stalled")),
        }
    )


def summary(healths: DataFrame) -> DataFrame:
    """Totals over all queues; ``unhealthy`` has the details."""
    return healths.agg(
        F.count(F.lit(1)).alias("total_queues"),
        F.count_if(~F.col("healthy")).alias("unhealthy_queues"),
        F.sum("pending").alias("total_pending"),
        F.sum("processing").alias("total_processing"),
        F.sum("failed").alias("total_failed"),
    )


def unhealthy(healths: DataFrame) -> DataFrame:
    """A row for each unhealthy queue: what waits, its error rate and why it is listed."""
    return healths.filter(~F.col("healthy")).select("queue", "pending", "processing", "error_rate", "stalled", "message")


def longest_stalls(snapshots: DataFrame, timeout_seconds: float) -> DataFrame:
    """(queue, stalled, gap_seconds) of queues that stood still, as ``health`` takes it: the longest gap of each."""
    seen = stalled(snapshots, timeout_seconds).filter("stalled")
    return seen.groupBy("queue").agg(F.max("gap_seconds").alias("gap_seconds"), F.lit(True).alias("stalled"))


def run_summary(events: DataFrame) -> DataFrame:
    """Per task: crawled, failed and queued URLs, start, end, seconds."""
    return events.groupBy("task_id").agg(
        F.count_if(F.col("event") == "complete").alias("crawled"),
        F.count_if(F.col("event") == "fail").alias("failed"),
        F.count_if(F.col("event") == "enqueue").alias("queued"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
    ).withColumn(
        "duration_seconds", (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6
    )


def failure_reasons(events: DataFrame, reason: str = "error") -> DataFrame:
    return (
        events.filter(F.col("event") == "fail").groupBy("task_id", reason)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def task_status(events: DataFrame) -> DataFrame:
    """A task with nothing pending and nothing in hand is completed."""
    rows = events.groupBy("task_id").agg(*_counters(), F.max("ts").alias("last_activity"))
    done = (F.col("pending") <= 0) & (F.col("processing") <= 0)
    return rows.withColumns(
        {
            "status": F.when(done, F.lit("completed")).otherwise(F.lit("running")),
            "completed_at": F.when(done, F.col("last_activity")),
        }
    )


def with_progress(metrics: DataFrame) -> DataFrame:
    total = F.col("pending") + F.col("processing") + F.col("completed") + F.col("failed")
    return metrics.withColumn("progress", labels.progress(F.col("completed"), total))


def site_status(sites: DataFrame, events: DataFrame, running: DataFrame) -> DataFrame:
    """Per site: counters of its queue, and active while a task of it runs."""
    counts = events.groupBy("site_id").agg(*_counters())
    active = running.groupBy("site_id").agg(F.max(F.col("status") == "running").alias("_active"))
    rows = sites.select("site_id", "name", "enabled").join(counts, "site_id", "left").join(active, "site_id", "left")
    return rows.select(
        "site_id", "name", "enabled",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in DELTAS],
        F.when(F.coalesce("_active", F.lit(False)), F.lit("active")).otherwise(F.lit("idle")).alias("status"),
    )


def stage_shares(timings: DataFrame, stages: list[str], key: str = "query_id") -> DataFrame:
    """Milliseconds per stage and their share of the total, one row per query."""
    sums = timings.groupBy(key).agg(
        *[F.sum(F.when(F.col("stage") == s, F.col("ms")).otherwise(0.0)).alias(f"{s}_ms") for s in stages],
        F.sum("ms").alias("total_ms"),
    )
    return sums.withColumns(
        {
            f"{s}_share": F.when(F.col("total_ms") > 0, F.col(f"{s}_ms") / F.col("total_ms") * 100).otherwise(F.lit(0.0))
            for s in stages
        }
    )


def throughput(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Completed URLs per second, failures and backlog change per time window."""
    return (
        events.groupBy(F.window("ts", window).alias("_w"))
        .agg(
            F.count_if(F.col("event") == "complete").alias("completed"),
            F.count_if(F.col("event") == "fail").alias("failed"),
            F.sum(delta("pending")).alias("backlog_change"),
        )
        .select(
            F.col("_w.start").alias("window_start"), "completed", "failed", "backlog_change",
            (F.col("completed") / ((F.unix_micros("_w.end") - F.unix_micros("_w.start")) / 1e6)).alias("urls_per_second"),
        )
    )


def recent_urls(events: DataFrame, n: int = 20) -> DataFrame:
    return events.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(n)


STATUS_AFTER = {
    "enqueue": "pending", "dequeue": "processing", "complete": "completed", "fail": "failed", "retry": "retry",
}


def task_states(events: DataFrame, bucket: Column | None = None) -> DataFrame:
    """State of each task after all its events.

    Completing counts only for a task in hand, that is directly after a
    dequeue; any other completion leaves the task as it was.
    """
    bucket = F.date_trunc("day", "ts") if bucket is None else bucket
    seen = ordered.with_previous(events, ["task_id"], ["ts", "seq"], bucket, {"_prev": "event"})
    status = F.lit(None).cast("string")
    for event, after in STATUS_AFTER.items():
        status = F.when(F.col("event") == event, after).otherwise(status)
    counts = (F.col("event") != "complete") | F.col("_prev").eqNullSafe("dequeue")
    return (
        seen.filter(counts).withColumn("_status", status)
        .groupBy("task_id")
        .agg(
            F.max_by("_status", F.struct("ts", "seq")).alias("status"),
            F.count_if(F.col("event") == "retry").alias("retry_count"),
            F.min(F.when(F.col("event") == "enqueue", F.col("ts"))).alias("created_at"),
            F.max(F.when(F.col("event") == "dequeue", F.col("ts"))).alias("started_at"),
            F.max(F.when(F.col("event") == "complete", F.col("ts"))).alias("completed_at"),
            F.max("ts").alias("updated_at"),
        )
    )


def next_attempts(failures: DataFrame, max_retries: int) -> DataFrame:
    """Failed rows to queue again, while their retry count allows it."""
    return failures.filter(F.coalesce("retry_count", F.lit(0)) < max_retries).withColumn(
        "retry_count", F.coalesce("retry_count", F.lit(0)) + 1
    )


def idle_sessions(sessions: DataFrame, now: Column, max_age_hours: int = 24) -> DataFrame:
    """(session_id, ts) rows to sessions with last activity and expiry flag."""
    last = sessions.groupBy("session_id").agg(F.max("ts").alias("last_activity"), F.count(F.lit(1)).alias("events"))
    return last.withColumn(
        "expired", F.col("last_activity") < now - F.make_dt_interval(hours=F.lit(max_age_hours))
    )
