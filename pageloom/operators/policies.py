"""Crawl and refresh policies, schedules and other control rows.

Every job takes ``now`` as a column, so that a run can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as u
from ..schemas import SCHEDULE_TYPES

# Reasons shown for a due policy.
NEVER_RUN = "策略从未执行过"
ONCE_DUE = "单次执行时间已到"
INTERVAL_DUE = "间隔执行时间已到 (间隔%d秒)"
INTERVAL_NEVER = "间隔执行且从未执行过"
CRON_DUE = "Cron表达式执行时间已到"
REFRESH_NEVER = "刷新策略从未执行过"
REFRESH_DUE = "刷新间隔时间已到"


def seconds(n: Column) -> Column:
    return F.make_dt_interval(secs=n)


def days(n: Column) -> Column:
    return F.make_dt_interval(days=n)


def due_reason(now: Column, last_executed: str = "last_executed") -> Column:
    """Why a schedule is due, or NULL; run count and dates set its bounds."""
    last = F.coalesce(F.col("last_run"), F.col(last_executed))
    elapsed = F.unix_micros(now) - F.unix_micros(last)
    open_now = (
        (F.coalesce("run_count", F.lit(0)) < F.coalesce("max_runs", F.lit(2**31 - 1)))
        & (F.coalesce(F.col("start_date"), now) <= now)
        & (F.coalesce(F.col("end_date"), now) >= now)
    )
    kind = F.col("schedule_type")
    return F.when(
        open_now,
        F.when(
            (kind == "once") & (F.col("one_time_date") <= now) & F.col("last_run").isNull(), F.lit(ONCE_DUE)
        )
        .when((kind == "interval") & (F.col("interval_seconds") > 0) & last.isNull(), F.lit(INTERVAL_NEVER))
        .when(
            (kind == "interval") & (elapsed >= F.col("interval_seconds") * 1_000_000),
            F.format_string(INTERVAL_DUE, "interval_seconds"),
        )
        .when((kind == "cron") & (F.col("next_run") <= now), F.lit(CRON_DUE)),
    )


def due_crawls(policies: DataFrame, schedules: DataFrame, now: Column) -> DataFrame:
    """Enabled crawl policies that are due, with the reason of their first due schedule."""
    active = policies.filter("enabled")
    executed = active.filter(F.col("last_executed").isNotNull()).select("policy_id", "last_executed")
    hits = (
        schedules.filter("enabled")
        .join(executed, "policy_id")
        .withColumn("_reason", due_reason(now))
        .filter(F.col("_reason").isNotNull())
        .groupBy("policy_id")
        .agg(F.min_by("_reason", "schedule_id").alias("_reason"))
    )
    reason = F.when(F.col("last_executed").isNull(), F.lit(NEVER_RUN)).otherwise(F.col("_reason"))
    return (
        active.join(hits, "policy_id", "left").withColumn("reason", reason)
        .filter(F.col("reason").isNotNull()).drop("_reason")
    )


def due_refreshes(refresh: DataFrame, now: Column) -> DataFrame:
    reason = F.when(F.col("last_refresh").isNull(), F.lit(REFRESH_NEVER)).when(
        F.col("next_refresh") <= now, F.lit(REFRESH_DUE)
    )
    return refresh.filter("enabled").withColumn("reason", reason).filter(F.col("reason").isNotNull())


def due_by_site(
    sites: DataFrame, policies: DataFrame, schedules: DataFrame, refresh: DataFrame, now: Column
) -> DataFrame:
    """(site_id, site_name, policy_type, policy_id, name, reason) of all that is due."""
    names = sites.select("site_id", F.col("name").alias("site_name"))
    cols = ["site_id", "site_name", "policy_type", "policy_id", "name", "reason"]
    crawl = due_crawls(policies, schedules, now).withColumn("policy_type", F.lit("crawl"))
    again = due_refreshes(refresh, now).withColumn("policy_type", F.lit("refresh")).withColumn(
        "policy_id", F.col("refresh_id")
    )
    return names.join(crawl, "site_id").select(*cols).unionByName(names.join(again, "site_id").select(*cols))


def first_next_run(now: Column) -> Column:
    """Next run of a schedule that was just created."""
    kind = F.col("schedule_type")
    return (
        F.when(kind == "once", F.col("one_time_date"))
        .when((kind == "interval") & F.col("start_date").isNotNull(), F.greatest(F.col("start_date"), now))
        .when((kind == "interval") & (F.col("interval_seconds") > 0), now + seconds(F.col("interval_seconds")))
        .otherwise(F.col("next_run"))
    )


def changed_next_run(now: Column) -> Column:
    """Next run of a schedule that was changed or enabled again."""
    kind, step = F.col("schedule_type"), F.col("interval_seconds")
    return (
        F.when(kind == "once", F.col("one_time_date"))
        .when((kind == "interval") & (step > 0) & F.col("last_run").isNotNull(), F.col("last_run") + seconds(step))
        .when((kind == "interval") & (step > 0) & F.col("start_date").isNotNull(), F.greatest(F.col("start_date"), now))
        .when((kind == "interval") & (step > 0), now + seconds(step))
        .otherwise(F.col("next_run"))
    )


def next_refresh(last: Column, interval_days: Column, enabled: Column, current: Column) -> Column:
    return F.when(enabled & (interval_days > 0), last + days(interval_days)).otherwise(current)


def mark_executed(policies: DataFrame, due: DataFrame, now: Column) -> DataFrame:
    ran = due.select("policy_id", F.lit(True).alias("_ran"))
    return (
        policies.join(ran, "policy_id", "left")
        .withColumn("last_executed", F.when(F.col("_ran"), now).otherwise(F.col("last_executed")))
        .drop("_ran")
    )


def mark_scheduled(schedules: DataFrame, due: DataFrame, now: Column) -> DataFrame:
    """All enabled schedules of an executed policy: run counted, next run set."""
    ran = due.select("policy_id", F.lit(True).alias("_policy_ran"))
    hit = F.coalesce(F.col("_policy_ran"), F.lit(False)) & F.col("enabled")
    step = F.col("interval_seconds")
    return (
        schedules.join(ran, "policy_id", "left")
        .withColumns(
            {
                "next_run": F.when(
                    hit & (F.col("schedule_type") == "interval") & (step > 0), now + seconds(step)
                ).otherwise(F.col("next_run")),
                "last_run": F.when(hit, now).otherwise(F.col("last_run")),
                "run_count": F.when(hit, F.coalesce("run_count", F.lit(0)) + 1).otherwise(F.col("run_count")),
            }
        )
        .drop("_policy_ran")
    )


def mark_refreshed(refresh: DataFrame, due: DataFrame, now: Column) -> DataFrame:
    ran = due.select("refresh_id", F.lit(True).alias("_ran"))
    hit = F.coalesce(F.col("_ran"), F.lit(False))
    return (
        refresh.join(ran, "refresh_id", "left")
        .withColumns(
            {
                "next_refresh": F.when(
                    hit, next_refresh(now, F.col("refresh_interval_days"), F.col("enabled"), F.col("next_refresh"))
                ).otherwise(F.col("next_refresh")),
                "last_refresh": F.when(hit, now).otherwise(F.col("last_refresh")),
            }
        )
        .drop("_ran")
    )


def execution_report(due: DataFrame, failures: DataFrame) -> DataFrame:
    """Per site: policies executed and failed. ``failures`` has policy_id, policy_type, error."""
    rows = due.join(failures.select("policy_id", "policy_type", "error"), ["policy_id", "policy_type"], "left")
    return rows.groupBy("site_id", "site_name").agg(
        F.count_if(F.col("error").isNull()).alias("executed"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def schedules_of_site(schedules: DataFrame, policies: DataFrame, site_id: str | None = None) -> DataFrame:
    of_site = policies.select("policy_id", "site_id", F.col("name").alias("policy_name"))
    if site_id is not None:
        of_site = of_site.filter(F.col("site_id") == site_id)
    return schedules.join(of_site, "policy_id")


def resolve_refresh(requests: DataFrame, refresh: DataFrame) -> DataFrame:
    """Request value, else policy value, else the default."""
    policy = refresh.select("site_id", F.col("strategy").alias("_strategy"), F.col("max_age_days").alias("_age"))
    return (
        requests.join(policy, "site_id", "left")
        .withColumns(
            {
                "strategy": F.coalesce("strategy", "_strategy", F.lit("incremental")),
                "max_age_days": F.coalesce("max_age_days", "_age", F.lit(30)),
            }
        )
        .drop("_strategy", "_age")
    )


def select_refresh(
    docs: DataFrame, strategy: str = "all", now: Column | None = None, max_age_days: int = 30,
    include: Sequence[str] = (), exclude: Sequence[str] = (), priority: Sequence[str] = (),
) -> DataFrame:
    """Documents to fetch again; ``priority`` 0 comes before 1."""
    if strategy == "incremental":
        docs = docs.filter(F.col("updated_at") < now - days(F.lit(max_age_days)))
    elif strategy == "selective":
        keep = u.any_of(F.col("url").rlike(p) for p in include) if include else F.lit(True)
        docs = docs.filter(keep & ~u.any_of(F.col("url").rlike(p) for p in exclude))
    first = u.any_of(F.col("url").rlike(p) for p in priority)
    return docs.withColumn("priority", F.when(first, 0).otherwise(1))


def patch_rows(table: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Only the fields a patch gives (not NULL) change."""
    fields = [c for c in patch.columns if c != key]
    given = patch.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return table.join(given, key, "left").select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns]
    )


def toggle(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    hit = ids.select(key, F.lit(True).alias("_hit"))
    return (
        table.join(hit, key, "left")
        .withColumn("enabled", F.when(F.col("_hit"), ~F.col("enabled")).otherwise(F.col("enabled")))
        .drop("_hit")
    )


def _errors(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def site_errors() -> Column:
    return _errors(
        (_blank("site_id"), "site_id missing"),
        (_blank("name"), "name missing"),
        (_blank("base_url"), "base_url missing"),
        (~_blank("site_id") & ~F.col("site_id").rlike(r"\A[a-zA-Z0-9_]+\z"), "site_id invalid"),
    )


def schedule_errors() -> Column:
    kind = F.col("schedule_type")
    return _errors(
        (_blank("name"), "name missing"),
        (_blank("schedule_type"), "schedule_type missing"),
        (~_blank("schedule_type") & ~kind.isin(*SCHEDULE_TYPES), "schedule_type invalid"),
        ((kind == "once") & _blank("one_time_date"), "one_time_date missing"),
        ((kind == "interval") & (F.coalesce("interval_seconds", F.lit(0)) == 0), "interval_seconds missing"),
        ((kind == "cron") & _blank("cron_expression"), "cron_expression missing"),
    )


def feedback_errors() -> Column:
    return _errors(
        (_blank("log_id"), "log_id missing"),
        (F.col("feedback").isNull() | ~F.col("feedback").isin(-1, 0, 1), "feedback invalid"),
    )


def split_valid(rows: DataFrame, errors: Column):
    """(valid, rejected with their errors)."""
    marked = rows.withColumn("errors", errors)
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def apply_feedback(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """Set the feedback of search-log rows; invalid feedback changes nothing."""
    valid, _ = split_valid(feedback, feedback_errors())
    last = valid.groupBy("log_id").agg(F.max_by("feedback", "ts").alias("_feedback"))
    return (
        log.join(last, "log_id", "left")
        .withColumn("feedback", F.coalesce("_feedback", "feedback")).drop("_feedback")
    )
