"""Columns for display: dates, durations, percentages, glossary lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels shown to the user.
TODAY, YESTERDAY = "今天 ", "昨天 "
NO_TITLE = "无标题"
SECONDS, MINUTES = "秒", "分"


def relative_date(ts: Column, now: Column) -> Column:
    today = F.date_trunc("day", now)
    return (
        F.when(ts >= today, F.concat(F.lit(TODAY), F.date_format(ts, "HH:mm")))
        .when(
            ts >= today - F.make_dt_interval(days=F.lit(1)),
            F.concat(F.lit(YESTERDAY), F.date_format(ts, "HH:mm")),
        )
        .when(F.year(ts) == F.year(now), F.date_format(ts, "M/d"))
        .otherwise(F.date_format(ts, "yyyy/M/d"))
    )


def duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 0.001, F.format_string("%.2fµs", seconds * 1000000))
        .when(seconds < 1, F.format_string("%.2fms", seconds * 1000))
        .when(seconds < 60, F.format_string(f"%.2f{SECONDS}", seconds))
        .otherwise(
            F.format_string(
                f"%d{MINUTES}%d{SECONDS}",
                F.floor(seconds / 60),
                F.floor(seconds % 60 + 0.5),
            )
        )
    )


def progress(done: Column, total: Column) -> Column:
    return F.least(F.lit(100.0), done / F.greatest(F.lit(1), total) * 100)


def score_percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5)


def glossary_line(term: Column, full_name: Column, translation: Column, remarks: Column) -> Column:
    note = F.when(
        F.coalesce(remarks, F.lit("")) != "", F.concat(F.lit(" ("), remarks, F.lit(")"))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("- "), term, F.lit(" stands for "), full_name, F.lit(" and "), translation,
        F.lit(" in Chinese."), note,
    )
