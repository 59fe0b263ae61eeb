"""Usage statistics over a log of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly(log: DataFrame) -> DataFrame:
    """(ts, tool, n_findings) to month, tool, scans, findings."""
    return log.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "tool").agg(F.count("*").alias("scans"), F.sum("n_findings").cast("bigint").alias("findings"))


def daily_grades(log: DataFrame, keep: int = 90) -> DataFrame:
    """Score of the last scan of each of the last ``keep`` days that have one; days are few, so one task ranks them."""
    per_day = log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max_by("score", F.struct("ts", "scan_id")).alias("score"))
    return per_day.orderBy(F.desc("day")).limit(keep)


def month_trend(log: DataFrame) -> DataFrame:
    """First and last score of a month: improving, declining or stable."""
    m = log.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.min_by("score", F.struct("ts", "scan_id")).alias("first_score"), F.max_by("score", F.struct("ts", "scan_id")).alias("last_score")
    )
    trend = F.when(F.col("last_score") > F.col("first_score"), "improving").when(F.col("last_score") < F.col("first_score"), "declining").otherwise("stable")
    return m.select("month", "first_score", "last_score", trend.alias("trend"))
