"""Exceptions, ignores, gates and verdicts of policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talonscan.functions.patterns import glob_regex
from talonscan.functions.scoring import SEVERITIES, severity_rank


def excepted(rule: Column, file: Column, exceptions: list[dict], as_of: str) -> Column:
    """True where an exception {rule, globs, expires} covers a finding at the time ``as_of``; rule * is any rule.

    A policy is a hand-written file of the project, so it becomes an expression and nothing is joined.
    """
    out = F.lit(False)
    for e in exceptions:
        hit = F.lit(True) if e["rule"] == "*" else rule == e["rule"]
        if e.get("expires"):
            hit = hit & (F.to_timestamp(F.lit(e["expires"])) >= F.to_timestamp(F.lit(as_of)))
        globs = [file.rlike(glob_regex(g)) for g in e.get("globs") or []]
        for n, g in enumerate(globs):
            globs[0] = g if n == 0 else globs[0] | g
        out = out | (hit & globs[0] if globs else hit)
    return out


def ignored(rule: Column, file: Column, ignores: list[tuple[str, str | None]]) -> Column:
    """True where an ignore entry (rule, glob or None) covers a finding; globs match anywhere in the path."""
    out = F.lit(False)
    for r, g in ignores:
        hit = rule == r
        out = out | (hit & file.rlike(glob_regex(g, anchored=False)) if g else hit)
    return out


def gate(findings: DataFrame, by: str, threshold: str = "high") -> DataFrame:
    """Whether anything at or above the threshold blocks."""
    bad = severity_rank(F.col("severity")) <= SEVERITIES.index(threshold)
    counts = findings.groupBy(by).agg(F.count_if(bad).alias("blocking"), F.count("*").alias("total"))
    return counts.withColumn("blocked", F.col("blocking") > 0)


def audit_verdict(critical: Column, high: Column) -> Column:
    return F.when(critical > 0, "FAIL").when(high > 0, "WARN").otherwise("PASS")


def coverage_percent(scanned: Column, skipped: Column) -> Column:
    """Rounded share of files that were read; 0 of none."""
    total = scanned + skipped
    return F.when(total > 0, F.floor(scanned * 100 / total + 0.5)).otherwise(0).cast("bigint")
