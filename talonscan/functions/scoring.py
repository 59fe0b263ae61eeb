"""Severity ranks, scores and grades as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity order, score weights and grade bounds.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
WEIGHTS = {"critical": 15.0, "high": 5.0, "medium": 0.5}
STAGED_WEIGHTS = {"critical": 10, "high": 3, "medium": 1}
GRADES = [(90, "A"), (75, "B"), (50, "C"), (25, "D")]
CAPS = [("critical", 60), ("high", 75)]


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info; null for anything else."""
    rank = F.lit(None).cast("int")
    for n, s in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == s, F.lit(n)).otherwise(rank)
    return rank


def severity_counts(severity: Column) -> list[Column]:
    """One count aggregate for each severity."""
    return [F.count_if(severity == s).alias(s) for s in SEVERITIES]


def score(critical: Column, high: Column, medium: Column, files: Column, model: str = "linear") -> Column:
    """0 to 100 by weighted findings per file; capped where something critical or high is left."""
    density = (critical * WEIGHTS["critical"] + high * WEIGHTS["high"] + medium * WEIGHTS["medium"]) / F.greatest(files, F.lit(1))
    raw = 100 - F.least(density, F.lit(5.0)) * 20 if model == "linear" else 100 * F.exp(-density / 3)
    out = F.greatest(F.floor(raw + 0.5), F.lit(0))
    return F.when(critical > 0, F.least(out, F.lit(CAPS[0][1]))).when(high > 0, F.least(out, F.lit(CAPS[1][1]))).otherwise(out).cast("bigint")


def grade(points: Column) -> Column:
    out = F.lit("F")
    for least, letter in reversed(GRADES):
        out = F.when(points >= least, letter).otherwise(out)
    return out


def staged_score(critical: Column, high: Column, medium: Column, scanned: Column) -> Column:
    """0 to 100 by weighted findings per scanned file; no caps."""
    lost = critical * STAGED_WEIGHTS["critical"] + high * STAGED_WEIGHTS["high"] + medium * STAGED_WEIGHTS["medium"]
    points = F.floor(100 - lost / F.greatest(scanned, F.lit(1)) * 20 + 0.5)
    return F.greatest(points, F.lit(0)).cast("bigint")
