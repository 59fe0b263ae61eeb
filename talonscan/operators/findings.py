"""Operators on findings: (file, line, rule_id, severity, name, match_pos).

All are declarative plans: aggregates combine before the shuffle, top-k is pruned in each task, and joins are equi joins that
Catalyst may broadcast by measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talonscan.functions.scoring import grade, score, severity_counts, severity_rank


def severity_pivot(findings: DataFrame, by: str) -> DataFrame:
    return findings.groupBy(by).agg(*severity_counts(F.col("severity")), F.count("*").alias("total"))


def file_ranking(findings: DataFrame, k: int = 10) -> DataFrame:
    """The k files with most findings; ties by name."""
    return findings.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(k)


def rule_ranking(findings: DataFrame, k: int = 5) -> DataFrame:
    """The k worst rules: by severity, then occurrences, then id; with distinct files."""
    stats = findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
    return stats.orderBy(severity_rank(F.col("severity")), F.desc("n"), "rule_id").limit(k)


def exact_dedup(findings: DataFrame) -> DataFrame:
    """The first finding of a rule on a line, by position in the file; a minimum, which combines before the shuffle."""
    rest = [c for c in findings.columns if c not in ("file", "line", "rule_id", "match_pos", "severity")]
    first = F.min(F.struct("match_pos", "severity", *rest)).alias("_f")
    return findings.groupBy("file", "line", "rule_id").agg(first).select(*[F.col(c) if c in ("file", "line", "rule_id") else F.col(f"_f.{c}") for c in findings.columns])


def dominated_dedup(findings: DataFrame) -> DataFrame:
    """Drops a finding if a more specific rule of its duplicate class (column dup_class) hits the same line."""
    best = F.max("specificity").over(Window.partitionBy("file", "line", "dup_class"))
    return findings.withColumn("_best", F.when(F.col("dup_class").isNotNull(), best)).where("_best is null or specificity is null or specificity >= _best").drop("_best")


def scores(findings: DataFrame, by: str) -> DataFrame:
    stats = findings.groupBy(by).agg(*severity_counts(F.col("severity"))[:3], F.countDistinct("file").alias("files"))
    c = [F.col(x) for x in ("critical", "high", "medium", "files")]
    out = stats.withColumn("linear", score(*c)).withColumn("exponential", score(*c, model="exponential"))
    return out.select(by, "files", "linear", "exponential", grade(F.col("linear")).alias("grade"))


def result_hash(findings: DataFrame, by: str) -> DataFrame:
    """Order-insensitive 16-digit hash of what was found. By anything but the file, the files' hashes are hashed, so no task holds all findings."""
    key = F.concat_ws(":", "rule_id", "severity", "file", F.col("line").cast("string"))
    digest = lambda x: F.substring(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(x))), 256), 1, 16)
    if by == "file":
        return findings.groupBy("file").agg(digest(key).alias("hash"))
    return findings.groupBy(by, "file").agg(digest(key).alias("_h")).groupBy(by).agg(digest(F.col("_h")).alias("hash"))


def baseline_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status (new, fixed or unchanged) and n: how many findings have it.

    A finding is known by its keys, such as rule, file and matched text, so one that only moved is unchanged. Findings are bags: those of
    ``after`` are new or unchanged, each; those of ``before`` that are gone are fixed, each. One shuffle of combined counts.
    """
    both = before.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(after.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    counts = both.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    status = F.when(F.col("_a") == 0, "new").when(F.col("_b") == 0, "fixed").otherwise("unchanged")
    return counts.select(*keys, status.alias("status"), F.when(F.col("_b") == 0, F.col("_a")).otherwise(F.col("_b")).alias("n"))


def baseline_totals(diff: DataFrame) -> DataFrame:
    """``baseline_diff`` to (status, n): findings by status. What is fixed is always told, 0 if nothing is; new and unchanged where there are any."""
    count = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0))
    rows = F.array(*[F.struct(F.lit(status).alias("status"), count(status).alias("n")) for status in ("new", "unchanged", "fixed")])
    return diff.agg(rows.alias("rows")).select(F.inline("rows")).where("status = 'fixed' or n > 0")


def added_lines_only(findings: DataFrame, added: DataFrame) -> DataFrame:
    """Findings on lines (file, line) that a change adds."""
    return findings.join(added, ["file", "line"], "left_semi")


def in_hunks(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Findings inside a hunk (file, start, count) of their file."""
    lines = hunks.where("count > 0").select("file", F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("line"))
    return findings.join(lines, ["file", "line"], "left_semi")


def suppressed(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Drops findings that a directive (file, line, rule or null for all) covers."""
    d = directives.select(F.col("file").alias("_f"), F.col("line").alias("_l"), F.col("rule").alias("_r"))
    hit = (F.col("file") == F.col("_f")) & (F.col("line") == F.col("_l")) & (F.col("_r").isNull() | (F.col("_r") == F.col("rule_id")))
    return findings.join(d, hit, "left_anti")


def audit_totals(findings: DataFrame) -> DataFrame:
    """Counts by section and in all (section null)."""
    return findings.rollup("section").agg(*severity_counts(F.col("severity")), F.count("*").alias("total"))


def compare_sections(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sections of two audits side by side with a status."""
    a = before.groupBy("section").agg(F.count("*").alias("was"))
    b = after.groupBy("section").agg(F.count("*").alias("now"))
    was, now = F.coalesce("was", F.lit(0)), F.coalesce("now", F.lit(0))
    status = F.when(now == 0, "resolved").when(now < was, "improved").when(now > was, "regressed").otherwise("unchanged")
    return a.join(b, "section", "full").select("section", was.alias("was"), now.alias("now"), status.alias("status"))


def by_control(findings: DataFrame) -> DataFrame:
    """Control status of findings with a list of controls: FAIL if anything critical, else REVIEW."""
    rows = findings.select(F.explode("controls").alias("control"), "severity", "rule_id")
    status = F.when(F.bool_or(F.col("severity") == "critical"), "FAIL").otherwise("REVIEW")
    return rows.groupBy("control").agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("rules"), status.alias("status"))
