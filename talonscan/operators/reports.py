"""Reports as rows of JSON or Markdown, ready for any writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the SARIF format.
SARIF_LEVELS = [("critical", "error"), ("high", "error"), ("medium", "warning")]


def sarif_level(severity):
    out = F.lit("note")
    for name, level in reversed(SARIF_LEVELS):
        out = F.when(severity == name, level).otherwise(out)
    return out


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result for each finding, as JSON: a narrow projection, so a report of any size is written in parallel."""
    region = F.struct(F.greatest(F.col("line"), F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.array(place).alias("locations"))
    return findings.select("file", "line", "rule_id", F.to_json(result).alias("result"))


def occurrences(findings: DataFrame, by: list[str]) -> DataFrame:
    """Findings of a rule folded to one entry with its distinct lines, in order; combined before the shuffle."""
    lines = F.sort_array(F.collect_set("line"))
    return findings.groupBy(*by).agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(lines, lambda x: x.cast("string"))).alias("lines"))


def annotations(findings: DataFrame) -> DataFrame:
    level = F.when(F.col("severity").isin("critical", "high"), "failure").when(F.col("severity") == "medium", "warning").otherwise("notice")
    return findings.select("file", "line", "rule_id", level.alias("annotation_level"))
