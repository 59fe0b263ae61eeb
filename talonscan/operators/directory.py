"""A directory as one plan: files to findings, deduplicated, ranked and scored."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.functions.paths import is_test_path
from talonscan.functions.scoring import grade, score, severity_counts, severity_rank
from talonscan.functions.tables import written
from talonscan.operators import kernel
from talonscan.operators.findings import file_ranking
from talonscan.operators.rules import all_matches
from talonscan.sources import files as files_

#: Families of rules by parts of their names, and by id.
FAMILIES = {
    "html": ["innerHTML"],
    "auth": ["Unprotected Route", "Without Authentication", "Missing authentication"],
    "cors": ["CORS"],
    "admin": ["Admin", "Role Check", "Role Verification"],
    "redirect": ["Unvalidated redirect", "Open Redirect"],
}
SQL_RULES = ["VG010", "VG123"]
#: Secrets by provider: severity, pattern. Of our own; larger tables are a parameter.
PROVIDERS = [
    ("Private key", "critical", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    ("AWS", "critical", r"\bAKIA[0-9A-Z]{16}\b"),
    ("GitHub", "critical", r"\bgh[pousr]_[A-Za-z0-9_]{36,}"),
    ("Stripe", "critical", r"\b[srp]k_live_[A-Za-z0-9]{20,}"),
    ("Google", "high", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("Slack", "high", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("SendGrid", "high", r"\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    ("Connection string", "high", r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:@/\"']+:[^\s:@/\"']+@[^\s\"']+"),
]


def classes(rule_id: Column, name: Column) -> Column:
    """Families that a rule belongs to: rules of one family, or of one name, report one fault."""
    known = [F.when(F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: name.contains(p)), F.lit(family)) for family, parts in FAMILIES.items()]
    return F.array_compact(F.array(*known, F.when(rule_id.isin(SQL_RULES), F.lit("sql")), F.concat(F.lit("="), name)))


def specificity(rule_id: Column) -> Column:
    """3 for rules of a framework, 2 of interfaces and advisories, 1 of a category, else 0."""
    n = F.regexp_extract(rule_id, r"^VG(\d+)", 1).try_cast("int")
    return F.when(n.between(400, 499), 3).when(n >= 900, 2).when(n >= 100, 1).otherwise(0)


def deduplicate(findings: DataFrame) -> DataFrame:
    """One finding of a rule on a line, the first; then, of a family on a line, those that no more specific one covers.

    (file, rule_id, name, severity, line, before, match, confidence). Families overlap, so each finding is held against those of its line;
    a line holds each rule once, so the array of a line is bounded by the pack.
    """
    first = findings.groupBy("file", "line", "rule_id").agg(F.min(F.struct("before", "match", "name", "severity", "confidence")).alias("f"))
    ranked = first.select("file", "line", F.struct("rule_id", "f.*", classes(F.col("rule_id"), F.col("f.name")).alias("classes"), specificity(F.col("rule_id")).alias("rank")).alias("f"))
    lines = ranked.groupBy("file", "line").agg(F.collect_list("f").alias("fs"))
    best = F.filter("fs", lambda f: ~F.exists("fs", lambda g: (g["rank"] > f["rank"]) & F.arrays_overlap(f["classes"], g["classes"])))
    return lines.select("file", "line", F.explode(best).alias("f")).select("file", "f.rule_id", "f.name", "f.severity", "line", "f.before", "f.match", "f.confidence")


def worst_first(findings: DataFrame, k: int = 50) -> DataFrame:
    """The k worst findings: by severity, then file, line and rule."""
    return findings.orderBy(severity_rank(F.col("severity")), "file", "line", "rule_id").limit(k)


def report(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files scanned, findings by severity and in all, files and rules with findings, score and grade."""
    found = findings.agg(*severity_counts(F.col("severity")), F.count("*").alias("total"), F.countDistinct("file").alias("files"), F.countDistinct("rule_id").alias("rules"))
    both = files.agg(F.count("*").alias("scanned")).join(F.broadcast(found))  # two rows of one
    points = score(F.col("critical"), F.col("high"), F.col("medium"), F.col("scanned"))
    return both.withColumn("score", points).withColumn("grade", grade(points))


class Scan(NamedTuple):
    """What a scan of a tree gives, as tables: one row of report; findings; the ten files with most of them; hashes of what was read; what was not and why."""

    report: DataFrame
    findings: DataFrame
    ranking: DataFrame
    hashes: DataFrame
    skipped: DataFrame


def scan_directory(spark: SparkSession, path: str, pack: list[kernel.Rule], names: dict[str, str] | None = None, recursive: bool = True, excluded: list[str] = files_.EXCLUDED, max_bytes: int = files_.MAX_BYTES, **rest) -> Scan:
    """A tree of files to its report. ``names`` are names of rules; ``rest`` goes to the kernel (word, severities, disabled, auth_functions).

    Files that are read but of which nothing is found count as scanned. Findings are written once, since report, ranking and listing all read them.
    """
    read = files_.read_tree(spark, path, recursive, excluded, max_bytes)
    rows = read.select("file", F.col("file").alias("path"), "language", F.lit(None).cast("string").alias("framework"), "content")
    known = F.create_map(*[F.lit(x) for p in names.items() for x in p]) if names else None
    named = F.coalesce(F.try_element_at(known, "rule_id"), F.col("rule_id")) if names else F.col("rule_id")
    found = written(deduplicate(kernel.scan(rows, pack, **rest).withColumn("name", named)), "findings")
    survey = files_.survey_tree(spark, path, recursive, excluded, max_bytes)
    counts = survey.agg(F.count_if(F.col("skipped") == "too large").alias("skipped"), F.count_if(F.col("skipped") == "unsupported").alias("unsupported"), F.count_if(F.col("skipped") == "generated").alias("generated"))
    whole = report(found, survey.where("skipped is null")).join(F.broadcast(counts))  # two rows of one
    hashes = read.select("file", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    return Scan(whole.withColumn("pack", F.lit(len(pack))), found, file_ranking(found), hashes, survey.where("skipped is not null"))


def secrets(files: DataFrame, providers: list[tuple[str, str, str]] = PROVIDERS, ignored: list[str] = ()) -> DataFrame:
    """(file, content) to (file, provider, severity, line, match, ignored, actionable): one for a provider and line.

    A secret of an ignored file or of test code is not actionable. ``ignored`` are Java patterns of paths that version control leaves out.
    """
    found = all_matches(files, providers).groupBy("file", F.col("rule_id").alias("provider"), "severity", "line").agg(F.min_by("match", "nth").alias("match"))
    left = F.coalesce(F.exists(F.array(*[F.col("file").rlike(p) for p in ignored]), lambda x: x), F.lit(False)) if ignored else F.lit(False)
    return found.select("file", "provider", "severity", "line", "match", left.alias("ignored"), (~left & ~is_test_path(F.col("file"))).alias("actionable"))
