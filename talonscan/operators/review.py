"""Review of findings: confidence, merged analyzers, fixes, history, agent reports, posture and guides.

Joins are equi joins on keys; small vocabularies (overlaps, areas, guides) are parameters and become expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Paths of test code, prefixes of known keys, lines that are comments.
TEST_PATH = r"(?:/tests?/|__tests__|\.test\.|\.spec\.|/fixtures?/|/examples?/|/mocks?/)"
KEY_PREFIX = r"(?:sk-live-|sk_live_|ghp_|gho_|github_pat_|AKIA[0-9A-Z]{16}|xoxb-|xoxp-|whsec_|rk_live_)"
COMMENT_LINE = r"^\s*(?://|#|\*|/\*)"
#: Area, risk, parts of file names.
AREAS = [
    ("Authentication", "critical", ["auth", "login", "signup", "session", "middleware", "proxy"]),
    ("Payments", "critical", ["payment", "stripe", "checkout", "billing", "subscription", "webhook"]),
    ("PII / User Data", "high", ["user", "profile", "account", "patient", "customer", "personal"]),
    ("Admin / Internal", "high", ["admin", "dashboard", "internal", "management"]),
    ("API Surface", "medium", ["route.ts", "route.js", "api"]),
    ("Infrastructure / CI/CD", "high", ["dockerfile", "docker-compose", ".tf", "workflow", "deploy"]),
]


def confidence(path: Column, rule_id: Column, match: Column, line_text: Column, credential_rules: list[str], advisory_prefix: str) -> Column:
    """high, medium or low; a null path or line counts as neither test code nor comment."""
    return (
        F.when(path.rlike(TEST_PATH), "low")
        .when(rule_id.startswith(advisory_prefix) & path.endswith("package.json"), "high")
        .when(rule_id.isin(credential_rules), F.when(match.rlike(KEY_PREFIX), "high").otherwise("medium"))
        .when(line_text.rlike(COMMENT_LINE), "low")
        .otherwise("medium")
    )


def merged(patterns: DataFrame, others: DataFrame, overlap: dict[str, list[str]]) -> DataFrame:
    """Pattern findings (file, line, rule_id), and those of other analyzers (file, line, kind), once for each line and kind.

    Another analyzer's finding goes if a pattern that ``overlap`` lists for its kind hit the same line.
    """
    kinds = F.array(*[F.when(F.col("rule_id").isin(rules), F.lit(kind)) for kind, rules in overlap.items()])
    covered = patterns.select("file", "line", F.explode(F.array_compact(kinds)).alias("kind"))
    left = others.select("file", "line", "kind").distinct().join(covered, ["file", "line", "kind"], "left_anti")
    return patterns.select("file", "line", F.col("rule_id").alias("id")).unionByName(left.withColumnRenamed("kind", "id"))


def fix_status(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """For each (file, rule_id) to be fixed: still_vulnerable, new_issues (only other rules hit) or fixed."""
    per_rule = findings.groupBy("file", "rule_id").agg(F.count("*").alias("_n"))
    per_file = per_rule.groupBy("file").agg(F.sum("_n").alias("_all"))
    joined = targets.join(per_rule, ["file", "rule_id"], "left").join(per_file, "file", "left")
    status = F.when(F.col("_n") > 0, "still_vulnerable").when(F.col("_all") > 0, "new_issues").otherwise("fixed")
    return joined.select("file", "rule_id", status.alias("status"), F.coalesce("_n", "_all", F.lit(0)).alias("remaining"))


def secret_history(history: DataFrame, current: DataFrame) -> DataFrame:
    """Secrets (file, secret, seen_at) of a history: first and last sight, and active if still in ``current``, else removed."""
    seen = history.groupBy("file", "secret").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    now = current.select("file", "secret").distinct().withColumn("_now", F.lit(True))
    status = F.when(F.col("_now"), "active").otherwise("removed")
    return seen.join(now, ["file", "secret"], "left").select("file", "secret", "first_seen", "last_seen", status.alias("status"))


def agent_report(findings: DataFrame, edits: DataFrame) -> DataFrame:
    """Findings with their exact edit (file, rule_id, line, nth, edit), if there is one; of several, the last."""
    last = edits.groupBy("file", "rule_id", "line").agg(F.max_by("edit", "nth").alias("exact_edit"))
    return findings.join(last, ["file", "rule_id", "line"], "left").withColumn("auto_fixable", F.col("exact_edit").isNotNull())


def posture(files: DataFrame, keep: int = 10) -> DataFrame:
    """(project, path) to areas: project, area, risk, files, listed (the first ``keep`` paths)."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    hit = [F.when(F.greatest(*[name.contains(p) for p in parts]), F.struct(F.lit(a).alias("area"), F.lit(r).alias("risk"))) for a, r, parts in AREAS]
    rows = files.select("project", "path", F.inline(F.array_compact(F.array(*hit))))
    first = Window.partitionBy("project", "area", "risk").orderBy("path")
    counts = rows.groupBy("project", "area", "risk").agg(F.count("*").alias("files"))
    top = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= keep)
    listed = top.groupBy("project", "area", "risk").agg(F.concat_ws(",", F.sort_array(F.collect_list("path"))).alias("listed"))
    return counts.join(listed, ["project", "area", "risk"])


def posture_risk(areas: DataFrame) -> DataFrame:
    """Risk profile of each project from its areas."""
    c, h = F.count_if(F.col("risk") == "critical"), F.count_if(F.col("risk") == "high")
    profile = F.when(c >= 2, "critical").when(c >= 1, "high").when(h >= 2, "medium").otherwise("low")
    return areas.groupBy("project").agg(F.count("*").alias("areas"), profile.alias("profile"))


def search_guides(topics: DataFrame, guides: list[tuple[str, list[str]]]) -> DataFrame:
    """(topic) to guides: the one of that name, else those whose keyword score is 0.7 of the best or more."""
    asked = F.lower(F.trim("topic"))

    def points(keywords: list[str]) -> Column:
        each = [F.when(asked.contains(k), 2).when(F.lit(k).contains(asked), 1).otherwise(0) for k in keywords]
        return sum(each[1:], each[0])

    scored = F.array(*[F.struct(F.lit(n).alias("guide"), points(k).alias("score"), (asked == n).alias("exact")) for n, k in guides])
    rows = topics.select("topic", scored.alias("_g"))
    best, exact = F.array_max(F.transform("_g", lambda g: g["score"])), F.exists("_g", lambda g: g["exact"])
    rows = rows.select("topic", "_g", best.alias("_best"), exact.alias("_exact"))
    kept = F.filter("_g", lambda g: F.when(F.col("_exact"), g["exact"]).otherwise((g["score"] > 0) & (g["score"] * 10 >= F.col("_best") * 7)))
    return rows.select("topic", F.inline(kept)).select("topic", "guide", "score")


def fix_rates(log: DataFrame) -> DataFrame:
    """(ts, n_findings, n_fixed) to month, findings, fixed and the rounded percent fixed (0 without findings); month null: all time."""
    sums = log.select(F.date_format("ts", "yyyy-MM").alias("month"), "n_findings", "n_fixed").rollup("month")
    out = sums.agg(F.sum("n_findings").cast("bigint").alias("findings"), F.sum("n_fixed").cast("bigint").alias("fixed"))
    rate = F.when(F.col("findings") > 0, F.floor(F.col("fixed") * 100 / F.col("findings") + 0.5)).otherwise(0)
    return out.withColumn("rate", rate.cast("bigint"))
