"""A full audit: seven sections of findings of a project as one relation, and a verdict on it.

Every section reads the files it needs, and what leaves it is narrow: (project, section, rule_id, severity, file, line, hashed). Totals, score and
hash are aggregates of this relation by project, combined before they are shuffled.

Defined results: a section without findings counts zero; flows within a file and unprotected routes count, but are not part of the hash; the hash of a
project hashes those of its files; files of unknown languages are skipped ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talonscan.functions.paths import language
from talonscan.functions.scoring import grade, score
from talonscan.operators import directory, kernel
from talonscan.operators.audit import config_audit
from talonscan.operators.crossfile import cross_file_flows
from talonscan.operators.findings import result_hash
from talonscan.operators.middleware import protection
from talonscan.operators.packages import typosquats, version_key
from talonscan.operators.policy import audit_verdict, coverage_percent
from talonscan.operators.project_imports import imported, undeclared
from talonscan.operators.taint import taint
from talonscan.sources.manifests import manifests

SECTIONS = ["code", "secrets", "dependencies", "config", "taint", "auth-coverage", "hallucinated-packages"]
#: Files with versions by precedence; points that a finding outside of the code costs; rules of invented packages.
VERSIONS = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "package.json"]
COSTS = {"critical": 5, "high": 3, "medium": 1}
INVENTED = "VG-SLOP"


def _rows(df: DataFrame, section: str, rule, severity, file="file", line="line", hashed=True) -> DataFrame:
    as_column = lambda x: x if not isinstance(x, str) else F.col(x)
    return df.select("project", F.lit(section).alias("section"), as_column(rule).alias("rule_id"), as_column(severity).alias("severity"), as_column(file).alias("file"), as_column(line).cast("bigint").alias("line"), F.lit(hashed).alias("hashed"))


def _dependencies(files: DataFrame, advisories: DataFrame) -> DataFrame:
    root = files.where(F.col("file").isin(VERSIONS)).select("project", "file", "content", F.array_position(F.array(*map(F.lit, VERSIONS)), F.col("file")).alias("rank"))
    best = root.groupBy("project").agg(F.min("rank").alias("rank"))
    chosen = root.join(best, ["project", "rank"]).select(F.concat_ws("/", "project", "file").alias("file"), "content")
    held = manifests(chosen).select(F.regexp_replace("file", "/[^/]*$", "").alias("project"), "name", "version").where("version is not null").distinct()
    v = version_key(F.col("version"))
    hit = held.join(advisories, "name").where((v >= version_key(F.col("introduced"))) & (v < version_key(F.col("fixed"))))
    used = imported(files).withColumn("reachable", F.lit(True))
    return hit.join(used, ["project", "name"], "left").select("project", "name", "version", "advisory", "severity", F.coalesce("reachable", F.lit(False)).alias("reachable"))


def findings(files: DataFrame, pack: list[kernel.Rule], names: dict[str, str], advisories: DataFrame, popular: list[str], own: list[str] = (), word: str = "scan-ignore") -> DataFrame:
    """(project, file, content) to the findings of all sections. ``names`` are names of rules, ``advisories`` (advisory, name, introduced, fixed, severity)."""
    files = files.select(F.col("project").cast("string").alias("project"), "file", "content").where("file is not null")
    zero = F.lit(0)
    code = files.select(F.struct("project", "file").alias("file"), F.col("file").alias("path"), language(F.col("file")).alias("language"), F.lit(None).cast("string").alias("framework"), "content")
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), "rule_id"), F.col("rule_id")) if names else F.col("rule_id")
    found = directory.deduplicate(kernel.scan(code, pack, word).withColumn("name", named)).select("file.project", "file.file", "rule_id", "severity", "line")
    keyed = files.select(F.concat_ws("/", "project", "file").alias("file"), "content", "project", F.col("file").alias("path"))
    split = lambda df: df.withColumn("project", F.split_part("file", F.lit("/"), F.lit(1))).withColumn("file", F.regexp_replace("file", "^[^/]*/", ""))
    secret = split(directory.secrets(keyed.select("file", "content"))).where("actionable")
    left_out = files.where("file = '.gitignore'").select("project", F.explode(F.split("content", r"\r?\n")).alias("file")).distinct()
    secret = secret.join(left_out, ["project", "file"], "left_anti")
    deps = _dependencies(files, advisories)
    issues = config_audit(files, list(own))
    across = cross_file_flows(files)
    within = split(taint(keyed.select("file", "content")))
    routes = protection(files, list(own)).where("source = 'none'")
    loose = undeclared(files)
    near = typosquats(loose.select("name").distinct(), popular)
    invented = loose.join(near.select("name", "similar_to"), "name", "left")
    parts = [
        _rows(found, "code", "rule_id", "severity"),
        _rows(secret, "secrets", F.concat(F.lit("SECRET:"), "provider"), "severity"),
        _rows(deps, "dependencies", F.concat(F.lit("DEP:"), "advisory"), "severity", F.lit("package.json"), zero),
        _rows(issues, "config", "id", "severity", F.coalesce(F.get("files", zero), F.lit("")), zero),
        _rows(across, "taint", F.concat(F.lit("TAINT:"), "sink"), "severity", "file", "source_line"),
        _rows(within, "taint", F.concat(F.lit("TAINT:"), "sink"), F.lit("medium"), "file", "source_line", hashed=False),
        _rows(routes, "auth-coverage", F.lit("AUTH:UNPROTECTED"), F.lit("high"), "file", zero, hashed=False),
        _rows(invented, "hallucinated-packages", F.lit(INVENTED), F.when(F.col("similar_to").isNotNull(), "critical").otherwise("high"), F.lit("package.json"), zero),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def totals(found: DataFrame) -> DataFrame:
    """Counts by project and section, and (section null) by project, in one pass."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return found.groupingSets([["project", "section"], ["project"]], "project", "section").agg(count("critical"), count("high"), count("medium"), F.count("*").alias("total"))


def verdicts(found: DataFrame, files: DataFrame, rules: int) -> DataFrame:
    """One row a project: verdict, score, grade, files read and skipped, coverage, rules, counts, hash of the result, and what to do."""
    project = F.col("project").cast("string").alias("project")
    read = files.where("file is not null").groupBy(project).agg(F.count_if(language(F.col("file")).isNotNull()).alias("scanned"), F.count_if(language(F.col("file")).isNull()).alias("skipped"))
    of = lambda s, inside: F.count_if((F.col("severity") == s) & ((F.col("section") == "code") == F.lit(inside)))
    section = lambda s: F.count_if(F.col("section") == s)
    counts = found.groupBy("project").agg(
        *[of(s, inside).alias(f"{'code' if inside else 'other'}_{s}") for s in COSTS for inside in (True, False)], F.count("*").alias("total"),
        section("secrets").alias("secrets"), section("dependencies").alias("dependencies"), section("auth-coverage").alias("open_routes"),
    )
    hashes = result_hash(found.where("hashed"), "project")
    rows = read.join(counts, "project", "left").join(hashes, "project", "left").na.fill(0)
    c = F.col
    rows = rows.select("*", *[(c(f"code_{s}") + c(f"other_{s}")).alias(s) for s in COSTS])
    points = score(c("code_critical"), c("code_high"), c("code_medium"), c("scanned")) - sum((c(f"other_{s}") * n for s, n in COSTS.items()), F.lit(0))
    rows = rows.withColumn("score", F.greatest(points, F.lit(0)).cast("bigint"))
    verdict = audit_verdict(c("critical"), c("high"))
    say = lambda when, *text: F.when(when, F.concat(*[t if not isinstance(t, str) else F.lit(t) for t in text]))
    actions = F.array_compact(
        F.array(
            say(c("critical") > 0, "Fix ", c("critical"), " critical finding(s) immediately"),
            say(c("high") > 0, "Address ", c("high"), " high severity finding(s)"),
            say(c("secrets") > 0, "Rotate exposed secrets and add to .gitignore"),
            say(c("dependencies") > 0, "Update vulnerable dependencies"),
            say(c("open_routes") > 0, "Add auth guards to ", c("open_routes"), " unprotected route(s)"),
            say(verdict == "PASS", "No action required"),
        )
    )
    nothing = F.substring(F.sha2(F.lit(""), 256), 1, 16)
    return rows.select(
        "project", verdict.alias("verdict"), "score", grade(c("score")).alias("grade"), "scanned", "skipped", coverage_percent(c("scanned"), c("skipped")).alias("coverage"), F.lit(rules).cast("bigint").alias("rules"),
        "critical", "high", "medium", "total", F.coalesce("hash", nothing).alias("hash"), actions.alias("actions"),
    )


def full_audit(files: DataFrame, pack: list[kernel.Rule], names: dict[str, str], advisories: DataFrame, popular: list[str], own: list[str] = (), word: str = "scan-ignore") -> DataFrame:
    """(project, file, content) to one verdict a project."""
    return verdicts(findings(files, pack, names, advisories, popular, own, word), files, len(pack))
