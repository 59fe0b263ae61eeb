"""Dependencies: typosquats, advisories by version range, phantom imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """Comparable array of the four first numbers of a dotted version, missing ones 0, and whether it is a release: what follows a hyphen comes before it."""
    plain = F.split(F.regexp_extract(version, r"^[vV=\s]*([0-9.]*)", 1), r"\.")
    part = lambda n: F.coalesce(F.try_element_at(plain, F.lit(n)).try_cast("int"), F.lit(0))
    return F.array(part(1), part(2), part(3), part(4), (~F.coalesce(version.contains("-"), F.lit(False))).cast("int"))


def advisories_hit(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """(name, version) within [introduced, fixed) of (advisory, name, introduced, fixed)."""
    joined = packages.join(advisories, "name")
    v = version_key(F.col("version"))
    return joined.where((v >= version_key(F.col("introduced"))) & (v < version_key(F.col("fixed")))).select("name", "version", "advisory")


def phantom_imports(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """Imported names that no manifest of the project declares."""
    return imports.join(declared, ["project", "name"], "left_anti")


def typosquats(names: DataFrame, popular: list[str]) -> DataFrame:
    """Names at edit distance 1 or 2 from a popular one, and not popular themselves: nearest, then first of the list."""
    options = F.array(*[F.struct(F.levenshtein("name", F.lit(p), 2).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(popular)])
    near = F.array_min(F.filter(options, lambda o: o["d"] >= 0))
    found = names.select("name", near.alias("near")).where("near.d between 1 and 2")
    similar = F.get(F.array(*[F.lit(p) for p in popular]), F.col("near.i"))
    return found.select("name", similar.alias("similar_to"), F.when(F.col("near.d") == 1, 0.9).otherwise(0.7).cast("double").alias("confidence"))


def cvss_severity(label: Column, number: Column) -> Column:
    """Severity of an advisory: its label if known, else by CVSS number, else medium."""
    named = F.lower(label)
    by_number = F.when(number >= 9, "critical").when(number >= 7, "high").when(number >= 4, "medium").when(number.isNotNull(), "low").otherwise("medium")
    return F.when(named.isin("critical", "high", "medium", "low"), named).when(named == "moderate", "medium").otherwise(by_number)


def package_risk(registry: DataFrame, as_of: str) -> DataFrame:
    """(name, present, downloads, last_publish, maintainers, deprecated, typosquat) with flags, in order, and risk. ``as_of`` is the present time."""
    now = F.to_timestamp(F.lit(as_of))
    few = F.col("downloads") < 100
    checks = {
        "typosquat": F.col("typosquat"),
        "deprecated": F.col("deprecated"),
        "unmaintained": F.col("last_publish") < F.add_months(now, -24),
        "new_package": (F.col("last_publish") > F.date_sub(now, 30)) & few,
        "low_adoption": few,
        "single_maintainer": (F.col("maintainers") == 1) & few,
    }
    raised = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))
    flags = F.when(F.col("present"), raised).otherwise(F.array(F.lit("typosquat")))
    has = lambda *names: F.arrays_overlap("flags", F.array(*[F.lit(n) for n in names]))
    risk = F.when(has("typosquat"), "critical").when(has("deprecated", "unmaintained", "single_maintainer"), "high").when(has("low_adoption", "new_package"), "medium").otherwise("low")
    return registry.withColumn("flags", flags).select("name", F.concat_ws(",", "flags").alias("flags"), risk.alias("risk"))


def reachable(dependencies: DataFrame, imports: DataFrame) -> DataFrame:
    """Dependencies with a flag that tells whether a file imports them; none is dropped."""
    used = imports.select("project", "name").distinct().withColumn("_used", F.lit(True))
    return dependencies.join(used, ["project", "name"], "left").select(*dependencies.columns, F.coalesce("_used", F.lit(False)).alias("reachable"))


def import_roots(files: DataFrame) -> DataFrame:
    """(file, content) to (file, name): packages that JavaScript text imports or requires; relative and built-in ones are none."""
    quoted = r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)["']([^"'\n]+)["']"""
    specs = files.where(F.col("content").rlike(quoted)).select("file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(quoted), F.lit(1)))).alias("spec"))
    root = F.regexp_extract("spec", r"^((?:@[^/]+/)?[^/]+)", 1)
    return specs.where(~F.col("spec").rlike(r"^(?:[./~#]|node:|@/)")).select("file", root.alias("name")).distinct()


# Severity that a signal has on its own, worst first.
SIGNAL_SEVERITY = {
    "critical": ["typosquat", "deceptive_prefix", "nonexistent"],
    "high": ["phantom_import", "single_maintainer", "unmaintained", "deprecated"],
    "medium": ["new_package", "low_adoption"],
}
FAKE = ["phantom_import", "typosquat", "deceptive_prefix"]


def merged_signals(raised: DataFrame) -> DataFrame:
    """(name, signal, online) to one row a name: its signals sorted, the worst severity, the tier; unknown signals are left out.

    A new package that looks made up (``FAKE``) is critical. Signals are of a short list, so sets of a name are combined before the shuffle.
    """
    known = [x for names in SIGNAL_SEVERITY.values() for x in names]
    per = raised.where(F.col("signal").isin(known)).groupBy("name").agg(F.sort_array(F.collect_set("signal")).alias("signals"), F.max("online").alias("online"))
    has = lambda names: F.arrays_overlap("signals", F.array(*[F.lit(n) for n in names]))
    critical = has(SIGNAL_SEVERITY["critical"]) | (has(["new_package"]) & has(FAKE))
    severity = F.when(critical, "critical").when(has(SIGNAL_SEVERITY["high"]), "high").otherwise("medium")
    return per.select("name", "signals", severity.alias("severity"), F.when(F.col("online"), "online").otherwise("offline").alias("tier"))
