"""Guards of routes, names of packages that imitate others, and set operations on findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talonscan.operators.rules import newlines

#: Suffixes and prefixes by which names imitate popular ones.
PREFIXES = ["node-", "js-", "npm-"]
SUFFIXES = ["-js", "-node", "-npm", ".js"]


def stripped(name: Column) -> Column:
    """A package name without its scope, usual prefixes and suffixes, and separators."""
    bare = F.regexp_replace(F.lower(name), r"^@[^/]+/", "")
    bare = F.regexp_replace(bare, "^(?:" + "|".join(PREFIXES) + ")", "")
    bare = F.regexp_replace(bare, r"(?:" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + r")\z", "")
    return F.regexp_replace(bare, "[-_.]", "")


def imitations(names: DataFrame, popular: DataFrame) -> DataFrame:
    """(name) and (popular) to (name, similar_to): a name that is not popular itself but is one without its trimmings. An equi join."""
    wanted = popular.select(stripped(F.col("popular")).alias("_key"), F.col("popular").alias("similar_to"))
    found = names.join(popular, F.col("name") == F.col("popular"), "left_anti").select("name", stripped(F.col("name")).alias("_k"))
    return found.join(wanted, F.col("_k") == F.col("_key")).groupBy("name").agg(F.min("similar_to").alias("similar_to"))


def layouts_over(routes: DataFrame, layouts: DataFrame) -> DataFrame:
    """(file) of routes and (folder, guarded) of layouts to (file, guarded): whether the nearest layout above a route guards it; false without one.

    A route is joined to each folder above it by equality, so no prefix is searched for.
    """
    parts = F.split(F.regexp_replace("file", "/?[^/]*$", ""), "/")
    above = routes.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder"))
    nearest = above.join(layouts, "folder").groupBy("file").agg(F.max_by("guarded", F.length("folder")).alias("guarded"))
    return routes.join(nearest, "file", "left").select("file", F.coalesce("guarded", F.lit(False)).alias("guarded"))


def resolved(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of findings that are gone."""
    return before.select(*keys).distinct().join(after, keys, "left_anti")


def only_known(found: DataFrame, known: DataFrame, by: str, key: str) -> DataFrame:
    """For each group, whether all its keys are among the known ones: (by, within)."""
    seen = known.select(F.col(key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    rows = found.select(by, key).distinct().join(seen, F.col(key) == F.col("_k"), "left")
    return rows.groupBy(by).agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("within"))


def without_comments(code: Column) -> Column:
    """Code without block comments and line comments; a colon before // is taken for a URL."""
    return F.regexp_replace(F.regexp_replace(code, r"/\*[\s\S]*?\*/", ""), r"(?m)(?<!:)//[^\n]*$", "")


def tagged(findings: DataFrame, tags: DataFrame) -> DataFrame:
    """Findings with the union of a rule's own tags and those that a table (rule_id, tags) adds, in order, each once.

    Tags are made distinct before they are collected, so what a finding meets grows with the tags of its rule, not with the rows that name them.
    """
    once = tags.select("rule_id", F.explode("tags").alias("_tag")).distinct()
    more = once.groupBy("rule_id").agg(F.array_sort(F.transform(F.collect_list(F.struct("_tag")), lambda t: t["_tag"])).alias("_more"))
    own = F.coalesce("tags", F.array().cast("array<string>"))
    return findings.join(more, "rule_id", "left").select(*[F.array_union(own, F.coalesce("_more", F.array().cast("array<string>"))).alias("tags") if c == "tags" else findings[c] for c in findings.columns])


def line_count(content: Column) -> Column:
    return 1 + newlines(content)
