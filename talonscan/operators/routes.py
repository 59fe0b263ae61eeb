"""Routes of an app directory: methods, guards, middleware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talonscan.functions.patterns import matcher_pattern
from talonscan.functions.paths import route_url

METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


def covered(url: Column, matchers: list[str] | None) -> Column:
    """Whether middleware covers a URL; no middleware (None) covers none, an empty list of matchers all."""
    if matchers is None:
        return F.lit(False)
    if not matchers:
        return F.lit(True)
    patterns = [p for m in matchers if (p := matcher_pattern(m))]
    return F.exists(F.array(*[url.rlike(p) for p in patterns]), lambda x: x) if patterns else F.lit(False)


def routes(files: DataFrame, *kept: str) -> DataFrame:
    """(file, content) of route handlers to (file, url, method), and the columns ``kept``."""
    own = files.where(F.col("file").rlike(r"(?:^|/)route\.[jt]sx?$"))
    has = [F.when(F.col("content").rlike(rf"export\s+(?:(?:async\s+)?function|const)\s+{m}\b"), F.lit(m)) for m in METHODS]
    return own.select(*kept, "file", route_url(F.col("file")).alias("url"), F.explode(F.array_compact(F.array(*has))).alias("method"))


def coverage(routed: DataFrame, guard: Column, matchers: list[str] | None, by: str) -> DataFrame:
    """Routes and covered ones of each group, with the rounded percentage."""
    ok = guard | covered(F.col("url"), matchers)
    out = routed.groupBy(by).agg(F.count("*").alias("routes"), F.count_if(ok).alias("covered"))
    return out.withColumn("percent", F.floor(F.col("covered") * 100 / F.col("routes") + 0.5).cast("bigint"))
