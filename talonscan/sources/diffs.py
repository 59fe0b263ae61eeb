"""Unified diffs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def hunks(diffs: DataFrame) -> DataFrame:
    """(file, diff) to (file, start, count)."""
    rows = diffs.select("file", F.explode(F.split("diff", "\n", -1)).alias("line")).where(F.col("line").rlike("^" + HEADER))
    count = F.coalesce(F.nullif(F.regexp_extract("line", HEADER, 2), F.lit("")), F.lit("1"))
    return rows.select("file", F.regexp_extract("line", HEADER, 1).cast("bigint").alias("start"), count.cast("bigint").alias("count"))


def added_lines(diffs: DataFrame) -> DataFrame:
    """(file, diff) to the numbers of added lines (file, line). A window per file: a diff is as long as one file's change."""
    rows = diffs.select("file", F.posexplode(F.split("diff", "\n", -1)).alias("pos", "raw"))
    head = F.when(F.col("raw").startswith("@@"), F.nullif(F.regexp_extract("raw", HEADER, 1), F.lit("")).cast("bigint"))
    w = Window.partitionBy("file").orderBy("pos")
    rows = rows.withColumn("head", head).withColumn("hunk", F.count("head").over(w)).withColumn("start", F.last("head", ignorenulls=True).over(w))
    meta = F.col("raw").startswith("@@") | (F.col("raw") == "") | F.col("raw").startswith("+++") | F.col("raw").startswith("---")
    moves = F.when(meta | F.substring("raw", 1, 1).isin("-", "\\"), 0).otherwise(1)
    before = F.sum(moves).over(Window.partitionBy("file", "hunk").orderBy("pos")) - moves
    rows = rows.withColumn("line", F.col("start") + before)
    return rows.where((F.col("hunk") > 0) & F.col("raw").startswith("+") & ~meta).select("file", "line")
