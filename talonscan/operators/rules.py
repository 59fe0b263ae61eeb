"""The pattern kernel: a rule dimension held against the lines of texts."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A small built-in pack of our own; larger packs are a parameter (rows of rule_id, severity, pattern).
PACK = [
    ("T001", "critical", r"(?i)(?:password|secret|token)\s*[:=]\s*[\"']?[A-Za-z0-9+/_.-]{6,}"),
    ("T002", "high", r"AKIA[A-Z0-9]{16}"),
    ("T003", "medium", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"),
    ("T004", "low", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("T005", "info", r"(?i)licensed under"),
]


def _gate(pattern: str) -> str | None:
    """A pattern that any text with a matching line matches as a whole; none where the pattern looks around or at edges."""
    return None if re.search(r"\(\?[=!<]|\\[zZAbBG]|[$^]", pattern) else pattern


def line_matches(files: DataFrame, pack: list[tuple[str, str, str]] = PACK, block: int = 40) -> DataFrame:
    """(file, content) to (file, line, rule_id, severity): each rule at most once on a line. No join: rules are expressions.

    Texts are held against the rules first, and only those that hit are cut into lines, which are then held against the rules
    that hit their text. Large packs are taken in blocks of rules, so that no expression grows with the pack.
    """
    found = []
    for a in range(0, len(pack), block):
        part = pack[a : a + block]
        able = F.array(*[F.col("content").rlike(g) if (g := _gate(p)) else F.col("content").isNotNull() for _, _, p in part])
        texts = files.select("file", "content", able.alias("able")).where(F.exists("able", lambda x: x))
        lines = texts.select("file", "able", F.posexplode(F.split("content", "\n", -1)).alias("pos", "code"))
        hits = F.array(*[F.when(F.get("able", n) & F.col("code").rlike(p), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for n, (i, s, p) in enumerate(part)])
        rows = lines.select("file", (F.col("pos") + 1).cast("bigint").alias("line"), F.explode(F.array_compact(hits)).alias("h"))
        found.append(rows.select("file", "line", "h.rule_id", "h.severity"))
    return reduce(DataFrame.unionByName, found)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def all_matches(files: DataFrame, pack: list[tuple[str, str, str]] = PACK, cut: int = 80) -> DataFrame:
    """(file, content) to every match with the line it starts on, also of patterns that span lines. One scan for the whole pack.

    The pieces between matches and the matches themselves alternate, so line numbers are running sums of their newlines, which are
    all that leaves the JVM besides the matches. Nothing is built for a rule that does not hit.
    """
    hits = [
        F.when(
            F.col("content").rlike(p),
            F.struct(
                F.lit(rule).alias("rule_id"),
                F.lit(severity).alias("severity"),
                F.transform(F.split("content", p, -1), newlines).alias("gaps"),
                F.regexp_extract_all("content", F.lit(p), F.lit(0)).alias("found"),
            ),
        )
        for rule, severity, p in pack
    ]
    rows = files.select(F.struct("file").alias("of"), F.explode(F.array_compact(F.array(*hits))).alias("h")).select("of", "h.*")
    rows = rows.select("of", "rule_id", "severity", "gaps", F.transform("found", newlines).alias("inside"), F.transform("found", lambda m: F.substring(m, 1, cut)).alias("found"))
    of = rows.schema["of"].dataType.simpleString()
    placed = rows.mapInArrow(_placed, f"of {of}, rule_id string, severity string, nth bigint, line bigint, match string")
    return placed.select("of.file", "rule_id", "severity", "nth", "line", "match")


def _placed(batches):
    """Rows with newlines of the gaps, newlines inside of the matches, and the matches, to one row for each match with its line."""
    for batch in batches:
        gaps, inside, found = (batch.column(k) for k in (3, 4, 5))
        times = np.diff(inside.offsets.to_numpy())
        if not times.sum():
            continue
        row = np.repeat(np.arange(len(times)), times)
        first = np.repeat(np.cumsum(times) - times, times)
        nth = np.arange(len(row)) - first
        lead = gaps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)[np.arange(len(row)) + row]  # a row has one gap more than matches
        steps = np.cumsum(lead + inside.flatten().to_numpy(zero_copy_only=False))
        before = np.concatenate([[0], steps])[:-1]
        line = 1 + before - before[first] + lead
        kept = [batch.column(k).take(pa.array(row)) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(nth), pa.array(line), found.flatten()], ["of", "rule_id", "severity", "nth", "line", "match"])


def load_pack(spark, path: str) -> list[tuple[str, str, str]]:
    """Rule pack from JSON lines {rule_id, severity, pattern, flags}, patterns in ECMAScript syntax. A pack is a hand-written file."""
    from talonscan.functions.patterns import java_regex

    rows = spark.read.schema("rule_id string, severity string, pattern string, flags string").json(path).orderBy("rule_id").collect()
    return [(r.rule_id, r.severity, java_regex(r.pattern, r.flags or "")) for r in rows]
