"""The pattern kernel: rules of a pack held against whole files, with the files and matches that do not count left out.

1. An automaton over the literals of all patterns names the candidate rules of each file (``prefilter``).
2. Candidates are held against the text in the JVM, pattern by pattern from one array, so that no expression grows with the pack.
3. Files that a rule hits get the signs that its conditions ask for, and no others (``signs``).
4. Matches are extracted, and placed and judged in their file in one pass (``context``).

All of it works on the row of a file, so there is no shuffle until findings are deduplicated. A file costs time in proportion to
its size, its candidates and its matches.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talonscan.functions.patterns import java_regex
from talonscan.operators import context, signs
from talonscan.operators.prefilter import candidates
from talonscan.operators.review import confidence

C_LIKE = ["javascript", "typescript", "go"]
CREDENTIALS = ["VG001", "VG062"]
#: Characters of matches that leave a task at once.
SENT = 1 << 22


class Rule(NamedTuple):
    """``pattern`` is a Java regular expression that matches no empty text."""

    id: str
    severity: str
    pattern: str
    languages: tuple[str, ...]


def load_rules(spark, path: str) -> list[Rule]:
    """Rules from JSON lines {rule_id, severity, pattern, flags, languages}, patterns in ECMAScript syntax. A pack is a hand-written file."""
    rows = spark.read.schema("rule_id string, severity string, pattern string, flags string, languages array<string>").json(path).orderBy("rule_id").collect()
    return [Rule(r.rule_id, r.severity, java_regex(r.pattern, r.flags or ""), tuple(r.languages or ())) for r in rows]


def block_comments(content: Column) -> Column:
    """array<struct<first,last>>: lines, from 1, of each block comment outside of strings and line comments."""

    @F.arrow_udf("array<struct<first:int,last:int>>")
    def read(texts: pa.Array) -> pa.Array:
        rows = [[{"first": a, "last": b} for a, b in context.block_comments(t or "")] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))

    return read(content)


def directives(content: Column, word: str) -> Column:
    """array<struct<line,rule>>: lines, from 1, that comments with the word silence, for one rule or (null) all."""

    @F.arrow_udf("array<struct<line:int,rule:string>>")
    def read(texts: pa.Array) -> pa.Array:
        rows = [[{"line": n, "rule": r} for n, r in context.directives((t or "").split("\n"), word)] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("line", pa.int32()), ("rule", pa.string())])))

    return F.when(F.lower(content).contains(word.lower()), read(content)).otherwise(F.array().cast("array<struct<line:int,rule:string>>"))


def skipped_files(content: Column, path: Column) -> Column:
    """Files that define rules themselves."""
    several = F.regexp_count(content, F.lit(signs.RULE_ID)) >= 3
    own = F.when(content.contains("VG"), several & content.rlike(java_regex(*signs.RULE_PATTERN))).otherwise(False)
    named = path.rlike(signs.GUIDES_PATH) | (path.rlike(signs.PATH["rules_path"][0]) & content.rlike(r"SecurityRule\s*\[\]"))
    return own | F.coalesce(named, F.lit(False))


def hits(files: DataFrame, pack: list[Rule]) -> DataFrame:
    """files with ``hit``: array<int>, the rules for the file's language that its content matches."""
    patterns = F.array(*[F.lit(r.pattern) for r in pack])
    able = candidates([r.pattern for r in pack], [r.languages for r in pack], F.col("content"), F.col("language"))
    rows = files.withColumn("able", able).where(F.size("able") > 0)
    return rows.withColumn("hit", F.filter("able", lambda n: F.rlike("content", F.get(patterns, n)))).drop("able").where(F.size("hit") > 0)


def scan(files: DataFrame, pack: list[Rule], word: str = "scan-ignore", severities: dict[str, str] | None = None, disabled: tuple[str, ...] = (), auth_functions: list[str] = (), cut: int = 80) -> DataFrame:
    """(file, path, language, framework, content) to findings (file, rule_id, severity, line, before, match, confidence), before dedup.

    ``path`` may be null. A null content or unknown language has no findings. ``severities`` overrides a rule's severity; ``disabled`` rules
    are left out; ``auth_functions`` are names that guard a handler besides the known ones.
    """
    pack = [r for r in pack if r.id not in disabled]
    kept = files.select("file", "path", "language", "framework", "content").where(~F.coalesce(skipped_files(F.col("content"), F.col("path")), F.lit(True)))
    if not pack:
        return kept.where("false").select("file", *[F.lit(None).cast(t).alias(n) for n, t in [("rule_id", "string"), ("severity", "string"), ("line", "bigint"), ("before", "bigint"), ("match", "string"), ("confidence", "string")]])
    rows = hits(kept, pack)

    conditions = {n: c for n, r in enumerate(pack) if (c := signs.silent_when(r.id))}
    milder = [([n for n, r in enumerate(pack) if signs.covers(x, r.id)], c, was, now) for x, c, was, now in signs.MILDER]
    milder = [m for m in milder if m[0]]
    asked: dict[str, set[int]] = {}
    for ns, c in [*[([n], c) for n, c in conditions.items()], *[(ns, c) for ns, c, _, _ in milder]]:
        for name in signs.names(c):
            asked.setdefault(name, set()).update(ns)
    asks = lambda ns: F.arrays_overlap("hit", F.array(*map(F.lit, sorted(ns))))
    known = signs.signs(set(asked), auth_functions)
    rows = rows.withColumn("sign", F.struct(F.lit(True).alias("any"), *[F.when(asks(asked[n]), c).alias(n) for n, c in known.items()]))
    of = lambda name: F.col("sign")[name]
    by_condition: dict[str, list[int]] = {}
    for n, c in conditions.items():
        by_condition.setdefault(c, []).append(n)
    silent = F.flatten(F.array(F.array().cast("array<int>"), *[F.when(asks(ns) & signs.holds(c, of), F.array(*map(F.lit, ns))).otherwise(F.array().cast("array<int>")) for c, ns in by_condition.items()]))
    rows = rows.withColumn("hit", F.array_except("hit", silent)).where(F.size("hit") > 0)
    named, weights, patterns = (F.array(*map(F.lit, x)) for x in ([r.id for r in pack], [severities.get(r.id, r.severity) if severities else r.severity for r in pack], [r.pattern for r in pack]))

    def severity(n: Column) -> Column:
        out = F.get(weights, n)
        for ns, c, was, now in milder:
            out = F.when(n.isin(ns) & signs.holds(c, of) & ((F.get(weights, n) == was) if was else F.lit(True)), now).otherwise(out)
        return out

    one = lambda n: F.named_struct(
        F.lit("rule"), F.get(named, n), F.lit("severity"), severity(n),
        F.lit("gaps"), F.transform(F.split("content", F.get(patterns, n), -1), F.length), F.lit("found"), F.regexp_extract_all("content", F.get(patterns, n), F.lit(0)),
    )
    rows = rows.select(F.struct("file").alias("of"), "path", "language", "content", F.transform("hit", one).alias("hits"))
    shape = rows.schema["of"].dataType
    judged = rows.mapInArrow(lambda batches: _judged(batches, word), f"of {shape.simpleString()}, path string, rule_id string, severity string, line bigint, before bigint, match string, head string")
    sure = confidence(F.col("path"), F.col("rule_id"), F.col("match"), F.col("head"), CREDENTIALS, "VG9")
    return judged.select("of.file", "rule_id", "severity", "line", "before", F.substring("match", 1, cut).alias("match"), sure.alias("confidence"))


def _judged(batches, word: str):
    """Files with their hits to the matches that count; ``head`` is how the line begins."""
    advisory = signs.advisory()
    for batch in batches:
        at, columns, size = [], [[] for _ in range(7)], 0
        for n, (path, language, content, found) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(1, 5)])):
            source = context.Source(content, path, language, word)
            for hit in found:
                rule, place = hit["rule"], 0
                idle = not advisory(rule)
                guards = [drop for rules, drop in context.GUARDS if signs.covers(rules, rule)]
                for gap, text in zip(hit["gaps"], hit["found"]):
                    start = place + gap
                    place = start + len(text)
                    line = source.line_at(start)
                    if source.silenced(line, rule) or (idle and (("\n" not in text and source.once("commented", line, lambda: source.commented(line))) or source.in_string(line, start))):
                        continue
                    if guards:
                        match = context.Match(source, text, start, line)
                        if any(drop(match) for drop in guards):
                            continue
                    at.append(n)
                    for column, value in zip(columns, (path, rule, hit["severity"], line, start, text, source.once("head", line, lambda: source.lines[line - 1].lstrip(context.WHITE)[:4]))):
                        column.append(value)
                    size += len(text)
            if size > SENT:
                yield _sent(batch, at, columns)
                at, columns, size = [], [[] for _ in range(7)], 0
        yield _sent(batch, at, columns)


def _sent(batch, at, columns):
    text, number = pa.string(), pa.int64()
    made = [pa.array(c, t) for c, t in zip(columns, (text, text, text, number, number, text, text))]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *made], ["of", "path", "rule_id", "severity", "line", "before", "match", "head"])
