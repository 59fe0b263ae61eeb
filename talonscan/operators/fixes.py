"""Edits of findings as rows, applied and proven by scanning again.

An edit replaces one line. A round makes one candidate of each file with all of its edits, one for a line, and scans all candidates in one job; a
candidate stands if each edit took a finding away and none came. Where it does not stand, each edit of the file becomes a candidate of its
own, and the first that stands is taken; those before it are not tried again. Files that did not change leave the loop, so rounds shrink.

Defined results: null content has no findings; an edit of an empty line is none; edits of one line are taken in the order of rule ids, one in a round; a file
is clean (nothing found), secured (nothing left), partial (something fixed) or no_autofix.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talonscan.functions.tables import discard, written

#: Rules whose credential moves to the environment, and what the credential looks like.
CREDENTIALS = "VG001 VG062 VG060 VG506 VG514 VG517 VG603 VG621 VG626 VG651 VG665 VG677"
CREDENTIAL, QUOTED = r"(\w+)\s*[:=]\s*['\"][^'\"]+['\"]", r"['\"][^'\"]+['\"]"
#: Fixed values: (rules, what the line has to hold, what is replaced, by what, whether each time, import); the first row that changes the line counts.
REPLACED = [
    ("VG411 VG604 VG627 VG631 VG655 VG671 VG676 VG755 VG1028", None, r"(?:NEXT_PUBLIC_|VITE_|EXPO_PUBLIC_|REACT_APP_|GATSBY_|NUXT_PUBLIC_|PUBLIC_)([A-Z]\w+)", "$2", False, None),
    ("VG012 VG042 VG408", None, r"(innerHTML)", "textContent", False, None),
    ("VG040 VG403 VG500 VG510", None, r"(['\"]\*['\"])", "process.env.ALLOWED_ORIGIN", False, None),
    ("VG998", None, r"(,?\s*dangerouslyAllowBrowser\s*:\s*true\s*,?)", "", False, None),
    ("VG512 VG662", None, r"(true)", "false", False, None),
    ("VG874 VG998 VG1023", None, r"(,?\s*(?:dangerouslyAllowBrowser|browser)\s*:\s*true\s*,?)", "", True, None),
    ("VG1033", r"(?:generateText|streamText|generate|streamObject|invoke|run)\s*\(\s*\{[^}]*\btools\s*:", r"(\})(\s*\)\s*;?\s*)\z", ", maxSteps: 8 $2$3", False, None),
    ("VG1036", None, r"(,?\s*(?:unsafe|noSandbox|allowEval|allowAsync|privileged|allowAllNetwork)\s*:\s*true\s*,?)", "", True, None),
    ("VG1031", None, r"<\w+\s+dangerouslySetInnerHTML\s*=\s*\{\{\s*__html\s*:\s*([^}]+?)\s*\}\}\s*/?>", "<ReactMarkdown>{$2}</ReactMarkdown>", False, 'import ReactMarkdown from "react-markdown"'),
]
#: Rules of routes without a guard, the lines that go before, and their import.
UNGUARDED = "VG002 VG402 VG420 VG952"
GUARD = ["const { userId } = await auth();", 'if (!userId) return new Response("Unauthorized", { status: 401 });']
GUARD_IMPORT = 'import { auth } from "@clerk/nextjs/server"'
ROUNDS = 50

_EDIT = "struct<line:bigint,rule_id:string,old:string,new:string,import:string>"


def edit(rule: Column, text: Column) -> Column:
    """struct<new,import> for a rule's finding on a line of text; null where there is none."""
    made = lambda new, extra=None: F.struct(new.alias("new"), F.lit(extra).cast("string").alias("import"))
    is_ = lambda rules: rule.isin(rules.split())
    name = F.upper(F.regexp_replace(F.regexp_extract(text, CREDENTIAL, 1), "([a-z])([A-Z])", "$1_$2"))
    moved = F.regexp_replace(text, F.lit(rf"^(.*?){QUOTED}"), F.concat(F.lit("$1process.env."), name))
    ways = [F.when(is_(CREDENTIALS) & (name != ""), made(moved))]
    for rules, needs, pattern, by, each, extra in REPLACED:
        new = F.regexp_replace(text, pattern, by) if each else F.regexp_replace(text, rf"^(.*?){pattern}", f"$1{by}")
        ways.append(F.when(is_(rules) & (new != text) & (text.rlike(needs) if needs else F.lit(True)), made(new, extra)))
    indent = F.coalesce(F.nullif(F.regexp_extract(text, r"^(\s*)", 1), F.lit("")), F.lit("  "))
    guarded = F.concat(*[x for g in GUARD for x in (indent, F.lit(g + "\n"))], text)
    ways.append(F.when(is_(UNGUARDED), made(guarded, GUARD_IMPORT)))
    found = F.coalesce(*ways)
    return F.when((F.trim(F.regexp_replace(text, r"\s", " ")) != "") & (found["new"] != text), found)


def with_edits(content: str | None, edits: list[dict]) -> str | None:
    """The text with lines replaced, and imports that it lacks behind its last import, else behind a directive, else at its head."""
    if content is None:
        return None
    lines = content.split("\n")
    for e in edits:
        if 1 <= e["line"] <= len(lines) and lines[e["line"] - 1] == e["old"]:
            lines[e["line"] - 1] = e["new"]
    lines = "\n".join(lines).split("\n")
    module = lambda x: (re.search(r"from\s+['\"]([^'\"]+)['\"]", x) or [None, None])[1]
    known = {module(x) for x in lines}
    missing = [i for i in dict.fromkeys(e["import"] for e in edits if e["import"]) if module(i) not in known and i.strip() not in content]
    at = max((n + 1 for n, x in enumerate(lines) if re.match(r"\s*import\s", x)), default=int(bool(re.match(r"\s*['\"]use (?:client|server|strict)['\"];?\s*\Z", lines[0]))))
    return "\n".join(lines[:at] + [i if i.strip().endswith(";") else f"{i};" for i in missing] + lines[at:])


def applied(content: Column, edits: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([with_edits(t, e or []) for t, e in zip(texts.to_pylist(), lists.to_pylist())], pa.large_string() if pa.types.is_large_string(texts.type) else pa.string())

    return run(content, edits)


def edits_of(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings (file, rule_id, line) and files (file, content) to edits (file, edits), sorted by line and rule; a rule edits a line once."""
    asked = findings.select("file", "line", "rule_id").distinct().groupBy("file").agg(F.collect_list(F.struct("line", "rule_id")).alias("at"))
    rows = asked.join(files.select("file", F.split("content", "\n", -1).alias("lines")), "file")
    rows = rows.select("file", "lines", F.explode("at").alias("a")).select("file", "a.line", "a.rule_id", F.get("lines", F.col("a.line").cast("int") - 1).alias("old"))
    made = rows.select("file", "line", "rule_id", "old", edit(F.col("rule_id"), F.col("old")).alias("e")).where("e is not null")
    return made.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "rule_id", "old", "e.new", "e.import"))).cast(f"array<{_EDIT}>").alias("edits"))


def _counted(findings: DataFrame, label: str) -> DataFrame:
    key = F.concat_ws("\0", "rule_id", "severity", F.trim("match"))
    return findings.groupBy("file").agg(F.count("*").alias(f"{label}"), F.collect_set(key).alias(f"{label}_keys"))


def _scanned(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """candidates with ``after`` and ``after_keys`` of their findings."""
    counted = _counted(found, "after").withColumnRenamed("file", "_file")
    rows = candidates.join(counted, F.col("file") == F.col("_file"), "left").drop("_file")
    return rows.withColumn("after", F.coalesce("after", F.lit(0))).withColumn("after_keys", F.coalesce("after_keys", F.array().cast("array<string>")))


def _tried(e: Column) -> Column:
    return F.concat_ws("\0", e["rule_id"], F.trim(e["old"]))


def fix_loop(files: DataFrame, scan: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """files (file, content and what ``scan`` needs) to (file, status, initial, final, applied, resolved, content).

    ``scan`` gives findings (file, rule_id, severity, line, match) of such files. ``applied`` has the edits in order, ``resolved`` the rules of which
    a finding went. The driver sees one count a round.
    """
    kept = files.columns
    none = F.array().cast("array<string>")
    scan_ = lambda rows, label: written(scan(rows.select(kept)).select("file", "rule_id", "severity", "line", "match"), label)
    found = scan_(files, "found")
    rows = files.join(_counted(found, "before"), "file", "left").withColumn("before", F.coalesce("before", F.lit(0))).withColumn("before_keys", F.coalesce("before_keys", none))
    rows = rows.withColumn("initial", F.col("before")).withColumn("initial_keys", F.col("before_keys")).withColumn("applied", F.array().cast(f"array<{_EDIT}>")).withColumn("rejected", none)
    active, done = written(rows, "fixes"), []
    sound = F.size(F.array_except("after_keys", "before_keys")) == 0
    for _ in range(rounds):
        able = F.filter(F.coalesce("edits", F.array().cast(f"array<{_EDIT}>")), lambda e: ~F.array_contains(F.col("rejected"), _tried(e)))
        planned = active.join(edits_of(found, active), "file", "left").withColumn("edits", able)
        first = F.filter("edits", lambda e, i: (i == 0) | (F.get("edits", i - 1)["line"] != e["line"]))
        planned = written(planned.withColumn("batch", first), "planned")
        if not planned.where(F.size("batch") > 0).limit(1).count():
            discard(planned)
            break
        whole = planned.where(F.size("batch") > 0).withColumn("content", applied(F.col("content"), F.col("batch")))
        after = scan_(whole, "found")
        together = written(_scanned(whole, after).withColumn("stands", sound & (F.col("after") <= F.col("before") - F.size("batch"))), "together")
        new = together.where("stands").select(F.col("file").alias("_f"), F.col("content").alias("_content"), F.col("batch").alias("_batch"), F.col("after").alias("_after"), F.col("after_keys").alias("_keys"))
        news = after.join(new.select("_f"), F.col("file") == F.col("_f"), "left_semi")
        gone, seen = [after, together], None
        if together.where("not stands").limit(1).count():
            # where the edits do not stand together, each of them alone
            apart = planned.join(together.where("not stands").select("file"), "file", "left_semi").select("*", F.posexplode("edits").alias("nth", "one"))
            apart = apart.withColumn("_whole", F.col("file")).withColumn("file", F.concat(F.col("file").cast("string"), F.lit("\0"), F.col("nth"))).withColumn("batch", F.array("one"))
            apart = apart.withColumn("content", applied(F.col("content"), F.col("batch")))
            alone = scan_(apart, "found")
            tried = _scanned(apart, alone).withColumn("stands", sound & (F.col("after") < F.col("before")))
            tried = written(tried.select("_whole", "file", "nth", "one", "content", "after", "after_keys", "stands"), "tried")
            best = tried.groupBy("_whole").agg(F.min(F.when(F.col("stands"), F.col("nth"))).alias("best"))
            seen = tried.join(best, "_whole").where("best is null or nth < best").groupBy("_whole").agg(F.collect_list(_tried(F.col("one"))).alias("seen")).withColumnRenamed("_whole", "_s")
            taken = tried.join(best.select(F.col("_whole").alias("_f"), "best"), (F.col("_whole") == F.col("_f")) & (F.col("nth") == F.col("best")))
            new = new.unionByName(taken.select("_f", F.col("content").alias("_content"), F.array("one").alias("_batch"), F.col("after").alias("_after"), F.col("after_keys").alias("_keys")))
            renamed = alone.join(taken.select(F.col("file").alias("_c"), "_f"), F.col("file") == F.col("_c")).select(F.col("_f").cast(files.schema["file"].dataType).alias("file"), "rule_id", "severity", "line", "match")
            news = news.unionByName(renamed)
            gone += [alone, tried]
        joined = planned.join(new, F.col("file") == F.col("_f"), "left")
        joined = joined.join(seen, F.col("file") == F.col("_s"), "left") if seen is not None else joined.withColumn("seen", none)
        hit = F.col("_f").isNotNull()
        pick = lambda name, other: F.when(hit, F.col(name)).otherwise(F.col(other))
        state = joined.select(
            *[pick("_content", "content").alias(c) if c == "content" else F.col(c) for c in kept],
            pick("_after", "before").alias("before"), pick("_keys", "before_keys").alias("before_keys"), "initial", "initial_keys",
            F.when(hit, F.concat("applied", "_batch")).otherwise(F.col("applied")).alias("applied"), F.concat("rejected", F.coalesce("seen", none)).alias("rejected"), hit.alias("changed"),
        )
        state, news = written(state, "state"), written(news, "found")
        for table in (active, planned, found, *gone):
            discard(table)
        done.append(state.where("not changed").drop("changed"))
        active, found = written(state.where("changed").drop("changed"), "fixes"), news
    discard(found)
    rows = active
    for d in done:
        rows = rows.unionByName(d)
    gone = F.array_sort(F.array_distinct(F.transform(F.array_except("initial_keys", "before_keys"), lambda k: F.split_part(k, F.lit("\0"), F.lit(1)))))
    status = F.when(F.col("initial") == 0, "clean").when(F.col("before") == 0, "secured").when(F.size("applied") > 0, "partial").otherwise("no_autofix")
    return rows.select("file", status.alias("status"), "initial", F.col("before").alias("final"), "applied", gone.alias("resolved"), "content")
