"""Route protection of many projects: the middleware of each, the routes it covers, and guards in the routes themselves.

Only the few files named like middleware reach Python, where their matchers are read; files of routes stay in the JVM.
One row a project is joined to the routes, so a large project shuffles nothing but its file names.

Defined results: of several fitting middleware files the first by path is taken; null content is empty; a matcher that is no
regular expression in either reading covers nothing.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talonscan.functions.paths import route_url
from talonscan.functions.patterns import java_regex, matcher_pattern
from talonscan.operators.routes import routes

# Signs of a guard in code, of a middleware that guards, and of one that does other work.
GUARDS = [
    r"(?:getServerSession|getSession|getToken|auth|currentUser|getAuth)\s*\(",
    r"(?:clerkClient|useAuth|useUser|createServerClient)",
    r"(?:session|token|user)\s*(?:&&|!==?\s*null|\?\.)",
    r"(?:status:\s*(?:401|403)|new\s+Response\s*\([^)]*(?:401|403)|Unauthorized|Forbidden)",
    r"(?i)await\s+[\w.]*(?:auth|session|permission|guard|verify|protect)\w*\s*\(",  # no repeated group, which Java matches by recursion
]
GUARDING = r"\b(?:clerkMiddleware|authMiddleware|withAuth|createRouteMatcher|NextAuth|auth0|betterAuth|supabaseMiddleware|updateSession|createServerClient|getToken)\b|auth\s*\.\s*protect\s*\("
OTHER_WORK = r"\b(?:next-intl|createI18nMiddleware|next-international|paraglide|@vercel\/analytics|posthog)\b|from\s+[\"']next-intl\/middleware[\"']"
ENTRY = r"(?:^|/)(?:middleware|proxy)\.[tj]s$"
LOOSE = r"middleware\.[tj]s$"

_PIECE = re.compile(r"""(?s)"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|[\[\]]""")
_COMMENT = re.compile(r"(?s)/\*.*?\*/|//[^\n]*")
_LIST = re.compile(r"matcher\s*:\s*(?=\[)")
_ONE = re.compile(r"""(?s)matcher\s*:\s*(?=["'`])""")
_PROTECTED = re.compile(r"createRouteMatcher\s*\(\s*(?=\[)")


def _list_at(text: str, at: int) -> list[str] | None:
    """Strings of the list that opens at ``at``; None if it never closes."""
    found, depth = [], 0
    for m in _PIECE.finditer(text, at):
        if m[0] == "[":
            depth += 1
        elif m[0] == "]":
            depth -= 1
            if depth == 0:
                return found
        else:
            found.append(m[0][1:-1].replace("\\\\", "\\"))
    return None


def configured_matchers(content: str | None) -> list[str]:
    """Routes that the file says it runs on: a list, else one string."""
    text = _COMMENT.sub("", content or "")
    listed, one = _LIST.search(text), _ONE.search(text)
    kept = (_list_at(text, listed.end()) or []) if listed else []
    if not kept and one and (m := _PIECE.match(text, one.end())):
        kept = [m[0][1:-1].replace("\\\\", "\\")]
    return kept


def read_matchers(content: str | None) -> list[str]:
    """Routes that the file says it protects, else those it says it runs on."""
    text = _COMMENT.sub("", content or "")
    return [x for m in _PROTECTED.finditer(text) for x in _list_at(text, m.end()) or ()] or configured_matchers(content)


def has_guard(content: Column, own: list[str] = ()) -> Column:
    """Whether code shows a guard; ``own`` are names of a project's own guard functions."""
    names = [n.strip() for n in own if re.fullmatch(r"[A-Za-z_$][\w$]*", n.strip())]
    patterns = [*GUARDS, *([rf"\b(?:{'|'.join(map(re.escape, names))})\s*\("] if names else [])]
    test = F.lit(False)
    for p in patterns:
        test = test | content.rlike(java_regex(p.removeprefix("(?i)"), "i" if p.startswith("(?i)") else ""))
    return F.coalesce(test, F.lit(False))


def middleware(files: DataFrame) -> DataFrame:
    """(project, file, content) to (project, middleware, guards, patterns, everything): one row for each project that has one.

    An entry file counts beside the app directory that it serves; without one, any file with a name that ends like middleware does.
    """
    parts = F.split(F.col("file"), "/")
    # folders that hold an app folder, from the paths of files below it
    below = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: (F.get("p", i - 1) == "app") & (i < F.size("p")))
    named = files.where(F.col("file").rlike(r"(?:^|/)app/")).select("project", parts.alias("p"))
    served = named.select("project", F.explode(F.transform(below, lambda i: F.array_join(F.slice("p", 1, i - 1), "/"))).alias("folder")).distinct()
    asked = files.where(F.col("file").rlike(f"{ENTRY}|{LOOSE}")).select("project", "file", F.coalesce("content", F.lit("")).alias("content"))
    asked = asked.withColumn("folder", F.when(F.col("file").rlike(ENTRY), F.regexp_replace("file", r"/?[^/]+$", "")))
    loose = asked.where(F.col("file").rlike(LOOSE)).withColumn("rank", F.lit(1)).drop("folder")
    chosen = asked.join(served, ["project", "folder"], "left_semi").withColumn("rank", F.lit(0)).drop("folder").unionByName(loose)
    first = Window.partitionBy("project").orderBy("rank", "file")
    chosen = chosen.withColumn("_n", F.row_number().over(first)).where("_n = 1")

    def run(batches):
        for b in batches:
            read = [read_matchers(t) for t in b.column(2).to_pylist()]
            kept = [[p for p in map(matcher_pattern, m) if p is not None] for m in read]
            everything = pa.array([not m for m in read], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(kept, pa.list_(pa.string())), everything], ["project", "middleware", "guards", "patterns", "everything"])

    c = F.col("content")
    guards = (c != "") & (has_guard(c) | c.rlike(GUARDING) | ~c.rlike(OTHER_WORK))
    read = chosen.select(F.col("project").cast("string").alias("project"), "file", "content", guards.alias("guards"))
    return read.mapInArrow(run, "project string, middleware string, guards boolean, patterns array<string>, everything boolean")


def sheltered(routes_: DataFrame, layouts: DataFrame) -> DataFrame:
    """(project, file) of routes that lie below a layout with a guard, (project, folder): each folder above a route is joined by equality."""
    parts = F.split(F.regexp_replace("file", "/[^/]*$", ""), "/")
    above = routes_.select("project", "file").distinct().select("project", "file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder"))
    return above.join(layouts, ["project", "folder"], "left_semi").select("project", "file").distinct()


def protection(files: DataFrame, own: list[str] = ()) -> DataFrame:
    """(project, file, content) to (project, file, url, method, guarded, covered, source) for each route and page; project is a string.

    ``method`` of a page is PAGE. A guard in the route, middleware that covers it, or a guard in a layout above it protects it.
    """
    files = files.select(F.col("project").cast("string").alias("project"), "file", "content")
    handlers = files.where(F.col("file").rlike(r"(?:^|/)route\.[jt]sx?$"))
    guarded = has_guard(F.col("content"), own).alias("guarded")
    found = routes(handlers.select(F.struct("project", "file", guarded).alias("of"), "file", "content"), "of")
    found = found.select("of.project", "file", "url", "method", "of.guarded")
    pages = files.where(F.col("file").rlike(r"/page\.(?:ts|tsx|js|jsx)$")).select("project", "file", route_url(F.col("file")).alias("url"), F.lit("PAGE").alias("method"), guarded)
    found = found.unionByName(pages)
    hit = F.col("everything") | F.exists("patterns", lambda p: F.rlike("url", p))
    joined = found.join(middleware(files), "project", "left").withColumn("covered", F.coalesce(F.col("guards") & hit, F.lit(False)))
    layout = r"/layout\.(?:ts|tsx|js|jsx)$"
    layouts = files.where(F.col("file").rlike(layout) & has_guard(F.col("content"), own)).select("project", F.regexp_replace("file", layout, "").alias("folder")).distinct()
    below = sheltered(joined.where("not guarded and not covered"), layouts).withColumn("sheltered", F.lit(True))
    joined = joined.join(below, ["project", "file"], "left")
    source = F.when(F.col("guarded"), "auth-guard").when(F.col("covered"), "middleware").when(F.col("sheltered"), "layout").otherwise("none")
    return joined.select("project", "file", "url", "method", (F.col("guarded") | (source == "layout")).alias("guarded"), "covered", source.alias("source"))
