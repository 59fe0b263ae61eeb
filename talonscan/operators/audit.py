"""Audits of whole projects: checks that look at several files at once.

What a check needs of a file, bits and short lists, is found where the file is read, so contents are never shuffled. A project's few settings files
become one row by conditional minima; its handlers, of which there may be many, stay rows that meet this row in an equi join, and are counted
by partial aggregates. The first paths of an issue come from a ranking that Spark prunes in every task.

Defined results: null and empty files are absent; of several middleware or configuration files the first by the order of names counts; handlers are those of
``src/app`` if the project has any file there, else of ``app``; an issue lists the first paths in the order of paths.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talonscan.functions.patterns import java_regex, matcher_pattern
from talonscan.functions.paths import route_url
from talonscan.operators.middleware import configured_matchers

#: Names of settings files by precedence, folders that hold no handlers, depth of handlers below their folder.
NEXT_CONFIG = ["next.config.ts", "next.config.mjs", "next.config.js"]
MIDDLEWARE = [d + n for d in ("", "src/") for n in ("middleware.ts", "middleware.js", "proxy.ts", "proxy.js")]
ENV = [".env", ".env.local", ".env.production", ".env.development", ".env.example"]
IGNORE, DEPLOY = ".gitignore", "vercel.json"
NO_HANDLERS = ["node_modules", ".git", ".next", "build", "dist"]
DEEPEST = 8
#: What settings files and handlers say (ECMAScript, flags).
HEADERS = {
    "headers": (r"headers\s*\(", ""),
    "csp": (r"Content-Security-Policy", "i"),
    "hsts": (r"Strict-Transport-Security", "i"),
    "frame": (r"X-Frame-Options", "i"),
    "sniff": (r"X-Content-Type-Options", "i"),
    "powered": (r"poweredByHeader\s*:\s*true", ""),
    "maps": (r"productionBrowserSourceMaps\s*:\s*true", ""),
    "any_host": (r"remotePatterns[\s\S]*?hostname\s*:\s*[\"'](?:\*\*|\*)[\"']", ""),
}
MIDDLEWARE_AUTH = (r"auth|clerkMiddleware|withAuth|getToken|getServerSession|requireAuth", "i")
IGNORED_ENV = (r"\.env\b", "")
PUBLIC_SECRET = (r"^(NEXT_PUBLIC_\w*(?:SECRET|KEY|PASSWORD|TOKEN|PRIVATE|CREDENTIAL)\w*)\s*=", "m")
PUBLIC_NAMES = [
    "NEXT_PUBLIC_SUPABASE_ANON_KEY", "NEXT_PUBLIC_SUPABASE_URL", "NEXT_PUBLIC_TURNSTILE_SITE_KEY", "NEXT_PUBLIC_STRIPE_PUBLISHABLE_KEY", "NEXT_PUBLIC_CLERK_PUBLISHABLE_KEY",
    "NEXT_PUBLIC_RECAPTCHA_SITE_KEY", "NEXT_PUBLIC_GA_MEASUREMENT_ID", "NEXT_PUBLIC_SITE_URL", "NEXT_PUBLIC_APP_URL",
]
REAL_SECRET = (r"(?:SECRET|KEY|TOKEN|PASSWORD)\w*\s*=\s*(?:sk_live_|sk_test_|re_|whsec_|phx_|AKIA|ghp_|gho_|eyJ)[A-Za-z0-9_\-]{10,}", "")
CRON_PATH = (r"[\"']path[\"']\s*:\s*[\"']([^\"']+)[\"']", "")
DEPLOYED_SECRET = (r"[\"'](?:SECRET|KEY|TOKEN|PASSWORD)\w*[\"']\s*:\s*[\"'][A-Za-z0-9_\-]{12,}[\"']", "i")
API_GUARD = (r"requireAdmin|requireAuth|checkAuth|withAuth|getServerSession|auth\(\)|clerkClient|currentUser", "")
ANY_GUARD = (r"(auth|getServerSession|currentUser|getUser|requireAuth|clerkClient|getToken|CRON_SECRET)", "i")
LISTED = re.compile(r"matcher\s*[=:]\s*(\[[\s\S]*?\])")
#: Severity and category of each check.
CHECKS = {
    "AC001": ("high", "headers"), "AC002": ("high", "headers"), "AC003": ("medium", "headers"), "AC004": ("medium", "headers"), "AC005": ("high", "headers"),
    "AC010": ("high", "auth"), "AC011": ("high", "auth"), "AC012": ("medium", "auth"),
    "AC020": ("critical", "secrets"), "AC021": ("critical", "secrets"), "AC022": ("high", "secrets"),
    "AC030": ("high", "auth"), "AC031": ("critical", "secrets"), "AC040": ("high", "auth"),
    "AC050": ("low", "config"), "AC051": ("medium", "config"), "AC052": ("high", "config"),
}
SHOWN = 5
_ISSUES = "array<struct<id:string,severity:string,category:string,detail:string,files:array<string>>>"


def _says(pattern: tuple[str, str], content: Column | None = None) -> Column:
    return (F.col("content") if content is None else content).rlike(java_regex(*pattern))


def _rank(names: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), F.col("file"))


def _read_middleware(batches):
    """(project, file, content) of middleware to its matchers as Java patterns, and the parts of paths that stand in where there are none."""
    for b in batches:
        patterns, parts, listed = [], [], []
        for text in b.column(2).to_pylist():
            given = LISTED.search(text)
            listed.append(given is not None)
            patterns.append([p for m in configured_matchers(text) if (p := matcher_pattern(m))])
            strings = re.findall(r"[\"']([^\"']+)[\"']", given[1]) if given and not configured_matchers(text) else []
            parts.append([re.sub(r"\(.*?\)", "", s.replace(":path*", "", 1), count=1) for s in strings])
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(patterns, strings), pa.array(parts, strings), pa.array(listed)], ["project", "file", "rank", "auth", "patterns", "parts", "listed"])


def settings(files: DataFrame) -> DataFrame:
    """One row for each project: config, middleware, env (a list), ignore, deploy, each null where it is absent, and src_app."""
    there = files.where("content <> ''")
    content = F.col("content")
    config = F.struct(_rank(NEXT_CONFIG).alias("rank"), "file", *[_says(p).alias(n) for n, p in HEADERS.items()])
    exposed = F.filter(F.regexp_extract_all(content, F.lit(java_regex(*PUBLIC_SECRET)), F.lit(1)), lambda n: ~F.upper(n).contains("PUBLISHABLE") & ~n.isin(PUBLIC_NAMES))
    env = F.struct(_rank(ENV).alias("rank"), "file", exposed.alias("exposed"), ((F.col("file") == ".env.example") & _says(REAL_SECRET)).alias("real"))
    crons = F.when(content.contains("crons"), F.array_distinct(F.regexp_extract_all(content, F.lit(java_regex(*CRON_PATH)), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    deploy = F.struct("file", crons.alias("crons"), _says(DEPLOYED_SECRET).alias("secret"))
    of = lambda names, value: F.when(F.col("file").isin(names), value)
    small = there.where(F.col("file").isin([*NEXT_CONFIG, *ENV, IGNORE, DEPLOY])).select(
        "project",
        of(NEXT_CONFIG, config).alias("config"),
        of(ENV, env).alias("env"),
        of([IGNORE], F.struct("file", _says(IGNORED_ENV).alias("env"))).alias("ignore"),
        of([DEPLOY], deploy).alias("deploy"),
    )
    # a name occurs once in a project, or the least of its rows counts: nothing here grows with the project
    first = lambda c: F.min(c).alias(c)
    one = small.groupBy("project").agg(first("config"), first("ignore"), first("deploy"), F.array_sort(F.collect_set("env")).alias("env"))
    found = there.where(F.col("file").isin(MIDDLEWARE)).select(F.col("project").cast("string").alias("project"), "file", "content", _rank(MIDDLEWARE).alias("rank"), _says(MIDDLEWARE_AUTH).alias("auth"))
    read = found.mapInArrow(_read_middleware, "project string, file string, rank bigint, auth boolean, patterns array<string>, parts array<string>, listed boolean")
    guard = read.groupBy("project").agg(F.min(F.struct("rank", "file", "auth", "patterns", "parts", "listed")).alias("middleware"))
    src = files.where(F.col("file").startswith("src/app/")).select("project").distinct().withColumn("src_app", F.lit(True))
    known = files.select("project").distinct()
    return known.join(one, "project", "left").join(guard, "project", "left").join(src, "project", "left")


def handlers(files: DataFrame, own: list[str] = ()) -> DataFrame:
    """(project, file, src, api_guard, any_guard, cron_guard) of route handlers, by bits only."""
    below = F.regexp_extract("file", r"^(?:src/)?app/(.*)$", 1)
    folders = F.split(below, "/")
    named = (F.col("content") != "") & F.col("file").rlike(r"^(?:src/)?app/(?:.*/)?route\.(?:ts|js|tsx|jsx)\z")
    fits = (F.size(folders) - 1 <= DEEPEST) & ~F.arrays_overlap(F.slice(folders, 1, F.size(folders) - 1), F.array(*map(F.lit, NO_HANDLERS)))
    names = [re.escape(n) for n in own if re.fullmatch(r"[A-Za-z_$][\w$]*", n)]
    mine = F.col("content").rlike(rf"\b(?:{'|'.join(names)})\s*\(") if names else F.lit(False)
    return files.where(named & fits).select(
        "project", "file", F.col("file").startswith("src/").alias("src"), (_says(API_GUARD) | mine).alias("api_guard"), _says(ANY_GUARD).alias("any_guard"), F.col("content").contains("CRON_SECRET").alias("cron_guard")
    )


def _issue(id_: str, when: Column, files: Column, detail: Column | None = None) -> Column:
    severity, category = CHECKS[id_]
    detail = F.lit("") if detail is None else detail
    return F.when(when, F.struct(F.lit(id_).alias("id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), detail.alias("detail"), files.alias("files")))


def config_audit(files: DataFrame, own: list[str] = ()) -> DataFrame:
    """(project, file, content) to issues (project, id, severity, category, detail, files). ``own`` are names of the projects' own guard functions.

    ``detail`` is the exposed name, the path of the scheduled job, or the number of handlers.
    """
    files = files.select(F.col("project").cast("string").alias("project"), "file", "content")
    project = settings(files)
    c = F.col
    config, middleware, deploy = c("config"), c("middleware"), c("deploy")
    at = lambda of: F.array(of["file"])
    headers = F.coalesce(config["headers"], F.lit(False))
    lacking = [_issue(i, headers & ~config[n], at(config)) for i, n in (("AC001", "csp"), ("AC002", "hsts"), ("AC003", "frame"), ("AC004", "sniff"))]
    no_files = F.array().cast("array<string>")
    none = F.array().cast(_ISSUES)
    env_files = F.transform("env", lambda e: e["file"])
    ignore = F.concat(F.array(F.coalesce(c("ignore.file"), F.lit(IGNORE))), env_files)
    exposed = F.flatten(F.transform("env", lambda e: F.transform(e["exposed"], lambda n: _issue("AC021", F.lit(True), F.array(e["file"]), n))))
    real = F.transform(F.filter("env", lambda e: e["real"]), lambda e: _issue("AC022", F.lit(True), F.array(e["file"])))
    single = F.array(
        *lacking,
        _issue("AC005", config.isNotNull() & ~headers, at(config)),
        _issue("AC010", ~middleware["auth"], at(middleware)),
        _issue("AC012", middleware.isNull() & config.isNotNull(), no_files),
        _issue("AC020", (F.size("env") > 0) & ~F.coalesce(c("ignore.env"), F.lit(False)), ignore),
        _issue("AC031", deploy["secret"], at(deploy)),
        _issue("AC050", config["powered"], at(config)),
        _issue("AC051", config["maps"], at(config)),
        _issue("AC052", config["any_host"], at(config)),
    )
    every = project.select("project", F.inline(F.array_compact(F.concat(single, F.coalesce(exposed, none), F.coalesce(real, none)))))

    routed = handlers(files, own).join(project.select("project", "middleware", "deploy.crons", c("deploy.file").alias("deployed"), F.coalesce("src_app", F.lit(False)).alias("src_app")), "project")
    routed = routed.where(c("src") == c("src_app")).withColumn("path", F.concat(F.lit("/"), "file"))
    by_pattern = F.exists("middleware.patterns", lambda p: F.rlike(route_url(c("file")), p))
    by_part = F.exists("middleware.parts", lambda p: c("path").contains(p))
    open_api = middleware["listed"] & c("path").contains("/api/") & ~by_pattern & ~by_part & ~c("api_guard")
    kind = F.when(open_api, "AC011").when(middleware.isNull() & ~c("any_guard"), "AC040")
    missed = routed.select("project", "file", middleware["file"].alias("by"), kind.alias("id")).where("id is not null")
    first = Window.partitionBy("project", "id").orderBy("file")
    top = missed.withColumn("_n", F.row_number().over(first)).where(c("_n") <= SHOWN)
    top = top.groupBy("project", "id").agg(F.sort_array(F.collect_list("file")).alias("top"))
    counted = missed.groupBy("project", "id").agg(F.count("*").cast("string").alias("detail"), F.first("by").alias("by")).join(top, ["project", "id"])
    shown = F.when(c("id") == "AC011", F.concat(F.array("by"), F.slice("top", 1, 3))).otherwise(c("top"))
    counted = counted.select("project", "id", F.lit(CHECKS["AC011"][0]).alias("severity"), F.lit(CHECKS["AC011"][1]).alias("category"), "detail", shown.alias("files"))

    return every.unionByName(counted).unionByName(_crons(routed))


def _crons(routed: DataFrame) -> DataFrame:
    """Scheduled paths whose handler, the first by path that holds them, does not ask for the secret."""
    named = routed.select("project", "file", "cron_guard", "deployed", "path", F.explode("crons").alias("cron"))
    met = named.where(F.col("path").contains(F.regexp_replace("cron", "^/", "")))
    best = met.groupBy("project", "cron").agg(F.min(F.struct("file", "cron_guard", "deployed")).alias("h")).where(~F.col("h.cron_guard"))
    severity, category = CHECKS["AC030"]
    return best.select("project", F.lit("AC030").alias("id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.col("cron").alias("detail"), F.array("h.deployed", "h.file").alias("files"))
