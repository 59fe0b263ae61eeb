"""Queries of ``operators.audit`` over written projects, and the issues they have to give, stated as literals. Same form as ``registry``.

Each part stands for one project; which files it holds follows from its key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talonscan.operators import audit
from talonscan.plans.kernel import literals
from talonscan.plans.protection import held

ALL_HEADERS = "headers() { 'content-security-policy' 'Strict-Transport-Security' 'X-Frame-Options' 'X-Content-Type-Options' }"
OPEN = "export async function GET() { return 1; }"
AUTH = "export default auth(() => {});\n"
#: Files (path, text) of each kind of project.
PROJECTS = [
    # headers, each lacking one by one, and none at all
    [("next.config.ts", "headers() { return [{ key: 'X-Frame-Options' }] }"), ("middleware.ts", AUTH)],
    [("next.config.mjs", ALL_HEADERS), ("next.config.js", "module.exports = {}"), ("src/proxy.ts", AUTH)],
    [("next.config.js", "module.exports = { poweredByHeader: true, productionBrowserSourceMaps: true, images: { remotePatterns: [{ hostname: '**' }] } }")],
    [("next.config.js", ALL_HEADERS + " poweredByHeader: false, remotePatterns: [{ hostname: 'a.example' }]"), ("middleware.js", "export function middleware() {}")],
    # environment files
    [(".env", "DB=x"), (".env.local", "NEXT_PUBLIC_SECRET_KEY=a\nNEXT_PUBLIC_STRIPE_PUBLISHABLE_KEY=b\nNEXT_PUBLIC_SUPABASE_ANON_KEY=c\n#NEXT_PUBLIC_TOKEN=d\nNEXT_PUBLIC_API_TOKEN =e"), (".gitignore", "node_modules\n")],
    [(".env", "DB=x"), (".env.example", "STRIPE_SECRET_KEY=sk_live_abcdefghijklmnop\n"), (".gitignore", ".env\n")],
    [(".env.example", "STRIPE_SECRET_KEY=your_key_here\n"), (".env.production", ""), ("lib/.env.local", "NEXT_PUBLIC_TOKEN=x")],
    # scheduled paths
    [("vercel.json", '{"crons": [{"path": "/api/cron/clean"}, {"path": "/api/cron/sure"}, {"path": "/api/none"}], "env": {"SECRET_KEY": "abcdefghijkl"}}'),
     ("app/api/cron/clean/route.ts", "auth(); run();"), ("app/api/cron/sure/route.ts", "process.env.CRON_SECRET"), ("app/api/cron/clean/deep/route.ts", OPEN)],
    [("vercel.json", '{"rewrites": [{"path": "/api/x"}], "TOKEN": "short"}'), ("app/api/x/route.ts", "getUser()")],
    # handlers and matchers
    [("middleware.ts", AUTH + "export const config = { matcher: ['/api/in/:path*'] }"), ("app/api/in/a/route.ts", OPEN), ("app/api/out/route.ts", OPEN), ("app/api/own/route.ts", "requireAuth()"), ("app/page/route.ts", OPEN)],
    [("middleware.ts", AUTH + "export const config = { matcher: [\"/((?!_next|api).*)\", '/(api|trpc)(.*)'] }"), ("app/api/a/route.ts", OPEN)],
    [("middleware.ts", AUTH + "const matcher = ['/api/in/:path*']"), ("app/api/in/route.ts", OPEN), ("app/api/out/route.ts", OPEN)],
    [("middleware.ts", AUTH), ("app/api/out/route.ts", OPEN)],
    [(f"app/api/r{k}/route.ts", OPEN) for k in range(7)] + [("app/api/s/route.ts", "getToken()"), ("app/node_modules/x/route.ts", OPEN), ("app/1/2/3/4/5/6/7/8/9/route.ts", OPEN), ("app/empty/route.ts", None)],
    [("src/app/a/route.ts", OPEN), ("app/b/route.ts", OPEN), ("src/middleware.ts", ""), (None, None)],
    [("app/api/mine/route.js", "await myGuard();"), ("middleware.ts", AUTH + "export const config = { matcher: ['/x'] }")],
    [("readme.md", "nothing")],
]
SEVERITY = {i: s for i, (s, _) in audit.CHECKS.items()}
#: n, id, detail, files joined by commas.
ISSUES = [
    (0, "AC001", "", "next.config.ts"), (0, "AC002", "", "next.config.ts"), (0, "AC004", "", "next.config.ts"),
    (2, "AC005", "", "next.config.js"), (2, "AC012", "", ""), (2, "AC050", "", "next.config.js"), (2, "AC051", "", "next.config.js"), (2, "AC052", "", "next.config.js"),
    (3, "AC010", "", "middleware.js"),
    (4, "AC020", "", ".gitignore,.env,.env.local"), (4, "AC021", "NEXT_PUBLIC_SECRET_KEY", ".env.local"), (4, "AC021", "NEXT_PUBLIC_API_TOKEN", ".env.local"),
    (5, "AC022", "", ".env.example"), (6, "AC020", "", ".gitignore,.env.example"),
    (7, "AC030", "/api/cron/clean", "vercel.json,app/api/cron/clean/deep/route.ts"), (7, "AC031", "", "vercel.json"), (7, "AC040", "1", "app/api/cron/clean/deep/route.ts"),
    (9, "AC011", "1", "middleware.ts,app/api/out/route.ts"), (11, "AC011", "1", "middleware.ts,app/api/out/route.ts"),
    (13, "AC040", "7", "app/api/r0/route.ts,app/api/r1/route.ts,app/api/r2/route.ts,app/api/r3/route.ts,app/api/r4/route.ts"),
    (14, "AC040", "1", "src/app/a/route.ts"),
]
ROWS = [(n, i, SEVERITY[i], audit.CHECKS[i][1], d, f) for n, i, d, f in ISSUES]


def _audited(s, d):
    kinds, files = held(s, d, PROJECTS, "part", "p_partkey")
    found = audit.config_audit(files, own=["myGuard"])
    rows = found.join(kinds, "project").select("n", "id", "severity", "category", "detail", F.array_join("files", ",").alias("files"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("projects"))


def queries():
    return {"config_audit": _audited}


def oracle_sql():
    columns = "n, id, severity, category, detail, files"
    kinds = f"k as (select p_partkey % {len(PROJECTS)} as n from part)"
    return {"config_audit": f"with {kinds}, e({columns}) as (values {literals(ROWS)}) select {columns}, count(*) as projects from e join k using (n) group by all"}
