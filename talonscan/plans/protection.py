"""Queries of ``operators.middleware`` and ``operators.crossfile`` over written projects, and the rows they have to give, stated as literals. Same form as ``registry``.

Each supplier stands for one project; which files it holds follows from its key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talonscan.operators import crossfile, middleware
from talonscan.plans.kernel import literals

GET = "export async function GET() { return 1; }"
#: Files (path, text) of each kind of project.
PROJECTS = [
    [("middleware.ts", "export const config = { matcher: ['/admin/:path*', '/u/:id'] };"), ("app/admin/x/route.ts", GET), ("app/u/[id]/route.ts", GET), ("app/open/route.ts", GET), ("app/u/[id]/more/route.ts", GET)],
    [("src/proxy.ts", "// matcher: ['/no']\nexport const config = { matcher: [\"/((?!_next|[^?]*\\\\.css).*)\"] }"), ("src/app/a/route.ts", GET), ("src/app/_next/route.ts", GET)],
    [("lib/proxy.ts", "matcher: ['/a']"), ("app/a/route.ts", GET)],
    [("lib/my.middleware.js", "matcher: '/a'"), ("app/a/route.ts", GET), ("app/b/route.ts", "export const POST = async () => { const s = await checkSession(); }")],
    [("middleware.ts", "import x from 'next-intl/middleware'; export default x();"), ("app/a/route.ts", GET)],
    [("middleware.ts", "const p = createRouteMatcher(['/p(.*)']); export const config = { matcher: ['/x'] };"), ("app/p/q/route.ts", GET), ("app/x/route.ts", GET)],
    [("middleware.ts", "export default function middleware() {}"), ("app/a/route.ts", "export const PUT = mine(() => needsKey());")],
    [("middleware.ts", "matcher: ['/a(', '/b']"), ("app/b/route.ts", GET), ("app/c/route.ts", None)],
    [("app/admin/layout.tsx", "const s = await getServerSession(o);"), ("app/admin/users/page.tsx", "x"), ("app/admin/(in)/a/route.ts", GET), ("app/page.tsx", "x"), ("app/administer/route.ts", GET), ("app/own/page.jsx", "await getSession(req)")],
    [("layout.tsx", "auth()"), ("app/layout.tsx", "return children;"), ("app/a/page.tsx", "x")],
]
#: n, path, url, method, guarded, covered, source.
PROTECTED = [
    (0, "app/admin/x/route.ts", "/admin/x", "GET", False, True, "middleware"), (0, "app/u/[id]/route.ts", "/u/[id]", "GET", False, True, "middleware"),
    (0, "app/open/route.ts", "/open", "GET", False, False, "none"), (0, "app/u/[id]/more/route.ts", "/u/[id]/more", "GET", False, False, "none"),
    (1, "src/app/a/route.ts", "/a", "GET", False, True, "middleware"), (1, "src/app/_next/route.ts", "/_next", "GET", False, False, "none"),
    (2, "app/a/route.ts", "/a", "GET", False, False, "none"), (3, "app/a/route.ts", "/a", "GET", False, True, "middleware"),
    (3, "app/b/route.ts", "/b", "POST", True, False, "auth-guard"), (4, "app/a/route.ts", "/a", "GET", False, False, "none"),
    (5, "app/p/q/route.ts", "/p/q", "GET", False, True, "middleware"), (5, "app/x/route.ts", "/x", "GET", False, False, "none"),
    (6, "app/a/route.ts", "/a", "PUT", True, True, "auth-guard"), (7, "app/b/route.ts", "/b", "GET", False, True, "middleware"),
    (8, "app/admin/users/page.tsx", "/admin/users", "PAGE", True, False, "layout"), (8, "app/admin/(in)/a/route.ts", "/admin/a", "GET", True, False, "layout"), (8, "app/page.tsx", "/", "PAGE", False, False, "none"),
    (8, "app/administer/route.ts", "/administer", "GET", False, False, "none"), (8, "app/own/page.jsx", "/own", "PAGE", True, False, "auth-guard"), (9, "app/a/page.tsx", "/a", "PAGE", False, False, "none"),
]

#: Files of each kind of project: calls in one file, functions in another.
LINKED = [
    [("api/a.ts", "import { find as look, other } from '../lib/db';\nconst id = req.query.id;\nconst t = id + 'x';\nlook(1, t);\nother(t);"),
     ("lib/db.ts", "export function find(n: number, q: string) {\n  const s = q;\n  db.query(`select ${s}`);\n}\nexport function other(q) {\n  const ok = sanitizeIt(q);\n  eval(q);\n}")],
    [("a.js", "const run = require('./run.js');\nrun(req.body.cmd);\nrun('fixed');"), ("run.js", "function go(c) {\n  exec(c);\n}\nmodule.exports = go;")],
    [("a.ts", "import * as m from './m';\nimport d, { w } from './m';\nm.w(f(1, 2), req.body.x);\nd(req.body.y);\nw(1,\n  req.body.z);"),
     ("m.ts", "export default function any(u) { redirect(u); }\nexport const w = (a, b) => fs.writeFileSync(b, a);")],
    [("a.ts", "import { pass, sink } from './p';\nconst v = pass(req.body.v);\nsink(v);"), ("p.ts", "export function pass(x) {\n  return x;\n}\nexport function sink(x) {\n  eval(x);\n}")],
    [("a.ts", "import { w } from 'm';\nw(req.body.x);"), ("m.ts", "function w(a) { eval(a); }"), (None, None)],
    [("a.ts", "import { pass, sink } from './p';\nconst v = pass(\n  req.body.v);\nsink(v);"), ("p.ts", "export function pass(x) {\n  return x;\n}\nexport function sink(x) {\n  eval(x);\n}")],
]
#: n, path, source, source_line, variable, line, name, sink, severity, sink_file, sink_line.
LINKS = [
    (0, "api/a.ts", "propagated", 3, "t", 4, "find", "sql-injection", "critical", "lib/db.ts", 3),
    (1, "a.js", "http-input", 2, "", 2, "default", "command-injection", "critical", "run.js", 2),
    (2, "a.ts", "http-input", 3, "", 3, "w", "path-traversal", "high", "m.ts", 2), (2, "a.ts", "http-input", 4, "", 4, "default", "open-redirect", "medium", "m.ts", 1),
    (2, "a.ts", "http-input", 5, "", 5, "w", "path-traversal", "high", "m.ts", 2), (3, "a.ts", "http-input", 2, "v", 3, "sink", "code-injection", "critical", "p.ts", 5),
    (5, "a.ts", "return-propagated", 2, "v", 4, "sink", "code-injection", "critical", "p.ts", 5),
]


def held(s, d, projects, table="supplier", key="s_suppkey"):
    """Projects by their key (project, n), and their files (project, file, content)."""
    row = "struct<path: string, content: string>"
    of = F.array(*[F.array(*[F.struct(F.lit(p).cast("string").alias("path"), F.lit(t).cast("string").alias("content")) for p, t in files]).cast(f"array<{row}>") for files in projects])
    kinds = s.read.parquet(f"{d}/{table}.parquet").select(F.concat(F.lit("s"), key).alias("project"), F.pmod(key, F.lit(len(projects))).cast("int").alias("n"))
    return kinds, kinds.select("project", F.inline(F.get(of, F.col("n")))).withColumnRenamed("path", "file")


def _links(s, d):
    kinds, files = held(s, d, LINKED)
    columns = ["n", F.col("file").alias("path"), "source", "source_line", "variable", "line", "name", "sink", "severity", "sink_file", "sink_line"]
    return crossfile.cross_file_flows(files).join(kinds, "project").groupBy(*columns).agg(F.count("*").alias("files"))


def _protection(s, d):
    kinds, files = held(s, d, PROJECTS)
    found = middleware.protection(files, ["needsKey"])
    return found.join(kinds, "project").groupBy("n", F.col("file").alias("path"), "url", "method", "guarded", "covered", "source").agg(F.count("*").alias("files"))


def queries():
    return {"route_protection": _protection, "cross_file_taint": _links}


def oracle_sql():
    each = lambda n, columns, rows: f"with p as (select s_suppkey % {n} as n from supplier), e({columns}) as (values {literals(rows)}) select {columns}, count(*) as files from e join p using (n) group by all"
    return {
        "route_protection": each(len(PROJECTS), "n, path, url, method, guarded, covered, source", PROTECTED),
        "cross_file_taint": each(len(LINKED), "n, path, source, source_line, variable, line, name, sink, severity, sink_file, sink_line", LINKS),
    }
