"""Queries of a large pack over whole pages, and of the guards of matches over written files. Same form as ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from talonscan.operators import kernel
from talonscan.plans.kernel import SCRIPT, literals

#: Rules of the large pack, made of three syllables each, from all such words by regular steps.
SYLLABLES = "th er on an re he in ed nd ha en sch ver que la de ou le un ch".split()
WORDS = list(dict.fromkeys(a + b + c for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES))[::19][:375]


def large_pack() -> list[kernel.Rule]:
    return [kernel.Rule(f"P{n:03d}", "low", f"[ >]{p}[a-z]+", ("html",)) for n, p in enumerate(WORDS)]


FIND = kernel.Rule("VG950", "high", r"\.find(?:Unique|First)\s*\(\s*\{", SCRIPT)
CHANGE = kernel.Rule("VG951", "high", r"\.(?:delete|update)\s*\(\s*\{", SCRIPT)
ROUTE = kernel.Rule("VG406", "high", r"(?:params|searchParams)\b[\s\S]*?\b(?:query|findMany|findUnique|execute)\s*\(", SCRIPT)
REGEX = kernel.Rule("VG126", "medium", r"new\s+RegExp\s*\(", SCRIPT)
SQL = kernel.Rule("VG123", "high", r"query\s*\(\s*`[^`]*\$\{", SCRIPT)
LOOSE_SQL = kernel.Rule("VG010", "critical", r"\b(?:query|get|run)\s*\(\s*`[^`]*\$\{", SCRIPT)
OTHERS = [
    kernel.Rule("VG012", "high", r"\.innerHTML\s*=", SCRIPT), kernel.Rule("VG152", "medium", r"req\.body[\s\S]{0,100}?\w+\[\s*key\s*\]", SCRIPT),
    kernel.Rule("VG1009", "medium", r"\.ilike\(", SCRIPT), kernel.Rule("VG426", "medium", r"/api/admin/", SCRIPT), kernel.Rule("VG999", "low", r"generateText\(\{[^}]*\}", SCRIPT),
    kernel.Rule("VG1027", "low", r"json\(\{\s*messages", SCRIPT), kernel.Rule("VG863", "low", r'"name"\s*:', ("json",)), kernel.Rule("VG955", "medium", r"findMany\(\{[^)]*\}\s*\)", SCRIPT),
    kernel.Rule("VG1002", "medium", r"isAdmin\b", SCRIPT), kernel.Rule("VG106", "medium", r"token\s*===", SCRIPT), kernel.Rule("VG138", "medium", r"password\w*\s*===", SCRIPT),
    kernel.Rule("VG409", "medium", r"redirect\(\s*\w+", SCRIPT), kernel.Rule("VG514", "medium", r"(?i)secret\w*\s*=\s*\S+", ("shell",)), kernel.Rule("VG020", "medium", r'"\*"', ("json",)),
    kernel.Rule("VG850", "high", r"system:\s*`[^`]*?\$\{", SCRIPT), kernel.Rule("VG1021", "medium", r"z\.enum\(\s*[a-z]\w*", SCRIPT), kernel.Rule("VG1083", "medium", r"jwt\.decode\(", SCRIPT),
]
PACK = [FIND, CHANGE, ROUTE, REGEX, SQL, LOOSE_SQL, *OTHERS]
H = "export async function GET(req, { params, ctx }) {\n"
#: (path, language, text, rules that still hit, with their lines).
CASES = [
    ("app/a/route.ts", "typescript", H + "  const key = params.key;\n  return db.item.findMany({ where: { key } });\n}", [("VG406", 1), ("VG955", 3)]),
    ("app/a/route.ts", "typescript", H + "  log(params.key);\n  return db.item.findMany({ take: 5 });\n}", [("VG955", 3)]),
    ("a.ts", "typescript", H + "  return db.t.findUnique({ where: { id: params.id } });\n}", [("VG406", 1), ("VG950", 2)]),
    ("a.ts", "typescript", H + "  return db.t.findUnique({ where: { id: params.id, team: { some: { userId: ctx.user.id } } } });\n}", [("VG406", 1)]),
    (None, "typescript", H + "  return db.t.findFirst({ where: { id: x.id, userId: ctx.user.id } });\n}", [("VG950", 2)]),
    ("a.ts", "typescript", "async function h(ctx, v) {\n  const t = await load(v.id);\n  if (t.ownerId !== ctx.user.id) return;\n  await db.t.delete({ where: { id: v.id } });\n}", []),
    ("a.ts", "typescript", "async function h(ctx, v) {\n  await db.t.delete({ where: { id: v.id } });\n}", [("VG951", 2)]),
    ("a.ts", "typescript", "async function h(ctx, v) {\n  await ensureMemberRole(ctx.user, v.teamId);\n  await db.t.update({ where: { id: v.teamId } });\n}", []),
    ("a.ts", "typescript", "const NAMES = ['a', 'b'];\nconst f = (t) => NAMES.some((n) => new RegExp(n).test(t));\nconst g = (n) => new RegExp(escapedName);\n\n\nconst h = (q) => new RegExp(q);", [("VG126", 6)]),
    ("a.ts", "typescript", "db.query(`select * from t where a in (${ids.map(() => '?').join(',')})`, ids);\ndb.query(`select * from t where a = $1 and b = ${hash(b)}`, { bind: [a] });\ndb.query(`select ${b}`);", [("VG010", 3), ("VG123", 3)]),
    ("a.service.ts", "typescript", "this.http.get(`/x/${id}`);\ncache.get(`k:${id}`);\ndb.run(`delete from t where a = ${id}`);\nthis.get(`${base}/y`);", [("VG010", 3)]),
    ("a.ts", "typescript", "import jsforce from 'jsforce';\nconst s = sanitizeForSoql(x);\nconn.query(`select ${s}`);", []),
    ("a.js", "javascript", "a.innerHTML = \"<b>x</b>\";\n// biome-ignore lint/security/noDangerouslySetInnerHtml: fine\nb.innerHTML = x;\n\n\nc.innerHTML = x;", [("VG012", 6)]),
    ("a.js", "javascript", "const a = req.body; o[key] = a;\nconst b = req.body; use(o[key]);", [("VG152", 1)]),
    ("a.js", "javascript", "q.ilike(`%${escaped}%`);\nq.ilike(`%${name}%`);", [("VG1009", 2)]),
    ("a.js", "javascript", "x = 1; /* * */\n  * GET /api/admin/x\nfetch('/api/admin/x');", [("VG426", 3)]),
    ("a.js", "javascript", "generateText({ output: Output.object({ s }) });\n\ngenerateText({ model });", [("VG999", 3)]),
    ("a.js", "javascript", "json({ messages: convertToUIMessages(m) });\n\n\n\njson({ messages: m });", [("VG1027", 5)]),
    ("package.json", "json", '{"name": "x", "private": true}', []), ("package.json", "json", '{"name": "x", "scripts": {"start": "NODE_ENV=production node a.js"}}', []),
    ("package.json", "json", '{"name": "x", "main": "dist/a.js", "scripts": {"start": "node a.js"}}', [("VG863", 1)]),
    ("package.json", "json", '{\n"engines": {\n"node": "*"\n},\n"dependencies": {\n"a": "*"\n}}', [("VG020", 6)]),
    ("app/api/a/route.ts", "typescript", "db.a.findMany({ where: { teamId } })\ndb.a.findMany({ where: { id: { in: ids } } })\ndb.a.findMany({ where: { open: true } })", [("VG955", 3)]),
    ("a.ts", "typescript", "const o = { isAdmin: false };\nconst p = { isAdmin: req.x };", [("VG1002", 2)]),
    ("a.ts", "typescript", "if (tokenRef.current && token === x) {}\nif (token === y) {}", [("VG106", 2)]),
    ("a.ts", "typescript", "if (password === confirmPassword) {}\nif (password === stored) {}", [("VG138", 2)]),
    ("a.ts", "typescript", "const next: string = '/home';\nredirect(next);\nredirect(other);", [("VG409", 3)]),
    ("a.sh", "shell", "SECRET=$OTHER\nSECRET_KEY=abc", [("VG514", 2)]),
    ("a.ts", "typescript", "const a = { system: `You are ${role}` };\n\n\n\n\n\n\n\nconst b = { system: `You are ${userInput}` };", [("VG850", 9)]),
    ("a.ts", "typescript", "const kinds = ['a'];\nz.enum(kinds);\nz.enum(others);\nz.enum(table.column.enumValues);", [("VG1021", 3)]),
    ("a.ts", "typescript", "jwt.decode(t);", [("VG1083", 1)]), ("a.ts", "typescript", "jwt.decode(t); jwt.verify(t, k);", []),
]


def _pages(s, d):
    pages = s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("file"), F.lit(None).cast("string").alias("path"), F.lit("html").alias("language"), F.lit(None).cast("string").alias("framework"), F.col("html").alias("content"))
    found = kernel.scan(pages, large_pack()).groupBy("rule_id", "file").agg(F.count("*").alias("n"))
    return found.groupBy("rule_id").agg(F.sum("n").alias("matches"), F.count("*").alias("pages"))


def _cases(s, d):
    texts = F.array(*[F.struct(F.lit(p).cast("string").alias("path"), F.lit(x).alias("language"), F.lit(t).alias("content")) for p, x, t, _ in CASES])
    rows = s.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % len(CASES)).cast("int").alias("n"))
    files = rows.select(F.col("n").alias("file"), F.inline(F.array(F.get(texts, F.col("n"))))).withColumn("framework", F.lit(None).cast("string"))
    return kernel.scan(files, PACK).groupBy(F.col("file").alias("n"), "rule_id", "line").agg(F.count("*").alias("files"))


def queries():
    return {"pack_matches": _pages, "match_guards": _cases}


def oracle_sql():
    kept = [(n, r, line) for n, (_, _, _, found) in enumerate(CASES) for r, line in found]
    pairs = ", ".join(f"('P{n:03d}', '{p}')" for n, p in enumerate(WORDS))
    return {
        "pack_matches": f"with r(rule_id, p) as (values {pairs}), m as (select rule_id, len(regexp_extract_all(html, '[ >]' || p || '[a-z]+')) as n from pages, r where contains(html, p)) "
        "select rule_id, sum(n)::bigint as matches, count(*) as pages from m where n > 0 group by rule_id",
        "match_guards": f"with p as (select p_partkey % {len(CASES)} as n from part), e(n, rule_id, line) as (values {literals(kept)}) select n, rule_id, line, count(*) as files from e join p using (n) group by all",
    }
