"""The fix loop over written files, and the texts that it has to end with, stated as literals. Same form as ``registry``.

Each supplier stands for one file; which text it holds follows from its key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talonscan.operators import fixes, kernel
from talonscan.plans.kernel import SCRIPT, literals

PACK = [
    kernel.Rule("VG001", "critical", r"(?i)(?:password|secret|token|api_?key)\s*[:=]\s*[\"'][^\"'\n]{6,}[\"']", SCRIPT),
    kernel.Rule("VG012", "high", r"\.innerHTML\s*=", SCRIPT),
    kernel.Rule("VG014", "high", r"\beval\s*\(", SCRIPT),
    kernel.Rule("VG040", "medium", r"origin:\s*[\"']\*[\"']", SCRIPT),
    kernel.Rule("VG420", "high", r"export\s+async\s+function\s+(?:GET|POST)\b", SCRIPT),
    kernel.Rule("VG777", "low", r"process\.env\.DEBUG_\w+", SCRIPT),
    kernel.Rule("VG1036", "high", r"noSandbox\s*:\s*true", SCRIPT),
]
ROUTE = 'import x from "x";\n\nexport async function POST(req) {\n  run();\n}'
GUARDED = 'import x from "x";\nimport { auth } from "@clerk/nextjs/server";\n\n  const { userId } = await auth();\n  if (!userId) return new Response("Unauthorized", { status: 401 });\nexport async function POST(req) {\n  run();\n}'
BAD = 'const debugToken = "abcdef1234";'
#: (text before, status, findings before, after, rules applied in order, rules resolved, text after).
CASES = [
    ('const apiKey = "abcdef123456";\nuse(apiKey);', "secured", 1, 0, "VG001", "VG001", "const apiKey = process.env.API_KEY;\nuse(apiKey);"),
    ("const a = 1;", "clean", 0, 0, "", "", "const a = 1;"),
    ("'use client'\na.innerHTML = x;\nb.innerHTML = y;", "secured", 2, 0, "VG012,VG012", "VG012", "'use client'\na.textContent = x;\nb.textContent = y;"),
    ("cors({ origin: '*' });\n", "secured", 1, 0, "VG040", "VG040", "cors({ origin: process.env.ALLOWED_ORIGIN });\n"),
    (ROUTE, "secured", 1, 0, "VG420", "VG420", GUARDED),
    (BAD, "no_autofix", 1, 1, "", "", BAD),
    ("eval(x);\nrun({ noSandbox: true, a: 1 });", "partial", 2, 1, "VG1036", "VG1036", "eval(x);\nrun({ a: 1 });"),
    (f"{BAD}\na.innerHTML = x;\nb.innerHTML = y;", "partial", 3, 1, "VG012,VG012", "VG012", f"{BAD}\na.textContent = x;\nb.textContent = y;"),
    ("a.innerHTML = f({ origin: \"*\" });", "secured", 2, 0, "VG012,VG040", "VG012,VG040", "a.textContent = f({ origin: process.env.ALLOWED_ORIGIN });"),
    (None, "clean", 0, 0, "", "", None),
]


def _fixed(s, d):
    texts = F.array(*[F.lit(t[0]).cast("string") for t in CASES])
    key = (F.col("s_suppkey") % len(CASES)).cast("int")
    files = s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("f"), "s_suppkey").alias("file"), F.lit("src/a.ts").alias("path"), F.lit("typescript").alias("language"), F.lit(None).cast("string").alias("framework"), F.get(texts, key).alias("content"), key.alias("n"))
    done = fixes.fix_loop(files.drop("n"), lambda f: kernel.scan(f, PACK)).join(files.select("file", "n"), "file")
    rules = F.array_join(F.transform("applied", lambda e: e["rule_id"]), ",")
    return done.groupBy("n", "status", "initial", "final", rules.alias("applied"), F.array_join("resolved", ",").alias("resolved"), "content").agg(F.count("*").alias("files"))


def queries():
    return {"fix_loop": _fixed}


def oracle_sql():
    columns = "n, status, initial, final, applied, resolved, content"
    rows = [(n, *c[1:]) for n, c in enumerate(CASES)]
    return {"fix_loop": f"with p as (select s_suppkey % {len(CASES)} as n from supplier), e({columns}) as (values {literals(rows)}) select {columns}, count(*) as files from e join p using (n) group by all"}
