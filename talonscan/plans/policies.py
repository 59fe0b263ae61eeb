"""Generated policies of written projects, and the texts that they have to be. Same form as ``registry``.

Each part stands for one project; which files it holds follows from its key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talonscan.operators import policies
from talonscan.plans.kernel import literals
from talonscan.plans.protection import held

REST = "object-src 'none'; base-uri 'self'; form-action 'self'; frame-ancestors 'none'"
STRICT = f"default-src 'self'; script-src 'self'; style-src 'self' 'unsafe-inline'; img-src 'self' data: blob:; font-src 'self'; connect-src 'self'; frame-src 'none'; {REST}"
SHOP = (
    "default-src 'self'; script-src 'self' 'unsafe-eval' https://*.clerk.accounts.dev https://js.stripe.com; style-src 'self' 'unsafe-inline' https://fonts.googleapis.com; img-src 'self' data: blob: https://res.cloudinary.com; "
    "font-src 'self' https://fonts.gstatic.com; connect-src 'self' https://*.clerk.accounts.dev https://clerk.com https://api.stripe.com https://*.supabase.co; "
    f"frame-src 'self' https://*.clerk.accounts.dev https://js.stripe.com; {REST}"
)
TALK = (
    "default-src 'self'; script-src 'self' https://us.i.posthog.com https://eu.i.posthog.com https://unpkg.com; style-src 'self' 'unsafe-inline'; img-src 'self' data: blob:; font-src 'self'; "
    f"connect-src 'self' https://us.i.posthog.com https://eu.i.posthog.com https://*.firebaseapp.com https://*.googleapis.com https://api.openai.com; frame-src 'self' https://*.firebaseapp.com; {REST}"
)
PAID = STRICT.replace("script-src 'self'", "script-src 'self' https://js.stripe.com").replace("connect-src 'self'", "connect-src 'self' https://api.stripe.com").replace("frame-src 'none'", "frame-src 'self' https://js.stripe.com")
#: Files (path, text) of each kind of project, and what it gets: framework, csp, origins, tables of row policies, limit of the interface, number of headers.
KINDS = [
    ([("readme.md", "stripe"), ("node_modules/a.js", "stripe"), ("a/b/c/d/e/f/g/h.ts", "openai")], (None, STRICT, "https://yourdomain.com", "", 60, 5)),
    ([("package.json", '{"dependencies": {"next": "15", "@clerk/nextjs": "6", "@supabase/supabase-js": "2"}}'), ("app/pay.ts", "import Stripe from 'stripe';"), ("app/a.tsx", "cloudinary.url() fonts.googleapis.com")],
     ("nextjs", SHOP, "https://*.clerk.accounts.dev,https://js.stripe.com", "profiles,profiles,*,*,subscriptions", 60, 6)),
    ([("src/a.js", "import posthog from 'posthog-js'; import 'firebase/auth'; // astro"), (".env", "OPENAI_API_KEY=x"), ("i.json", '"https://unpkg.com/x"'), ("b.ts", None)], ("astro", TALK, "https://yourdomain.com", "", 20, 5)),
    ([("a.ts", "stripe")], (None, PAID, "https://js.stripe.com", "", 60, 5)),
    ([("a.ts", "prisma.x"), ("b.mjs", "remix and svelte")], ("sveltekit", STRICT, "https://yourdomain.com", "N/A (ORM-level)", 60, 5)),
]


def _policies(s, d):
    kinds, files = held(s, d, [k for k, _ in KINDS], "part", "p_partkey")
    made = policies.generate_policies(files).join(kinds, "project")
    tables = F.array_join(F.transform("rows", lambda r: r["table"]), ",")
    return made.groupBy("n", "framework", "csp", F.array_join("origins", ",").alias("origins"), tables.alias("tables"), F.col("limits.api").cast("bigint").alias("api"), F.size("headers").cast("bigint").alias("headers")).agg(F.count("*").alias("projects"))


def queries():
    return {"generated_policy": _policies}


def oracle_sql():
    columns = "n, framework, csp, origins, tables, api, headers"
    rows = [(n, *row) for n, (_, row) in enumerate(KINDS)]
    return {"generated_policy": f"with p as (select p_partkey % {len(KINDS)} as n from part), e({columns}) as (values {literals(rows)}) select {columns}, count(*) as projects from e join p using (n) group by all"}
