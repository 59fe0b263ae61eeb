"""Policies of a project from what it is built with.

Each file tells which capabilities its text shows, an array of a few dozen at most; a project's capabilities are their union, combined before the
shuffle. Policies are expressions over that one row: directives are unions of what each capability adds, in the order of the table.

Defined results: whole texts of all source files count; a project that shows nothing gets the strict defaults; null content shows nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Capabilities and the texts that show them, frameworks by precedence first.
FRAMEWORKS = [("nextjs", ["next"]), ("nuxt", ["nuxt"]), ("sveltekit", ["svelte"]), ("astro", ["astro"]), ("remix", ["remix"])]
SHOWN_BY = FRAMEWORKS + [
    ("tailwindcss", ["tailwindcss"]), ("radix-ui", ["@radix-ui", "shadcn"]),
    ("clerk", ["@clerk"]), ("next-auth", ["next-auth", "@auth/"]), ("supabase-auth", ["@supabase/auth"]), ("firebase-auth", ["firebase/auth", "firebase-admin"]), ("descope", ["@descope"]),
    ("supabase", ["@supabase"]), ("prisma", ["prisma"]), ("drizzle", ["drizzle"]), ("neon", ["@neondatabase", "@vercel/postgres"]), ("mongodb", ["mongoose", "mongodb"]), ("upstash-redis", ["@upstash/redis"]),
    ("stripe", ["stripe"]), ("polar", ["@polar"]), ("lemonsqueezy", ["lemonsqueezy"]),
    ("openai", ["openai", "@ai-sdk", "OPENAI_API_KEY"]), ("anthropic", ["anthropic", "ANTHROPIC_API_KEY"]), ("google-ai", ["@google/generative-ai", "@ai-sdk/google"]),
    ("vercel-blob", ["@vercel/blob"]), ("s3", ["@aws-sdk/client-s3", "aws-sdk"]), ("cloudinary", ["cloudinary"]), ("uploadthing", ["@uploadthing"]),
    ("sanity", ["sanity"]), ("contentful", ["contentful"]),
    ("vercel-analytics", ["@vercel/analytics"]), ("posthog", ["posthog"]), ("sentry", ["@sentry"]),
    ("fonts.googleapis.com", ["fonts.googleapis.com"]), ("cdn.jsdelivr.net", ["cdn.jsdelivr.net"]), ("unpkg.com", ["unpkg.com"]), ("cdnjs.cloudflare.com", ["cdnjs.cloudflare.com"]),
]
#: Directives with their defaults, and what capabilities add to them, in order.
DIRECTIVES = {
    "default-src": ["'self'"], "script-src": ["'self'"], "style-src": ["'self'", "'unsafe-inline'"], "img-src": ["'self'", "data:", "blob:"], "font-src": ["'self'"], "connect-src": ["'self'"],
    "frame-src": ["'none'"], "object-src": ["'none'"], "base-uri": ["'self'"], "form-action": ["'self'"], "frame-ancestors": ["'none'"],
}
ADDED = [
    ("nextjs", "script-src", ["'unsafe-eval'"]),
    ("vercel-analytics", "script-src", ["https://va.vercel-scripts.com"]), ("vercel-analytics", "connect-src", ["https://vitals.vercel-insights.com"]),
    ("posthog", "script-src", ["https://us.i.posthog.com", "https://eu.i.posthog.com"]), ("posthog", "connect-src", ["https://us.i.posthog.com", "https://eu.i.posthog.com"]),
    ("sentry", "script-src", ["https://*.sentry.io"]), ("sentry", "connect-src", ["https://*.sentry.io"]),
    ("vercel-blob", "img-src", ["https://*.public.blob.vercel-storage.com"]), ("s3", "img-src", ["https://*.s3.amazonaws.com"]), ("cloudinary", "img-src", ["https://res.cloudinary.com"]), ("uploadthing", "img-src", ["https://utfs.io"]),
    ("sanity", "img-src", ["https://cdn.sanity.io"]), ("contentful", "img-src", ["https://images.ctfassets.net"]),
    ("fonts.googleapis.com", "style-src", ["https://fonts.googleapis.com"]), ("fonts.googleapis.com", "font-src", ["https://fonts.gstatic.com"]),
    ("cdn.jsdelivr.net", "script-src", ["https://cdn.jsdelivr.net"]), ("unpkg.com", "script-src", ["https://unpkg.com"]), ("cdnjs.cloudflare.com", "script-src", ["https://cdnjs.cloudflare.com"]),
    ("clerk", "connect-src", ["https://*.clerk.accounts.dev", "https://clerk.com"]), ("clerk", "script-src", ["https://*.clerk.accounts.dev"]),
    ("supabase-auth", "connect-src", ["https://*.supabase.co"]), ("firebase-auth", "connect-src", ["https://*.firebaseapp.com", "https://*.googleapis.com"]),
    ("stripe", "script-src", ["https://js.stripe.com"]), ("stripe", "connect-src", ["https://api.stripe.com"]),
    ("openai", "connect-src", ["https://api.openai.com"]), ("anthropic", "connect-src", ["https://api.anthropic.com"]), ("google-ai", "connect-src", ["https://generativelanguage.googleapis.com"]),
    ("supabase", "connect-src", ["https://*.supabase.co"]),
]
#: Frames, of which the last capability's replace those before, and one adds; origins of other sites; limits a minute; headers.
FRAMES = [("clerk", "https://*.clerk.accounts.dev"), ("firebase-auth", "https://*.firebaseapp.com")]
FRAME_ADDED = ("stripe", "https://js.stripe.com")
ORIGINS = [("clerk", "https://*.clerk.accounts.dev"), ("stripe", "https://js.stripe.com")]
NO_ORIGIN = "https://yourdomain.com"
LIMITS = {"global": 100, "auth": 5, "api": 60, "api with models": 20}
MODELS = ["openai", "anthropic", "google-ai"]
PAYMENTS = ["stripe", "polar", "lemonsqueezy"]
HEADERS = [
    ("Strict-Transport-Security", "max-age=63072000; includeSubDomains; preload"), ("X-Frame-Options", "DENY"), ("X-Content-Type-Options", "nosniff"),
    ("Referrer-Policy", "strict-origin-when-cross-origin"), ("Permissions-Policy", "camera=(), microphone=(), geolocation=()"),
]
NEXT_HEADER = ("X-DNS-Prefetch-Control", "on")
#: Row policies (table, statement) of projects with a hosted database, with payments too, and with a mapper.
ROWS = [
    ("profiles", 'CREATE POLICY "Users can view own profile" ON profiles FOR SELECT USING (auth.uid() = id);'),
    ("profiles", 'CREATE POLICY "Users can update own profile" ON profiles FOR UPDATE USING (auth.uid() = id) WITH CHECK (auth.uid() = id);'),
    ("*", "ALTER TABLE your_table ENABLE ROW LEVEL SECURITY;"),
    ("*", "REVOKE ALL ON your_table FROM anon; GRANT SELECT ON your_table TO anon;"),
]
PAID_ROWS = ("subscriptions", 'CREATE POLICY "Users can view own subscription" ON subscriptions FOR SELECT USING (auth.uid() = user_id);')
MAPPED_ROWS = ("N/A (ORM-level)", "// Always filter by authenticated user\nconst items = await prisma.item.findMany({ where: { userId: session.user.id } });")
SKIPPED = ["node_modules", ".git", ".next", "build", "dist", "coverage", ".turbo", "vendor"]
DEEPEST = 6
SOURCE = r"(?:^|/)(?:\.env(?:\.local|\.example)?|[^/]*\.(?:ts|tsx|js|jsx|mjs|env|json|toml|yaml|yml))\z"


def capabilities(files: DataFrame) -> DataFrame:
    """(project, file, content) to (project, has): the capabilities of each project, sorted."""
    folders = F.split(F.regexp_replace("file", "/?[^/]*$", ""), "/")
    deep = F.when(F.col("file").contains("/"), F.size(folders)).otherwise(0)
    read = F.col("file").rlike(SOURCE) & (deep <= DEEPEST) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED)))
    shown = F.array(*[F.when(_any(F.col("content").contains(t) for t in texts), name) for name, texts in SHOWN_BY])
    rows = files.select(F.col("project").cast("string").alias("project"), F.when(read, F.array_compact(shown)).alias("has"))
    return rows.groupBy("project").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("has")))).alias("has"))


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _joined(parts: list[Column]) -> Column:
    return F.array_distinct(F.flatten(F.array(*parts)))


def policies(known: DataFrame) -> DataFrame:
    """(project, has) to (project, framework, csp, origins, rows, limits, headers)."""
    has = lambda *names: F.arrays_overlap("has", F.array(*map(F.lit, names)))
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    none = F.array().cast("array<string>")
    framework = F.lit(None).cast("string")
    for name, _ in reversed(FRAMEWORKS):
        framework = F.when(has(name), name).otherwise(framework)
    frames = texts(DIRECTIVES["frame-src"])
    for name, host in FRAMES:
        frames = F.when(has(name), texts(["'self'", host])).otherwise(frames)
    own = F.when(has(*[n for n, _ in FRAMES]), frames).otherwise(texts(["'self'"]))
    frames = F.when(has(FRAME_ADDED[0]), F.concat(own, texts([FRAME_ADDED[1]]))).otherwise(frames)
    # what only the framework in use adds counts for it alone
    uses = lambda name: (framework == name) if name in dict(FRAMEWORKS) else has(name)
    csp = []
    for directive, base in DIRECTIVES.items():
        values = frames if directive == "frame-src" else _joined([texts(base), *[F.when(F.coalesce(uses(n), F.lit(False)), texts(v)).otherwise(none) for n, d, v in ADDED if d == directive]])
        csp.append(F.concat(F.lit(directive + " "), F.array_join(values, " ")))
    origins = F.array_compact(F.array(*[F.when(has(n), o) for n, o in ORIGINS]))
    row = lambda t: F.struct(F.lit(t[0]).alias("table"), F.lit(t[1]).alias("statement"))
    rows = F.array_compact(F.array(*[F.when(has("supabase"), row(r)) for r in ROWS], F.when(has("supabase") & has(*PAYMENTS), row(PAID_ROWS)), F.when(has("prisma", "drizzle"), row(MAPPED_ROWS))))
    header = lambda h: F.struct(F.lit(h[0]).alias("key"), F.lit(h[1]).alias("value"))
    headers = F.array_compact(F.array(*map(header, HEADERS), F.when(framework == "nextjs", header(NEXT_HEADER))))
    api = F.when(has(*MODELS), LIMITS["api with models"]).otherwise(LIMITS["api"])
    limits = F.struct(F.lit(LIMITS["global"]).alias("all"), F.lit(LIMITS["auth"]).alias("auth"), api.alias("api"))
    return known.select(
        "project", framework.alias("framework"), F.concat_ws("; ", *csp).alias("csp"), F.when(F.size(origins) > 0, origins).otherwise(texts([NO_ORIGIN])).alias("origins"), rows.alias("rows"), limits.alias("limits"), headers.alias("headers")
    )


def generate_policies(files: DataFrame) -> DataFrame:
    """(project, file, content) to one row of policies a project."""
    return policies(capabilities(files))
