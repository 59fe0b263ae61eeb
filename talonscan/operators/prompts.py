"""Triage of requests to write code: what they build, whether security has to be asked for, and which rules say how.

Concepts (technologies, surfaces, terms of security) are recognised by one pattern each, native to Spark. Rules are an inverted index: postings of the
concepts whose keywords a rule's text holds. Requests meet rules through an equi join on concepts, are scored by sums, and keep the first few by ranks that are
pruned in every task; so the work follows the concepts that a request has, not the number of rules.

Defined results: a null request is empty; an empty one needs nothing. Concepts of a request come from it alone; the context only adds technologies.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talonscan.functions.scoring import severity_rank


class Concept(NamedTuple):
    """``tokens`` show it in a request, ``keywords`` in a rule; ``implies`` are surfaces that come with it."""

    id: str
    tokens: list[str]
    keywords: list[str]
    implies: list[str] = []


class Vocabulary(NamedTuple):
    techs: list[Concept]
    surfaces: list[Concept]
    terms: list[list[str]]  # groups of words for one notion of security
    vague: list[str]


def _words(text: str) -> list[str]:
    return [w.strip() for w in text.split(",")]


#: Technologies (id; tokens; keywords of rules; implied surfaces).
TECHS = [
    Concept("nextjs", _words("next.js, nextjs, next js, app router, server action, server actions, server component, server components, route handler"), _words("next.js, nextjs, server action, app router, route handler, next_public")),
    Concept("react", _words("react, jsx, tsx"), _words("react, dangerouslysetinnerhtml")),
    Concept("express", _words("express, expressjs"), ["express"]), Concept("hono", ["hono"], ["hono"]),
    Concept("supabase", _words("supabase, row level security, rls"), _words("supabase, row level security"), ["database"]),
    Concept("clerk", ["clerk"], ["clerk"], ["auth"]), Concept("nextauth", _words("next-auth, nextauth, auth.js, authjs"), _words("next-auth, nextauth, auth.js"), ["auth"]),
    Concept("stripe", ["stripe"], ["stripe"], ["payments"]), Concept("lemonsqueezy", _words("lemonsqueezy, lemon squeezy"), ["lemonsqueezy"], ["payments"]),
    Concept("prisma", ["prisma"], ["prisma"], ["database"]), Concept("drizzle", ["drizzle"], ["drizzle"], ["database"]),
    Concept("mongodb", _words("mongodb, mongoose, mongo"), _words("mongo, nosql"), ["database"]), Concept("postgres", _words("postgres, postgresql"), _words("postgres, sql"), ["database"]),
    Concept("firebase", _words("firebase, firestore"), _words("firebase, firestore"), ["database"]), Concept("trpc", ["trpc"], _words("trpc, procedure")),
    Concept("fastapi", ["fastapi"], ["fastapi"]), Concept("django", ["django"], ["django"]),
]
#: Surfaces (id; tokens; keywords of rules).
SURFACES = [
    Concept("auth", _words("auth, authentication, authorization, login, log in, signin, sign in, signup, sign up, logout, password, session, sessions, jwt, oauth, sso, 2fa, mfa, role, roles, permission, permissions, admin, account, user management"), _words("auth, session, login, access control, unauthorized, credential, jwt, bola, idor")),
    Concept("payments", _words("payment, payments, checkout, billing, subscription, subscriptions, invoice, refund, pricing, pay"), _words("stripe, payment, webhook, checkout, billing, price")),
    Concept("file-upload", _words("upload, uploads, file upload, avatar, attachment, attachments, multipart, image upload"), _words("upload, file type, multipart, path traversal, content-type")),
    Concept("user-input", _words("form, forms, input, inputs, comment, comments, search, user input, query param, query params, request body, post endpoint, api endpoint, endpoint, contact form, profile"), _words("validation, sanitiz, xss, injection, innerhtml, user input")),
    Concept("database", _words("sql, database, db, query, queries, mysql, sqlite, orm, table, schema, migration"), _words("sql, injection, query, orm, database, mass assignment")),
    Concept("secrets", _words("secret, secrets, api key, api keys, apikey, token, tokens, credential, credentials, .env, env var, env vars, environment variable, environment variables, private key"), _words("secret, credential, api key, hardcoded, env")),
    Concept("external-api", _words("external api, third-party, third party, fetch, webhook, webhooks, http request, api call, api calls, integration, proxy, scrape, scraper"), _words("ssrf, request forgery, external, url")),
    Concept("deserialization", _words("deserialize, deserialization, unserialize, pickle, yaml.load, eval, serialize"), _words("deserial, eval, prototype pollution, unserialize")),
    Concept("redirect", _words("redirect, redirects, callback url, return url, returnto, return to, callback"), _words("redirect, callback")),
]
#: Words for notions of security, signs of a vague request, thresholds of triage.
TERMS = [
    _words("auth, authn, authentication, authorization, access control, ownership check"), _words("validate, validates, validation, input validation, schema validation, zod"), _words("sanitize, sanitizes, sanitization, escape, escaping"),
    _words("rate limit, rate-limit, rate limiting, rate-limiting, throttle"), ["csrf"], ["xss"], _words("sql injection, injection, parameterized, prepared statement"),
    _words("webhook signature, signature verification, verify the signature, constructevent, hmac, timingsafeequal, timing-safe"), _words("secret manager, secrets manager, env var, environment variable"),
    _words("encrypt, encryption, hash, hashed, hashing, bcrypt, argon2, scrypt"), _words("jwt verification, verify jwt"), _words("rls, row level security, least privilege"), _words("csp, hsts, x-frame-options, security header, security headers, helmet"),
    ["cors"], _words("2fa, mfa"), _words("owasp, idor, bola, ssrf"), _words("allowlist, whitelist, denylist"),
]
VAGUE = _words("somehow, something, stuff, make it work, or whatever, etc, some kind of, quick and dirty, simple app, basic app, a thing")
AWARE, SPECIFIC, FEWEST_WORDS, MOST_RULES = 3, 4, 6, 8
DEFAULT = Vocabulary(TECHS, SURFACES, TERMS, VAGUE)
CODE = ["javascript", "typescript", "python", "go"]


class _Text(NamedTuple):
    """A text in lower case and, with hyphens and underscores as spaces, in plain form; and the words of both that may begin a token, to sift by."""

    low: Column
    plain: Column
    begun: Column | None = None


def _first(token: str) -> str:
    """The first run of word characters of a token, which stands between others in any text that has the token."""
    return re.search("[a-z0-9_-]+", token.lower()).group()


def _forms(text: Column) -> _Text:
    low = F.lower(text)
    return _Text(low, F.regexp_replace(low, "[-_]+", " "))


def mentions(text: Column | _Text, tokens: list[str]) -> Column:
    """Whether a text has one of the tokens as words of its own, hyphens and underscores as they are or as spaces."""
    forms = text if isinstance(text, _Text) else _forms(text)
    pattern = "(?<![a-z0-9_-])(?:" + "|".join(re.escape(t.lower()) for t in tokens) + ")(?![a-z0-9_-])"
    found = forms.low.rlike(pattern) | forms.plain.rlike(pattern)
    firsts = sorted({_first(t) for t in tokens})
    return found if forms.begun is None else F.exists(forms.begun, lambda w: w.isin(firsts)) & found


def _named(text: _Text, concepts: list[Concept]) -> Column:
    return F.array_compact(F.array(*[F.when(mentions(text, c.tokens), c.id) for c in concepts]))


def concepts(requests: DataFrame, words: Vocabulary = DEFAULT) -> DataFrame:
    """requests (id, prompt, context) with ``stack``, ``surfaces`` and ``terms``, the number of notions of security.

    A text is cut into words once; only tokens that begin with one of them are looked for by pattern.
    """
    prompt = F.coalesce("prompt", F.lit(""))
    rows = requests.select("id", prompt.alias("prompt"), F.concat(prompt, F.lit("\n"), F.coalesce("context", F.lit(""))).alias("_all"))
    own, every = _forms(F.col("prompt")), _forms(F.col("_all"))
    rows = rows.select("id", "prompt", own.low.alias("_low"), own.plain.alias("_plain"), every.low.alias("_all_low"), every.plain.alias("_all_plain"))
    firsts = sorted({_first(t) for c in (*words.techs, *words.surfaces) for t in c.tokens} | {_first(t) for ts in words.terms for t in ts})
    begun = lambda a, b: F.filter(F.array_distinct(F.concat(*[F.split(x, "[^a-z0-9_-]+") for x in (a, b)])), lambda w: w.isin(firsts))
    rows = rows.withColumns({"_begun": begun("_low", "_plain"), "_all_begun": begun("_all_low", "_all_plain")})
    own, every = _Text(F.col("_low"), F.col("_plain"), F.col("_begun")), _Text(F.col("_all_low"), F.col("_all_plain"), F.col("_all_begun"))
    rows = rows.select("id", "prompt", _named(every, words.techs).alias("stack"), _named(own, words.techs).alias("_own"), _named(own, words.surfaces).alias("_direct"), *[mentions(own, t).cast("int").alias(f"_t{n}") for n, t in enumerate(words.terms)])
    implied = F.flatten(F.array(F.array().cast("array<string>"), *[F.when(F.array_contains("_own", c.id), F.array(*map(F.lit, c.implies))).otherwise(F.array().cast("array<string>")) for c in words.techs if c.implies]))
    terms = F.lit(0)
    for n in range(len(words.terms)):
        terms = terms + F.col(f"_t{n}")
    return rows.select("id", "prompt", "stack", F.array_distinct(F.concat("_direct", implied)).alias("surfaces"), terms.alias("terms"))


def specificity(prompt: Column, techs: Column, vague: list[str]) -> Column:
    """Points for technologies, paths, identifiers and length, less for vague words."""
    plain = F.trim(F.regexp_replace(prompt, r"\s+", " "))
    words = F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.regexp_replace(w, r"[,;:!?)]+\z", ""))
    path = lambda w: (w.contains("/") & (F.length(w) > 3)) | w.rlike(r"(?i)\.[a-z]{2,4}\z")
    code = lambda w: ~path(w) & (w.rlike("[a-z][A-Z]") | w.contains("(") | w.contains("`"))
    n = F.size(words)
    hits = F.when(mentions(plain, vague), sum((mentions(plain, [v]).cast("int") for v in vague), F.lit(0))).otherwise(0)
    length = F.when(n >= 25, 2).when(n >= 12, 1).otherwise(0)
    return F.least(F.lit(4), techs * 2) + F.least(F.lit(2), F.size(F.filter(words, path))) + F.least(F.lit(2), F.size(F.filter(words, code))) + length - F.least(F.lit(2), hits) * 2


def triage(known: DataFrame, words: Vocabulary = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Requests with concepts to (id, verdict, score): NO_MOD, LIGHT_MOD (say what security asks for) or HEAVY_MOD (ask back too). ``keep`` names columns that stay."""
    plain = F.trim(F.regexp_replace("prompt", r"\s+", " "))
    count = F.when(plain == "", 0).otherwise(F.size(F.split(plain, " ")))
    rows = known.withColumns({"_words": count, "_score": specificity(F.col("prompt"), F.size("stack"), words.vague)})
    specific = (F.col("_words") >= FEWEST_WORDS) & (F.col("_score") >= SPECIFIC)
    nothing = (F.col("_words") == 0) | ((F.size("surfaces") == 0) & (F.col("terms") == 0)) | (specific & (F.col("terms") >= AWARE))
    return rows.select("id", *keep, F.when(nothing, "NO_MOD").when(specific, "LIGHT_MOD").otherwise("HEAVY_MOD").alias("verdict"), F.col("_score").cast("bigint").alias("score"))


def rule_index(rules: DataFrame, words: Vocabulary = DEFAULT) -> DataFrame:
    """Rules (rule_id, severity, name, description, fix, languages) to postings (concept, points, rule_id, severity, key); rules that no code can satisfy are left out.

    ``key`` is what the rule asks for, up to a colon: rules that ask for the same are one in a ranking.
    """
    text = F.lower(F.concat_ws(" ", "name", "description"))
    held = [F.when(F.exists(F.array(*map(F.lit, c.keywords)), lambda k: text.contains(k)), F.struct(F.lit(f"{kind}:{c.id}").alias("concept"), F.lit(points).alias("points"))) for kind, points, cs in (("tech", 2, words.techs), ("surface", 1, words.surfaces)) for c in cs]
    plain = F.trim(F.regexp_replace(F.coalesce("fix", F.lit("")), r"\s+", " "))
    sentence = F.regexp_extract(plain, r"^(.*?[^.]\.)(?: |\z)", 1)
    asked = F.when(sentence == "", plain).otherwise(sentence)
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.split_part(asked, F.lit(":"), F.lit(1))), "[^a-z0-9 ]", ""), " +", " "))
    code = rules.where(F.arrays_overlap("languages", F.array(*map(F.lit, CODE))))
    return code.select("rule_id", "severity", key.alias("key"), F.explode(F.array_compact(F.array(*held))).alias("c")).select("c.concept", "c.points", "rule_id", "severity", "key")


def matched_rules(known: DataFrame, index: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """Requests with concepts to (id, rank, rule_id, score): the first rules by severity, score and id, one for each thing that they ask for.

    The index, made of a hand-written pack, is what is broadcast; requests never are, whatever Spark takes their size for.
    """
    tagged = F.concat(F.transform("stack", lambda s: F.concat(F.lit("tech:"), s)), F.transform("surfaces", lambda s: F.concat(F.lit("surface:"), s)))
    met = known.select("id", F.explode(tagged).alias("concept")).join(F.broadcast(index), "concept")
    scored = met.groupBy("id", "rule_id", "severity", "key").agg(F.sum("points").alias("score"))
    order = [F.coalesce(severity_rank(F.col("severity")), F.lit(99)), F.desc("score"), F.col("rule_id")]
    one = scored.withColumn("_n", F.row_number().over(Window.partitionBy("id", "key").orderBy(*order))).where("_n = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= most).select("id", F.col("rank").cast("bigint").alias("rank"), "rule_id", "score")
