"""Triage of requests: written ones with literal results, and all turns of users against a vocabulary of words that they hold. Same form as ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from talonscan.functions.tables import written
from talonscan.operators import prompts
from talonscan.plans.kernel import literals

#: (request, context), and verdict, technologies, surfaces in the order of the tables, rules by rank.
REQUESTS = [
    ("", None), (None, None), ("make the header blue", None), ("make the header blue", "next.js and prisma"), ("build a login somehow", None),
    ("Add a POST handler in app/api/pay/route.ts that charges with Stripe via createCharge() in our Next.js app", None),
    ("Add POST in app/api/pay/route.ts with Stripe and Next.js: validate with zod, check auth, verify the webhook signature, rate limit", None),
    ("sign-in form with next_auth", None), ("store uploads", "uses supabase"), ("rewrite my prologin page", None),
]
RESULTS = [
    (0, "NO_MOD", "", "", ""), (1, "NO_MOD", "", "", ""), (2, "NO_MOD", "", "", ""), (3, "NO_MOD", "nextjs,prisma", "", "R3,R6"), (4, "HEAVY_MOD", "", "auth", "R1,R4"),
    (5, "LIGHT_MOD", "nextjs,stripe", "payments", "R2,R6"), (6, "NO_MOD", "nextjs,stripe", "auth,payments,external-api", "R2,R1,R6,R4"), (7, "HEAVY_MOD", "", "auth,user-input", "R1,R3,R4"), (8, "HEAVY_MOD", "supabase", "file-upload", ""), (9, "NO_MOD", "", "", ""),
]
RULES = [
    ("R1", "critical", "Missing auth", "no session check", "Check the session first. Then more.", ["typescript"]), ("R2", "critical", "Stripe webhook", "unsigned", "Verify the signature: code. More", ["javascript"]),
    ("R3", "high", "SQL injection", "prisma raw query", "Use parameters.", ["typescript"]), ("R4", "medium", "JWT login", "weak", "Use a strong key", ["python"]), ("R5", "medium", "Idor", "no access control", "Check the session first: now.", ["go"]),
    ("R6", "high", "Next.js secret", "server action", "Keep secrets on the server", ["javascript"]), ("R7", "critical", "Stripe", "old version", "Update", ["json"]),
]
#: Words of the synthetic turns, so that the same operators run over all of them.
TALK = prompts.Vocabulary(
    [prompts.Concept("en", ["the", "that"], ["alpha"], ["many"]), prompts.Concept("de", ["und", "die"], ["beta"]), prompts.Concept("fr", ["les", "que"], ["gamma"], ["few"])],
    [prompts.Concept("many", ["of", "der"], ["delta"]), prompts.Concept("few", ["pour", "with"], ["alpha", "delta"])],
    [["in", "en"], ["to", "zu"], ["is"]], ["or"],
)
TALK_RULES = [
    ("A", "high", "Alpha", "x", "Do a.", ["go"]), ("B", "low", "beta and gamma", "x", "Do b.", ["go"]), ("C", "high", "delta", "x", "Do c.", ["go"]), ("D", "critical", "delta alpha", "x", "Do a.", ["go"]), ("E", "medium", "gamma", "delta", "Do e.", ["go"]),
]
_RULES = "rule_id string, severity string, name string, description string, fix string, languages array<string>"


def _requests(s, d):
    texts = F.array(*[F.struct(F.lit(p).cast("string").alias("prompt"), F.lit(c).cast("string").alias("context")) for p, c in REQUESTS])
    n = (F.col("id.key") % len(REQUESTS)).cast("int")
    # few bytes but much work: dealt to all tasks, which a plain shuffle of small rows would be merged out of
    part = s.read.parquet(f"{d}/part.parquet").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    keys = part.groupBy(F.col("p_partkey").alias("key")).agg(F.count("*").alias("copies")).select(F.struct("key", "copies").alias("id")).where(n >= 0)
    known = written(prompts.concepts(keys.select("id", F.inline(F.array(F.get(texts, n))))), "requests")
    ranked = prompts.matched_rules(known, prompts.rule_index(s.createDataFrame(RULES, _RULES)))
    rules = ranked.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "rule_id"))), lambda r: r["rule_id"]), ",").alias("rules"))
    # merged: what Spark guesses for the size of either side lets it broadcast all requests
    found = prompts.triage(known, keep=("stack", "surfaces")).hint("merge").join(rules, "id", "left")
    return found.groupBy(n.alias("n"), "verdict", F.array_join("stack", ",").alias("stack"), F.array_join("surfaces", ",").alias("surfaces"), F.coalesce("rules", F.lit("")).alias("rules")).agg(F.sum("id.copies").alias("requests"))


def _turns(s, d):
    turns = s.read.parquet(f"{d}/conversations.parquet").where("role = 'user'")
    return turns.select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("prompt"), F.lit(None).cast("string").alias("context"))


def _ranked(s, d):
    known = prompts.concepts(_turns(s, d), TALK)
    found = prompts.matched_rules(known, prompts.rule_index(s.createDataFrame(TALK_RULES, _RULES), TALK), 3)
    return found.select("id.conv_id", "id.turn", "rank", "rule_id", "score")


def _verdicts(s, d):
    found = prompts.triage(prompts.concepts(_turns(s, d), TALK), TALK)
    return found.select("id.conv_id", "id.turn", "verdict", "score")


def queries():
    return {"prompt_triage": _requests, "prompt_rules": _ranked, "prompt_verdicts": _verdicts}


def _sql_concepts() -> str:
    def has(tokens):
        p = "(^|[^a-z0-9_-])(" + "|".join(tokens) + ")($|[^a-z0-9_-])"
        return f"(regexp_matches(low, '{p}') or regexp_matches(plain, '{p}'))"

    columns = [f"{has(c.tokens)} as {c.id}" for c in TALK.techs] + [f"{has(c.tokens)} as own_{c.id}" for c in TALK.surfaces]
    terms = " + ".join(f"cast({has(t)} as int)" for t in TALK.terms)
    return (
        "t as (select conv_id, turn, coalesce(text, '') as p, lower(coalesce(text, '')) as low, regexp_replace(lower(coalesce(text, '')), '[-_]+', ' ', 'g') as plain from conversations where role = 'user'), "
        f"c0 as (select *, {', '.join(columns)}, {terms} as terms, {has(TALK.vague)} as vague from t), c as (select *, own_many or en as many, own_few or fr as few from c0)"
    )


def oracle_sql():
    columns = "n, verdict, stack, surfaces, rules"
    posts = [("en", 2, "A"), ("en", 2, "D"), ("de", 2, "B"), ("fr", 2, "B"), ("fr", 2, "E"), ("many", 1, "C"), ("many", 1, "D"), ("many", 1, "E"), ("few", 1, "A"), ("few", 1, "C"), ("few", 1, "D"), ("few", 1, "E")]
    rules = [("A", 1, "do a"), ("B", 3, "do b"), ("C", 1, "do c"), ("D", 0, "do a"), ("E", 2, "do e")]
    sql = "with " + _sql_concepts()
    return {
        "prompt_triage": f"with p as (select p_partkey % {len(REQUESTS)} as n from part), e({columns}) as (values {literals(RESULTS)}) select {columns}, count(*) as requests from e join p using (n) group by all",
        "prompt_rules": sql + f""", h as (select conv_id, turn, unnest(['en', 'de', 'fr', 'many', 'few']) as concept, unnest([en, de, fr, many, few]) as held from c),
            i(concept, points, rule_id) as (values {literals(posts)}), r(rule_id, worst, ask) as (values {literals(rules)}),
            s as (select conv_id, turn, rule_id, worst, ask, sum(points)::bigint as score from h join i using (concept) join r using (rule_id) where held group by all),
            o as (select *, row_number() over (partition by conv_id, turn, ask order by worst, score desc, rule_id) as k from s),
            f as (select *, row_number() over (partition by conv_id, turn order by worst, score desc, rule_id) as rank from o where k = 1)
            select conv_id, turn, rank, rule_id, score from f where rank <= 3""",
        "prompt_verdicts": sql + r""", w as (select *, list_filter(regexp_split_to_array(trim(regexp_replace(p, '\s+', ' ', 'g')), ' '), lambda x: x <> '') as ws from c),
            x as (select *, list_transform(ws, lambda x: regexp_replace(x, '[,;:!?)]+$', '')) as cs from w),
            y as (select *, len(list_filter(cs, lambda x: (contains(x, '/') and length(x) > 3) or regexp_matches(x, '(?i)\.[a-z]{2,4}$'))) as paths,
              len(list_filter(cs, lambda x: not ((contains(x, '/') and length(x) > 3) or regexp_matches(x, '(?i)\.[a-z]{2,4}$')) and (regexp_matches(x, '[a-z][A-Z]') or contains(x, '(') or contains(x, '`')))) as codes from x),
            z as (select *, least(4, 2 * (en::int + de::int + fr::int)) + least(2, paths) + least(2, codes) + case when len(ws) >= 25 then 2 when len(ws) >= 12 then 1 else 0 end - 2 * vague::int as score from y)
            select conv_id, turn, case when len(ws) = 0 or (not many and not few and terms = 0) or (len(ws) >= 6 and score >= 4 and terms >= 3) then 'NO_MOD' when len(ws) >= 6 and score >= 4 then 'LIGHT_MOD' else 'HEAVY_MOD' end as verdict,
              score::bigint as score from z""",
    }
