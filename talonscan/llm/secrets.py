"""Secret scan over a trigram inverted index, in DataFrame expressions only.

Each rule's regular expression is parsed, and a Boolean query of trigrams that any match must
hold is derived from it. An index of (trigram, doc_id) postings over the rules' trigrams is built
from the whole corpus; intersecting postings gives each rule's candidates, which alone are verified
with the regular expression. A rule without mandatory trigrams is evaluated on every text.

Defined results: null text is the empty text and has no spans; rows with one doc_id share their
postings, which only widens the candidates; a null doc_id is a document too; repeated rows give
repeated results; other columns are ignored; an empty table gives no rows. The index holds at most
one posting for each trigram of the rules and document, so memory does not depend on text lengths.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.llm.common import table
from talonscan.llm.spans import Rule, with_spans

BASE_RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
]
MORE_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
]
RULES = BASE_RULES + MORE_RULES
#: Alternatives that an expansion of classes and options may reach before it is cut.
MAX_STRINGS = 32


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """A conjunction of disjunctions of trigram sets; a text that matches holds, for each conjunct, all trigrams of one set. Lower case."""
    conjuncts: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
        if sets and all(sets):
            conjuncts.append(sets)

    def exact(tokens) -> set[str] | None:
        """All strings that the tokens match, if these are few."""
        out = {""}
        for op, arg in tokens:
            if op is sre.LITERAL:
                more = {chr(arg).lower()}
            elif op is sre.IN:
                more = set()
                for kind, x in arg:
                    if kind is sre.LITERAL:
                        more.add(chr(x).lower())
                    elif kind is sre.RANGE and x[1] - x[0] < MAX_STRINGS:
                        more |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                    else:
                        return None
            elif op is sre.SUBPATTERN:
                more = exact(arg[3])
            elif op is sre.BRANCH:
                parts = [exact(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] != sre.MAXREPEAT and arg[1] <= 8:
                part = exact(arg[2])
                more = None if part is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(part, repeat=n)} if len(part) ** arg[1] <= MAX_STRINGS else None
            else:
                return None
            if more is None or len(out) * len(more) > MAX_STRINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(tokens) -> None:
        held = {""}
        for token in tokens:
            op, arg = token
            more = exact([token])
            if more is not None and len(held) * len(more) <= MAX_STRINGS:
                held = {a + b for a in held for b in more}
                continue
            flush(held)
            held = {""} if more is None else more
            if more is None and op is sre.SUBPATTERN:
                walk(arg[3])
            elif more is None and op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                walk(arg[2])
        flush(held)

    walk(parser.parse(pattern))
    return conjuncts


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id), trigram being an index into ``trigrams``."""
    lower = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = F.array(*[F.when(F.col("low").contains(t), F.lit(n)) for n, t in enumerate(trigrams)])
    return lower.select("doc_id", F.explode(F.filter(held, lambda x: x.isNotNull())).alias("trigram"))


def candidates(index: DataFrame, queries: list[list[list[frozenset[str]]]], trigrams: list[str]) -> DataFrame:
    """(doc_id, one boolean column ruleN for each query), for documents with postings: the intersection of postings."""
    at = {t: n for n, t in enumerate(trigrams)}
    words = range((len(trigrams) + 59) // 60)
    bits = index.groupBy("doc_id").agg(
        *[
            F.expr(f"bit_or(if(trigram div 60 = {w}, shiftleft(1L, cast(trigram % 60 as int)), 0L))").alias(f"b{w}")
            for w in words
        ]
    )

    def holds(query) -> Column:
        every = F.lit(True)
        for conjunct in query:
            some = F.lit(False)
            for need in conjunct:
                all_of = F.lit(True)
                for w in words:
                    mask = sum(1 << (at[t] % 60) for t in need if at[t] // 60 == w)
                    if mask:
                        all_of = all_of & (F.col(f"b{w}").bitwiseAND(F.lit(mask)) == mask)
                some = some | all_of
            every = every & some
        return every

    return bits.select("doc_id", *[holds(q).alias(f"rule{n}") for n, q in enumerate(queries)])


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``; spans as of with_spans over ``rules``."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for c in q for s in c for t in s})
    found = candidates(build_index(docs, trigrams), queries, trigrams).withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = texts.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    gates = [F.coalesce(f"rule{n}", F.lit(False)) if q else None for n, q in enumerate(queries)]
    return with_spans(both, rules, gates).select("doc_id", "spans")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] < len(BASE_RULES))), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
