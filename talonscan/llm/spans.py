"""Positions of regular-expression matches, in DataFrame expressions only.

``split`` gives the texts between matches and ``regexp_extract_all`` the matches, so starts are
running sums over their lengths. Running sums go block by block, so that a text of very many
matches costs little more than in proportion.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


class Rule(NamedTuple):
    """``pattern`` finds spans leftmost and non-overlapping; those whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def block_sums(lengths: Column) -> Column:
    """Sums of the elements before each block of BLOCK elements."""
    sums = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / BLOCK).cast("int") - 1, F.lit(0))),
        lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))),
    )
    return F.aggregate(
        sums,
        F.array(F.lit(0)),
        lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)),
    )


def before(lengths: Column, blocks: Column, k: Column) -> Column:
    """Sum of the elements before index k, given ``blocks`` from block_sums."""
    b = F.floor(k / BLOCK).cast("int")
    return F.get(blocks, b) + _sum(F.slice(lengths, b * BLOCK + 1, k - b * BLOCK))


def with_spans(df: DataFrame, rules: list[Rule], gates: list[Column | None], text: str = "text", out: str = "spans") -> DataFrame:
    """Adds ``out``: array<struct<start,kind,end>>, sorted; kind is the rule's index, offsets are code points, the end is exclusive.

    A gate decides for which rows its rule is evaluated (None: all). Null text has no spans.
    """
    names = df.columns
    hits = []
    for n, (rule, gate) in enumerate(zip(rules, gates)):
        pattern = F.lit(rule.pattern)
        applies = F.col(text).rlike(rule.pattern) if gate is None else gate & F.col(text).rlike(rule.pattern)
        found = F.struct(
            F.lit(n).alias("kind"),
            F.transform(F.split(text, rule.pattern, -1), F.length).alias("gaps"),
            F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("sizes"),
            F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("values"),
        )
        hits.append(F.when(applies, found))
    df = df.select(*names, F.filter(F.array(*hits), lambda h: h.isNotNull()).alias("_hits"))
    df = df.select(
        *names,
        F.transform(
            "_hits",
            lambda h: F.struct(
                h["kind"].alias("kind"),
                h["gaps"].alias("gaps"),
                h["sizes"].alias("sizes"),
                h["values"].alias("values"),
                F.transform(h["sizes"], lambda s, k: s + F.get(h["gaps"], k)).alias("steps"),
            ),
        ).alias("_hits"),
    )
    df = df.select(*names, F.transform("_hits", lambda h: F.struct(h.alias("h"), block_sums(h["steps"]).alias("blocks"))).alias("_hits"))
    least = F.array(*[F.lit(r.least) for r in rules])
    spans = F.flatten(
        F.transform(
            "_hits",
            lambda x: F.filter(
                F.transform(
                    x["h"]["sizes"],
                    lambda s, k: F.when(
                        F.get(x["h"]["values"], k) >= F.get(least, x["h"]["kind"]),
                        F.struct(
                            (before(x["h"]["steps"], x["blocks"], k) + F.get(x["h"]["gaps"], k)).alias("start"),
                            x["h"]["kind"].alias("kind"),
                            (before(x["h"]["steps"], x["blocks"], k) + F.get(x["h"]["gaps"], k) + s).alias("end"),
                        ),
                    ),
                ),
                lambda s: s.isNotNull(),
            ),
        )
    )
    return df.select(*names, F.sort_array(spans).alias(out))
