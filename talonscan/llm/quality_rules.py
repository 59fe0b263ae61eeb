"""Line-first quality rules, in DataFrame expressions only.

Every line of a text is held against punctuation, navigation and boilerplate rules; failing
lines are removed, and a document that loses more than ``max_loss`` of its word characters, or
that fails the base measures, is rejected.

Defined results: a null text has no words and is rejected (fewer than 50 words); an empty text
likewise; repeated rows give repeated results; columns other than doc_id and text play no part
in a decision and are carried through by ``clean``, whatever their names; an empty table gives no rows. All work is per row, without
a shuffle, and memory is a small multiple of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.llm.common import WORD_SPLIT, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of word characters that the line rules may remove before the document is rejected.
MAX_LOSS = 0.5

#: Rule 1, punctuation: a short line that ends without sentence punctuation, or one without a letter.
FRAGMENT_WORDS = 3
SENTENCE_END = r"[.!?:;…。！？…»”\"')\]]\s*$"
HAS_LETTER = r"\p{L}"
#: Rule 2, navigation: menus, breadcrumbs, page links.
NAVIGATION = (
    r"(?i)^\s*(?:home|menu|next|previous|prev|back to top|skip to (?:main )?content|read more|log ?in|sign ?(?:in|up)|"
    r"search|share|tweet|print)\s*[|>»›·.:]*\s*$|^\s*page \d+ of \d+\s*\.?\s*$"
)
#: A menu: three or more short entries between these marks. (A repeated group would recurse once for each entry in Java.)
MENU_MARK = r"\s[|»›·]\s"
MENU_ENTRY = 30
#: Rule 3, boilerplate: notices that are about the site and not the text.
BOILERPLATE = (
    r"(?i)all rights reserved|(?:privacy|cookie) policy|terms of (?:use|service)|(?:uses?|accept) cookies|"
    r"enable javascript|subscribe to our|click here to|lorem ipsum"
)


def line_fails(line: Column) -> Column:
    """True where a line holds a word and breaks one of the three rules."""
    words = F.size(F.filter(F.split(line, WORD_SPLIT), lambda w: w != ""))
    punctuation = ((words <= FRAGMENT_WORDS) & ~line.rlike(SENTENCE_END)) | ~line.rlike(HAS_LETTER)
    entries = F.split(line, MENU_MARK, -1)
    menu = line.rlike(MENU_MARK) & (F.size(entries) >= 3) & F.forall(entries, lambda e: F.length(e).between(1, MENU_ENTRY) & ~e.rlike("[|»›·]"))
    return line.rlike(r"[^\x20\x09-\x0D]") & (punctuation | line.rlike(NAVIGATION) | menu | line.rlike(BOILERPLATE))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\f\r", ""))


def measure(docs: DataFrame) -> DataFrame:
    """(input struct, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, kept_chars, base_failed, kept, clean_text)."""
    kept_columns = ["input"]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input"), F.coalesce("text", F.lit("")).alias("_t"))
    out = out.select("*", F.split("_t", "\n", -1).alias("_lines"), F.filter(F.split("_t", WORD_SPLIT), lambda w: w != "").alias("_w"))
    out = out.select(
        "*",
        F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_full"),
        F.filter("_lines", lambda x: ~line_fails(x)).alias("_good"),
        F.when(
            F.size("_w") >= 3,
            F.transform(F.slice("_w", F.lit(1), F.size("_w") - 2), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_h"),
    )
    # Windows are told apart by a 64-bit hash within one text. Sorted, equal ones are neighbours.
    out = out.select(
        "*",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        )
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        .alias("_z"),
    )
    out = out.select(
        "*",
        F.sort_array(
            F.transform(
                F.filter(
                    "_z",
                    lambda z, k: F.coalesce(F.get("_z", k - 1)["h"] == z["h"], F.lit(False))
                    | F.coalesce(F.get("_z", k + 1)["h"] == z["h"], F.lit(False)),
                ),
                lambda z: z["i"],
            )
        ).alias("_p"),
    )
    # each repeated window adds the words that the next one does not cover
    repeat = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    out = out.select(
        *kept_columns,
        F.size("_w").cast("long").alias("n_words"),
        word_chars(F.col("_t")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_lines_removed"),
        F.array_join("_good", "\n").alias("clean_text"),
    )
    # The row number keeps filters on the result from being pushed, expanded, below these projections.
    out = out.select("*", word_chars(F.col("clean_text")).cast("long").alias("kept_chars"), F.monotonically_increasing_id().alias("_row"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(
        *[F.col(f"`{c}`") for c in out.columns if c != "_row"],
        failed.alias("base_failed"),
        (~failed & (F.col("kept_chars") >= (1 - MAX_LOSS) * F.col("word_chars")) & (F.col("_row") >= 0)).alias("kept"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """The accepted documents, without their failing lines; the columns of ``docs``."""
    names = docs.columns
    good = measure(docs).where("kept")
    changed = {"text": F.col("clean_text")}
    if "n_chars" in names:
        changed["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return good.select(*[changed[c].alias(c) if c in changed else F.col("input")[c].alias(c) for c in names])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return measure(docs).select(
        "input.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed"
    )


def _sql_string(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP1_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
ws as (select doc_id, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w, string_split(t, chr(10)) as ls, t from d),
grams as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from ws where len(w) >= 3)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
covered as (
  select doc_id, sum(least(3, coalesce(nxt - i, 3)))::bigint as n
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from twice) group by doc_id),
lines as (
  select doc_id, l,
    regexp_matches(l, '[^ \t\n\x0B\f\r]') and (
      (len(list_filter(regexp_split_to_array(l, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) <= {FRAGMENT_WORDS} and not regexp_matches(l, {_sql_string(SENTENCE_END)}))
      or not regexp_matches(l, '\p{{L}}')
      or regexp_matches(l, {_sql_string(NAVIGATION)})
      or (len(regexp_split_to_array(l, {_sql_string(MENU_MARK)})) >= 3 and len(list_filter(regexp_split_to_array(l, {_sql_string(MENU_MARK)}), lambda e: not (length(e) between 1 and {MENU_ENTRY}) or regexp_matches(e, '[|»›·]'))) = 0) or regexp_matches(l, {_sql_string(BOILERPLATE)})) as bad
  from (select doc_id, unnest(ls) as l from ws)),
per as (
  select doc_id, sum(bad::int)::bigint as removed,
    sum(case when bad then 0 else length(regexp_replace(l, '[ \t\n\x0B\f\r]', '', 'g')) end)::bigint as kept_chars,
    (count(*) filter (regexp_matches(l, '[^ \t\n\x0B\f\r]')) - count(distinct l) filter (regexp_matches(l, '[^ \t\n\x0B\f\r]')))::bigint as n_dup_lines
  from lines group by doc_id),
m as (
  select ws.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
    removed as n_lines_removed, kept_chars
  from ws left join covered c on c.doc_id = ws.doc_id join per on per.doc_id = ws.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and kept_chars >= {1 - MAX_LOSS} * word_chars as kept,
  n_lines_removed
from m
"""
