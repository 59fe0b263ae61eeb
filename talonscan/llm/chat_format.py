"""Chat formatting with Spark expressions only.

Turn rows are gathered per conversation as structs and sorted; adjacent turns of one role
are merged into a block with array functions, and blocks are concatenated to one string:

    <|role:R|>text(<|next|>text)*<|end|>

Inside roles and texts a backslash is written ``\\s`` and ``<`` is written ``\\l``, and in roles ``>`` is ``\\g``, so no text
can hold a control string, a role ends at the first ``|>``, and the escape is reversible.

Defined results: null text or role is the empty string; turns that tie are ordered by role
then text, repeated rows are all kept; a null conversation id is a conversation of its own;
null turns come first; other columns of the input are ignored; an empty table gives no rows.
A conversation becomes one string, so its turns have to be together: that is the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.llm.common import table
from talonscan.llm.spans import before, block_sums

#: Code points of the pieces that spans are cut out of.
PIECE = 1024
ROLE_OPEN, ROLE_CLOSE, NEXT, END = "<|role:", "|>", "<|next|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) rows to (conv_id, formatted, loss_spans).

    ``loss_spans`` are (start, length) pairs in code points of ``formatted``, one for each turn
    of ``loss_role``, without markers.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            escape_role(F.coalesce("role", F.lit(""))).alias("role"),
            escape(F.coalesce("text", F.lit(""))).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # a turn that follows one of the same role joins its block
    marked = convs.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t, i: F.struct(
                t["role"].alias("role"),
                t["text"].alias("text"),
                F.when((i > 0) & (F.get("ts", i - 1)["role"] == t["role"]), F.lit(NEXT))
                .when(i > 0, F.concat(F.lit(END + ROLE_OPEN), t["role"], F.lit(ROLE_CLOSE)))
                .otherwise(F.concat(F.lit(ROLE_OPEN), t["role"], F.lit(ROLE_CLOSE)))
                .alias("head"),
            ),
        ).alias("parts"),
    )
    role = escape_role(F.lit(loss_role))
    sized = marked.select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"])), ""), F.lit(END)).alias("formatted"),
        F.transform(
            "parts",
            lambda p: F.struct(
                (p["role"] == role).alias("loss"),
                F.length(p["head"]).alias("head"),
                F.length(p["text"]).alias("size"),
            ),
        ).alias("sizes"),
    )
    # spans of turns follow from running sums over the pieces' lengths, block by block
    steps = sized.select("*", F.transform("sizes", lambda s: s["head"] + s["size"]).alias("steps"))
    steps = steps.select("*", block_sums(F.col("steps")).alias("blocks"))
    spans = F.filter(
        F.transform(
            "sizes",
            lambda s, i: F.when(s["loss"], F.struct((before(F.col("steps"), F.col("blocks"), i) + s["head"]).cast("int").alias("start"), s["size"].alias("length"))),
        ),
        lambda s: s.isNotNull(),
    )
    return steps.select("conv_id", "formatted", spans.alias("loss_spans"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) back to (conv_id, turns array<struct<role,text>>, loss_text)."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, ROLE_CLOSE) + len(ROLE_CLOSE), F.length(b)), r"<\|next\|>", -1),
                lambda t: F.struct(
                    unescape_role(F.substring(b, F.lit(len(ROLE_OPEN) + 1), F.instr(b, ROLE_CLOSE) - len(ROLE_OPEN) - 1)).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )
    # a span is cut out of the pieces that it lies in, so that no span is counted from the start of the string
    cut = formatted.select("conv_id", "formatted", turns.alias("turns"), "loss_spans", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))

    def text(s: Column) -> Column:
        first, last = F.floor(s["start"] / PIECE).cast("int"), F.floor((s["start"] + s["length"] - 1) / PIECE).cast("int")
        at = s["start"] % PIECE + 1
        within = F.substring(F.get("pieces", first), at, s["length"])
        across = F.substring(F.array_join(F.slice("pieces", first + 1, last - first + 1), ""), at, s["length"])
        return F.when(s["length"] == 0, "").when(first == last, unescape(within)).otherwise(unescape(across))

    return cut.select("conv_id", "formatted", "turns", F.array_join(F.transform("loss_spans", text), "").alias("loss_text"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "select cast(-7 as bigint) conv_id, cast(i as bigint) turn, if(i = 0, 'user', 'assistant') role, "
        "'</s>[INST] ok [/INST]' text from values (0), (1) as v(i)"
    )
    back = parse_conversations(format_conversations(given.unionByName(probe)))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, lag(role) over (partition by conv_id order by turn nulls first, replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g'), replace(replace(text, '\', '\s'), '<', '\l')) as before,
    row_number() over (partition by conv_id order by turn nulls first, replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g'), replace(replace(text, '\', '\s'), '<', '\l')) as k,
    length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g')) as rl,
    length(replace(replace(text, '\', '\s'), '<', '\l')) as tl
  from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum(tl + case when before = role then 8 when before is null then 9 + rl else 16 + rl end)::bigint + 7 as formatted_chars
from e group by conv_id
"""
