"""Repair of conversation structure: the cheapest edits after which roles read ``(s?(ua)+)?``, by dynamic programming shared in a prefix trie.

The signature of a conversation has one letter for each row: the row's role initial and first fault. It is all that the edits depend
on, so the layers of the dynamic programme (cheapest cost in each of four states after a row) belong to prefixes of signatures. Each task
sorts the signatures of its conversations, inserts them into a trie, computes a layer where a node is made, and finds the answer at the
node where a signature ends, once for all conversations that share it.

Two passes: rows without their texts (digest, initial, fault) are dealt by conversation and give signatures and answers; texts are dealt
once and edited in a stream that begins with the answer. So no task holds the texts of a conversation; one letter and one digest for each of its rows
are held, and a trie of more than ``NODES`` nodes is begun anew.

Defined results: null role or text is one space. Rows are ordered by turn, null first; rows that tie by the digest of role and
text; repeated rows all count, later ones as duplicates. A null conversation id is a conversation of its own. Other columns are ignored.
Conversations of which ``present`` is false for every row have no rows, cost nothing and stay. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.llm.common import crc32_sql, table

REROLE, DELETE, INSERT, MEND = 3, 4, 3, 3
NODES = 200_000
#: Characters of signatures that a task gathers before it sorts them.
GATHER = 1 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
CLEAN, BLANK, TRUNCATED = range(3)
_SPACE = r"[\x20\x09-\x0D]"


def keep_moves(letter: str) -> tuple[tuple[int, int], ...]:
    """(state, next) for keeping a row of this initial."""
    return {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}.get(letter, ())


#: (state, next): the role that a turn gets which is inserted or renamed is the one that the state calls for.
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}


def moves(letter: str) -> list[tuple[str, int, int, int]]:
    """(edit, state, next, cost) over a row, in the order of the edits' initials. An upper-case letter is a truncated row, ``x`` one that has to go."""
    out = [("D", s, s, DELETE) for s in range(4)]
    if letter != "x":
        extra = MEND if letter.isupper() else 0
        out += [("K", a, b, extra) for a, b in keep_moves(letter.lower())]
        out += [("R", a, b, REROLE + extra) for a, b in NEXT.items()]
    return out


MOVES = {x: moves(x) for x in "suaoSUAOx"}


def settle(layer: list[int]) -> tuple[int, ...]:
    """With inserted turns. Two rounds reach a fixpoint, as no state is cheaper by way of itself."""
    layer = list(layer)
    layer[USER] = min(layer[USER], INSERT + min(layer[START], layer[SYSTEM], layer[ASSISTANT]))
    layer[ASSISTANT] = min(layer[ASSISTANT], INSERT + layer[USER])
    return tuple(layer)


class Trie:
    """Signatures to (cost, audit); one layer for each prefix."""

    def __init__(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.layers = [settle([0, FAR, FAR, FAR])]
        self.answers: dict[int, tuple[int, str]] = {}

    def insert(self, signature: str) -> list[int]:
        """The nodes on the way, from the root."""
        at, path = 0, [0]
        for letter in signature:
            node = self.child.get((at, letter))
            if node is None:
                layer, new = self.layers[at], [FAR] * 4
                for _, s, t, cost in MOVES[letter]:
                    if layer[s] + cost < new[t]:
                        new[t] = layer[s] + cost
                node = self.child[at, letter] = len(self.layers)
                self.layers.append(settle(new))
            at = node
            path.append(at)
        return path

    def solve(self, signature: str) -> tuple[int, str]:
        path = self.insert(signature)
        if path[-1] not in self.answers:
            self.answers[path[-1]] = self._answer(signature, [self.layers[n] for n in path])
        return self.answers[path[-1]]

    def _answer(self, signature: str, layers: list[tuple[int, ...]]) -> tuple[int, str]:
        """Cost and least audit. States from which the end is reached at that cost are marked backwards; the least letters are read off forwards."""
        n, best = len(signature), min(layers[-1][START], layers[-1][ASSISTANT])
        good = [[False] * 4 for _ in layers]
        for i in range(n, -1, -1):
            here, mark = layers[i], good[i]
            if i == n:
                for s in (START, ASSISTANT):
                    mark[s] = here[s] == best
            else:
                for _, s, t, cost in MOVES[signature[i]]:
                    if good[i + 1][t] and here[s] + cost == layers[i + 1][t]:
                        mark[s] = True
            for s in (USER, START, SYSTEM, ASSISTANT, USER):
                mark[s] = mark[s] or mark[NEXT[s]] and here[s] < FAR and here[s] + INSERT == here[NEXT[s]]
        out, i, s = [], 0, START
        while i < n or not (s in (START, ASSISTANT) and layers[n][s] == best):
            row = [(e, i + 1, t) for e, a, t, cost in MOVES[signature[i]] if a == s and good[i + 1][t] and layers[i][s] + cost == layers[i + 1][t]] if i < n else []
            if good[i][NEXT[s]] and layers[i][s] + INSERT == layers[i][NEXT[s]]:
                row.append(("I", i, NEXT[s]))
            edit, i, s = min(row)
            out.append(edit)
        return best, "".join(out)


_PLAN = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_NAMES = [c.split(" ")[0] for c in _PLAN.split(", ")]


def _signed(batches):
    """Rows (conv_id, turn, digest, initial, fault) in order, all of a conversation together, to a row (conv_id, plan columns)."""
    trie, waiting, size = Trie(), [], 0

    def answered():
        nonlocal trie
        rows = []
        for signature, conv, stats in sorted(waiting, key=lambda w: w[0]):
            rows.append((conv, *stats, *trie.solve(signature)))
            if len(trie.layers) > NODES:
                trie = Trie()
        columns = list(zip(*rows))
        types = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", *_NAMES])

    class Conv:
        def __init__(self, conv):
            self.conv, self.letters, self.seen = conv, [], set()
            self.low = self.high = self.last = self.before = None
            self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

        def add(self, turn, digest, initial, fault):
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.turns += turn != self.last
                self.high = self.last = turn
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
            again, letter = digest in self.seen, initial if initial in ("s", "u", "a") else "o"
            self.seen.add(digest)
            if fault == BLANK or again:
                self.blank += fault == BLANK
                self.duplicate += fault != BLANK
                letter = "x"
            elif fault == TRUNCATED:
                self.truncated += 1
                letter = letter.upper()
            self.letters.append(letter)

        def row(self):
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return "".join(self.letters), self.conv, (gaps, self.blank, self.duplicate, self.truncated, self.illegal)

    now = None
    for batch in batches:
        for conv, turn, digest, initial, fault in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or conv != now.conv:
                if now is not None:
                    waiting.append(now.row())
                    size += len(now.letters) + 1
                    if size > GATHER:
                        yield answered()
                        waiting, size = [], 0
                now = Conv(conv)
            if digest is not None:
                now.add(turn, digest, initial, fault)
    if now is not None:
        waiting.append(now.row())
        yield answered()


def _edited(rows):
    """Rows (plan or None, role, text), each conversation led by its plan, to (plan, role, text) of the repaired rows and (plan, None, None) at its end."""
    plan = None
    for new, role, text in rows:
        if new is not None:
            if plan is not None:
                yield from ends(plan, edits, state)
            plan, edits, state = new, iter(new["audit"]), START
            continue
        for edit in edits:
            if edit != "I":
                break
            state = NEXT[state]
            yield plan, "user" if state == USER else "assistant", ""
        if edit == "R":
            state = NEXT[state]
            yield plan, "user" if state == USER else "assistant", text
        elif edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield plan, role, text
    if plan is not None:
        yield from ends(plan, edits, state)


def ends(plan, edits, state):
    for _ in edits:  # only insertions are left
        state = NEXT[state]
        yield plan, "user" if state == USER else "assistant", ""
    yield plan, None, None


def _streamed(batches):
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in ("plan", "role", "text")])


def _rows(batches):
    out, size, pos = [], 0, 0

    def made():
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", "pos", "role", "text"])

    for plan, role, text in _edited(_streamed(batches)):
        if role is None:
            pos = 0
            continue
        out.append((plan["conv_id"], pos, role, text))
        pos, size = pos + 1, size + len(text)
        if len(out) >= 4096 or size > 1 << 24:
            yield made()
            out, size = [], 0
    if out:
        yield made()


def _digests(batches):
    names, out, hashed, first = ["conv_id", *_NAMES], [], hashlib.sha256(), True

    def made():
        types = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [*names, "repaired_sha256"])

    for plan, role, text in _edited(_streamed(batches)):
        if role is not None:
            hashed.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False
            continue
        out.append((*[plan[n] for n in names], hashed.hexdigest()))
        hashed, first = hashlib.sha256(), True
        if len(out) >= 4096:
            yield made()
            out = []
    if out:
        yield made()


def _prepared(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256))
    present = F.coalesce("present", F.lit(True)) if "present" in turns.columns else F.lit(True)
    return turns.select("conv_id", "turn", F.when(present, digest).alias("digest"), role.alias("role"), text.alias("text"))


def _fault(text: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(1))
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), CLEAN).otherwise(TRUNCATED)


def plan_repairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, optionally present) to (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit).

    A row is blank without a visible character, a duplicate if role and text came before in its conversation, truncated unless its
    last visible character ends a sentence; its first fault counts. ``audit`` has the initials of the edits (Keep, Rerole, Delete, Insert) in order.
    """
    rows = _prepared(turns).select("conv_id", "turn", "digest", F.left("role", F.lit(1)).alias("initial"), _fault(F.col("text")).alias("fault"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest")
    return dealt.mapInArrow(_signed, "conv_id bigint, " + _PLAN)


def _planned(turns: DataFrame) -> DataFrame:
    """Texts behind the plan of their conversation, in order."""
    texts = _prepared(turns).where("digest is not null").select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text", F.lit(None).cast(f"struct<conv_id: bigint, {_PLAN.replace(' ', ': ').replace(',:', ',')}>").alias("plan"))
    plans = plan_repairs(turns).select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("role"), F.lit("").alias("text"), F.struct("conv_id", *_NAMES).alias("plan"))
    return plans.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest").select("plan", "role", "text")


def repair(turns: DataFrame) -> DataFrame:
    """The repaired rows: (conv_id, pos, role, text), ``pos`` from 0."""
    return _planned(turns).mapInArrow(_rows, "conv_id bigint, pos bigint, role string, text string")


def repair_digests(turns: DataFrame) -> DataFrame:
    """``plan_repairs`` with the SHA-256 of the repaired rows, as ``role:text`` joined by newlines."""
    return _planned(turns).mapInArrow(_digests, f"conv_id bigint, {_PLAN}, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Drops, empties, robs of full stops, repeats or renames rows by a hash of their place."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(place) % 20).alias("k"))
    rows = rows.select("conv_id", "turn", "role", "text", "k", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") != 0).alias("present"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damage(table(spark, sf_dir, "conversations")))


def _sql_layer() -> str:
    """The next layer of (c, a, t) in each state from layer ``l``, then inserted turns."""
    one = lambda s, cost, edit, add: f"{{'c': l[{s + 1}].c + {cost}, 'a': l[{s + 1}].a || '{edit}', 't': l[{s + 1}].t || {add}}}"
    states = []
    for t in range(4):
        ways = [one(t, DELETE, "D", "''")]
        for initial in "sua":
            ways += [f"case when not gone and ini = '{initial}' then {one(s, 'extra', 'K', 'kept')} end" for s, to in keep_moves(initial) if to == t]
        role = "user" if t == USER else "assistant"
        ways += [f"case when not gone then {one(s, f'extra + {REROLE}', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} end" for s, to in NEXT.items() if to == t]
        states.append(f"list_min([{', '.join(ways)}])")
    return f"[{', '.join(states)}]"


def _sql_settled(layer: str) -> str:
    put = lambda x, role: f"{{'c': {x}.c + {INSERT}, 'a': {x}.a || 'I', 't': {x}.t || chr(10) || '{role}:'}}"
    user = f"list_min([x[3], {put('x[1]', 'user')}, {put('x[2]', 'user')}, {put('x[4]', 'user')}])"
    inner = f"list_transform([{layer}], lambda x: [x[1], x[2], {user}, x[4]])[1]"
    return f"list_transform([{inner}], lambda x: [x[1], x[2], x[3], list_min([x[4], {put('x[3]', 'assistant')}])])[1]"


_FAR = "{'c': 1000000000::bigint, 'a': '', 't': ''}"
OP13_SQL = rf"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as s from conversations),
q as (select *, {crc32_sql('s')} % 20 as k from k),
d as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
    case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text
  from (select *, unnest(case when k = 0 then [] when k = 3 then [0, 1] else [0] end) from q)),
e as (select *, left(role, 1) as ini, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role)::varchar || ':' || role || text)) as i from d),
f as (
  select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
    row_number() over (partition by conv_id, role, text order by i) > 1 as seen,
    not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as cut,
    lag(ini) over (partition by conv_id order by i) as before
  from e),
g as (select *, blank or seen as gone, case when cut then {MEND} else 0 end as extra, chr(10) || role || ':' || text as kept from f),
dp as (
  select conv_id, 0::bigint as i, {_sql_settled("[{'c': 0::bigint, 'a': '', 't': ''}, " + ", ".join([_FAR] * 3) + "]")} as l from (select distinct conv_id from k)
  union all
  select dp.conv_id, g.i, {_sql_settled(_sql_layer())} from dp join g on dp.conv_id is not distinct from g.conv_id and g.i = dp.i + 1),
z as (select conv_id, arg_max(list_min([l[1], l[4]]), i) as r from dp group by conv_id),
s as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (seen and not blank) as duplicate, count(*) filter (cut and not gone) as truncated,
    count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au')) as illegal
  from g group by conv_id)
select z.conv_id, coalesce(gaps, 0) as gaps, coalesce(s.blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, r.c as cost, r.a as audit, sha256(substr(r.t, 2)) as repaired_sha256
from z left join s on z.conv_id is not distinct from s.conv_id
"""
