"""Conversation repair against a search over whole edit strings."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from talonscan.llm import turn_repair
from talonscan.llm.turn_repair import Trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, repaired) by best-first search over (rows read, roles so far, audit); rows are (role, text, fault)."""
    heap = [(0, "", 0, ())]
    while True:
        cost, audit, i, made = heapq.heappop(heap)
        roles = "".join(r[:1] for r, _ in made)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, [f"{r}:{t}" for r, t in made]
        ways = [(3, "I", i, (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            ways.append((4, "D", i + 1, None))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                ways += [(extra, "K", i + 1, (role, text))] + [(3 + extra, "R", i + 1, (r, text)) for r in ("user", "assistant")]
        for c, e, j, row in ways:
            now = made + ((row,) if row else ())
            if re.fullmatch("s?(ua)*u?", "".join(r[:1] or " " for r, _ in now)):
                heapq.heappush(heap, (cost + c, audit + e, j, now))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        kept = WORD.findall(text)
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(given, damaged=True):
    """conv_id to the row of the contract; rows of one turn and conversation are the same or ordered by digest."""
    out = {c: [] for c, *_ in given}
    for conv, turn, role, text in given:
        role, text = " " if role is None else role, " " if text is None else text
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        k = zlib.crc32(":".join(shown).encode()) % 20 if damaged else 9
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    done = {}
    for conv, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = {t for t, _, _ in rows if t is not None}
        marked = faults([r[1:] for r in rows])
        count = lambda f: sum(x[2] == f for x in marked)
        roles = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit, made = cheapest(marked)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        done[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return done


def got(frame):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in frame.collect()}


def given():
    rng, rows = random.Random(5), []
    for conv in range(60):
        for turn in range(rng.randrange(1, 8)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "ux"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice(["Yes.", "no", "", " \t\x0b", None, "wait! ", " ", f"text {turn}?", f"cut {turn}"])))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hi."), (-3, 0, "user", "Hi."), (-3, 0, "user", "Hi.")]
    return rows


def test_every_short_signature():
    trie = Trie()
    say = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(5):
        for letters in itertools.product("suaoAx", repeat=n):
            rows = [("tool", "", "blank") if x == "x" else (say[x.lower()], "t", "truncated" if x.isupper() else None) for x in letters]
            assert trie.solve("".join(letters)) == cheapest(rows)[:2]


def test_layers_are_shared_and_long_signatures_take_proportional_time():
    trie = Trie()
    trie.solve("suaua")
    before = len(trie.layers)
    trie.solve("suauA")
    assert len(trie.layers) == before + 1
    cost, audit = Trie().solve("ua" * 100_000 + "u")
    assert (cost, len(audit), audit[-1]) == (3, 200_002, "I")


def test_query_is_as_by_search(spark, tmp_path):
    rows = given()
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)  # a column of the input with the name of a result's
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(turn_repair.op13_turn_repair(spark, str(tmp_path))) == expected(rows)


def test_small_tries_and_groups(spark, monkeypatch):
    rows = [r for r in given() if r[0] is not None]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    monkeypatch.setattr(turn_repair, "NODES", 5)
    monkeypatch.setattr(turn_repair, "GATHER", 3)
    assert got(turn_repair.repair_digests(frame)) == expected(rows, damaged=False)


def test_repaired_rows_are_whole(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "cut"), (1, 3, "user", ""), (2, 0, "assistant", "x" * 100_000 + ".")]
    made = [tuple(r) for r in turn_repair.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("conv_id", "pos").collect()]
    want = {c: cheapest(faults([r[2:] for r in rows if r[0] == c]))[2] for c in (1, 2)}
    assert {c: [f"{r[2]}:{r[3]}" for r in made if r[0] == c] for c in (1, 2)} == want
    assert [r[1] for r in made if r[0] == 2] == list(range(len(want[2])))


def test_empty_table_and_absent_rows(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi.", "x")], SCHEMA)
    assert got(turn_repair.repair_digests(frame.limit(0))) == {}
    gone = got(turn_repair.repair_digests(frame.withColumn("present", F.lit(False))))
    assert gone == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
