"""The trie of conversation prefixes against one that is built with dictionaries."""

import hashlib
import random
import zlib

import pytest

from talonscan.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    own = {c: [r[1:] for r in sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {n: [m for m in members if len(m) == len(n) + 1 and m[:-1] == n] for n in members}

    def below(node):
        yield node
        for kid in kids[node]:
            yield from below(kid)

    out = set()
    for node, of in members.items():
        words = lambda n: len(n[-1][1].encode().split()) if n else 0
        ends = ",".join(map(str, sorted(c for c in of if len(built[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        inside = list(below(node))
        out.add((min(of), len(node), parent, len(of), len(kids[node]), sum(not kids[n] for n in inside), sum((len(members[n]) - 1) * words(n) for n in inside), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(frame):
    return {tuple(r[c] for c in COLUMNS) for r in frame.collect()}


def given(convs=120):
    """Few roles and texts, so that prefixes branch at every depth; blocks without a first conversation; ties, nulls and turnless conversations."""
    rng, rows = random.Random(11), []
    for conv in range(convs):
        if conv % 60 == 20:
            continue
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, None if rng.random() < 0.1 else turn, rng.choice(["user", "assistant", None]), rng.choice(["a b c", "a b", "a", None, " x y \x1c z "])))
    rows += [(None, 0, "user", "a"), (200, 0, "user", "a"), (200, 0, "user", "a"), (200, 0, "user", "b")]
    rows += [(c, t, "user", "the same words") for c in range(400, 470) for t in range(12)]
    return rows


@pytest.mark.parametrize("hot", [4096, 3])
def test_trie_is_as_by_dictionaries(spark, hot, monkeypatch):
    rows = given()
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    paths = prefix_trie.heavy_paths
    monkeypatch.setattr(prefix_trie, "heavy_paths", lambda chain, known: paths(chain, known, hot))
    assert got(prefix_trie.prefix_trie(frame)) == expected(rows)


def test_query_on_edge_rows(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(50_000))
    rows = [(5, t, "user", long) for t in range(3)] + [(9, t, "user", long) for t in range(3)] + [(-1, 0, None, None)]
    spark.createDataFrame([(*r, None) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {r for r in expected([r for r in rows if r[0] >= 0])}
    found = got(prefix_trie.prefix_trie(spark.createDataFrame([(*r, None) for r in rows if r[0] >= 0], SCHEMA)))
    assert found == want
    assert {r[3] for r in got(prefix_trie.op11_prefix_trie(spark, str(tmp_path))) if r[1] == 0} == {3}


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert got(prefix_trie.prefix_trie(frame)) == set()
    assert got(prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "a", "x")], SCHEMA))) == set()
