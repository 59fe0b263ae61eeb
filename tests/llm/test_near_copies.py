"""The near-dedup stage against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from talonscan.llm import near_copies, simhash
from tests.llm.edge import ROWS, frame


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def similar(a, b):
    return not a and not b or 5 * len(a & b) >= 4 * len(a | b)


def slow_kept(rows):
    """Ids kept of rows with distinct ids."""
    rows = sorted(rows, key=lambda r: r[0])
    sets, root = [grams(r[1]) for r in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [rows[k][0] for k in range(len(rows)) if find(k) == k]


def row(k, text):
    return (k, text, "en", "s", len(text), "x")


def planted():
    """Originals with copies in which 1 to 12 of 120 words differ, in shuffled order."""
    rng, texts = random.Random(3), []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        texts.append(" ".join(words))
        for changes in rng.sample(range(1, 13), 3):
            copy = list(words)
            for n in range(changes):
                copy[rng.randrange(120)] = f"new{k}x{n}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return [row(k, t) for k, t in enumerate(texts)]


def test_stage_keeps_what_brute_force_keeps(spark):
    rows = planted()
    sets = [grams(r[1]) for r in rows]
    shares = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.8 <= s < 0.95 for s in shares) > 20 and sum(0.5 < s < 0.8 for s in shares) > 20
    want = slow_kept(rows)
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == want and got.columns == frame(spark, []).columns
    assert sorted(r.doc_id for r in near_copies.keep_one(frame(spark, ROWS)).collect()) == slow_kept(ROWS)
    assert near_copies.keep_one(frame(spark, [])).count() == 0


def test_large_bucket_in_shards(spark):
    """One text and its variants, many of them too far from the smallest id but near to one another."""
    rng, rows = random.Random(5), []
    base = [f"b{k}" for k in range(150)]
    for k in range(120):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(3, 10)):
            copy[at] = f"v{rng.randrange(3)}"
        rows.append(row(k, " ".join(copy)))
    assert len(slow_kept(rows)) > 1
    assert sorted(r.doc_id for r in near_copies.keep_one(frame(spark, rows), shard=4).collect()) == slow_kept(rows)


def test_rows_not_ids(spark):
    """Rows of one id with different texts stay, copies without an id go."""
    a, b = ("one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen")
    rows = [row(1, a), row(1, b), row(2, b), row(None, b + " x y z p q r s"), row(None, b + " x y z p q r s")]
    got = sorted((str(r.doc_id), r.text) for r in near_copies.keep_one(frame(spark, rows)).collect())
    assert got == sorted([("1", a), ("1", b), ("None", b + " x y z p q r s")])


def test_fingerprints_agree_as_calculated():
    """Pairs at 0.8 share a bucket and lie within the radius; unrelated sets do not lie within it."""
    rng = np.random.default_rng(4)
    bits, tables = near_copies.tables_for(200_000)
    words = near_copies.WORDS + -(-bits * tables // 64)
    sets = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    print_ = lambda s: np.unpackbits(np.frombuffer(near_copies.fingerprint(s, words), np.uint8))
    shares = []
    for size in (9, 45, 90, 270, 900):
        for _ in range(20):
            both = sets(size * 8 // 9)
            a, b = (print_(np.concatenate([both, sets(size // 9)])) for _ in range(2))
            same = a == b
            shares.append(same.mean())
            assert (~same[: 64 * near_copies.WORDS]).sum() <= near_copies.RADIUS
            assert same[64 * near_copies.WORDS :][: bits * tables].reshape(tables, bits).all(axis=1).any()
            assert (a != print_(sets(size)))[: 64 * near_copies.WORDS].sum() > near_copies.RADIUS
    assert abs(np.mean(shares) - 0.849) < 0.01


def test_bk_trees_link_what_brute_force_links():
    """Trees of operator 3 over 128 bits, one for each bucket."""
    assert near_copies.search_forest is simhash.search_forest
    rng, rows = random.Random(6), []
    for gid in range(30):
        prints = [rng.getrandbits(128) for _ in range(3)]
        for _ in range(40):
            x = rng.choice(prints)
            for at in rng.sample(range(128), rng.randrange(0, 45)):
                x ^= 1 << at
            prints.append(x)
        rows += [(gid, 100 * gid + k, x) for k, x in enumerate(prints)]
    signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
    gids, ords, prints = zip(*rows)
    columns = [pa.array(gids), pa.array(ords), pa.array(ords), pa.array([True] * len(rows)), signed([x & (1 << 64) - 1 for x in prints]), signed([x >> 64 for x in prints])]
    batch = pa.RecordBatch.from_arrays(columns, ["gid", "ord", "root", "lead", "a", "b"])

    def components(links):
        root = {o: o for o in ords}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in links:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return [find(o) for o in ords]

    found = [(r["item"], r["hub"]) for b in near_copies._near([batch]) for r in b.to_pylist()]
    brute = [(o, p) for g, o, x in rows for h, p, y in rows if g == h and o < p and (x ^ y).bit_count() <= near_copies.RADIUS]
    assert len(found) < len(rows) and components(found) == components(brute)
    assert len(set(components(brute))) > 31


def test_large_group_is_linked_about_once(spark, monkeypatch):
    """A group that meets in the buckets of 34 tables: links to join, not one for each row and table."""
    rng, rows = random.Random(7), []
    base = [f"b{k}" for k in range(150)]
    for k in range(400):
        copy = list(base)
        for n in range(rng.randrange(2, 9)):
            copy[rng.randrange(150)] = f"v{k}x{n}"
        rows.append(row(k, " ".join(copy)))
    joined, solve = [], near_copies.min_label_components

    def counted(links):
        joined.append(links.distinct().count())
        return solve(links)

    monkeypatch.setattr(near_copies, "min_label_components", counted)
    assert sorted(r.doc_id for r in near_copies.keep_one(frame(spark, rows)).collect()) == slow_kept(rows)
    assert sum(joined) < 4 * len(rows)


def test_known_roots_are_not_linked_again():
    """Rows of one root, alike or not, in several buckets; each other root is linked once."""
    gids, roots, prints = zip(*[(g, r, p) for g in range(5) for r, p in ((0, 0), (0, 1), (0, (1 << 60) - 1), (7, 3), (8, (1 << 60) - 2), (9, (1 << 30) - 1))])
    columns = [pa.array(gids), pa.array(range(30)), pa.array(roots), pa.array([True] * 30), pa.array(prints), pa.array(prints)]
    batch = pa.RecordBatch.from_arrays(columns, ["gid", "ord", "root", "lead", "a", "b"])
    assert [(r["item"], r["hub"]) for b in near_copies._near([batch]) for r in b.to_pylist()] == [(7, 0), (8, 0)]
