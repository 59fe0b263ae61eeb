"""Components of near copies against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talonscan.llm import minhash
from tests.llm.edge import ROWS, frame, saved


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 2]) for i in range(max(len(words) - 1, 1))} if words else set()


def slow(rows):
    """Rows (doc_id, n_shingles, component_id) by all pairs."""
    sets, root = [grams(r[1]) for r in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(r[0], least.get(find(k), r[0]))
    return sorted(((r[0], len(s), least.get(find(k)) if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets))), key=str)


def row(k, text):
    return (k, text, "en", "s", len(text), "x")


def planted(originals=40):
    """Originals with copies of 120 words of which 1 to 12 differ, and chains in which each copy is a copy of the one before."""
    rng, texts = random.Random(3), []
    for k in range(originals):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        texts.append(" ".join(words))
        for changes in rng.sample(range(1, 13), 3):
            copy = list(words)
            for n in range(changes):
                copy[rng.randrange(120)] = f"new{k}x{n}"
            texts.append(" ".join(copy))
            if k % 5 == 0:
                words = copy
    rng.shuffle(texts)
    return [row(k, t) for k, t in enumerate(texts)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_components_are_those_of_all_pairs(spark):
    rows = planted() + [row(1000 + k, t) for k, t in enumerate(["one", "ONE", "", " \t", "a b", "a b a b", "b a b a", "A\x0bB", "é É"])]
    assert got(minhash.near_duplicates(frame(spark, rows))) == slow(rows)


@pytest.mark.parametrize("shard", [3])
def test_large_buckets_are_dealt(spark, monkeypatch, shard):
    """Groups far larger than a shard, with members near the limit of similarity on both sides."""
    rng, texts = random.Random(4), []
    base = [f"w{k}" for k in range(100)]
    for k in range(60):
        copy = list(base)
        for n in rng.sample(range(0, 100, 3), rng.choice([1, 4, 5, 6, 7, 10])):
            copy[n] = f"v{k % 9}x{n}"
        texts.append(" ".join(copy))
    rows = [row(k, t) for k, t in enumerate(texts)]
    monkeypatch.setattr(minhash, "SHARD", shard)
    assert got(minhash.near_duplicates(frame(spark, rows))) == slow(rows)


def test_edge_rows_and_shared_ids(spark, tmp_path):
    rows = ROWS + [row(None, "some text here and there"), row(None, "some text here and there"), row(11, "another text of this id"), row(20, "some text here and there"), (4, *ROWS[0][1:])]
    assert got(minhash.near_duplicates(frame(spark, rows))) == slow(rows)
    found = minhash.op12_minhash(spark, saved(spark, tmp_path, ROWS)).collect()
    assert {(r.doc_id, r.kept) for r in found} == {(i, i == c) for i, _, c in slow(ROWS)}
    assert minhash.op12_minhash(spark, saved(spark, tmp_path, [])).collect() == []


def test_sketches_estimate_similarity_and_miss_few():
    """Over pairs of similarity 0.8, at most a few in a thousand share no table."""
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(400):
        a = rng.integers(0, 1 << 63, 90, np.uint64)
        b = np.concatenate([a[:80], rng.integers(0, 1 << 63, 10, np.uint64)])
        x, y = minhash.half_sketches(a) == minhash.half_sketches(b), minhash.HALVES
        missed += not (x[:y].any() and x[y:].any())
    assert missed <= 2


def test_bitmaps_never_lose_a_link():
    """Pairs at and above the limit survive at every size, pairs far below it mostly do not."""
    rng = np.random.default_rng(2)
    lost = 0
    for n in [1, 2, 5, 9, 31, 32, 33, 64, 65, 100, 129, 250, 512, 515, 2000]:
        base = np.unique(rng.integers(0, 1 << 63, 2 * n, np.uint64))[:n]
        rows = [base, base[: -(-4 * n // 5)], np.unique(np.concatenate([base, rng.integers(0, 1 << 63, n // 4, np.uint64)])), np.unique(rng.integers(0, 1 << 63, n, np.uint64))]
        words, sizes, none = [minhash.bitmap(r) for r in rows], np.array([len(r) for r in rows]), np.zeros((4, 2 * minhash.HALVES), np.int64)
        kept = minhash.survivors(-1, np.arange(4), none, sizes, words)
        for i in range(3):
            near = any(5 * len(np.intersect1d(rows[i], rows[j])) >= 4 * len(np.union1d(rows[i], rows[j])) for j in range(3) if j != i)
            assert kept[i] or not near
        lost += not kept[3]
    assert lost >= 11


def test_marked_rows_pass_and_most_others_do_not(spark):
    rows = spark.range(-20_000, 20_000).select(F.col("id"), F.xxhash64("id").alias("h"))
    pages = minhash.marked(rows.where("id % 10 = 0").select("h"))
    kept = {r.id for r in minhash.maybe_marked(rows, F.col("h"), pages).collect()}
    assert kept >= set(range(-20_000, 20_000, 10)) and len(kept) < 4_100
    few = spark.createDataFrame([(v,) for v in (0, 1, 7, 8, 32767, 32768, 32769, -1, minhash.MARKED - 1, minhash.MARKED)], "v bigint")
    for (v,) in few.collect():
        one = minhash.marked(few.where(few.v == v))
        assert {r.v for r in minhash.maybe_marked(few, few.v, one).collect()} == {x.v for x in few.collect() if x.v % minhash.MARKED == v % minhash.MARKED}
