"""SimHash groups against brute force over all pairs."""

import random
import re

import numpy as np
import xxhash

from talonscan.llm import simhash
from tests.llm.edge import ROWS, frame, saved

SF = "/root/testdata/sf0.001"


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(prints):
    """prints: key -> fingerprint; key -> smallest key reachable."""
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def check(rows, texts):
    prints = {d: slow_print(t) for d, t in texts.items()}
    want = components(prints)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id], r.doc_id


def test_op3(spark, tmp_path):
    check(simhash.op3_simhash(spark, saved(spark, tmp_path)).collect(), {r[0]: r[1] for r in ROWS})
    check(simhash.op3_simhash(spark, SF).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_with_small_shards(spark):
    random.seed(5)
    seeds = [random.getrandbits(64) for _ in range(30)]
    prints = set(seeds)
    for _ in range(500):
        x = random.choice(sorted(prints))
        for _ in range(random.randint(1, 4)):
            x ^= 1 << random.randrange(64)
        prints.add(x)
    signed = {int(np.uint64(p).view(np.int64)): p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    from talonscan.llm.common import min_label_components

    got = {r.item: r.root for r in min_label_components(simhash.link_fingerprints(df, shard=8)).collect()}
    want = components(signed)
    for s in signed:
        assert got.get(s, s) == want[s]


def test_block_counts():
    """All schemes find every pair within the radius."""
    rng = np.random.default_rng(1)
    for distinct in (10, 1 << 24, 1 << 30, 1 << 40):
        m = simhash.block_count(distinct)
        edges = [64 * i // m for i in range(m + 1)]
        for _ in range(200):
            bits = rng.choice(64, 4, replace=False)
            assert sum(not any(edges[b] <= x < edges[b + 1] for x in bits) for b in range(m)) >= m - 4

