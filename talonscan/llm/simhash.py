"""SimHash near-duplicate groups through BK-trees.

Distinct fingerprints are put in buckets that any two linked ones share: of m blocks of the 64 bits, fingerprints
that differ in at most 4 bits agree on some m - 4. A bucket is cut into shard trees of at most ``SHARD``
fingerprints; each shard's BK-tree (children keyed by Hamming distance to the parent) is searched by every shard of
the bucket, following only edges within the radius. Trees travel to the tasks by shuffle instead of broadcast: their
number grows with the corpus, so no bound for a broadcast could be proven. All trees of a task are built and searched level by level at once.

A search emits a spanning forest of its links, never all pairs; components are joined by label propagation.

Defined results: null text has no words, and a text without words has fingerprint zero; rows with one doc_id are kept
each; a null doc_id can link others but names no component (component_id is null if no member has an id);
other columns are ignored; an empty table gives no rows. A huge group of equal texts is one fingerprint, summed before any shuffle.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.llm.common import materialize, min_label_components, table

SHINGLE = 4
RADIUS = 4
SHARD = 1024
#: Fingerprints that a task searches at a time.
CHUNK = 1 << 15
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash over XXH64 (seed 42) of word shingles, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    for a in range(0, n, 50_000):
        b = min(n, a + 50_000)
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[a:b], ends[a + width - 1 : b + width - 1])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def block_count(distinct: int, radius: int = RADIUS) -> int:
    """Blocks so that buckets of random fingerprints stay small; radius of the blocks may differ, the others key a bucket."""
    extra = 1 if distinct <= 1 << 20 else 2 if distinct <= 1 << 28 else 3 if distinct <= 1 << 33 else 4
    return radius + extra


def bucket_keys(blocks: int, radius: int = RADIUS):
    """Columns of the keys of fp: one for each choice of blocks - radius blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        value = F.lit(n).cast("bigint")
        for b in chosen:
            size = edges[b + 1] - edges[b]
            part = F.shiftrightunsigned("fp", edges[b]).bitwiseAND(F.lit((1 << size) - 1))
            value = F.shiftleft(value, size).bitwiseOR(part)
        keys.append(value)
    return keys


def popcount(x: np.ndarray) -> np.ndarray:
    """Bits set in each number, or in each row of numbers."""
    bits = np.bitwise_count(x).astype(np.int64)
    return bits if bits.ndim == 1 else bits.sum(axis=1)


def search_forest(tree_fp: np.ndarray, tree_group: np.ndarray, query_fp: np.ndarray, query_group: np.ndarray, radius: int = RADIUS, block: int = 4096):
    """Yields (query index, node index) arrays of pairs within the radius and in one group, ``block`` queries at a time.

    One BK-tree for each group over distinct fingerprints; ``tree_group`` is sorted and dense from 0. A fingerprint is
    a number of 64 bits or a row of them.
    """
    n = len(tree_fp)
    edges = 1 + 64 * tree_fp[:1].size  # distances that two fingerprints can have
    root_of = np.flatnonzero(np.concatenate([[True], tree_group[1:] != tree_group[:-1]])) if n else np.zeros(0, np.int64)
    root_at = np.full(int(max(tree_group.max(initial=-1), query_group.max(initial=-1))) + 1, -1, np.int64)
    root_at[tree_group[root_of]] = root_of
    pending = np.setdiff1d(np.arange(n), root_of, assume_unique=True)
    at = root_at[tree_group[pending]]
    parents, dists, nodes = [], [], []
    while len(pending):
        d = popcount(tree_fp[pending] ^ tree_fp[at])
        key, first, back = np.unique(at * edges + d, return_index=True, return_inverse=True)
        child = pending[first]
        parents.append(at[first])
        dists.append(d[first])
        nodes.append(child)
        rest = np.ones(len(pending), bool)
        rest[first] = False
        at, pending = child[back][rest], pending[rest]
    parent, dist, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, dists, nodes))
    order = np.argsort(parent, kind="stable")
    dist, node = dist[order], node[order]
    begin = np.searchsorted(parent[order], np.arange(n + 1))
    for a in range(0, len(query_fp), block):
        q = np.arange(a, min(a + block, len(query_fp)))
        v = root_at[query_group[q]]
        q, v = q[v >= 0], v[v >= 0]
        while len(q):
            d = popcount(query_fp[q] ^ tree_fp[v])
            near = d <= radius
            if near.any():
                yield q[near], v[near]
            deg = begin[v + 1] - begin[v]
            total = int(deg.sum())
            src = np.repeat(np.arange(len(q)), deg)
            e = np.arange(total) - np.repeat(np.cumsum(deg) - deg, deg) + begin[v][src]
            follow = np.abs(dist[e] - d[src]) <= radius
            q, v = q[src[follow]], node[e[follow]]


def merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each the index of a row with that label) after x and y, pair by pair, are given one label."""
    while True:
        p, r = label[x], label[y]
        apart = p != r
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(p, r)[apart], np.minimum(p, r)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _links(batches, radius: int):
    """Rows (gid, diagonal, tree, fp), sorted by gid, to spanning links (item, hub)."""

    def solve(gid, diagonal, tree, fp):
        group = np.concatenate([[0], np.cumsum(gid[1:] != gid[:-1])])
        t = np.flatnonzero(tree)
        q = np.flatnonzero(diagonal | ~tree)
        label = np.arange(len(gid))
        u = fp.view(np.uint64)
        for a, b in search_forest(u[t], group[t], u[q], group[q], radius):
            label = merge(label, q[a], t[b])
        moved = np.flatnonzero(label != np.arange(len(gid)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["item", "hub"])

    held = None
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if len(held[0]) >= CHUNK:
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            if cut:
                yield solve(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield solve(*held)


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Distinct fp to links (item, hub) that connect the same fingerprints as all pairs within the radius do."""
    blocks = block_count(distinct.count(), radius)
    keyed = distinct.select("fp", F.explode(F.array(*bucket_keys(blocks, radius))).alias("key"))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(f"n > {shard}").select(F.col("key").alias("_k"), F.ceil(F.col("n") / shard).cast("int").alias("shards"))
    keyed = keyed.join(large, F.col("key") == F.col("_k"), "left").select("fp", "key", F.coalesce("shards", F.lit(1)).alias("shards"))
    own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    dealt = keyed.select("fp", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
    ready = dealt.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("gid"),
        (F.col("own") == F.col("other")).alias("diagonal"),
        (F.col("own") <= F.col("other")).alias("tree"),
        "fp",
    )
    sorted_ = ready.repartition("gid").sortWithinPartitions("gid", "fp")
    return sorted_.mapInArrow(lambda batches: _links(batches, radius), "item bigint, hub bigint")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    prints = materialize(fingerprints(docs, width), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = materialize(link_fingerprints(distinct.select("fp"), radius), "links")
    roots = min_label_components(links)
    named = distinct.join(roots, distinct["fp"] == roots["item"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "named")
    # written, so that both sides of the joins are plain tables, which Spark's skew join can split at a large group
    names = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "names")
    of_print = materialize(named.join(names, "root").select(F.col("fp").alias("_fp"), "component_id"), "of_print")
    return prints.join(of_print, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
