"""Near copies by SimHash and BK-trees, for the pipeline: links at a Jaccard similarity of word shingles.

Operator 3 with a similarity in the place of a radius. Rows with equal shingle sets are one class. A class has a long
SimHash fingerprint of independent bits over its distinct shingles; two sets of similarity s (of equal size, the least
favourable) agree in a bit with probability 1 - acos(2s / (1 + s)) / pi, 0.849 at 0.8.

1. Tables key classes by sampled bits of the fingerprint, each bit in one table. Wider keys for more rows keep buckets
   small; as many tables are searched as leave out ``MISS`` of the pairs at 0.8, fewer above.
2. In each bucket a BK-tree over 128 bits that no key holds is searched by its members, with a radius that leaves out
   9 pairs in a million at 0.8; 2 in a million unrelated pairs are within it. The search emits a spanning forest. Tables are searched
   one, then eight, then up to ``ROUND`` at a time, which bounds what is on disk at once. A round knows the roots of those
   before it and links roots only, so that a large group is linked about once and not anew in each table.
3. Classes so connected are a family, whose sets travel once; every link is decided by the exact similarity of two sets,
   and a family is linked as all its pairs are.

Buckets and families of more than ``SHARD`` members are cut into shards that each hold the smallest member too. What is
then still apart from the root that most members have is held against every member.

These are calculations for sums of many shingles. They hold from 8 shingles on; a set of 4 in one of 5 agrees in a
bit with 0.8125, and such a pair may be missed.

Defined results: null text has no words, and texts without words are copies of each other; fewer words than a
shingle are one shingle. Rows count, not ids: of each component the row with the smallest id stays, rows that share an id
or have none like any others. Other columns are carried through; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talonscan.llm.common import complete_groups, discard, materialize, min_label_components, release_shuffles
from talonscan.llm.simhash import CHUNK, LOWER, merge, popcount, search_forest
from talonscan.llm.suffix_dedup import _mix, _ordered

WIDTH = 5
#: Least similarity, in hundredths.
LEAST = 80
#: Share of the pairs at that similarity that share no bucket.
MISS = 3e-5
#: Bits searched in a bucket, as 64-bit words, and their radius.
WORDS, RADIUS = 2, 38
SHARD = 1024
ROUND = 40


def tables_for(rows: int, least: int = LEAST) -> tuple[int, int]:
    """Bits of a key and number of tables: about 16 to 32 random fingerprints in a bucket."""
    bits = min(max(rows.bit_length() - 5, 8), 24)
    agree = 1 - math.acos(2 * least / (100 + least)) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - width + 1, 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())], np.uint64))


def fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """SimHash of ``words`` times 64 bits over distinct shingles."""
    seeds = _mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    counts = np.zeros(64 * words, np.int64)
    for a in range(0, len(hashes), 255):  # what a byte can count
        mixed = _mix(hashes[a : a + 255, None] ^ seeds)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def _prints(batches, words: int):
    for batch in batches:
        classes, prints = [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            classes.append(xxhash.xxh3_64_intdigest(s.tobytes()))
            prints.append(fingerprint(s, words) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(classes, np.uint64).view(np.int64)), pa.array(prints, pa.binary())], ["ord", "class", "print"])


def _rounds(tables: int):
    """First and last table of each round; the early ones are short, as what they connect is linked only once."""
    first, size = 0, 1
    while first < tables:
        last = min(first + size, tables)
        yield first, last
        first, size = last, min(8 * size, ROUND)


def _keys(batches, bits: int, first: int, last: int):
    """(ord, root, print) to a row (key, ord, root, a, b) for each table from first to last: its bucket and the words to search."""
    weights = (1 << np.arange(bits)).astype(np.float32)  # exact up to 24 bits
    names = np.arange(first, last, dtype=np.int64) << 32
    begin = 64 * WORDS + first * bits
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            prints = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
            sampled = np.unpackbits(prints, axis=1)[:, begin : begin + (last - first) * bits]
            keys = (sampled.reshape(part.num_rows, last - first, bits).astype(np.float32) @ weights).astype(np.int64) + names
            words = np.ascontiguousarray(prints[:, : 8 * WORDS]).view(np.int64)
            each = lambda x: pa.array(np.repeat(x, last - first))
            ords, roots = part.column(0).to_numpy(), part.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), each(ords), each(roots), each(words[:, 0]), each(words[:, 1])], ["key", "ord", "root", "a", "b"])


def _near(batches):
    """Rows (gid, ord, root, lead, a, b), sorted by gid, to links (item, hub) of roots that connect what all pairs within the radius do, given that equal roots are connected."""

    def take(rows):
        gid, ord_, root = (rows.column(k).to_numpy() for k in range(3))
        fp = np.stack([rows.column(k).to_numpy() for k in (4, 5)], axis=1).view(np.uint64)
        order = np.lexsort((ord_, ~rows.column(3).to_numpy(zero_copy_only=False), gid))
        gid, root, fp = gid[order], root[order], fp[order]
        new = np.concatenate([[True], gid[1:] != gid[:-1]])
        group = np.cumsum(new) - 1
        top = np.flatnonzero(new)[group]
        label = np.arange(len(gid))
        # one root is connected, in whatever buckets, and needs one link at most
        kin = np.argsort(root, kind="stable")
        head = np.concatenate([[True], np.diff(root[kin]) != 0])
        label = merge(label, kin, kin[head][np.cumsum(head) - 1])
        # one fingerprint is one node
        alike = np.lexsort((fp[:, 1], fp[:, 0], group))
        first = np.concatenate([[True], (np.diff(group[alike]) != 0) | (fp[alike[1:]] != fp[alike[:-1]]).any(axis=1)])
        t = np.sort(alike[first])
        label = merge(label, alike, alike[first][np.cumsum(first) - 1])
        # what is known to be connected with the top of its tree has no need to search
        known = (root == root[top]) | (popcount(fp ^ fp[top]) <= RADIUS)
        label = merge(label, np.flatnonzero(known), top[known])
        q = t[~known[t]]
        for a, b in search_forest(fp[t], group[t], fp[q], group[q], RADIUS, 1024):
            label = merge(label, q[a], t[b])
        item, hub = root[kin[head]], root[label[kin[head]]]
        moved = item != hub
        yield pa.RecordBatch.from_arrays([pa.array(item[moved]), pa.array(hub[moved])], ["item", "hub"])

    return complete_groups(batches, CHUNK, take)


def _sets(batches):
    for batch in batches:
        sets = pa.array([shingles(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(1), sets], ["key", "ord", "root", "hashes"])


def spanning(root: np.ndarray, sets: list[np.ndarray], least: int = LEAST):
    """Links (item, hub) of roots that connect what all pairs of that similarity do, given that equal roots are connected."""
    sizes = np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(flat), bool)
    left, items, hubs = np.arange(len(sets)), [], []
    while len(left):
        same = root[left] == root[left[0]]
        todo, left = left[same].tolist(), left[~same]
        while todo and len(left):
            k = todo.pop()
            held = flat[begin[k] : begin[k] + sizes[k]]
            mark[held] = True
            try_ = left[(100 * np.minimum(sizes[left], sizes[k]) >= least * np.maximum(sizes[left], sizes[k]))]
            if len(try_):
                at = np.concatenate([[0], np.cumsum(sizes[try_])[:-1]])
                rows = np.arange(int(sizes[try_].sum())) + np.repeat(begin[try_] - at, sizes[try_])
                both = np.add.reduceat(mark[flat[rows]], at, dtype=np.int64)
                near = try_[100 * both >= least * (sizes[try_] + sizes[k] - both)]
                items += root[near].tolist()
                hubs += [root[k]] * len(near)
                now = np.isin(root[left], root[near])
                todo += left[now].tolist()
                left = left[~now]
            mark[held] = False
    return items, hubs


def _similar(batches):
    """Rows (gid, ord, root, lead, hashes), sorted by gid, to links (item, hub) of roots that connect what all similar pairs do, given that equal roots are connected."""

    def take(rows):
        gid, root = rows.column(0).to_numpy(), rows.column(2).to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in rows.column(4).to_pylist()]
        edges = np.concatenate([[0], np.flatnonzero(gid[1:] != gid[:-1]) + 1, [len(gid)]]).tolist()
        items, hubs = [], []
        for a, b in zip(edges, edges[1:]):
            i, h = spanning(root[a:b], sets[a:b])
            items += i
            hubs += h
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(hubs, pa.int64())], ["item", "hub"])

    return complete_groups(batches, 512, take)


def _renamed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows whose root is an item of ``roots`` (item, root) take its root."""
    moved = roots.where("item <> root").select(F.col("item").alias("_item"), F.col("root").alias("_root"))
    renamed = rows.join(moved, F.col("root") == F.col("_item"), "left")
    return renamed.select(*[F.coalesce("_root", "root").alias("root") if c == "root" else c for c in rows.columns])


def connect(rows: DataFrame, solve, shard: int, label: str) -> DataFrame:
    """rows (key, ord, root, payload) to (item, root) of the roots that ``solve`` connects with others within keys, given that equal roots are connected."""
    payload = rows.columns[3:]
    wide = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("ord").alias("top")).where(f"n > {shard}")
    wide = materialize(wide.select(F.col("key").alias("_key"), "top", F.ceil(F.col("n") / shard).cast("int").alias("shards")), "wide")
    on = F.col("key") == F.col("_key")
    own = lambda n: F.pmod(F.xxhash64("ord"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)

    def solved(dealt, what):
        dealt = dealt.select("gid", "ord", "root", "lead", *payload).repartition("gid").sortWithinPartitions("gid")
        links = materialize(dealt.mapInArrow(solve, "item bigint, hub bigint"), what)
        roots = min_label_components(links)
        discard(links)
        return roots

    alone = F.lit(True).alias("lead")
    if not wide.limit(1).count():
        return solved(rows.select(F.col("key").alias("gid"), "ord", "root", alone, *payload), label)
    shards = F.when(F.col("_key").isNull(), F.array(F.lit(0))).when(F.col("ord") == F.col("top"), every(F.col("shards"))).otherwise(F.array(own(F.col("shards"))))
    dealt = rows.join(wide, on, "left").select("key", "ord", "root", *payload, F.explode(shards).alias("s"))
    roots = solved(dealt.select(F.xxhash64("key", "s").alias("gid"), "ord", "root", alone, *payload), label)

    named = materialize(_renamed(rows.join(wide, on).select("key", "ord", "shards", "root", *payload), roots), "named")
    held = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = held.groupBy(F.col("key").alias("_key")).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = materialize(main.where("`all` > most").select("_key", "main", F.ceil((F.col("all") - F.col("most")) / shard).cast("int").alias("others")), "main")
    if main.limit(1).count():
        apart = named.join(main, on).withColumn("lead", F.col("root") == F.col("main"))
        members = apart.select("*", own(F.col("shards")).alias("s"), F.explode(every(F.col("others"))).alias("t"))
        others = apart.where("not lead").select("*", F.explode(every(F.col("shards"))).alias("s"), own(F.col("others")).alias("t"))
        dealt = members.union(others).select(F.xxhash64("key", "s", "t").alias("gid"), "ord", "root", "lead", *payload)
        more = solved(dealt, "apart")
        roots = materialize(_renamed(roots, more).unionByName(more.join(roots.select("item"), "item", "left_anti")), "roots")
    for done in (wide, named, main):
        discard(done)
    return roots


def components(docs: DataFrame, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with a distinct ``ord`` to (ord, class), classes (ord: their smallest) and (item, root) of the classes linked with others."""
    bits, tables = tables_for(docs.count())
    words = WORDS + -(-bits * tables // 64)
    prints = materialize(docs.select("ord", "text").mapInArrow(lambda b: _prints(b, words), "ord bigint, class bigint, print binary"), "prints")
    classes = materialize(prints.groupBy("class").agg(F.min("ord").alias("ord")).select("ord"), "classes")
    printed = materialize(prints.where("print is not null").join(classes, "ord", "left_semi").select("ord", F.col("ord").alias("root"), "print"), "printed")
    for first, last in _rounds(tables):
        keyed = printed.mapInArrow(lambda b, first=first, last=last: _keys(b, bits, first, last), "key bigint, ord bigint, root bigint, a bigint, b bigint")
        renamed = materialize(_renamed(printed, connect(keyed, _near, shard, "near")), "printed")
        discard(printed)
        printed = renamed
        release_shuffles(docs.sparkSession)
    linked = printed.where("root <> ord").select(F.col("root").alias("key"), F.col("ord").alias("_ord"))
    # written, so that Spark knows their size and few families do not shuffle the texts
    families = materialize(linked.union(linked.select("key", F.col("key").alias("_ord")).distinct()), "families")
    members = docs.select("ord", "text").join(families, F.col("ord") == F.col("_ord")).select("key", "ord", "text")
    members = materialize(members.mapInArrow(_sets, "key bigint, ord bigint, root bigint, hashes binary"), "members")
    roots = connect(members, _similar, shard, "links")
    for done in (printed, families, members):
        discard(done)
    return prints, classes, roots


def keep_one(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row of each component."""
    rows = _ordered(docs)
    prints, classes, roots = components(rows, shard)
    kept = classes.join(roots.where("root <> item"), F.col("ord") == F.col("item"), "left_anti")
    gone = materialize(prints.select("ord").join(kept, "ord", "left_anti"), "gone")
    discard(prints)
    discard(classes)
    return rows.join(gone, "ord", "left_anti").select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])
