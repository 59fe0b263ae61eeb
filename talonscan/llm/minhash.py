"""Near copies by MinHash with tensored banding: Jaccard similarity of word pairs of 0.8 or more.

Two small collections of ``HALVES`` sketches, of ``DEPTH`` minima each, are computed for a set. Every sketch of the first with every one of the second
is the key of a table, so that 100 tables of four minima cost 40 minima instead of 400. Two sets of similarity s share a table unless all
sketches of a collection differ: both do with probability (1 - (1 - s^DEPTH)^HALVES)^2, which leaves out 7 pairs in 100,000 at 0.8, 5 in a million at 0.85.

Candidates are verified on whole sets and linked as all their pairs would be:

1. Equal sets are one class, by a 128-bit hash of the sorted set.
2. Each class is held against one hub, the smallest class it shares a bucket with; a hub's classes are dealt into shards that all hold the hub.
3. Only buckets that still hold several components are looked at again, classes apart from the bucket's largest component against all of its
   members and one another, in shards. A pair that shares several tables is compared in the first of them.

Before whole sets travel, bitmaps do, of two to four bits for each shingle: a bit that one set has and the other lacks is a shingle that they do not share, which
bounds their similarity from above. Only classes that some candidate may still be similar to are held against one another by their sets.

Where few rows of a large table are wanted (keys of buckets, classes in buckets), a broadcast bitmap of ``MARKED`` bits, of fixed size, keeps most others from
the shuffle, or from being read again; it lets some pass, which the joins behind it drop, and none that is wanted is lost.

Defined results: null text has no words; rows without words have no shingles, are their own component and kept; one word is one shingle. Rows
count, not ids: repeated rows are copies; rows that share an id or have none like any others; the smallest id of a component leaves nulls out, and a row is kept whose
id is that one. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.llm.common import complete_groups, discard, materialize, min_label_components, table
from talonscan.llm.near_copies import shingles
from talonscan.llm.suffix_dedup import _ordered

WIDTH = 2
#: Least similarity, in hundredths.
LEAST = 80
DEPTH, HALVES = 2, 10
SHARD = 1024
#: Bits of broadcast bitmaps: 8 MB, whatever the input.
MARKED = 1 << 26
_FACTORS = np.random.default_rng(12).integers(0, 1 << 63, (2, 2 * HALVES * DEPTH, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def half_sketches(hashes: np.ndarray) -> np.ndarray:
    """The 2 * HALVES sketches of a set: the first collection, then the second."""
    low = np.full(2 * HALVES * DEPTH, ~np.uint64(0))
    for a in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[a : a + 2048] * _FACTORS[0] + _FACTORS[1]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(low[k * DEPTH : (k + 1) * DEPTH].tobytes(), k) for k in range(2 * HALVES)], np.uint64)


def table_keys() -> Column:
    """array<struct<nth,key>> of a row's ``halves``: each sketch of the first collection with each of the second."""
    first, second = F.slice("halves", 1, HALVES), F.slice("halves", HALVES + 1, HALVES)
    key = lambda x, i, y, j: F.struct((i * HALVES + j).alias("nth"), F.xxhash64(x, y, i * HALVES + j).alias("key"))
    return F.flatten(F.transform(first, lambda x, i: F.transform(second, lambda y, j: key(x, i, y, j))))


def _halves(sets: list[np.ndarray]) -> pa.Array:
    flat = [half_sketches(s) if len(s) else np.zeros(2 * HALVES, np.uint64) for s in sets]
    values = pa.array(np.concatenate(flat).view(np.int64)) if flat else pa.array([], pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * 2 * HALVES), values)


def _sketches(batches):
    for batch in batches:
        sets = [shingles(t, WIDTH) for t in batch.column(2).to_pylist()]
        marks = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks, pa.array([len(s) for s in sets], pa.int64()), _halves(sets)], ["ord", "doc_id", "mark", "size", "halves"])


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Words of a bitmap of the low bits of hashes, its length a power of two, at least twice the set's size. Its halves together are the bitmap of half the length."""
    size = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[hashes & np.uint64(size - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _sets(batches):
    for batch in batches:
        sets = [shingles(t, WIDTH) for t in batch.column(1).to_pylist()]
        columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), _halves(sets), *columns], ["ord", "halves", "size", "bits", "hashes"])


def _in_table(nth: int, halves: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
    """Which of the others share table ``nth`` with k as their first (any, if negative)."""
    if nth < 0:
        return np.ones(len(others), bool)
    both = halves[others] == halves[k]
    return both[:, :HALVES].argmax(axis=1) * HALVES + both[:, HALVES:].argmax(axis=1) == nth


def survivors(nth: int, root: np.ndarray, halves: np.ndarray, sizes: np.ndarray, words: list[np.ndarray], least: int = LEAST) -> np.ndarray:
    """Mask of the rows that, by their bitmaps, may be similar to a row of another root. Sizes of similar sets differ so little that bitmaps differ in length by a factor of two at most."""
    keep, level = np.zeros(len(root), bool), np.array([len(w) for w in words])
    for m in np.unique(level).tolist():
        own, twice = np.flatnonzero(level == m), np.flatnonzero(level == 2 * m)
        at = np.concatenate([own, twice])
        rows = np.stack([words[i] for i in own] + [words[i][:m] | words[i][m:] for i in twice])
        for n, k in enumerate(own.tolist()):
            b = at[n + 1 :]
            able = (root[b] != root[k]) & (100 * np.minimum(sizes[b], sizes[k]) >= least * np.maximum(sizes[b], sizes[k]))
            able = np.flatnonzero(able)
            able = able[_in_table(nth, halves, k, b[able])]
            if not len(able):
                continue
            b, other = b[able], rows[n + 1 :][able]
            alone = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
            both = np.minimum(sizes[k] - alone(rows[n] & ~other), sizes[b] - alone(~rows[n] & other))
            near = 100 * both >= least * (sizes[k] + sizes[b] - both)
            keep[k] |= near.any()
            keep[b[near]] = True
    return keep


def spanning(nth: int, ord_: np.ndarray, root: np.ndarray, halves: np.ndarray, sets: list[np.ndarray], least: int = LEAST):
    """Links (item, hub) that connect what all pairs do whose first common table is ``nth`` (any, if negative), given that equal roots are connected."""
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
            try_ = left[100 * np.minimum(sizes[left], sizes[k]) >= least * np.maximum(sizes[left], sizes[k])]
            try_ = try_[_in_table(nth, halves, k, try_)]
            if not len(try_):
                continue
            held = flat[begin[k] : begin[k] + sizes[k]]
            mark[held] = True
            at = np.concatenate([[0], np.cumsum(sizes[try_])[:-1]])
            rows = np.arange(int(sizes[try_].sum())) + np.repeat(begin[try_] - at, sizes[try_])
            both = np.add.reduceat(mark[flat[rows]], at, dtype=np.int64)
            near = try_[100 * both >= least * (sizes[try_] + sizes[k] - both)]
            mark[held] = False
            if len(near):
                items += ord_[near].tolist()
                hubs += [ord_[k]] * len(near)
                now = np.isin(root[left], root[near])
                todo += left[now].tolist()
                left = left[~now]
    return items, hubs


def _groups(rows: pa.Table):
    """Bounds of the groups, and the columns gid, nth, ord, root and halves."""
    gid, nth, ord_, root = (rows.column(k).to_numpy() for k in range(4))
    halves = rows.column(4).combine_chunks().flatten().to_numpy().reshape(-1, 2 * HALVES)
    edges = np.concatenate([[0], np.flatnonzero(gid[1:] != gid[:-1]) + 1, [len(gid)]]).tolist()
    return zip(edges, edges[1:]), nth, ord_, root, halves


def _sifted(batches):
    """Rows (gid, nth, ord, root, halves, size, bits) sorted by gid to those that may have a link."""

    def take(rows):
        bounds, nth, _, root, halves = _groups(rows)
        sizes, words = rows.column(5).to_numpy(), [np.frombuffer(b, np.uint64) for b in rows.column(6).to_pylist()]
        keep = np.zeros(rows.num_rows, bool)
        for a, b in bounds:
            keep[a:b] = survivors(int(nth[a]), root[a:b], halves[a:b], sizes[a:b], words[a:b])
        yield from rows.select(["gid", "nth", "ord", "root"]).filter(pa.array(keep)).to_batches()

    return complete_groups(batches, 512, take)


def _links(batches):
    """Rows (gid, nth, ord, root, halves, hashes) sorted by gid to links."""

    def take(rows):
        bounds, nth, ord_, root, halves = _groups(rows)
        sets, items, hubs = [np.frombuffer(b, np.uint64) for b in rows.column(5).to_pylist()], [], []
        for a, b in bounds:
            i, h = spanning(int(nth[a]), ord_[a:b], root[a:b], halves[a:b], sets[a:b])
            items += i
            hubs += h
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(hubs, pa.int64())], ["item", "hub"])

    return complete_groups(batches, 512, take)


def _linked(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """dealt (gid, nth, ord, root) to links within each gid."""
    rows = dealt.join(sets, "ord").select("gid", "nth", "ord", "root", "halves", "size", "bits")
    sifted = materialize(rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(_sifted, "gid bigint, nth int, ord bigint, root bigint"), "sifted")
    rows = sifted.join(sets, "ord").select("gid", "nth", "ord", "root", "halves", "hashes")
    links = materialize(rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(_links, "item bigint, hub bigint"), "links")
    discard(sifted)
    return links


def marked(values: DataFrame) -> DataFrame:
    """A column of hashes to (page, bits): a bitmap of MARKED bits in pages of 4 KB, those without a bit left out."""
    h = F.pmod(F.col(values.columns[0]), F.lit(MARKED))
    return values.groupBy(F.bitmap_bucket_number(h).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits"))


def maybe_marked(rows: DataFrame, by: Column, pages: DataFrame) -> DataFrame:
    """Rows whose hash ``by`` may be among the marked ones; none that is goes missing."""
    h = F.pmod(by, F.lit(MARKED))
    held = rows.select("*", F.bitmap_bucket_number(h).alias("_page"), F.bitmap_bit_position(h).cast("int").alias("_at"))
    met = held.join(F.broadcast(pages), F.col("_page") == F.col("page"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, F.col("_at") % 8) == 1).select(*rows.columns)


def _every(n) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _shard_of(n) -> Column:
    return F.pmod(F.xxhash64("ord"), n).cast("int")


def link_classes(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, nth, ord, hub, shards), the classes of each bucket, to (item, root) of the classes that are linked with others."""
    near = shared.where("ord <> hub").groupBy("ord").agg(F.min(F.struct("hub", "shards")).alias("h")).select("ord", "h.hub", "h.shards")
    near = materialize(near, "near")
    hubs = near.select("hub", "shards").distinct().select(F.col("hub").alias("ord"), "hub", "shards", _every(F.col("shards")).alias("s"))
    dealt = near.select("ord", "hub", "shards", _shard_of(F.col("shards")).alias("s")).unionByName(hubs)
    links = _linked(dealt.select(F.xxhash64("hub", "shards", "s").alias("gid"), F.lit(-1).alias("nth"), "ord", F.col("ord").alias("root")), sets)
    roots = min_label_components(links)
    discard(near)

    named = shared.join(roots, shared["ord"] == roots["item"], "left").select("key", "nth", "ord", "hub", "shards", F.coalesce("root", "ord").alias("root"))
    named = materialize(named, "named")
    per_root = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = per_root.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("most")).where("roots > 1")
    rows = materialize(named.join(mixed.select("key", F.col("most.root").alias("main")), "key"), "mixed")
    if rows.limit(1).count():
        small = rows.where("shards = 1").select(F.col("key").alias("gid"), "nth", "ord", "root")
        wide = rows.where("shards > 1")
        apart = wide.where("root <> main").groupBy("key").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("others"))
        wide = wide.join(apart, "key")
        members = wide.where("root = main").select("key", "nth", "ord", "root", _shard_of(F.col("shards")).alias("s"), _every(F.col("others")).alias("t"))
        # those apart are held against one another too: they are members of every shard of their own
        others = wide.where("root <> main").select("key", "nth", "ord", "root", _every(F.col("shards")).alias("s"), _shard_of(F.col("others")).alias("t"))
        among = wide.where("root <> main and others > 1").select("key", "nth", "ord", "root", _shard_of(F.col("others")).alias("own"), _every(F.col("others")).alias("o"))
        among = among.select(F.xxhash64("key", F.least("own", "o"), F.greatest("own", "o"), F.lit("among")).alias("gid"), "nth", "ord", "root")
        wide = members.unionByName(others).select(F.xxhash64("key", "s", "t").alias("gid"), "nth", "ord", "root")
        more = _linked(small.unionByName(wide).unionByName(among), sets)
        roots = min_label_components(links.unionByName(more))
        discard(more)
    for written in (links, named, rows):
        discard(written)
    return roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id), a row for each row."""
    rows = _ordered(docs.select("doc_id", "text")).select("ord", "doc_id", "text")
    prints = materialize(rows.mapInArrow(_sketches, "ord bigint, doc_id bigint, mark binary, size bigint, halves array<bigint>"), "prints")
    classes = prints.where("size > 0").groupBy("mark").agg(F.min("ord").alias("ord"), F.min("doc_id").alias("first_id"))
    classes = materialize(classes, "classes")
    firsts = prints.join(classes.select("ord"), "ord", "left_semi")
    keyed = firsts.select("ord", F.explode(table_keys()).alias("k")).select("ord", "k.nth", "k.key")
    buckets = keyed.groupBy("key", "nth").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("ord")).alias("x"), F.min("ord").alias("hub")).where("n > 1")
    # buckets of the same members are one, in the first of their tables; numbers of shards are powers of two, so that a hub's buckets agree on them
    buckets = buckets.groupBy("n", "x", "hub").agg(F.min(F.struct("nth", "key")).alias("k"))
    shards = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") / SHARD, F.lit(1))))).cast("int")
    buckets = materialize(buckets.select("k.key", "hub", shards.alias("shards")), "buckets")
    shared = materialize(maybe_marked(keyed, F.col("key"), marked(buckets.select("key"))).join(buckets, "key"), "shared")
    wanted = maybe_marked(rows.select("ord", "text"), F.xxhash64("ord"), marked(shared.select(F.xxhash64("ord"))))
    sets = materialize(wanted.mapInArrow(_sets, "ord bigint, halves array<bigint>, size bigint, bits binary, hashes binary"), "sets")
    roots = link_classes(shared, sets)

    named = classes.join(roots, F.col("ord") == F.col("item"), "left").select("mark", "first_id", F.coalesce("root", "ord").alias("root"))
    named = materialize(named, "named")
    # written, so that both sides of the joins are plain tables, which Spark's skew join can split at a large group
    names = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "names")
    of_mark = materialize(named.join(names, "root").select(F.col("mark").alias("_mark"), "component_id"), "of_mark")
    for written in (classes, buckets, shared, sets, named, names):
        discard(written)
    found = prints.join(of_mark, (F.col("mark") == F.col("_mark")) & (F.col("size") > 0), "left")
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP12_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from w),
n as (select doc_id, count(g) as n from w left join s using (doc_id) group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (g) where a.doc_id < b.doc_id group by all),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
r as (
  select doc_id as x, doc_id as y from w
  union
  select r.x, case when e.x = r.y then e.y else e.x end from r join e on r.y in (e.x, e.y))
select doc_id, n as n_shingles, min(y) as component_id, doc_id = min(y) as kept from n join r on r.x = doc_id group by doc_id, n
"""
