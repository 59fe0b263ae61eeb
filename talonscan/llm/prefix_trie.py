"""The trie of conversation prefixes with subtree sums, by heavy-path decomposition.

A node is a distinct sequence of first turns, named by a chained 128-bit BLAKE2b of its turns; the root has none. Every node's largest child (most members; of
equals the one with the smallest member) continues its path, so a path ends in a leaf, and the conversation that is the leaf's smallest member passes through all
of it: paths are cut out of the chains of these conversations. Subtree sums are suffix sums along paths. Light paths, those that begin below another path, are summed first
and added to the node that they hang from: one round for each number of light edges above a path, which is at most the logarithm of
the number of conversations, since a light child has at most half of its parent's members.

Hot nodes: members are counted by partial aggregates. Where chains meet the facts of their nodes, those nodes that more than one in ``HOT`` chain rows
pass through, ``HOT`` at most, are broadcast; all others are joined by shuffle. The ids that end at a node are joined in
runs of ``RUN`` consecutive numbers and hashed run by run in a stream, as a SHA-256 has to be.

Defined results: rows are ordered by turn, null first, ties by the digest of role and text; null role or text is empty; repeated rows all count; rows
without a conversation id are left out; other columns are ignored; an empty table gives no rows. A conversation's rows pass through one task, in a stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talonscan.llm.common import crc32_sql, discard, materialize, table

HOT = 4096
RUN = 4096
#: Conversations of a block share the first of these turns.
SHARED = 3
ROOT = bytes(16)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _chains(batches):
    """Rows (block, conv_id, own, digest, words) in order to the nodes of rebuilt conversations: (conv_id, depth, id, parent, words, ended)."""
    out = []

    def made():
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", "depth", "id", "parent", "words", "ended"])

    block = conv = None
    base, nth, depth, last, pending = [], 0, 0, ROOT, None

    def put(digest, words):
        nonlocal depth, last, pending
        node = hashlib.blake2b(last + digest, digest_size=16).digest()
        out.append((*pending, False))
        depth += 1
        pending, last = (conv, depth, node, last, words), node

    for batch in batches:
        for b, c, own, digest, words in zip(*[x.to_pylist() for x in batch.columns]):
            if c != conv or b != block:
                if pending is not None:
                    out.append((*pending, True))
                if b != block:
                    block, base = b, []
                conv, nth, depth, last, pending = c, 0, 0, ROOT, (c, 0, ROOT, None, 0)
                for d, w in base[:own] if c != b else ():
                    put(d, w)
            if c == b:
                if nth < SHARED:
                    base.append((digest, words))
                put(digest, words)
            elif nth >= own:
                put(digest, words)
            nth += 1
            if len(out) >= 8192:
                yield made()
                out = []
    if pending is not None:
        out.append((*pending, True))
    if out:
        yield made()


def chains(turns: DataFrame) -> DataFrame:
    """Rebuilds conversations from their own turns and the first turns of their block, and names each prefix."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % 20).alias("block"),
        "conv_id",
        (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int").alias("own"),
        "turn",
        F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    dealt = rows.repartition("block").sortWithinPartitions("block", F.col("conv_id") != F.col("block"), "conv_id", "turn", "digest")
    return dealt.select("block", "conv_id", "own", "digest", "words").mapInArrow(_chains, "conv_id bigint, depth int, id binary, parent binary, words bigint, ended boolean")


def _hashed(batches):
    """Rows (id, ids) sorted by node and run to (id, ends_sha256)."""
    at, hashed = None, None
    for batch in batches:
        nodes, digests = [], []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node == at:
                hashed.update(b",")
            else:
                if at is not None:
                    nodes.append(at)
                    digests.append(hashed.hexdigest())
                at, hashed = node, hashlib.sha256()
            hashed.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["id", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([hashed.hexdigest()], pa.string())], ["id", "ends_sha256"])


def end_digests(chain: DataFrame) -> DataFrame:
    """(id, ends_sha256) of nodes at which conversations end: no more than RUN ids are ever together."""
    runs = chain.where("ended").groupBy("id", F.floor(F.col("conv_id") / RUN).alias("run")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = runs.select("id", "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return joined.repartition("id").sortWithinPartitions("id", "run").select("id", "ids").mapInArrow(_hashed, "id binary, ends_sha256 string")


def facts(chain: DataFrame) -> DataFrame:
    """One row for each node: id, conv_id (smallest member), n_convs, n_children, heavy (smallest member of the largest child)."""
    nodes = chain.groupBy("id", "parent").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    largest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("m")))
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("_id")).agg(F.count("*").alias("n_children"), largest.alias("largest"))
    joined = nodes.join(kids, F.col("id") == F.col("_id"), "left")
    return joined.select("id", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), (-F.col("largest.m")).alias("heavy"))


def heavy_paths(chain: DataFrame, known: DataFrame, hot: int = HOT) -> DataFrame:
    """One row for each node: its path (smallest member of the leaf), level (light edges above), depth, facts, and ``up``, the node that the path hangs from, at its head."""
    leaves = known.where("n_children = 0").select(F.col("conv_id").alias("path"))
    rows = chain.join(leaves, F.col("conv_id") == F.col("path"), "left_semi").select(F.col("conv_id").alias("path"), "depth", F.col("id").alias("_id"), "words")
    often = known.where(F.col("n_convs") > F.lit(chain.count() // hot))  # at most ``hot`` rows, since every chain row counts at one node
    rest = known.where(F.col("n_convs") <= F.lit(chain.count() // hot))
    by_hash = rows.join(F.broadcast(often.select("id")), F.col("_id") == F.col("id"), "left_anti")
    met = rows.join(F.broadcast(often), F.col("_id") == F.col("id")).unionByName(by_hash.join(rest, F.col("_id") == F.col("id")))
    along = Window.partitionBy("path").orderBy("depth")
    above = met.drop("_id").select("*", F.lag("heavy").over(along).alias("_h"), F.lag("conv_id").over(along).alias("parent_conv_id"), F.lag("id").over(along).alias("_up"))
    light = above.select("*", ((F.col("depth") > 0) & (F.col("_h") != F.col("conv_id"))).alias("light"))
    whole = Window.partitionBy("path")
    placed = light.select("*", F.coalesce(F.max(F.when(F.col("light"), F.col("depth"))).over(whole), F.lit(0)).alias("head"), F.sum(F.col("light").cast("int")).over(whole).cast("int").alias("level"))
    own = (F.col("n_convs") - 1) * F.col("words")
    return placed.where("depth >= head").select(
        "path", "level", "depth", "id", "conv_id", "parent_conv_id", F.when((F.col("depth") == F.col("head")) & (F.col("depth") > 0), F.col("_up")).alias("up"),
        "n_convs", "n_children", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), own.alias("saved_tokens"),
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to one row for each node of the trie of rebuilt conversations."""
    chain = materialize(chains(turns), "chain")
    known = materialize(facts(chain), "known")
    paths = materialize(heavy_paths(chain, known), "paths", by="level")
    ends = materialize(end_digests(chain), "ends")
    discard(chain)
    discard(known)
    deepest = paths.agg(F.max("level")).first()[0]
    if deepest is None:
        discard(paths)
        discard(ends)
        return paths.select("conv_id", F.col("depth").cast("bigint"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.lit(_EMPTY).alias("ends_sha256")).limit(0)
    suffix = Window.partitionBy("path").orderBy(F.desc("depth"))
    done, hung = [], None
    for level in range(deepest, -1, -1):
        here = paths.where(F.col("level") == level)
        if hung is not None:
            here = here.join(hung, F.col("id") == F.col("_id"), "left")
            for c in ("n_leaves", "saved_tokens"):
                here = here.withColumn(c, F.col(c) + F.coalesce(f"_{c}", F.lit(0)))
        summed = here.select(
            "id", "up", "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children",
            F.sum("n_leaves").over(suffix).alias("n_leaves"), F.sum("saved_tokens").over(suffix).alias("saved_tokens"),
        )
        done.append(materialize(summed, "summed"))
        hung = done[-1].where("up is not null").groupBy(F.col("up").alias("_id")).agg(F.sum("n_leaves").alias("_n_leaves"), F.sum("saved_tokens").alias("_saved_tokens"))
    discard(paths)
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    ended = ends.select(F.col("id").alias("_id"), "ends_sha256")
    return nodes.join(ended, F.col("id") == F.col("_id"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = rf"""
with k as (
  select conv_id, conv_id - conv_id % 20 as block, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words, turn from conversations where conv_id is not null),
t as (select *, row_number() over (partition by conv_id order by turn nulls first, digest) as nth from k),
c as (select conv_id, conv_id - conv_id % 20 as block, {crc32_sql('s')} % 4 as h from (select distinct conv_id, conv_id::varchar as s from k)),
r as (
  select c.conv_id, t.nth, 0 as part, t.digest, t.words from c join t on t.conv_id = c.block and t.nth <= c.h
  union all select c.conv_id, t.nth, 1, t.digest, t.words from c join t on t.conv_id = c.conv_id and t.nth > c.h),
n as (select *, row_number() over (partition by conv_id order by part, nth) as depth from r),
chain as (
  select conv_id, depth, string_agg(digest, '') over (partition by conv_id order by depth) as id, words, depth = count(*) over (partition by conv_id) as ended from n
  union all select conv_id, 0, '', 0, conv_id not in (select conv_id from n) from c),
node as (
  select id, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ended), '')) as ends_sha256
  from chain group by id),
kids as (select m.id as parent, count(*) as n_children from node v join chain m on m.conv_id = v.conv_id and m.depth = v.depth - 1 group by 1),
f as (select node.*, coalesce(n_children, 0) as n_children from node left join kids on kids.parent = node.id),
sums as (
  select m.id, count(*) filter (v.n_children = 0) as n_leaves, sum((v.n_convs - 1) * v.words)::bigint as saved_tokens
  from f v join chain m on m.conv_id = v.conv_id and m.depth <= v.depth group by 1)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from f join sums using (id) left join (select m.conv_id as child, m.depth, node.conv_id from chain m join node using (id)) p on p.child = f.conv_id and p.depth = f.depth - 1
"""
