"""Approximate nearest neighbours by largest inner product: NN-descent graph, greedy graph search.

Equal vectors are one node, and the graph has one row for each node: its vector and its neighbours. It starts from neighbours within
buckets of random hyperplanes and is refined by Spark joins: each node gathers its neighbours in both directions, and any two of them are
offered to each other. For the graph, vectors get one more component that makes all norms equal, so that inner product and distance agree.
A query walks the graph in rounds of joins, expanding the best ``EXPAND`` nodes not yet expanded until the best ``BEAM`` are all
expanded. It starts from its own node and from ``2 * ENTRIES`` others, scored in full: the longest vectors, which the largest
inner products favour and which the graph links badly where norms differ much, and some of each of ``SHELLS`` ranges of norm.
These entries and each node's starting edges to the best of them are a bounded sample; every row is indexed, and recall against brute force is tested (0.9 or more).

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, and, where lengths differ,
those not of the most frequent length (of these the longest); equal scores go to
the smaller id; repeated rows are candidates each; other columns are ignored; an empty table gives no rows.
Copies of one vector are cut to as many as a result can hold before they are shuffled; joins on a vector or node are left to
Spark's skew join. Every round is one written table, and the one before is removed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talonscan.llm.common import complete_groups, discard, materialize, table

DEGREE = 40
REVERSE = 40
ROUNDS = 4
SETTLED = 0.05
TABLES = 4
BUCKET = 400
BEAM = 160
EXPAND = 40
WALK = 16
ENTRIES = 256
SHELLS = 16
GRAPH = "node bigint, vec binary, nbr array<bigint>, score array<double>, fresh array<boolean>"
STATE = "query bigint, qvec binary, ids array<bigint>, scores array<double>, done array<boolean>"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    e = F.col(column)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.where(e.isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column) -> np.ndarray:
    """Binary column of little-endian doubles to a matrix."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(chunk.to_pylist()), "<f8").reshape(len(chunk), -1)


def _to_binary(vectors: DataFrame) -> DataFrame:
    """(id, embedding) to (id, vec binary, norm2)."""

    def run(batches):
        for b in batches:
            rows = [np.array(x, "<f8") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([float(r @ r) for r in rows], pa.float64())], ["id", "vec", "norm2"])

    return vectors.mapInArrow(run, "id bigint, vec binary, norm2 double")


def _starts(key: np.ndarray) -> np.ndarray:
    """Where groups of a sorted key begin, and its end."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))


def _lists(group: np.ndarray, groups: int, *columns):
    """Values in order of their group to one list array for each column."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(group, minlength=groups))]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def _flat(t: pa.Table, k: int):
    """Values of a list column and the row of each."""
    column = t.column(k).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _top(group: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best of each group, in order; ties to the smaller other."""
    order = np.lexsort((other, -score, group))
    g = group[order]
    begin = _starts(g)[:-1] if len(g) else np.zeros(0, np.int64)
    nth = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return order[nth < k]


def _once(group: np.ndarray, other: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Indexes of distinct (group, other), those not late first."""
    order = np.lexsort((late, other, group))
    g, o = group[order], other[order]
    return order[np.concatenate([[True], (g[1:] != g[:-1]) | (o[1:] != o[:-1])])] if len(order) else order


def _augment(m: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([m, np.sqrt(np.maximum(top - (m * m).sum(1), 0))[:, None]])


def entry_nodes(nodes: DataFrame, entries: int = ENTRIES, shells: int = SHELLS) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of at most 2 * entries nodes: the longest, and as many over ranges of norm."""
    longest = nodes.select("node", "vec", "norm2").orderBy(F.desc("norm2"), "node").limit(entries).collect()
    edges = nodes.agg(F.percentile_approx("norm2", [i / shells for i in range(1, shells)])).first()[0] or []
    shell = sum((F.when(F.col("norm2") > e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    w = Window.partitionBy("_s").orderBy(F.xxhash64("node"), "node")
    some = nodes.select("node", "vec", shell.alias("_s")).withColumn("_n", F.row_number().over(w)).where(f"_n <= {max(entries // shells, 1)}").collect()
    found = {r.node: bytes(r.vec) for r in [*longest, *some]}
    ids = np.array(sorted(found), np.int64)
    return ids, np.frombuffer(b"".join(found[i] for i in ids.tolist()), "<f8").reshape(len(ids), -1)


def _in_buckets(nodes: DataFrame, n: int, top: float, degree: int, entries) -> DataFrame:
    """Starting edges (node, nbr array, score array): best neighbours within hyperplane buckets of bounded size, and the best few entries."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / (BUCKET / 2))))
    entry_ids, entry_vecs = entries

    def code(batches):
        for b in batches:
            m = _matrix(b.column(1))
            for t in range(TABLES):
                planes = np.random.default_rng(1000 + t).standard_normal((m.shape[1], bits))
                value = ((m @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64) if bits else np.zeros(len(m), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value * TABLES + t), b.column(0), b.column(1)], ["bucket", "node", "vec"])

    def solve(t):
        bucket, node = t.column(0).to_numpy(), t.column(1).to_numpy()
        m = _augment(_matrix(t.column(2)), top)
        edges = _starts(bucket)
        for a, b in zip(edges[:-1], edges[1:]):
            for lo in range(a, b, 2048):  # a bucket is at most a few times BUCKET
                hi = min(b, lo + 2048)
                if hi - lo < 2:
                    continue
                s = m[lo:hi] @ m[lo:hi].T
                np.fill_diagonal(s, -np.inf)
                k = min(degree, hi - lo - 1)
                nb = np.argpartition(-s, k - 1, axis=1)[:, :k]
                group = np.repeat(np.arange(hi - lo), k)
                yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi]), *_lists(group, hi - lo, node[lo:hi][nb].ravel(), np.take_along_axis(s, nb, 1).ravel())], ["node", "nbr", "score"])

    def first(batches):
        e = _augment(entry_vecs, top)
        k = min(4, len(e))
        for b in batches:
            s = _augment(_matrix(b.column(1)), top) @ e.T
            node = b.column(0).to_numpy(zero_copy_only=False)
            s[node[:, None] == entry_ids[None, :]] = -np.inf
            nb = np.argpartition(-s, k - 1, axis=1)[:, :k]
            own, best = np.take_along_axis(s, nb, 1).ravel(), entry_ids[nb].ravel()
            group, fine = np.repeat(np.arange(len(node)), k), np.isfinite(own)
            yield pa.RecordBatch.from_arrays([b.column(0), *_lists(group[fine], len(node), best[fine], own[fine])], ["node", "nbr", "score"])

    coded = nodes.select("node", "vec").mapInArrow(code, "bucket bigint, node bigint, vec binary")
    large = coded.groupBy(F.col("bucket").alias("_b")).agg(F.count("*").alias("n")).where(f"n > {BUCKET}")
    dealt = coded.join(large, F.col("bucket") == F.col("_b"), "left").select(
        F.xxhash64("bucket", F.pmod(F.xxhash64("node", "bucket"), F.coalesce(F.ceil(F.col("n") / BUCKET), F.lit(1)))).alias("bucket"), "node", "vec"
    )
    edge = "node bigint, nbr array<bigint>, score array<double>"
    found = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda x: complete_groups(x, 5000, solve), edge)
    return found.unionByName(nodes.select("node", "vec").mapInArrow(first, edge))


def _merged(graph: DataFrame, offers: DataFrame, degree: int) -> DataFrame:
    """GRAPH rows and offers (node, nbr, score) to GRAPH rows: the best ``degree`` of both, fresh where offered anew."""

    def solve(t):
        node = t.column(0).to_numpy()
        begin = _starts(node)[:-1]
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(node))))
        base = t.column(1).is_valid().to_numpy()
        nbr, row = _flat(t, 2)
        score, _ = _flat(t, 3)
        late = ~base[row]
        g = group[row]
        keep = _once(g, nbr, late)
        keep = keep[_top(g[keep], score[keep], nbr[keep], degree)]
        vecs = t.column(1).take(pa.array(np.flatnonzero(base)))  # each group has one base row
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[begin]), vecs.combine_chunks(), *_lists(g[keep], len(begin), nbr[keep], score[keep], late[keep])], ["node", "vec", "nbr", "score", "fresh"]
        )

    rows = graph.select("node", "vec", "nbr", "score").unionByName(offers.select("node", F.lit(None).cast("binary").alias("vec"), "nbr", "score"))
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(lambda x: complete_groups(x, 5000, solve), GRAPH)


def _backward(graph: DataFrame, order) -> DataFrame:
    """(pivot, member, fresh): up to REVERSE nodes that have the pivot as a neighbour."""
    edges = graph.select("node", F.explode(F.arrays_zip("nbr", "score", "fresh")).alias("e")).select(F.col("e.nbr").alias("pivot"), F.col("node").alias("member"), "e.score", "e.fresh")
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy("pivot").orderBy(*order))).where(f"_n <= {REVERSE}").select("pivot", "member", "fresh")


def _descend(graph: DataFrame, top: float) -> DataFrame:
    """Offers (node, nbr array, score array) that are better than a node's worst neighbour, from neighbours of neighbours."""
    ahead = graph.select(F.col("node").alias("pivot"), F.explode(F.arrays_zip("nbr", "fresh")).alias("e")).select("pivot", F.col("e.nbr").alias("member"), "e.fresh")
    members = ahead.unionByName(_backward(graph, [F.desc("fresh"), F.xxhash64("member", "pivot")]))
    worst = F.when(F.size("nbr") >= DEGREE, F.array_min("score")).otherwise(F.lit(float("-inf")))
    state = graph.select(F.col("node").alias("_m"), "vec", worst.alias("worst"))
    full = members.join(state, F.col("member") == F.col("_m")).select("pivot", "member", "fresh", "worst", "vec")

    def solve(t):
        pivot, member = t.column(0).to_numpy(), t.column(1).to_numpy()
        once = _once(pivot, member, ~t.column(2).to_numpy())
        pivot, member = pivot[once], member[once]
        fresh, worst_ = t.column(2).to_numpy()[once], t.column(3).to_numpy()[once]
        m = _augment(_matrix(t.column(4))[once], top)
        edges = _starts(pivot)
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            f = fresh[a:b]
            if b - a < 2 or not f.any():
                continue
            s = m[a:b] @ m[a:b].T
            good = (s > worst_[a:b, None]) & (f[:, None] | f[None, :])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            out.append((member[a:b][i], member[a:b][j], s[i, j]))
        if out:
            u, w, s = (np.concatenate(x) for x in zip(*out))
            keep = _once(u, w, np.zeros(len(u), bool))
            keep = keep[_top(u[keep], s[keep], w[keep], DEGREE)]
            node, group = np.unique(u[keep], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(node), *_lists(group, len(node), w[keep], s[keep])], ["node", "nbr", "score"])

    sorted_ = full.repartition("pivot").sortWithinPartitions("pivot")
    return sorted_.mapInArrow(lambda x: complete_groups(x, 10_000, solve), "node bigint, nbr array<bigint>, score array<double>")


def build_graph(nodes: DataFrame, entries, degree: int = DEGREE) -> DataFrame:
    """(node, vec, norm2) with distinct vectors to the neighbour graph, GRAPH rows."""
    n, top = nodes.agg(F.count("*"), F.max("norm2")).first()
    bare = nodes.select("node", "vec", F.array().cast("array<bigint>").alias("nbr"), F.array().cast("array<double>").alias("score"))
    graph = materialize(_merged(bare, _in_buckets(nodes, n, top, degree, entries), degree), "graph")
    for _ in range(ROUNDS):
        old, graph = graph, materialize(_merged(graph, _descend(graph, top), degree), "graph")
        discard(old)
        fresh = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0]
        if fresh <= SETTLED * degree * n:
            break
    return graph


def _best_first(group: np.ndarray, groups: int, key: np.ndarray, qvecs, ids, scores, done, beam: int) -> pa.RecordBatch:
    keep = _top(group, scores, ids, beam)
    return pa.RecordBatch.from_arrays([pa.array(key), qvecs, *_lists(group[keep], groups, ids[keep], scores[keep], done[keep])], ["query", "qvec", "ids", "scores", "done"])


def _starting(queries: DataFrame, entries, beam: int) -> DataFrame:
    """(query, qvec) to STATE rows: the own node and the entries."""
    entry_ids, entry_vecs = entries

    def run(batches):
        for b in batches:
            q, own = _matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
            ids = np.hstack([np.tile(entry_ids, (len(own), 1)), own[:, None]])
            s = np.hstack([np.einsum("ij,kj->ik", q, entry_vecs), np.einsum("ij,ij->i", q, q)[:, None]])
            fine = np.hstack([entry_ids[None, :] != own[:, None], np.ones((len(own), 1), bool)]).ravel()
            group = np.repeat(np.arange(len(own)), ids.shape[1])[fine]
            ids, s = ids.ravel()[fine], s.ravel()[fine]
            yield _best_first(group, len(own), own, b.column(1), ids, s, np.zeros(len(ids), bool), beam)

    return queries.mapInArrow(run, STATE)


def _walk(state: DataFrame, graph: DataFrame, beam: int, expand: int) -> DataFrame:
    """One round: expands the best ``expand`` nodes of each query that are not expanded yet."""
    open_ = F.filter(F.arrays_zip("ids", "done"), lambda x: ~x["done"])
    front = state.select("query", F.explode(F.slice(F.transform(open_, lambda x: x["ids"]), 1, expand)).alias("at"))
    near = front.join(graph, F.col("at") == F.col("node")).select("query", F.lit(False).alias("base"), "ways")

    def unseen(t):
        query, base = t.column(0).to_numpy(), t.column(1).to_numpy()
        other, row = _flat(t, 2)
        keep = _once(query[row], other, ~base[row])
        keep = keep[~base[row[keep]]]
        yield pa.RecordBatch.from_arrays([pa.array(query[row[keep]]), pa.array(other[keep])], ["query", "nbr"])

    rows = near.unionByName(state.select("query", F.lit(True).alias("base"), F.col("ids").alias("ways")))
    new = rows.repartition("query").sortWithinPartitions("query").mapInArrow(lambda x: complete_groups(x, 5000, unseen), "query bigint, nbr bigint")
    vecs = new.join(graph, F.col("nbr") == F.col("node")).select("query", "nbr", "vec")

    def solve(t):
        query = t.column(0).to_numpy()
        begin = _starts(query)[:-1]
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(query))))
        base = t.column(1).is_valid().to_numpy()
        pair = np.flatnonzero(~base)
        qvecs = t.column(1).take(pa.array(np.flatnonzero(base))).combine_chunks()
        ids, row = _flat(t, 2)
        scores, done = _flat(t, 3)[0], _flat(t, 4)[0].astype(bool)
        opened = np.cumsum(~done)
        first = np.searchsorted(row, np.arange(len(query)))
        before = np.concatenate([[0], opened])[first[row]]
        done = done | (opened - before <= expand)
        nbr = t.column(5).combine_chunks().take(pa.array(pair)).to_numpy()
        made = np.einsum("ij,ij->i", _matrix(t.column(6).take(pa.array(pair))), _matrix(qvecs)[group[pair]]) if len(pair) else np.zeros(0)
        yield _best_first(
            np.concatenate([group[row], group[pair]]), len(begin), query[begin], qvecs,
            np.concatenate([ids, nbr]), np.concatenate([scores, made]), np.concatenate([done, np.zeros(len(pair), bool)]), beam,
        )

    none = lambda kind: F.lit(None).cast(kind)
    old = state.select("query", "qvec", "ids", "scores", "done", none("bigint").alias("nbr"), none("binary").alias("vec"))
    pairs = vecs.select("query", none("binary").alias("qvec"), none("array<bigint>").alias("ids"), none("array<double>").alias("scores"), none("array<boolean>").alias("done"), "nbr", "vec")
    return old.unionByName(pairs).repartition("query").sortWithinPartitions("query").mapInArrow(lambda x: complete_groups(x, 10_000, solve), STATE)


def search(graph: DataFrame, queries: DataFrame, entries, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """Greedy search for queries (query, qvec). Returns STATE rows: the best ``beam`` found of each, best first."""
    back = _backward(graph, [F.desc("score"), "member"]).groupBy(F.col("pivot").alias("_to")).agg(F.collect_list("member").alias("back"))
    none = F.array().cast("array<bigint>")
    ways = materialize(graph.join(back, F.col("node") == F.col("_to"), "left").select("node", "vec", F.array_union("nbr", F.coalesce("back", none)).alias("ways")), "ways")
    state = materialize(_starting(queries, entries, beam), "beam")
    for _ in range(WALK):
        old, state = state, materialize(_walk(state, ways, beam, expand), "beam")
        discard(old)
        if not state.where(F.exists("done", lambda x: ~x)).limit(1).count():
            break
    return state


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """vectors (vec_id, embedding); rows where the column is_query holds search all others.

    Returns (query_id, rank, vec_id, score).
    """
    rows = usable(vectors.select("vec_id", "embedding")).where("vec_id is not null")
    lengths = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("embedding") == lengths[0]["size"])
    rows = materialize(_to_binary(rows.select(F.col("vec_id").alias("id"), "embedding")), "vectors")
    # equal vectors are one node, named by the smallest id; only its k + 1 smallest ids can be among k nearest, and each task sends no more
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(f"_n <= {k + 1}")
    nodes = materialize(few.groupBy("vec").agg(F.min("id").alias("node"), F.first("norm2").alias("norm2"), F.sort_array(F.collect_list("id")).alias("copies")), "nodes")
    entries = entry_nodes(nodes)
    graph = build_graph(nodes, entries)
    asking = rows.where(is_query(F.col("id"))).select("id", "vec")
    queries = materialize(asking.select("vec").distinct().join(nodes, "vec").select(F.col("node").alias("query"), F.col("vec").alias("qvec")), "queries")
    found = search(graph, queries, entries, max(BEAM, 2 * k))
    best = found.select("query", "qvec", F.explode(F.slice(F.arrays_zip("ids", "scores"), 1, k + 1)).alias("e")).select("query", "qvec", F.col("e.ids").alias("at"), F.col("e.scores").alias("score"))
    several = nodes.where(F.size("copies") > 1).select("node", "copies")
    hits = best.join(several, F.col("at") == F.col("node"), "left").select("query", "qvec", F.explode(F.coalesce("copies", F.array("at"))).alias("vec_id"), "score")
    # at most (k + 1)^2 hits of a query
    listed = hits.groupBy("qvec").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("below"), "vec_id", "score"))), 1, k + 1).alias("hits"))
    answers = materialize(listed, "answers")
    own = F.array_position(F.transform("hits", lambda h: h["vec_id"]), F.col("id"))
    # of rows with one id, the query leaves out one: itself
    others = F.slice(F.filter("hits", lambda h, i: (own == 0) | (i != own - 1)), 1, k)
    ranked = asking.join(answers, F.col("vec") == F.col("qvec")).select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "h"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
