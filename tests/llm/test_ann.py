"""Nearest neighbours against brute force: scores exact, order exact, recall 0.9 or more."""

import math
from collections import defaultdict

import numpy as np

from talonscan.llm import ann


def recall(rows, vectors, every):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], float)
    got = defaultdict(list)
    for r in rows:
        got[r.query_id].append(r)
    asked = [i for i in ids if i % every == 0]
    assert set(got) == set(asked)
    hit = total = 0
    for q in asked:
        s = m @ np.array(vectors[q], float)
        order = [ids[k] for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(order) + 1))
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(mine, mine[1:]))
        for r in mine:
            assert math.isclose(r.score, float(np.dot(vectors[q], vectors[r.vec_id])), rel_tol=1e-9, abs_tol=1e-12)
        hit += len({r.vec_id for r in mine} & set(order))
        total += len(order)
    return hit / total


def test_op9(spark):
    folder = "/root/testdata/sf0.01"
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    assert recall(ann.op9_ann(spark, folder).collect(), vectors, 20) >= 0.9


def test_larger(spark):
    folder = "/root/testdata/sf0.1"
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    assert recall(ann.op9_ann(spark, folder).collect(), vectors, 20) >= 0.9


def test_edges(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0])]
    rows += [(i, [1.0, 2.0]) for i in range(10, 50)] + [(i, [float(i), 1.0]) for i in range(50, 55)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest(df, lambda i: i % 10 == 0).collect()
    by = defaultdict(list)
    for r in out:
        by[r.query_id].append(r)
    assert set(by) == {10, 20, 30, 40, 50}
    assert all(len(v) == 20 for v in by.values())
    assert [r.vec_id for r in sorted(by[20], key=lambda r: r.rank)] == [54, 53, 52, 51, 50, *[i for i in range(10, 26) if i != 20]]
    assert ann.nearest(df.where("vec_id < 6"), lambda i: i % 10 == 0).count() == 0
    assert [r.vec_id for r in ann.nearest(df.where("vec_id in (50, 51)"), lambda i: i % 10 == 0).collect()] == [51]


def table_of(spark, m):
    return spark.createDataFrame([(i, x) for i, x in enumerate(m.tolist())], "vec_id long, embedding array<double>")


def test_mixed_norms(spark):
    """Long vectors beside tight clusters of short ones: recall holds, and every query has all its rows."""
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((20, 32))
    short = (centers[rng.integers(0, 20, 4000)] + 0.3 * rng.standard_normal((4000, 32))) * 5
    m = np.vstack([short, rng.standard_normal((40, 32)) * 60])[rng.permutation(4040)]
    out = ann.nearest(table_of(spark, m), lambda i: i % 20 == 0).collect()
    assert recall(out, dict(enumerate(m)), 20) >= 0.9


def test_lengths(spark):
    """Only the most frequent length takes part."""
    rows = [(i, [1.0, float(i)]) for i in range(6)] + [(i, [1.0, 2.0, 3.0]) for i in range(6, 10)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 2 == 0).collect()
    assert {r.query_id for r in out} == {0, 2, 4} and all(r.vec_id < 6 for r in out)


def test_repeated_ids(spark):
    """Rows that share an id and a vector: a query leaves out one row, itself."""
    rows = [(0, [1.0, 0.0])] * 2 + [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0).collect()
    assert sorted((r.rank, r.vec_id) for r in out) == [(1, 0), (1, 0), (2, 1), (2, 1), (3, 2), (3, 2)]
