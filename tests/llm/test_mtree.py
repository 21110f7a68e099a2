import math
import random

import numpy as np

from corpusloom.llm import mtree


def slow(rows, k):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        qv = min(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in ok if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * (3 if i % 7 else 0.1) for _ in range(6)], "x") for i in range(700)]
    rows += [(1000 + i, rows[3][1], "x") for i in range(300)]  # one vector repeated
    rows += [(None, [1.0] * 6, "x"), (2000, None, "x"), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (2100, [float("nan")] * 6, "x"), (2150, [float("inf")] * 6, "x"), (2200, [0.5], "x"), (2250, [], "x"), (100, rows[100][1], "x"), (2301, [-0.0] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, s string")
    for shard in (64, 4096):
        got = {tuple(r) for r in mtree.top_inner_products(df, shard=shard).collect()}
        assert got == slow([(i, v) for i, v, _ in rows], 5)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0, 2.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in mtree.top_inner_products(df).collect()} == slow([(0, [1.0, 2.0]), (50, [1.0, 2.0]), (3, [0.0, 0.0])], 5)
    assert mtree.top_inner_products(df.limit(0)).count() == 0
    assert mtree.top_inner_products(df.where("vec_id = 0")).count() == 0


def test_bounds_save_distances():
    rng = np.random.default_rng(0)
    c = rng.integers(-2000, 2000, (30, 8))
    x = (c[rng.integers(0, 30, 6000)] + rng.integers(-20, 20, (6000, 8))).astype(float)
    tree = mtree.MTree(x, np.arange(6000), float((x * x).sum(1).max()))
    done = [tree.search(x[i], i, 5)[1] for i in range(0, 6000, 100)]
    assert np.mean(done) < 3000


def test_scores_beyond_floats():
    p = np.array([[2.0**40, 1.0], [2.0**40, 2.0]])
    assert mtree.exact_products(p, np.array([2.0**20, 1.0])).tolist() == [2**60 + 1, 2**60 + 2]
    assert mtree.exact_products(p, np.array([2.0**30, 0.0])).tolist() == [2**63 - 1] * 2
