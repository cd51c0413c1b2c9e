import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trainscope.llm import negatives as N

VECTORS = "vec_id long, embedding array<float>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(table, every, n_pos=5, n_neg=3, low=50, high=95, scale=256):
    good = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], label) for i, v, label in table
            if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, v, label in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, w, other in good if i != a and len(w) == len(v))
        for p, pid in [(-s, i) for s, i, other in scored if other == label][:n_pos]:
            fit = [(-s, i) for s, i, other in scored if other != label and low * p <= -100 * s <= high * p][:n_neg]
            out += [(a, pid, rank, i, p, s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def found(df, every, **limits):
    return sorted(tuple(r) for r in N.hard_negatives(df, F.col("vec_id") % every == 0, **limits).select(*COLUMNS).collect())


def near(seed, n, dim, centres, spread):
    """Vectors around a few centres, so that bounds of neighbours say something."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dim))
    return [(i, [float(np.float32(x)) for x in middle[rng.integers(centres)] + spread * rng.standard_normal(dim)], int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("seed,dim,spread,block", [(1, 8, 1.0, 512), (2, 8, 0.02, 16), (3, 3, 0.2, 7), (4, 16, 0.0, 512)])
def test_negatives_against_brute_force(spark, monkeypatch, seed, dim, spread, block):
    monkeypatch.setattr(N, "ANCHORS", block)
    table = near(seed, 900, dim, 6, spread)
    df = spark.createDataFrame(table, VECTORS).repartition(5)
    assert found(df, 10) == brute(table, 10)


def test_passes_and_other_limits(spark, monkeypatch):
    monkeypatch.setattr(N, "ANCHORS", 8)
    monkeypatch.setattr(N, "PASS_BYTES", 500)
    table = near(7, 400, 4, 3, 0.3)
    df = spark.createDataFrame(table, VECTORS).repartition(3)
    assert found(df, 9, positives=2, negatives=4, low=20, high=100) == brute(table, 9, 2, 4, 20, 100)


def test_ties_bad_rows_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    table = [(i, [0.5, 0.25], i % 2) for i in range(40)] + [(i, [0.4, 0.2], 1 - i % 2) for i in range(40, 90)]
    table += [(90, None, 0), (91, [nan, 1.0], 0), (92, [inf, 1.0], 0), (93, [None, 1.0], 0), (None, [0.5, 0.25], 0), (94, [0.5, 0.25], None)]
    table += [(20, [0.9, 0.1], 1), (20, [0.5, 0.25], 0), (51, [0.45, 0.2], 1), (51, [0.45, 0.2], 1), (60, [0.1, 0.2, 0.3], 0), (61, [0.3, 0.2, 0.1], 0),
              (62, [0.2, 0.2, 0.1], 1), (70, [], 1), (71, [], 0), (72, [], 1), (80, [-1.0, -1.0], 3), (81, [1.0, 1.0], 3)]
    df = spark.createDataFrame(table, VECTORS).withColumns({"score": F.lit("x"), "slot": F.lit(1), "q": F.lit(2), "rank": F.lit(3)})
    assert found(df, 10) == brute(table, 10)
    assert found(df.limit(0), 10) == [] and found(df.where("vec_id % 10 = 1"), 10) == []


def test_bounds_leave_pairs_unscored():
    """Along short edges only pairs whose bounds meet the window are scored."""
    rng = random.Random(3)
    base = np.array([rng.randrange(-200, 200) for _ in range(16)])
    vectors = np.array([base + [rng.randrange(2) for _ in range(16)] for _ in range(30)])
    parents, edges = N._spanning_tree(vectors)
    assert (parents[1:] >= 0).all() and parents[0] == -1 and edges.max() <= 4
    row = {"ids": np.arange(30).tobytes(), "labels": np.zeros(30, np.int64).tobytes(), "vectors": vectors.tobytes(), "dim": 16,
           "parents": parents.tobytes(), "edges": edges.tobytes()}
    tree = N.Tree(row)
    others = np.array([[rng.randrange(-200, 200) for _ in range(16)] for _ in range(400)])
    scored = 0

    exact = vectors @ others.T
    low, high = np.full(30, int(np.quantile(exact, 0.99))), np.full(30, 1 << 40)
    real = N._products
    try:
        def counted(a, b):
            nonlocal scored
            scored += len(a) * len(b)
            return real(a, b)
        N._products = counted
        got = [(a, r, s) for at, row_, score in tree.scores(np.arange(1000, 1400), np.ones(400, np.int64), others, low, high, False)
               for a, r, s in zip(at.tolist(), row_.tolist(), score.tolist())]
    finally:
        N._products = real
    want = [(a, r, int(exact[a, r])) for a, r in zip(*np.nonzero(exact >= low[:, None]))]
    assert sorted(got) == sorted(want) and scored < exact.size / 4
