"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASH = SCHEMA + ", row int, v string, piece long, kind int, given string, anchor string, id string"


def brute(rows, anchor):
    some = [(k, i, [math.floor(256 * float(np.float32(x))) for x in v], label) for k, (i, v, label) in enumerate(rows) if v is not None and label is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    dot = lambda a, b: max(-N.LONG, min(N.LONG, sum(x * y for x, y in zip(a, b, strict=False))))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for k, i, v, label in some:
        if not anchor(i):
            continue
        scores = sorted(((dot(v, w), j, n, other) for n, j, w, other in some if n != k), key=order)
        for p, j, _, _ in [x for x in scores if x[3] == label][:5]:
            for rank, (s, m, _, _) in enumerate([x for x in scores if x[3] != label and 30 * p <= 100 * x[0] <= 90 * p][:10], 1):
                out.append((i, j, rank, m, p, s))
    return sorted(out, key=str)


def vectors(kind, n=400, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "even":
        x = rng.normal(size=(n, 16))
    elif kind == "clusters":
        x = rng.normal(size=(12, 16))[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * 0.02
    else:  # few different ones, so ties abound
        x = rng.integers(-1, 2, size=(n, 3))
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) * (1 if kind != "ties" else rng.integers(1, 3, size=(n, 1)))
    return [(k, [float(f) for f in v], int(rng.integers(0, 3)) if rng.random() < 0.7 else 0) for k, v in enumerate(x)]


def mined(df, every=10):
    out = N.mine_negatives(df, F.col("vec_id") % every == 0)
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("kind", ["even", "clusters", "ties"])
def test_mined(spark, kind):
    rows = vectors(kind)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows, lambda i: i % 10 == 0)


def test_messy_rows(spark):
    rows = vectors("clusters", 120)
    rows += [(None, rows[0][1], 1), (None, rows[0][1], 0), (130, None, 0), (140, rows[3][1], None), (150, [1.0, None], 0), (160, [float("nan")] * 16, 0), (170, [float("inf")] * 16, 1), (180, [], 0), (190, rows[5][1][:4], 1), rows[10], rows[10], rows[11], (200, [3e38] * 16, 0), (201, [-3e38, 2e38] * 8, 1), (202, [1e30] * 16, 0)]
    df = spark.createDataFrame([(*r, 1, "v", 2, 3, "g", "a", "i") for r in rows], CLASH).repartition(4)
    assert mined(df) == brute(rows, lambda i: i is not None and i % 10 == 0)


def test_nothing(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], SCHEMA)) == []


def test_several_pieces_and_small_leaves(spark, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 60)
    monkeypatch.setattr(N, "LEAF", 4)
    monkeypatch.setattr(N, "FEW", 1)
    rows = vectors("clusters", 500, 3)
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows, lambda i: i % 10 == 0)


def test_tree_covers_and_bounds_hold():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(20, 8))[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8)) * 0.05))
    tree = N.CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(3000)) and len(tree.centre) > 20
    for node in range(len(tree.centre)):
        mine = x[tree.order[tree.begin[node] : tree.end[node]]]
        for _ in range(3):
            q = np.floor(rng.normal(size=8) * 256)
            (high,), (low,) = tree.bounds(np.array([node]), q, float(np.linalg.norm(q)))
            assert low <= (mine @ q).min() and (mine @ q).max() <= high
        if tree.many[node]:
            below = range(tree.first[node], tree.first[node] + tree.many[node])
            assert [tree.begin[k] for k in below][0] == tree.begin[node] and sum(tree.end[k] - tree.begin[k] for k in below) == len(mine)


def test_search_skips_most_of_clustered_points():
    import pyarrow as pa

    rng = random.Random(2)
    g = np.random.default_rng(2)
    x = np.floor(256 * (g.normal(size=(50, 16))[g.integers(0, 50, 5000)] + g.normal(size=(5000, 16)) * 0.02))
    piece = N.Piece(x, np.arange(5000), pa.array(range(5000)), [rng.randrange(3) for _ in range(5000)])
    for k in range(20):
        piece.best(x[k], 0, False, k, [(-N.LONG, N.LONG)], 10)
    assert piece.scored < 20 * 5000 / 5
