"""Exact top-k search and hard-negative mining against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, difference
from lexigrain.llm import hardnegatives, topk, vectors

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, score string"


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_exact_top_k"])
def test_registered_query_equals_duckdb(spark, name):
    assert name in entry.oracle_sql()
    assert difference(spark, connect(FOLDER), name, FOLDER) is None


def whole(row):
    v = row[1]
    return row[0] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)


def integers(v):
    return [math.floor(256 * x) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, k):
    rows = [(r[0], integers(r[1])) for r in rows if whole(r)]
    out = []
    for q, v in rows:
        if q % 50 == 0:
            scored = sorted((-dot(v, w), c) for c, w in rows if c != q and len(w) == len(v))
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def brute_negatives(rows, k=5, m=3):
    rows = [(r[0], integers(r[1]), r[2]) for r in rows if whole(r) and r[2] is not None]
    out = []
    for a, v, label in rows:
        if a % 50:
            continue
        others = [(-dot(v, w), c, l) for c, w, l in rows if c != a and len(w) == len(v)]
        for s, p, _ in sorted(o for o in others if o[2] == label)[:k]:
            fitting = sorted(o for o in others if o[2] != label and 50 * -s <= 100 * -o[0] <= 95 * -s)
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fitting[:m], 1)]
    return sorted(out)


def clustered(n, seed, copies=0):
    """Vectors around few centres, some of them equal, over few labels."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, 8))
    own = draw.integers(0, 6, n)
    points = centres[own] + draw.normal(size=(n, 8)) * 0.4
    points[:copies] = centres[0]
    order = draw.permutation(n)
    label = np.where(draw.random(n) < 0.3, draw.integers(0, 3, n), own % 3)
    return [(int(i), points[j].tolist(), int(label[j]), "x") for i, j in enumerate(order)]


def found_top(spark, rows, k=5, **options):
    df = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k, **options)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in df.collect())


def found_negatives(spark, rows, **options):
    df = hardnegatives.mine_hard_negatives(
        spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, F.col("label"), **options
    )
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shard_rows, block_rows", [(16_384, 16_384), (150, 4)])
def test_top_k_equals_brute_force(spark, shard_rows, block_rows):
    rows = clustered(700, 1, copies=250)  # a third of all vectors are equal: ties by id
    assert found_top(spark, rows, shard_rows=shard_rows, block_rows=block_rows, leaf_rows=16) == brute_top(rows, 5)


@pytest.mark.parametrize("shard_rows, block_rows", [(16_384, 16_384), (150, 4)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, shard_rows, block_rows):
    rows = clustered(700, 2, copies=250)
    expected = brute_negatives(rows)
    assert expected
    assert found_negatives(spark, rows, shard_rows=shard_rows, block_rows=block_rows) == expected


ODD = [
    (0, [1.0, 2.0], 1, "x"),
    (0, [1.0, 2.0], 1, "x"),  # repeated row: a query and a candidate of its own
    (None, [9.0, 9.0], 1, "x"),
    (1, None, 1, "x"),
    (2, [1.0, None], 1, "x"),
    (3, [1.0, float("nan")], 1, "x"),
    (4, [float("inf"), 1.0], 1, "x"),
    (5, [], 1, "x"),
    (50, [], 2, "x"),  # vectors without components score 0
    (6, [1.0, 2.0, 3.0], 2, "x"),  # met by vectors of three components only
    (100, [1.0, 2.0, 2.0], 2, "x"),
    (7, [0.7, 1.4], 2, "x"),
    (8, [0.6, 1.2], None, "x"),
    (9, [1.0, 2.0], 1, "x"),
    (10, [1.0, 2.0], 1, "x"),
    (10, [0.6, 1.4], 2, "x"),
    (150, [-1.0, -2.0], 2, "x"),
]


def test_odd_rows(spark):
    assert found_top(spark, ODD) == brute_top(ODD, 5)
    assert found_negatives(spark, ODD) == brute_negatives(ODD)


def test_large_components_are_exact(spark):
    big = [
        (0, [5e6, -3e6], 1, "x"),
        (1, [5e6 + 1, -3e6], 1, "x"),
        (2, [3e6, -3e6 + 0.5], 2, "x"),
        (3, [1e5, 3.0], 2, "x"),
    ]
    assert found_top(spark, big) == brute_top(big, 5)
    assert found_negatives(spark, big) == brute_negatives(big)
    # Scores beyond 64 bits are held at the end of the range.
    huge = [(0, [1e30, 0.0], 1, "x"), (1, [1e30, 0.0], 1, "x"), (2, [-1e30, 0.0], 1, "x"), (3, [1e307, 0.0], 1, "x")]
    last = (1 << 63) - 1
    assert found_top(spark, huge, k=2) == [(0, 1, 1, last), (0, 2, 2, -last)]


def test_empty_table_and_single_rows(spark):
    assert found_top(spark, []) == [] and found_negatives(spark, []) == []
    assert found_top(spark, ODD[:1]) == [] and found_negatives(spark, ODD[:1]) == []


def test_balls_hold_their_points_and_bound_scores():
    draw = np.random.default_rng(3)
    points = np.floor(draw.normal(size=(900, 6)) * 100)
    tree = topk.BallTree(points, 32)
    assert sorted(np.concatenate(tree.rows).tolist()) == list(range(900)) and max(map(len, tree.rows)) <= 32
    queries = np.floor(draw.normal(size=(20, 6)) * 100)
    bound = tree.bounds(len(tree.levels) - 1, queries, np.sqrt((queries**2).sum(axis=1)))
    for leaf, rows in enumerate(tree.rows):
        assert (vectors.products(queries, points[rows]) <= bound[:, leaf][:, None]).all()


def test_shared_bound_opens_fewer_leaves(monkeypatch):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(8, 16)) * 300
    points = np.floor(np.repeat(centres, 200, axis=0) + draw.normal(size=(1600, 16)))
    ids = np.arange(1600)
    tree = topk.BallTree(points, 16)
    opened = []
    real = topk._open
    monkeypatch.setattr(topk, "_open", lambda *a: (opened.append(len(a[-1])), real(*a))[1])
    best = topk._Best(ids[:20], np.full(20, -(1 << 63)), 5)
    topk.search(tree, points, ids, points[:20], best)
    assert sum(opened) < 20 * len(tree.rows) / 4  # branch and bound leaves most balls closed
    exact = vectors.products(points[:20], points)
    assert (best.kth == np.sort(np.where(np.eye(20, 1600, dtype=bool), -(1 << 62), exact), axis=1)[:, -5]).all()


def test_only_overlapping_candidates_are_scored_again():
    draw = np.random.default_rng(5)
    anchors = np.floor(draw.normal(size=16) * 200 + draw.normal(size=(40, 16)))
    points = np.floor(draw.normal(size=(2_000, 16)) * 100)
    exact = vectors.products(anchors, points)
    floor = np.sort(exact, axis=1)[:, -5]
    scored = 0

    def window(i, middle, reach):
        return middle + reach >= floor[i]

    for i, rows, scores in hardnegatives.scored_along_tree(anchors, points, window):
        assert (exact[i, rows] == scores).all()
        assert set(np.flatnonzero(exact[i] >= floor[i])) <= set(rows.tolist())
        scored += len(rows)
    assert scored < 40 * 2_000 / 10


def test_spanning_tree_is_minimal():
    draw = np.random.default_rng(6)
    points = draw.normal(size=(60, 3))
    tree = hardnegatives.spanning_tree(points)
    assert sorted(t[0] for t in tree) == list(range(60))
    away = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    edges = sorted((away[i, j], i, j) for i in range(60) for j in range(i))
    group, total = list(range(60)), 0.0
    for d, i, j in edges:  # joining the closest groups first
        a, b = group[i], group[j]
        if a != b:
            group = [a if g == b else g for g in group]
            total += d
    assert abs(sum(t[2] for t in tree) - total) < 1e-9
