"""Hard negatives against all pairs."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score int, anchor string"


def brute(rows):
    part = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            part.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    def order(r):
        return -r[0], r[1] is None, r[1] or 0

    for a, label, v in part:
        if a is None or a % 100:
            continue
        mates = sorted(((score(v, w), i) for i, x, w in part if x == label and i != a), key=order)[:5]
        others = sorted(((score(v, w), i) for i, x, w in part if x != label), key=order)
        for ps, p in mates:
            for k, (ns, n) in enumerate([r for r in others if 30 * ps <= 100 * r[0] <= 90 * ps][:10]):
                out.append((a, p, k + 1, n, ps, ns))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = hard_negatives.mine(hard_negatives.participants(df), F.col("id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))


def clustered(seed, n, width):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, width)) / np.sqrt(width)
    at = draw.integers(0, 6, n)
    points = centres[at] + draw.normal(size=(n, width)) * 0.05
    return [(i, [float(x) for x in p], int((c + (draw.random() < 0.4)) % 3)) for i, (p, c) in enumerate(zip(points, at))]


@pytest.mark.parametrize("width", [8, 5])
def test_clusters(spark, monkeypatch, width):
    """Many groups per task and chunks per cell, several blocks of anchors."""
    monkeypatch.setattr(hard_negatives, "CHUNK", 20)
    monkeypatch.setattr(hard_negatives, "GROUP_BYTES", 4000)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 5)
    check(spark, clustered(width, 1200, width))


def test_ties_and_odd_rows(spark):
    """Copies, equal scores, nulls in every column, non-finite parts, other lengths, repeated ids and anchors."""
    draw = random.Random(3)
    rows = [(i, [draw.choice([0.0, 0.25, 0.5]) for _ in range(3)], draw.randrange(3)) for i in range(150)]
    rows += [(i, [0.5, 0.25, 0.5], 1) for i in range(200, 260)]
    rows += [(301, None, 1), (300, [0.1, None, 0.2], 1), (302, [1.0, float("nan"), 0.0], 1), (303, [float("inf"), 0.0, 0.0], 2), (304, [0.5, 0.5, 0.5], None),
             (None, [0.5, 0.5, 0.5], 1), (None, [0.5, 0.5, 0.5], 0), (305, [], 1), (306, [0.7], 0), (400, [], 2), (307, [0.5] * 5, 0)]
    rows += [(100, [0.25, 0.5, 0.25], 2), (100, [0.25, 0.5, 0.25], 2), (500, [-0.5, -0.5, 0.1], 0), (600, [0.0, 0.0, 0.0], 1)]
    check(spark, rows)


def test_nothing(spark):
    check(spark, [])
    check(spark, [(1, [1.0, 2.0], 1)])
    check(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)])
    check(spark, [(0, None, None)])


def test_large_components(spark):
    """Beyond what doubles hold exactly; beyond 64 bits there is an error and no wrong score."""
    rows = [(i, [float(np.float32(200_000.0 + 17 * i)), float(np.float32(3e5 + i * i)), -1e5], i % 2) for i in range(40)]
    check(spark, rows)
    with pytest.raises(ValueError, match="64 bits"):
        check(spark, [(0, [1e12, 1.0], 1)])


def test_walk_is_in_order_and_complete():
    draw = np.random.default_rng(4)
    books = draw.normal(size=(7, 3)), draw.normal(size=(5, 3))
    chunks = [{"a": a, "b": b, "n": 2, "ids": [0, 1], "labels": [0, 0], "vectors": np.round(np.concatenate([books[0][a], books[1][b]] * 2).reshape(2, 6) * 50).astype("<i2").tobytes()}
              for a in range(7) for b in range(5) if (a + b) % 4]
    group = hard_negatives._Group(chunks, books, 6, "<i2", True)
    q = draw.normal(size=6)
    seen = list(group.walk(q))
    assert len(seen) == len(chunks)
    assert [u for u, _, _ in seen] == sorted((u for u, _, _ in seen), reverse=True)
    for upper, lower, cell in seen:
        scores = np.concatenate([m @ q for m, _, _ in cell])
        assert lower <= scores.min() and scores.max() <= upper
    assert heapq.nlargest(1, seen)[0][0] == seen[0][0]
