"""Centroid clustering against plain integers in plain loops."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, point string, cluster string"


def brute(rows: list[tuple], k: int, rounds: int, width: int) -> list[tuple]:
    kept = [(i, v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()
    whole = [(i, [max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(256 * x))) for x in v]) for i, v in kept]
    centres = [list(whole[j][1]) for j in sorted(range(len(whole)), key=lambda j: (name(whole[j][0]), kept[j][1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in whole:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            centres[n] = [sum(column) // len(vs) for column in zip(*vs)]
    found = [(i, *near(v)) for i, v in whole]
    sums = {}
    for _, d, n in found:
        sums[n] = sums.get(n, 0) + d
    return [(i, n, d, sums[n], sum(sums.values()), ",".join(map(str, centres[n]))) for i, d, n in found]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("k,width,seed", [(5, 3, 1), (7, 8, 2), (40, 64, 3)])
def test_agrees_with_plain_loops(spark, k, width, seed):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.1) for m in rng.choice(middles)]) for i in range(150)]
    rows += [(200 + i, [round(rng.random() * 3) / 256 for _ in range(width)]) for i in range(60)]  # ties
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, rows[5][1]), (300, [0.0] * width), (301, [-0.0] * width)]
    rows += [(400, None), (401, []), (402, [0.5] * (width - 1)), (403, [None] + [0.5] * (width - 1)), (404, [math.nan] + [0.5] * (width - 1)),
             (405, [math.inf] + [0.5] * (width - 1))]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)
    got = centroids.cluster(df, k=k, rounds=3, width=width, pivots=4)
    assert in_order(got.collect()) == in_order(brute(rows, k, 3, width))


def test_large_components_are_held(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1e7, 1.0]), (4, [0.0, -3.1])]
    got = centroids.cluster(spark.createDataFrame([(i, v, 1, "", "") for i, v in rows], SCHEMA), k=2, rounds=1, width=2)
    assert in_order(got.collect()) == in_order(brute(rows, 2, 1, 2))


def test_few_vectors_and_none(spark):
    one = spark.createDataFrame([(9, [0.25] * 64, 1, "", "")], SCHEMA)
    assert [tuple(r) for r in centroids.cluster(one).collect()] == [(9, 0, 0, 0, 0, ",".join(["64"] * 64))]
    none = centroids.cluster(one.filter(F.lit(False)))
    assert none.collect() == [] and none.columns == centroids.cluster(one).columns


def test_pivots_spare_distances_and_lose_none():
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (40, 64))
    points = centres[rng.integers(0, 40, 2000)] + rng.integers(-30, 30, (2000, 64))
    pivots = centroids.farthest(points[:400], 12)
    best, distance, measured = centroids.nearest(points, centroids.roots(points, pivots), centres, centroids.roots(centres, pivots))
    every = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < 2000 * 40 / 4
