"""Centroid clustering against plain integers in Python."""
import hashlib
import math
import random

import numpy as np
import pytest

from kinsift.llm import centroid_clusters as cc


def plain(rows, k, rounds, size, scale=256):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        centroids = [c if not (own := [v for (_, v), (a, _) in zip(kept, found) if a == j]) else [sum(col) // len(own) for col in zip(*own)]
                     for j, c in enumerate(centroids)]
    found = assign()
    per = {j: sum(d for a, d in found if a == j) for j in range(len(centroids))}
    return sorted(((i, a, d, per[a], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[a])).encode()).hexdigest())
                   for (i, _), (a, d) in zip(kept, found)), key=str)


def got(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, data string").repartition(3)
    return sorted((tuple(r) for r in cc.cluster(df, **kwargs).collect()), key=str)


def vectors(n, size, seed, groups=6):
    draw = random.Random(seed)
    middles = [[draw.uniform(-1, 1) for _ in range(size)] for _ in range(groups)]
    return [(i, [x + draw.gauss(0, 0.2) for x in draw.choice(middles)]) for i in range(n)]


def test_same_as_plain(spark):
    rows = vectors(400, 8, 1) + [(7, [0.25] * 8)] * 90 + [(None, [0.5] * 8), (3, [0.1] * 8)]
    rows += [(900, None), (901, []), (902, [0.1] * 7), (903, [0.1] * 7 + [None]), (904, [0.1] * 7 + [float("nan")]), (905, [float("-inf")] + [0.0] * 7)]
    assert got(spark, rows, k=7, rounds=4, size=8, block=16) == plain(rows, 7, 4, 8)


def test_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(6)]
    assert got(spark, rows, k=10, rounds=2, size=2) == plain(rows, 10, 2, 2)
    assert got(spark, [], k=10, size=2) == []
    assert got(spark, [(1, [1.0])], size=2) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 400_000 for x in v]) for i, v in vectors(60, 4, 5)]
    rows = [(i, [max(-500_000.0, min(500_000.0, x)) for x in v]) for i, v in rows]
    assert got(spark, rows, k=5, rounds=3, size=4, block=8) == plain(rows, 5, 3, 4)
    held = got(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0])], k=1, rounds=1, size=2)
    assert [r[2] for r in held] == [cc.LARGEST ** 2] * 2


def test_boxes_leave_out_only_what_cannot_be_nearest():
    draw = np.random.default_rng(3)
    skipped = 0
    for _ in range(200):
        x, c = draw.integers(-40, 40, (30, 3)) // draw.integers(1, 8), draw.integers(-40, 40, (12, 3))
        low, high = x.min(0), x.max(0)
        some = cc.possible(low, high, c)
        whole = ((x[:, None] - c[None]) ** 2).sum(2)
        assert set(whole.argmin(1)) <= set(some)
        at, distance = cc.nearest(x, low, high, c)
        assert (at == whole.argmin(1)).all() and (distance == whole.min(1)).all()
        skipped += len(c) - len(some)
    assert skipped > 800


@pytest.mark.parametrize("axes, bits", [(2, 3), (3, 2)])
def test_hilbert_visits_neighbours(axes, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * axes, indexing="ij"), -1).reshape(-1, axes)
    place = cc.hilbert(cells, bits)
    assert sorted(place) == list(range(side ** axes))
    walked = cells[np.argsort(place)]
    assert (np.abs(np.diff(walked, axis=0)).sum(1) == 1).all()
