"""Heap-ordered clustering against plain rounds that measure every vector."""

import heapq
import math
import random
from hashlib import sha256

import numpy as np
import pytest

from tutorgauge.llm import centroids


def plain_clusters(rows, k, rounds, dims, scale, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    place = lambda: [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
    for _ in range(rounds):
        own = place()
        groups = [[v for (_, v), o in zip(kept, own) if o == j] for j in range(len(c))]
        c = [[sum(col) // len(g) for col in zip(*g)] if g else c[j] for j, g in enumerate(groups)]
    own = place()
    d = [far(v, c[o]) for (_, v), o in zip(kept, own)]
    return sorted((str(i), o, x, sum(y for y, p in zip(d, own) if p == o), sum(d), tuple(c[o])) for (i, _), o, x in zip(kept, own, d))


def got(df):
    return sorted((str(r.id), r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, block string")


@pytest.mark.parametrize("scale", [16, 1024, 1 << 24])
def test_against_plain_rounds(spark, scale):
    draw = random.Random(scale)
    spots = [[draw.uniform(-1, 1) for _ in range(6)] for _ in range(9)]
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32(x + draw.gauss(0, 0.3) for x in draw.choice(spots))) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [rows[5]] * 4 + [(None, rows[9][1]), (3, f32([0.0] * 6))]
    odd = [(1, None), (2, []), (3, [1.0] * 5), (4, [1.0] * 5 + [None]), (5, [1.0] * 5 + [math.nan]), (6, [math.inf] + [0.0] * 5)]
    stats = []
    out = centroids.clustered(table(spark, rows + odd).repartition(5), k=5, rounds=7, dims=6, scale=scale, block=64, stats=stats)
    assert got(out) == plain_clusters(rows + odd, 5, 7, 6, scale)
    assert stats[0] == len(rows) and len(stats) == 8 and min(stats) < len(rows) / 3


def test_few_vectors_ties_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.5, 0.5]), (3, [0.5, 0.5])]
    assert got(centroids.clustered(table(spark, rows), dims=2)) == plain_clusters(rows, 8, 10, 2, 1024)
    assert got(centroids.clustered(table(spark, rows * 20), dims=2, k=3)) == plain_clusters(rows * 20, 3, 10, 2, 1024)
    empty = centroids.clustered(table(spark, [(1, None)]), dims=2)
    assert empty.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"] and empty.count() == 0
    assert centroids.clustered(table(spark, rows[:1]), dims=2).collect()[0].inertia == 0
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(table(spark, [(1, [1e9, 0.0])]), dims=2).collect()


def test_heaps_hold_their_order():
    draw = np.random.default_rng(1)
    heaps = centroids.Heaps.empty(3)
    drift = np.zeros(3)
    own = draw.integers(0, 3, 500)
    heaps.push(np.arange(500), own, draw.random(500), drift)
    for _ in range(5):
        drift = drift + [0.1, 0.0, 0.2]
        heaps = centroids.Heaps.of(*heaps.packed())
        places, of = heaps.pop(drift)
        assert all(own[p] == j for p, j in zip(places, of)) and 1 not in of
        for j in range(3):
            keys = heaps.keys[j].tolist()
            assert not keys or min(keys) > drift[j] + centroids.SLACK
            assert all(keys[(i - 1) // 2] <= keys[i] for i in range(1, len(keys)))
        heaps.push(places, of, np.full(len(places), 0.15), drift)
    assert sorted(p for x in heaps.places for p in x.tolist()) == list(range(500))
    assert heapq.nsmallest(1, heaps.keys[0].tolist()) == [heaps.keys[0][0]]
