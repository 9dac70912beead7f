"""Clusters by bit planes against plain integer arithmetic."""

import hashlib

import numpy as np
import pytest

from tremorlens.llm import clusters


def plain(rows, k, rounds):
    good = [(i, np.clip(np.floor(64 * np.array(v, dtype=np.float64)), -clusters.LARGEST, clusters.LARGEST).astype(np.int64)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist()))
    centres = np.array([v for _, v in start[:k]])
    if not len(centres):
        return []
    vectors = np.array([v for _, v in good])

    def nearest():
        far = ((vectors[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(rounds):
        best, _ = nearest()
        centres = np.array([vectors[best == c].sum(axis=0) // (best == c).sum() if (best == c).any() else centres[c] for c in range(len(centres))])
    best, far = nearest()
    return sorted((str(i), int(c), int(d), int(far[best == c].sum()), int(far.sum()), centres[c].tolist()) for (i, _), c, d in zip(good, best, far, strict=True))


def table_of(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], "vec_id long, embedding array<double>, label int, id string, planes string, cluster string")
    return df.repartition(4)


def found(spark, rows, k=16, rounds=3):
    got = clusters.cluster(table_of(spark, rows), k, rounds)
    return sorted((str(r["vec_id"]), *(r[c] for c in ("cluster", "distance", "cluster_inertia", "inertia", "centroid"))) for r in got.collect())


@pytest.mark.parametrize("scale", [0.2, 30.0, 1e5])
@pytest.mark.parametrize("k,rounds", [(16, 3), (3, 0), (50, 6)])
def test_clusters(spark, scale, k, rounds):
    rng = np.random.default_rng(k)
    rows = [(i, rng.normal(0, scale, 64).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [rows[5]] * 4 + [(None, rows[1][1]), (None, rows[2][1])]
    rows += [(2001, None), (2004, []), (2007, [None] * 64), (2010, [float("nan")] * 64), (2013, [1.0] * 63 + [float("inf")]), (2016, [0.5] * 63), (2019, [0.0] * 64)]
    assert found(spark, rows, k, rounds) == plain(rows, k, rounds)


def test_few_and_no_vectors(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0] * 63)]) == []
    for rows in ([(7, [0.25] * 64)], [(None, [-1.0] * 64)], [(1, [1.0] * 64), (2, [-1.0] * 64), (3, [-1.0] * 64)], [(1, [1e300] * 64), (2, [-1e300] * 64)]):
        assert found(spark, rows) == plain(rows, 16, 3)


@pytest.mark.parametrize("planes,dims", [(1, 64), (7, 64), (28, 64), (5, 3), (9, 130)])
def test_planes_give_exact_products(planes, dims):
    rng = np.random.default_rng(planes)
    a, b = (rng.integers(-(1 << (planes - 1)), max(1, 1 << (planes - 1)), (n, dims)) for n in (40, 7))
    left, right = clusters.to_planes(a, planes), clusters.to_planes(b, planes)
    assert (clusters.from_planes(left, dims) == a).all()
    assert (clusters.products(left, right) == a @ b.T).all() and (clusters.squares(left) == (a * a).sum(axis=1)).all()


def test_ties_go_to_the_smaller_centroid():
    planes = clusters.to_planes(np.zeros((1, 64), dtype=np.int64), 3)
    centres = clusters.to_planes(np.array([[2] + [0] * 63, [1] + [0] * 63, [-1] + [0] * 63]), 3)
    assert [x.tolist() for x in clusters.nearest(planes, centres)] == [[1], [1]]
