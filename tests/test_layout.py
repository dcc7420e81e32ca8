import numpy as np
import pytest

from cytomix.operators import layout as L


@pytest.fixture(scope="module")
def clusters(spark):
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(0, 4, 8) + rnd.normal(0, 0.5, (30, 8)) for _ in range(5)])
    rows = [(f"t{i % 5}", i, [float(v) for v in p]) for i, p in enumerate(x)]
    return x, spark.createDataFrame(rows, "celltype string, sample int, points array<double>")


def trustworthiness(x, y, k=8):
    n = len(x)
    d = lambda z: np.linalg.norm(z[:, None] - z[None], axis=2) + np.diag(np.full(n, np.inf))
    rank = d(x).argsort(1).argsort(1) + 1
    near = d(y).argsort(1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()


def placed(frame):
    got = {(r.celltype, r.sample): (r.x, r.y) for r in frame.collect()}
    return np.array([got[f"t{i % 5}", i] for i in range(len(got))])


def test_planted_clusters_stay_apart(clusters):
    x, points = clusters
    y = placed(L.neighbour_layout(points, perplexity=10, rounds=20))
    assert trustworthiness(x, y) > 0.9
    centres = np.array([y[30 * c : 30 * c + 30].mean(0) for c in range(5)])
    assert (np.linalg.norm(y[:, None] - centres[None], axis=2).argmin(1) == np.arange(150) // 30).mean() > 0.97
    assert np.allclose(placed(L.neighbour_layout(points.repartition(7), perplexity=10, rounds=20)), y, atol=1e-3)


@pytest.mark.parametrize("numbers", [10**6, 200])
def test_neighbours_are_exact(spark, clusters, numbers):
    x, _ = clusters
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "at long, point array<double>").repartition(3)
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag(np.full(len(x), np.inf))
    for r in L.neighbours(points, 7, numbers).collect():
        assert list(r.near) == d[r.at].argsort()[:7].tolist() and np.allclose(r.dist, np.sort(d[r.at])[:7])


def test_affinities(spark):
    p = L.bandwidth(np.linspace(0.1, 9, 30) ** 2, 5.0)
    assert np.isclose(np.exp(-(p * np.log(p)).sum()), 5.0, rtol=1e-6) and np.allclose(L.bandwidth(np.ones(4), 2.0), 0.25) and not len(L.bandwidth(np.ones(0), 5.0))
    near = spark.createDataFrame([(0, [1, 2], [1.0, 2.0]), (1, [0, 2], [1.0, 3.0]), (2, [0, 1], [2.0, 3.0])], "at long, near array<long>, dist array<double>")
    got = {(r.at, r.to): r.p for r in L.affinities(near, 1.5).collect()}
    assert len(got) == 6 and np.isclose(sum(got.values()), 3) and all(np.isclose(got[i, j], got[j, i]) for i, j in got)


def test_few_points(spark):
    kind = "celltype string, sample int, points array<double>"
    assert L.neighbour_layout(spark.createDataFrame([], kind)).count() == 0
    assert L.neighbour_layout(spark.createDataFrame([("a", i, [1.0, float(i)]) for i in range(3)], kind)).count() == 3
    assert L.neighbour_layout(spark.createDataFrame([("a", i, [2.0]) for i in range(6)], kind), rounds=2).count() == 6
