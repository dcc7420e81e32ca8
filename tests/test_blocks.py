import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytomix.operators import factors, linkage, states


def greedy(x, sizes):
    """Average linkage the plain way: the nearest pair of clusters at each step, with a matrix of heights; and the correlation over all pairs of points."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups, merges = {i: [i] for i in range(len(x))}, []
    height = np.zeros((len(x), len(x)))
    while len(groups) > 1:
        mean = lambda a, b: sum(d[i, j] * sizes[i] * sizes[j] for i in groups[a] for j in groups[b]) / (sum(sizes[i] for i in groups[a]) * sum(sizes[j] for j in groups[b]))
        h, a, b = min((round(mean(a, b), 9), a, b) for a in groups for b in groups if a < b)
        for i in groups[a]:
            height[i, groups[b]] = height[groups[b], i] = h
        merges.append((a, b, h))
        groups[a] += groups.pop(b)
    w = np.outer(sizes, sizes)
    i, j = np.triu_indices(len(x), 1)
    same = sum(s * (s - 1) / 2 for s in sizes)
    dist, high, weight = np.append(d[i, j], 0), np.append(height[i, j], 0), np.append(w[i, j], same)
    cov = np.cov(np.vstack((dist, high)), aweights=weight)
    return merges, cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1])


@pytest.fixture(scope="module")
def cloud(spark):
    rnd = np.random.default_rng(6)
    groups = {"a": rnd.normal(size=(23, 3)), "b": np.round(rnd.normal(size=(9, 2))), "one": np.zeros((1, 2)), "same": np.ones((4, 2)), "line": np.arange(12.0)[:, None] ** 1.5}
    sizes = {g: rnd.integers(1, 4, len(x)).astype(float) for g, x in groups.items()}
    rows = [(g, f"p{i:03d}", float(sizes[g][i]), [float(v) for v in x[i]]) for g, x in groups.items() for i in range(len(x))]
    return groups, sizes, spark.createDataFrame(rows, "celltype string, id string, n double, point array<double>").repartition(4)


@pytest.mark.parametrize("most", [1000, 5])
def test_linkage_equals_the_greedy_one(cloud, most):
    groups, sizes, points = cloud
    merges = linkage.linkage(points, most=most, cells=40)
    got = merges.toPandas()
    correlation = {r.celltype: r.c for r in linkage.cophenetic_correlation(points, merges).collect()}
    for g in ("a", "line"):
        want, c = greedy(groups[g], sizes[g])
        own = got[got.celltype == g]
        assert sorted((r.a, r.b, round(r.height, 8)) for r in own.itertuples()) == sorted((a, b, round(h, 8)) for a, b, h in want)
        assert abs(correlation[g] - c) < 1e-9
    assert set(got.celltype) == {"a", "b", "same", "line"} and correlation["one"] == correlation["same"] == 1.0
    assert all(len(got[got.celltype == g]) == len(x) - 1 and got[got.celltype == g].pairs.sum() == (sizes[g].sum() ** 2 - (sizes[g] ** 2).sum()) / 2 for g, x in groups.items())


def leaves_by_recursion(merges, n):
    made = {i: (i,) for i in range(n)}
    number = dict.fromkeys(range(n))
    number = {i: i for i in range(n)}
    for k, (a, b, _) in enumerate(sorted(merges, key=lambda m: m[2])):
        left, right = (a, b) if number[a] < number[b] else (b, a)
        made[a], number[a] = made[left] + made[right], n + k
    return list(max(made.values(), key=len))


@pytest.mark.parametrize("most", [1000, 5])
def test_leaf_order_equals_brute_force(cloud, most):
    groups, _, points = cloud
    got = linkage.leaf_order(points, most=most, cells=40).toPandas().sort_values("place")
    for g in ("a", "line", "one"):
        merges, _ = greedy(groups[g], np.ones(len(groups[g]))) if len(groups[g]) > 1 else ([], 0)
        assert got[got.celltype == g].id.tolist() == [f"p{i:03d}" for i in leaves_by_recursion(merges, len(groups[g]))]
    assert all(sorted(got[got.celltype == g].place) == list(range(len(x))) for g, x in groups.items())


@pytest.fixture(scope="module")
def matrix(spark):
    rnd = np.random.default_rng(7)
    centres = rnd.normal(0, 2, (3, 30))
    rows = [("t" + str(t), f"s{s:02d}", g, float(centres[s % 3, g] + rnd.normal())) for t in range(2) for s in range(25) for g in range(30) if not (t == 1 and s > 6)]
    return spark.createDataFrame(rows, "celltype string, sample string, gene int, x double")


def test_factors_in_blocks_equal_those_of_a_task(spark, matrix):
    gram = states.gram(matrix)
    runs = spark.createDataFrame([(k, r) for k in (2, 3) for r in range(3)], "states int, run int")
    keys = ["celltype", "states", "run", "sample", "state"]
    whole, cut = (states.factorise(gram, runs, **a).toPandas().sort_values(keys, ignore_index=True) for a in ({}, {"block": 10}))
    assert whole[keys].equals(cut[keys]) and set(whole.celltype) == {"t0", "t1"}
    for c in ("h", "g", "err"):
        assert np.allclose(whole[c], cut[c], atol=1e-6), c


def test_products_of_blocks(spark, matrix):
    gram = states.gram(matrix.where("celltype = 't0'")).select("s1", "s2", "k")
    wide = matrix.where("celltype = 't0'").toPandas().pivot(index="gene", columns="sample", values="x").to_numpy()
    k, x = wide.T @ wide, np.random.default_rng(1).normal(size=(25, 4))
    for block in (4, 7, 100):
        products = factors.Products(gram, block)
        up, down = products(x)
        assert np.allclose(up, np.maximum(k, 0) @ x) and np.allclose(down, np.maximum(-k, 0) @ x) and np.allclose(products.diagonal, np.diag(k))
        assert products.blocks.select(F.max(F.length("data"))).head()[0] <= 8 * block * block


def test_a_batch_of_restarts_changes_nothing(spark, matrix):
    gram = states.gram(matrix.where("celltype = 't0'")).select("s1", "s2", "k")
    plan = [(k, r) for k in (2, 3) for r in range(2)]
    keys = ["states", "run", "sample", "state"]
    a, b = (factors.factorise(gram, plan, rounds=5, block=9, cells=c).toPandas().sort_values(keys, ignore_index=True) for c in (10**6, 60))
    assert np.allclose(a[["h", "g", "err"]], b[["h", "g", "err"]], atol=1e-9)


def plain_cophenetic(labels):
    c = np.mean([np.equal.outer(run, run) for run in labels.T], axis=0)
    return greedy(c, np.ones(len(c)))[1]


@pytest.mark.parametrize("most", [1000, 6])
def test_consensus_equals_the_matrix_of_samples(spark, most):
    rnd = np.random.default_rng(9)
    labels = {(t, k): rnd.integers(0, k, (30, 7)) for t in ("x", "y") for k in (2, 3)}
    for of in labels.values():
        of[:10] = of[0]  # ten samples that all restarts assign alike
    rows = [(t, k, r, i, s, float(of[i, r] == s)) for (t, k), of in labels.items() for i in range(30) for r in range(7) for s in range(k)]
    found = spark.createDataFrame(rows, "celltype string, states int, run int, sample int, state int, h double")
    got = {(r.celltype, r.states): r.c for r in states.cophenetic(found, most=most, cells=50).collect()}
    assert got.keys() == labels.keys()
    points = states.consensus_points(found).where("celltype = 'x' and states = 3").toPandas()
    c = np.mean([np.equal.outer(run, run) for run in labels["x", 3].T], axis=0)
    ways, n = np.unique(labels["x", 3], axis=0, return_counts=True)
    first = [int(np.flatnonzero((labels["x", 3] == w).all(1))[0]) for w in ways]
    points = points.sort_values("id")
    x = np.stack(points.point.to_list())
    assert np.allclose(linkage.distances(x, x), linkage.distances(c[first], c[first]), atol=1e-6) and points.n.tolist() == n.tolist()
    for key, of in labels.items():
        assert abs(got[key] - plain_cophenetic(of)) < 0.02, key  # ties may be joined in another order


def test_stable_restarts_agree_fully(spark):
    rows = [("x", 2, r, i, s, float(i % 2 == s)) for i in range(12) for r in range(4) for s in range(2)]
    found = spark.createDataFrame(rows, "celltype string, states int, run int, sample int, state int, h double")
    assert [(r.states, round(r.c, 9)) for r in states.cophenetic(found).collect()] == [(2, 1.0)]
    assert isinstance(states.consensus_points(found).toPandas(), pd.DataFrame)


def test_eigenpairs_equal_those_of_the_matrix(spark, matrix):
    gram = states.gram(matrix.where("celltype = 't0'")).select("s1", "s2", "k")
    wide = matrix.where("celltype = 't0'").toPandas().pivot(index="gene", columns="sample", values="x").to_numpy()
    want, of = np.linalg.eigh(wide.T @ wide)
    samples, values, vectors = factors.eigenpairs(gram, 3, block=9)
    assert list(samples) == sorted(samples) and np.allclose(values, want[::-1][:3], rtol=1e-9)
    assert np.allclose(np.abs((vectors * of[:, ::-1][:, :3]).sum(0)), 1, atol=1e-4)
    low = matrix.where("celltype = 't0'").selectExpr("celltype", "sample", "gene", "cast(substr(sample, 2) as double) * (gene % 2 + 1) as x")
    assert len(factors.eigenpairs(states.gram(low).select("s1", "s2", "k"), 5)[1]) == 1


def test_eigenpairs_of_all_types_by_task_and_by_blocks(spark, matrix):
    gram = states.gram(matrix)
    keys = ["celltype", "place", "sample"]
    whole, cut = (states.eigenpairs(gram, 4, **a).toPandas().sort_values(keys, ignore_index=True) for a in ({}, {"block": 10}))
    assert whole[keys].equals(cut[keys]) and set(whole.celltype) == {"t0", "t1"} and whole.groupby("celltype").place.max().tolist() == [3, 3]
    assert np.allclose(whole["value"], cut["value"], rtol=1e-9) and np.allclose(whole["entry"], cut["entry"], atol=1e-3)
