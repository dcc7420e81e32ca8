import numpy as np

from cytomix.operators import signature as S


def dominates(a, b):
    return a[0] >= b[0] and a[1] >= b[1] and a != b


def test_fronts_and_crowding():
    rnd = np.random.default_rng(1)
    values = np.round(rnd.random((60, 2)), 1)
    rank, rows = S.fronts(values), [tuple(v) for v in values]
    for i, v in enumerate(rows):
        above = [rank[j] for j, w in enumerate(rows) if dominates(w, v)]
        assert rank[i] == (max(above) + 1 if above else 0)
    line = np.column_stack((np.arange(5.0), -np.array([0.0, 1, 2, 3, 8])))
    assert S.crowding(line, np.zeros(5, int)).tolist() == [np.inf, 0.5 + 0.25, 0.5 + 0.25, 0.5 + 6 / 8, np.inf]


def test_front_has_no_dominated_set_and_finds_planted_markers(spark):
    rnd = np.random.default_rng(2)
    mu = rnd.normal(2, 0.05, (60, 4))
    for t in range(4):
        mu[3 * t : 3 * t + 3, t] += 3.0  # three markers a type
    centroids = spark.createDataFrame([(g, t, float(mu[g, t])) for g in range(60) for t in range(4)], "gene int, celltype int, mu double")
    args = {"islands": 4, "generations": 120, "offspring": 30}
    front = S.marker_front(centroids, **args).collect()
    values = [(r.distance, -r.correlation) for r in front]
    assert [r.solution for r in front] == list(range(len(front))) and not any(dominates(a, b) for a in values for b in values)
    assert values == sorted(values, reverse=True) and len(front) > 3
    for r in front[:5]:
        mask = np.isin(np.arange(60), r.genes)[None]
        assert np.allclose(S._objectives(mu.T, mask)[0], (r.distance, -r.correlation))
    fixed = S.marker_front(centroids, n_genes=12, **args).collect()
    assert all(len(r.genes) == 12 for r in fixed) and set(fixed[0].genes) == set(range(12))
    assert {r.gene for r in S.marker_search(centroids, solution=0, **args).collect()} == set(front[0].genes)
    again = S.marker_front(centroids.repartition(5), **args).collect()
    assert [tuple(r.genes) for r in again] == [tuple(r.genes) for r in front]
