import numpy as np
import pytest

from cytomix.llm import vectors as V


def brute(rows, least):
    """(links, component, kept) by place, from all cosines between vectors of one length. rows are (id, vector)."""
    fine = [k for k, (i, v) in enumerate(rows) if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, degree = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for size in {len(rows[k][1]) for k in fine}:
        at = [k for k in fine if len(rows[k][1]) == size]
        x = np.array([rows[k][1] for k in at], float)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= least
        for a, b in zip(*np.nonzero(near), strict=True):
            if a != b:
                degree[at[a]] += 1
                p, q = sorted((find(at[a]), find(at[b])))
                root[q] = p
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return [(degree[k], low[find(k)], low[find(k)] == i) for k, (i, _) in enumerate(rows)]


def found(spark, rows, parts=4):
    docs = spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, key int").repartition(parts)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_duplicates(docs).collect()}


@pytest.mark.parametrize(("shard", "most", "ball"), [(100, 3000, 16), (50, 120, 4), (60, 3000, 5)])
def test_against_brute_force(spark, monkeypatch, shard, most, ball):
    monkeypatch.setattr(V, "SHARD", shard)
    monkeypatch.setattr(V, "SHARD_MOST", most)
    monkeypatch.setattr(V, "BALL", ball)
    if most < 200:
        monkeypatch.setattr(V, "CENTRES", 4)
    rnd = np.random.default_rng(8)
    rows = []
    for _ in range(500):
        base = rnd.normal(size=16)
        for _ in range(rnd.choice((1, 1, 2, 12))):
            rows.append([float(x) for x in base + rnd.normal(size=16) * rnd.choice((0.0, 0.05, 0.15))])
    for base in rnd.normal(size=(3, 16)):  # larger groups, of which some vectors are just within reach
        rows += [[float(x) for x in base + rnd.normal(size=16) * s] for s in (0.01, 0.1, 0.2, 0.3) for _ in range(40)]
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1e300] * 16, [1e-300] * 16]
    rows += [[1.0, 2.0], [1.0, 2.01], [1.0, 2.0], [1.0] * 15]  # lengths that few have
    rows = [(3 * i, v) for i, v in enumerate(rows)]
    got, want = found(spark, rows), dict(zip([i for i, _ in rows], brute(rows, 0.95), strict=True))
    true = sum(w[0] for w in want.values())
    assert true * 0.99 <= sum(got[i][0] for i in want) <= true
    assert all(got[i][0] <= w[0] for i, w in want.items()) and sum(got[i] == w for i, w in want.items()) > 0.98 * len(want)
    assert [got[i] for i, v in rows[-6:]] == [want[i] for i, v in rows[-6:]]


def test_balls_link_among_themselves(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD_MOST", 200)
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=24) + rnd.normal(size=(1500, 24)) * 0.08
    nodes = spark.createDataFrame([(i, [float(y) for y in v], 1) for i, v in enumerate(x)], "node long, vec array<double>, size long")
    items, members = V.balls(nodes, 0.95)
    assert items.count() < 150
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = {}
    for r in members.collect():
        groups.setdefault(r.item, []).append(r.node)
    assert sorted(i for g in groups.values() for i in g) == list(range(1500))
    assert all((x[g] @ x[g].T >= 0.95).all() for g in groups.values())
    assert sum(r["size"] for r in items.collect()) == 1500


def test_a_dense_group_costs_rows_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD_MOST", 500)
    rnd = np.random.default_rng(4)
    group = rnd.normal(size=16) + rnd.normal(size=(4000, 16)) * 0.02
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*group, *rnd.normal(size=(500, 16))])]
    stored = []
    keep = V.materialize
    monkeypatch.setattr(V, "materialize", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    got = found(spark, rows)
    assert all(got[i] == (3999, 0, i == 0) for i in range(4000))
    assert max(t.count() for t in stored) <= 10 * len(rows)


def test_edges(spark):
    assert V.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert V.near_duplicates(spark.createDataFrame([(None, [1.0])], "vec_id long, embedding array<float>")).head().n_links == 0
    same = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (2, [0.0, 1.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in V.near_duplicates(same).collect()) == [(2, 2, 2), (5, 0, 5), (5, 2, 2), (5, 2, 2)]


def test_exact_comparison_makes_up_for_a_poor_search(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    group = rnd.normal(size=16) + rnd.normal(size=(60, 16)) * 0.01
    pairs = np.repeat(rnd.normal(size=(150, 16)), 2, 0) + rnd.normal(size=(300, 16)) * 0.01
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*group, *pairs])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "node long, vec array<double>, size long")
    counts = spark.createDataFrame([(i, 59 if i < 60 else 0) for i, _ in rows], "node long, links long")
    monkeypatch.setattr(V, "AUDIT", 1)
    assert V.audit(vectors, counts, 0.95) < 0.5
    monkeypatch.setattr(V, "SHARD_MOST", 100)
    empty = spark.createDataFrame([], "kind string, a long, b long")
    monkeypatch.setattr(V, "search", lambda items, least, overlap: empty)
    assert list(found(spark, rows).values()) == brute(rows, 0.95) or found(spark, rows) == dict(zip([i for i, _ in rows], brute(rows, 0.95), strict=True))


def test_audit_collects_few_vectors_where_none_has_a_partner(spark, monkeypatch):
    rnd = np.random.default_rng(12)
    rows = rnd.normal(size=(20_000, 48))
    rows[7], rows[8] = rows[9] + 0.01, rows[9]
    vectors = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(rows)], "node long, vec array<double>, size long")
    counts = spark.createDataFrame([(7, 2), (8, 1), (9, 2)], "node long, links long")
    seen, plain = [], type(vectors).collect
    monkeypatch.setattr(type(vectors), "collect", lambda self: seen.append(plain(self)) or seen[-1])
    assert abs(V.audit(vectors, counts, 0.95) - (1 + 0.5 + 1) / 3) < 1e-9
    assert 0 < max(map(len, seen)) < 5000
