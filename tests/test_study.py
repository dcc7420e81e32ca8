import numpy as np
import pytest

from cytomix.operators import signature as S
from cytomix.operators import states
from cytomix.plans import study
from cytomix.sources import tables


@pytest.fixture(scope="module")
def inputs(spark):
    rnd = np.random.default_rng(7)
    mu, f = rnd.normal(4, 1.5, (24, 2)), rnd.dirichlet([3, 3], 8)
    y = np.exp(mu) @ f.T * np.exp(rnd.normal(0, 0.05, (24, 8)))
    y = y / y.sum(0) * 1e4
    bulk = spark.createDataFrame([(f"g{g}", f"s{s}", float(y[g, s])) for g in range(24) for s in range(8)], "gene string, sample string, expr double")
    table = spark.createDataFrame([(f"g{g}", c, float(mu[g, i]), 0.05, g % 2 == 0) for g in range(26) for i, c in enumerate(("B", "T")) if g < 24], "gene string, celltype string, mu double, var double, is_marker boolean")
    return bulk, table


def test_from_bulk_to_states(spark, inputs, tmp_path):
    bulk, table = inputs
    begun = study.begin(bulk, signature_table=table)
    assert begun.counts.head().asDict() == {"bulk_genes": 24, "signature_genes": 24, "common_genes": 24, "common_markers": 12}
    found = begun.deconvolve(reps=2, iterations=1).refine(iterations=3, genes=table.select("gene").where("gene <> 'g3'"))
    assert found.fractions.fit["nu"].select("gene").distinct().count() == 12
    totals = found.fractions.fraction.groupBy("sample").sum("fraction").collect()
    assert len(totals) == 8 and all(abs(r[1] - 1) < 1e-9 for r in totals)
    assert found.extract("B").count() == 8 * 23 and found.omega.count() == 2 * 23
    with pytest.raises(ValueError, match="'B', 'T'"):
        found.extract("NK")
    done = found.discover_states(k={"T": 2}, final_runs=3)
    assert done.wide_scores().columns == ["sample", "T_0", "T_1"] and done.wide_loadings().count() == 23
    assert [(r.celltype, r.k, r.chosen) for r in done.cophenetic().collect()] == [("T", 2, True)]
    study.save(done, str(tmp_path / "study"))
    again = study.load(spark, str(tmp_path / "study"))
    assert isinstance(again, study.States) and sorted(again.scores("T").collect()) == sorted(done.scores("T").collect())
    assert again.retrieve(found.gex, found.omega, found.fractions.fraction).count() == 8 * 2


def test_prior_fractions(spark, inputs):
    bulk, table = inputs
    begun = study.begin(bulk, signature_table=table)
    prior = spark.createDataFrame([(f"s{s}", c, 0.9 if c == "B" else None) for s in range(8) for c in ("B", "T")], "sample string, celltype string, prior double")
    alpha = {(r.sample, r.celltype): r.alpha for r in begun.deconvolve(reps=1, iterations=1, expected=prior).fit["alpha"].collect()}
    assert all(abs(alpha[f"s{s}", "B"] / (alpha[f"s{s}", "B"] + alpha[f"s{s}", "T"]) - 0.9) < 1e-9 for s in range(8))
    for bad, match in ((prior.where("celltype = 'B'"), "cell types"), (prior.fillna(1.0), "exactly")):
        with pytest.raises(ValueError, match=match):
            begun.deconvolve(expected=bad)


def test_begin_wants_one_signature(spark, inputs, tmp_path):
    bulk, table = inputs
    tables.save_signature(table, str(tmp_path / "catalog"), "lung")
    assert study.begin(bulk, catalog=str(tmp_path / "catalog"), tumor_type="lung").signature.count() == 48
    with pytest.raises(ValueError, match="only one"):
        study.begin(bulk)
    with pytest.raises(ValueError, match="is_marker"):
        study.begin(bulk, signature_table=table.drop("is_marker"))
    with pytest.raises(ValueError, match="in common"):
        study.begin(bulk, signature_table=table.withColumn("gene", table.gene.substr(2, 9)))


def test_numbers_of_states(spark):
    gex = spark.createDataFrame([("B", 1), ("T", 1)], "celltype string, x int")
    rows = lambda *a: sorted(map(tuple, study.wanted_states(gex, *a).collect()))
    assert study.wanted_states(gex, None, None) is None
    assert rows(["T"], 3) == [("B", 3), ("T", 3)] and rows(None, [2, 4]) == [("B", 2), ("T", 4)] and rows(["B"], {"T": 5}) == [("T", 5)] and rows("T", None) == [("T", None)]
    for bad, error in ((([["B"], [2, 3]]), ValueError), ((None, "3"), TypeError), ((["X"], None), ValueError)):
        with pytest.raises(error):
            study.wanted_states(gex, *bad)


def test_cells_are_checked(spark):
    fine = [(i, "t" if i % 2 else "u", f"g{g}", float(np.log1p(0.37 * (g + 1) * (1 + i % 2 * (g % 3)) + 0.01 * i))) for i in range(12) for g in range(8)]
    kind = "cell_id int, celltype string, gene string, x double"
    got = S.create_signature(spark.createDataFrame(fine, kind), n_markers=3)
    assert got.count() == 16 and got.where("is_marker").select("gene").distinct().count() == 3
    for rows, match in (([(*r[:3], -1.0) for r in fine], "negative"), ([(*r[:3], float(r[0])) for r in fine], "counts"), ([], "no expression")):
        with pytest.raises(ValueError, match=match):
            S.create_signature(spark.createDataFrame(rows, kind))
    with pytest.raises(ValueError, match="celltype"):
        S.create_signature(spark.createDataFrame(fine, kind).drop("celltype"))


def test_trend_follows_its_curve():
    rnd = np.random.default_rng(2)
    x = np.sort(rnd.uniform(0.05, 5, 3000))
    true = 2 * x / (x**1.7 + 1.3)
    got = S.trend(x, true * np.exp(rnd.normal(0, 0.1, len(x))))
    assert np.abs(np.log(got[x > 0.1] / true[x > 0.1])).max() < 0.1
    assert np.allclose(S._local_lines(x, 3 * x - 1, 0.05), 3 * x - 1)


def test_markers_that_tell_types_apart_are_found(spark):
    rnd = np.random.default_rng(1)
    mu = rnd.normal(1, 0.01, (30, 3))
    mu[:6] += np.tile(np.eye(3), (2, 1)) * 5
    rows = [(g, c, float(mu[g, c])) for g in range(30) for c in range(3)]
    got = [r.gene for r in S.marker_search(spark.createDataFrame(rows, "gene int, celltype int, mu double"), 6, islands=2, generations=100).collect()]
    masks = np.array([np.isin(np.arange(30), got), *(np.isin(np.arange(30), rnd.choice(30, 6, replace=False)) for _ in range(3000))])
    scores = S._objectives(mu.T, masks).sum(1)
    assert len(set(got)) == 6 and scores[0] >= scores[1:].max()


def test_gram_with_holes(spark):
    rnd = np.random.default_rng(0)
    x = {(c, s, g): float(rnd.normal()) for c in range(2) for s in range(5) for g in range(9) if (s + g + c) % 4}
    got = {(r.celltype, r.s1, r.s2): r.k for r in states.gram(spark.createDataFrame([(*k, v) for k, v in x.items()], "celltype int, sample int, gene int, x double").repartition(5)).collect()}
    want = {}
    for (c, s, g), v in x.items():
        for t in range(s, 5):
            if (c, t, g) in x:
                want[c, s, t] = want.get((c, s, t), 0.0) + v * x[c, t, g]
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_state_points_pad_and_drop_what_does_not_vary(spark):
    rows = [("a", s, k, 0.5 if k == 1 else float(s)) for s in range(3) for k in range(3)] + [("b", s, 0, float(s)) for s in range(3)] + [("b", 9, 0, float("nan"))]
    got = {(r.celltype, r.sample): r.points for r in states.state_points(spark.createDataFrame(rows, "celltype string, sample int, state int, score double")).collect()}
    assert got["a", 2] == [2.0, 2.0] and got["b", 1] == [1.0, 0.0] and got["b", 9] == [0.0, 0.0]
