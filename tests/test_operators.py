import decimal
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytomix.functions import special
from cytomix.operators import bulk, model, signature, states, variational
from cytomix.plans import catalog
from cytomix.sources import tables


def test_gamma_family(spark):
    xs = [0.001, 0.1, 0.5, 1.0, 1.5, 3.0, 10.0, 250.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.lgamma("x").alias("l"), special.digamma("x").alias("d"), special.trigamma("x").alias("t")).collect()
    for r in got:
        h = 1e-4 * r.x
        assert abs(r.l - math.lgamma(r.x)) < 1e-9 * max(1, abs(r.l))
        assert abs(r.d - (math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h)) < 1e-4 * max(1, abs(r.d))
        assert r.t > 0
    assert spark.range(1).select(special.lgamma(F.lit(-1.0)).alias("l"), special.digamma(F.lit(0.0)).alias("d")).head() == (None, None)


@pytest.mark.parametrize(("rows", "action"), [([("a", "s", 9999.5)], "accept"), ([("a", "s", 9999.0)], "rescale"), ([("a", "s", 10.0)], "keep"), ([("a", "s", -1.0)], "reject"), ([("a", "s", 4.0), ("a", "s", 5.0)], "reject"), ([("a", "s", 30.0), ("b", "t", -1.0)], "rescale")])
def test_format_rules(spark, rows, action):
    df = spark.createDataFrame(rows, "gene string, sample string, expr double")
    assert bulk.format_flags(df).head().action == action
    if action == "reject":
        with pytest.raises(ValueError):
            bulk.checked(df)
    else:
        assert bulk.checked(df).count() == len(rows)


def test_empty_bulk_is_an_error(spark):
    with pytest.raises(ValueError):
        bulk.checked(spark.createDataFrame([], "gene string, sample string, expr double"))


@pytest.mark.parametrize(("curve", "k"), [((0.99, 0.98, 0.96, 0.85, 0.8, 0.7, 0.6, 0.5), 4), ((0.99, 0.98, 0.97, 0.89, 0.8, 0.7, 0.6, 0.5), 4), ((0.5,) * 8, 9), ((0.99,) * 8, 9), ((0.99,) + (0.5,) * 7, 9)])
def test_choice_of_k(spark, curve, k):
    df = spark.createDataFrame([(0, i + 2, c) for i, c in enumerate(curve)], "celltype int, k int, c double")
    assert states.pick_k(df).head().chosen == k


def test_exact_ties_take_the_earlier_number_of_states(spark):
    df = spark.createDataFrame([(0, 2, 1.0), (0, 3, 0.75), (0, 4, 0.25)], "celltype int, k int, c double")
    assert states.pick_k(df, 0.5).head().chosen == 2


def test_divergence_keeps_terms_without_a_logarithm(spark):
    df = spark.createDataFrame([([0.0, 1.0], [2.0, 1.0]), ([-1.0, 3.0], [1.0, -2.0]), ([-1.0], [-2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(special.kl_divergence("a", "b")).collect()]
    assert np.allclose(got, [2.0, 2.0 - 5.0, np.log(2.0) - 1.0])


def test_signed_parts_and_interpolation(spark):
    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 1.0), (2.0, 5.0), (4.0, 3.0))])
    rows = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (2.0,), (3.5,), (9.0,)], "x double").select("x", special.interpolated("x", knots).alias("y"), special.positive_part("x").alias("p"), special.negative_part("x").alias("n")).collect()
    assert np.allclose([r.y for r in rows], np.interp([r.x for r in rows], [0, 2, 4], [1, 5, 3])) and all(r.p - r.n == r.x for r in rows)


def test_covariance_needs_no_pairs(spark):
    rnd = np.random.default_rng(5)
    nu, om, be = rnd.normal(size=(3, 2, 4)), rnd.uniform(0.1, 0.5, (2, 4)), rnd.uniform(1, 9, (3, 4))
    n = spark.createDataFrame([(s, g, c, float(nu[s, g, c])) for s in range(3) for g in range(2) for c in range(4)], "sample int, gene int, celltype int, nu double")
    o = spark.createDataFrame([(g, c, float(om[g, c])) for g in range(2) for c in range(4)], "gene int, celltype int, omega double")
    b = spark.createDataFrame([(s, c, float(be[s, c])) for s in range(3) for c in range(4)], "sample int, celltype int, beta double")
    for r in model.bulk_moments(n, o, b).collect():
        v, w, total = nu[r.sample, r.gene], om[r.gene] ** 2, be[r.sample].sum()
        f = be[r.sample] / total
        u = f * np.exp(v + w / 2)
        own = (np.exp(2 * v + 2 * w) * (f * (1 - f) / (total + 1) + f * f) - np.exp(2 * v + w) * f * f).sum()
        cov = sum(u[i] * u[j] for i in range(4) for j in range(4) if i != j) / (1 + total)
        assert abs(r.mean - u.sum()) < 1e-9 and abs(r["var"] - (own - cov)) < 1e-9


def test_planted_states_are_found(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(0, 2, (3, 40))
    rows = [(0, s, g, float(base[s % 3, g] + rnd.normal(0, 0.2))) for s in range(24) for g in range(40)]
    matrix = spark.createDataFrame(rows, "celltype int, sample int, gene int, x double")
    runs = spark.createDataFrame([(3, r) for r in range(6)], "states int, run int")
    factors = states.factorise(states.gram(matrix), runs)
    best = states.best_run(factors).withColumnRenamed("h", "score")
    top = {r.sample: r.state for r in states.dominant(best.select("celltype", "sample", "state", "score")).collect()}
    assert len({(s % 3, t) for s, t in top.items()}) == 3
    assert states.cophenetic(factors).head().c > 0.8
    known = states.loadings(matrix, best)
    again = {r.sample: r.state for r in states.dominant(states.retrieve(matrix, known)).collect()}
    assert sum(again[s] == top[s] for s in top) >= 22


def test_sparse_moments_count_absent_rows(spark):
    cells = spark.createDataFrame([(i, "t" if i < 4 else None) for i in range(5)], "cell_id int, celltype string")
    expr = spark.createDataFrame([(0, "g", 2.0), (1, "g", 4.0), (4, "g", 9.0)], "cell_id int, gene string, x double")
    r = signature.sparse_moments(cells, expr).head()
    assert (r.n, r.mu) == (4, 1.5) and abs(r["var"] - 2.76) < 1e-9


def test_tables_round_trip(spark, tmp_path):
    (tmp_path / "bulk.tsv").write_text("Gene\ts1\ts2\ng1\t1\tNaN\ng2\t3\t4.5\n")
    long = tables.read_wide(spark, str(tmp_path / "bulk.tsv"), "gene", "sample", "expr")
    assert {(r.gene, r.sample): r.expr for r in long.collect()} == {("g1", "s1"): 1.0, ("g1", "s2"): None, ("g2", "s1"): 3.0, ("g2", "s2"): 4.5}
    tables.write_wide(long, str(tmp_path / "out"), "gene", "sample", "expr", ["s1", "s2"])
    wide = spark.createDataFrame([("g", True, 1.0, 0.1, 2.0, 0.2)], "Gene string, IsMarker boolean, scExp_T double, scVar_T double, `scExp_B cell` double, `scVar_B cell` double")
    sig = tables.signature_from_wide(wide)
    tables.save_signature(sig, str(tmp_path / "catalog"), "lung")
    got = tables.fetch_signature(spark, str(tmp_path / "catalog"), "lung")
    assert sorted((r.celltype, r.mu, r["var"]) for r in got.collect()) == [("B cell", 2.0, 0.2), ("T", 1.0, 0.1)]
    with pytest.raises(ValueError, match="lung"):
        tables.fetch_signature(spark, str(tmp_path / "catalog"), "liver")
    tables.save_results({"x": sig}, str(tmp_path / "results"))
    assert tables.load_results(spark, str(tmp_path / "results"), ["x"])["x"].count() == 2


def test_sample_alpha_against_plain_loops(spark):
    rnd = np.random.default_rng(3)
    beta = rnd.uniform(0.5, 9, (6, 5))
    of = {0: [0, 1], 1: [2]}
    prior = {(s, g): (None if rnd.random() < 0.3 else float(rnd.uniform(0.05, 0.4))) for s in range(6) for g in of}
    frame = spark.createDataFrame([(s, c, float(beta[s, c])) for s in range(6) for c in range(5)], "sample int, celltype int, beta double")
    expected = spark.createDataFrame([(s, g, p) for (s, g), p in prior.items()], "sample int, group int, prior double")
    members = spark.createDataFrame([(g, c) for g, cs in of.items() for c in cs], "group int, celltype int")
    for heat in (None, 1.0, 30.0):
        want = np.zeros((6, 5))
        for s in range(6):
            f, pinned = beta[s] / beta[s].sum(), []
            for g, cs in of.items():
                if prior[s, g] is not None:
                    f[cs] = f[cs] / f[cs].sum() * prior[s, g]
                    pinned += cs
            free = [c for c in range(5) if c not in pinned]
            f[free] = f[free] / f[free].sum() * (1 - sum(prior[s, g] for g in of if prior[s, g] is not None))
            want[s] = f * (beta[s].sum() if heat is None else heat)
        got = {(r.sample, r.celltype): r.alpha for r in model.sample_alpha(frame, expected, members, heat).collect()}
        assert np.allclose([[got[s, c] for c in range(5)] for s in range(6)], want)
    plain = {(r.sample, r.celltype): r.alpha for r in model.sample_alpha(frame).collect()}
    assert np.allclose([[plain[s, c] for c in range(5)] for s in range(6)], beta)


def test_an_annealed_fit_ends_with_the_last_sum(spark):
    from test_variational import planted

    bulk, signature, _ = planted(spark, 10, 4, 2)
    for method in ("blocks", "joint"):
        alpha = variational.fit_model(bulk, signature, reps=1, iterations=2, inner=3, tolerance=0.0, temperature=(50.0, 8.0), method=method)["alpha"]
        assert all(abs(r.total - 8.0) < 1e-6 for r in alpha.groupBy("sample").agg(F.sum("alpha").alias("total")).collect())


def test_genes_of_bins_of_two_tie_exactly(spark):
    """Two genes of a bin are standardised to plus and minus the root of a half, and genes that tie across bins are taken by name; a bin's missing, equal and infinite dispersions stay as they were."""
    rng = np.random.default_rng(5)
    means = np.expm1(np.repeat(np.arange(20), 2) / 10 + np.tile((0.03, 0.06), 20) + 0.1)
    means[0], means[-1] = np.expm1(0.1), np.expm1(2.1)  # so that a bin is 0.1 wide
    genes = rng.permutation(40).tolist()
    rows = [(g, float(m), float(m * np.exp(d))) for g, m, d in zip(genes, means, rng.normal(1, 1e-3, 40), strict=True)]
    disp = signature.dispersion_of(spark.createDataFrame(rows, "gene int, m double, v double"))
    got = disp.toPandas()
    assert (got.groupby("bin").size() == 2).all() and set(got.disp_norm) == {-math.sqrt(0.5), math.sqrt(0.5)}
    assert (got.loc[got.groupby("bin").disp.idxmax()].disp_norm > 0).all()
    assert [r.gene for r in signature.top_variable(disp, 7).collect()] == sorted(got.gene[got.disp_norm > 0])[:7]
    odd = [(0, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 0.0), (3, 9.0, 9.0), (4, 9.0, 9.0), (5, 99.0, 9.0), (6, 99.0, math.inf)]
    norm = {r.gene: r.disp_norm for r in signature.dispersion_of(spark.createDataFrame(odd, "gene int, m double, v double")).collect()}
    assert norm[0] == -math.sqrt(0.5) and norm[1] == math.sqrt(0.5) and norm[2] is norm[3] is norm[4] is None and math.isnan(norm[5]) and math.isnan(norm[6])


def test_variable_genes_are_those_of_exact_arithmetic(spark):
    """Five genes of sf0.1 lie at the root of a half and four of them are taken: exp(ln(1 + 10 |e|)) - 1 is 10 |e|, so the order can be had from the components in whole numbers."""
    got = {r.gene for r in catalog.queries()["hvg_centroids"](spark, "/root/testdata/sf0.1").collect()}
    e = np.stack(pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet", columns=["embedding"])["embedding"]).astype(float)
    whole = [[int(x) for x in np.abs(column) * 2.0**60] for column in e.T]  # floats of 24 bits: lossless from 2^-36 on, and nearly so below
    with decimal.localcontext(prec=60):
        mean = [decimal.Decimal(10 * sum(c)) / len(c) / 2**60 for c in whole]
        ratio = [(decimal.Decimal(100 * sum(x * x for x in c)) / len(c) / 2**120 - m * m) / m for c, m in zip(whole, mean, strict=True)]
        at, disp = [(1 + m).ln() for m in mean], [r.ln() for r in ratio]
        width = (max(at) - min(at)) / 20
        bins = [min(max(math.ceil((a - min(at)) / width), 1), 20) for a in at]
        norm = []
        for b, d in zip(bins, disp, strict=True):
            own = [x for x, y in zip(disp, bins, strict=True) if y == b]
            centre = sum(own) / len(own)
            norm.append(decimal.Decimal(1) if len(own) == 1 else (d - centre) / (sum((x - centre) ** 2 for x in own) / (len(own) - 1)).sqrt())
        assert sum(abs(n - decimal.Decimal("0.5").sqrt()) < decimal.Decimal("1e-30") for n in norm) == 5
        want = sorted(range(len(norm)), key=lambda g: (-round(norm[g], 30), g))[:20]
    assert got == set(want)
