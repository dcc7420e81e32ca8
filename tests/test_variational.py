import math

import numpy as np
import pytest

from cytomix.functions.minimise import minimise
from cytomix.functions.special import gamma_terms
from cytomix.functions.support import support_regression
from cytomix.operators import variational as V


def slope(f, x, h=1e-6):
    out = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        d = np.zeros_like(x)
        d[i] = h * max(1.0, abs(x[i]))
        out[i] = (f(x + d) - f(x - d)) / (2 * d[i])
    return out


@pytest.fixture
def case():
    rnd = np.random.default_rng(4)
    s, c = 5, 3
    return {"y": rnd.normal(2, 0.4, s), "sigma": rnd.uniform(0.2, 0.6, s), "nu": rnd.normal(1, 0.5, (s, c)), "omega": rnd.uniform(0.1, 0.5, c), "beta": rnd.uniform(0.5, 6, (s, c)), "mu0": rnd.normal(1, 0.5, c), "beta0": rnd.uniform(20, 90, c)}


def test_gamma_terms():
    x = np.array([0.003, 0.4, 1.0, 7.5, 300.0])
    logs, first, second = gamma_terms(x)
    assert np.allclose(logs, [math.lgamma(v) for v in x], rtol=1e-10)
    assert np.allclose(first, slope(lambda v: sum(map(math.lgamma, v)), x, 1e-5), rtol=1e-3) and np.allclose(second, slope(lambda v: gamma_terms(v)[1].sum(), x, 1e-5), rtol=1e-2)


def test_likelihood_gradients(case):
    y, sigma, nu, omega, beta = (case[k] for k in ("y", "sigma", "nu", "omega", "beta"))
    wide = np.tile(omega, (5, 1))
    _, by_nu, by_omega, by_beta, miss = V.moment_terms(y, sigma, nu, wide, beta)
    total = lambda n=nu, o=wide, b=beta: V.moment_terms(y, sigma, n, o, b)[0].sum()
    assert np.allclose(by_nu, slope(lambda x: total(n=x), nu), rtol=1e-5, atol=1e-6)
    assert np.allclose(by_omega, slope(lambda x: total(o=x), wide), rtol=1e-5, atol=1e-6)
    assert np.allclose(by_beta, slope(lambda x: total(b=x), beta), rtol=1e-5, atol=1e-6)
    assert (miss > 0).all() and np.isclose(total(), (-0.5 / sigma**2 * miss).sum())


def test_prior_gradients(case):
    nu, omega, mu0, beta0 = (case[k] for k in ("nu", "omega", "mu0", "beta0"))
    _, by_nu, by_omega = V.expression_terms(nu, omega, mu0, beta0, 1000.0, 1.0)
    value = lambda n=nu, o=omega: V.expression_terms(n, o, mu0, beta0, 1000.0, 1.0)[0]
    assert np.allclose(by_nu, slope(lambda x: value(n=x), nu), rtol=1e-5, atol=1e-5) and np.allclose(by_omega, slope(lambda x: value(o=x), omega), rtol=1e-5, atol=1e-5)
    beta, alpha = case["beta"][0], np.array([0.7, 2.0, 5.0])
    assert np.allclose(V.fraction_terms(beta, alpha)[1], slope(lambda x: V.fraction_terms(x, alpha)[0], beta), rtol=1e-5, atol=1e-6)
    assert abs(V.fraction_terms(alpha, alpha)[0]) < 1e-9


def test_minimise():
    rosen = lambda x: (float((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2), np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)]))
    x, value = minimise(rosen, np.array([-1.2, 1.0]), -5.0, 5.0, 500, tol=1e-14)
    assert np.allclose(x, 1, atol=1e-4) and value < 1e-8
    x, _ = minimise(lambda x: (float(((x - [3, -1]) ** 2).sum()), 2 * (x - [3, -1])), np.array([0.5, 0.5]), 0.0, 1.0)
    assert np.allclose(x, [1, 0])
    x, _ = minimise(rosen, np.array([-1.2, 1.0]), np.array([-5.0, 0.0]), np.array([0.5, 5.0]), 500, tol=1e-14)
    assert np.allclose(x, [0.5, 0.25], atol=1e-4)


def test_fits_raise_the_objective(case):
    y, sigma, nu, omega, beta, mu0, beta0 = (case[k] for k in ("y", "sigma", "nu", "omega", "beta", "mu0", "beta0"))
    before = V.moment_terms(y, sigma, nu, np.tile(omega, (5, 1)), beta)[0].sum() + V.expression_terms(nu, omega, mu0, beta0, 1000.0, 1.0)[0]
    n, o, value = V.fit_gene(y, sigma, nu, omega, beta, mu0, beta0, 1000.0, 1.0, 1.0, 200)
    after = V.moment_terms(y, sigma, n, np.tile(o, (5, 1)), beta)[0].sum() + V.expression_terms(n, o, mu0, beta0, 1000.0, 1.0)[0]
    assert np.isclose(value, after) and after > before
    alpha = np.ones(3)
    found, value = V.fit_sample(y, sigma, nu, np.tile(omega, (5, 1)), beta[0], alpha, 1.3, 200)
    at = lambda b: V.moment_terms(y, sigma, nu, np.tile(omega, (5, 1)), np.tile(b, (5, 1)))[0].sum() + 1.3 * V.fraction_terms(b, alpha)[0]
    assert np.isclose(value, at(found)) and value > at(beta[0]) and (found >= V.LEAST).all()


def test_support_regression_leaves_out_wild_rows():
    rnd = np.random.default_rng(0)
    x = rnd.uniform(0, 5, (80, 3))
    y = x @ [0.2, 0.5, 0.3] + rnd.normal(0, 0.02, 80)
    y[:8] += 40
    found = support_regression(x, y, 0.5)
    assert np.allclose(found.coef, [0.2, 0.5, 0.3], atol=0.05)


@pytest.mark.parametrize("seed", range(12))
def test_support_regression_meets_its_conditions(seed):
    rnd = np.random.default_rng(seed)
    n, c, nu = int(rnd.choice([6, 30, 90])), int(rnd.choice([2, 5])), float(rnd.choice([0.25, 0.5, 0.75]))
    x = np.expm1(rnd.gamma(2, 0.7, (n, c)))
    y = x @ rnd.dirichlet(np.ones(c)) * np.exp(rnd.normal(0, 0.3, n))
    found = support_regression(x, y, nu)
    assert found.residual < 1e-6 and nu * n - 1e-6 <= np.abs(found.dual).sum() + 1e-9 <= nu * n + 1e-6 and len(found.support()) >= nu * n - 1e-6
    loss = lambda w, b, e: w @ w / 2 + n * nu * e + np.maximum(np.abs(y - x @ w - b) - e, 0).sum()
    best = loss(found.coef, found.intercept, found.width)
    assert all(loss(found.coef + d[:c], found.intercept + d[c], abs(found.width + d[c + 1])) >= best - 1e-9 * abs(best) for d in rnd.normal(0, 0.01, (200, c + 2)))


def test_support_regression_edges():
    ones = np.ones((6, 2))
    assert not support_regression(ones, np.zeros(6), 0.5).coef.any()
    assert support_regression(np.repeat(ones, 3, 0), np.arange(18.0) // 3, 0.5).residual < 1e-9
    assert support_regression(np.ones((1, 3)), np.ones(1), 0.5).residual < 1e-6


def test_genes_that_carry_no_regression_are_left_out(spark):
    bulk, signature, f = planted(spark, 60, 10, 3)
    noise = bulk.where("gene >= 45").selectExpr("gene", "sample", "expr * (1 + 4 * (hash(gene, sample) % 2)) as expr")
    found = V.regressions(bulk.where("gene < 45").unionByName(noise), signature)
    rows = found.collect()
    assert max(r.residual for r in rows) < 1e-6 and all(abs(sum(r.fraction) - 1) < 1e-9 for r in rows)
    counts = {}
    for r in rows:
        for g in r.support:
            counts[g] = counts.get(g, 0) + 1
    assert {r.gene: r.n for r in V.supported_genes(found, 0.5).collect()} == {g: n for g, n in counts.items() if n > 5}
    assert np.mean([counts.get(g, 0) for g in range(45, 60)]) > np.mean([counts.get(g, 0) for g in range(45)])
    fit = V.fit_model(bulk, signature, reps=1, iterations=1, inner=3, share=0.6)
    assert {r.gene for r in fit["omega"].select("gene").distinct().collect()} == {r.gene for r in V.supported_genes(V.regressions(bulk, signature), 0.6).collect()}


def planted(spark, genes=40, samples=12, types=3, seed=1):
    rnd = np.random.default_rng(seed)
    mu, f = rnd.normal(3, 1.2, (genes, types)), rnd.dirichlet(np.ones(types), samples)
    y = np.exp(mu) @ f.T * np.exp(rnd.normal(0, 0.05, (genes, samples)))
    bulk = spark.createDataFrame([(g, s, float(y[g, s])) for g in range(genes) for s in range(samples)], "gene int, sample int, expr double")
    signature = spark.createDataFrame([(g, c, float(mu[g, c]), 0.1) for g in range(genes) for c in range(types)], "gene int, celltype int, mu double, std double")
    return bulk, signature, f


def test_model_recovers_planted_fractions(spark):
    bulk, signature, f = planted(spark)
    start = {(r.sample, r.celltype): r.fraction for r in V.regression_start(bulk, signature).collect()}
    assert np.corrcoef([start[s, c] for s in range(12) for c in range(3)], f.ravel())[0, 1] > 0.95
    fit = V.fit_model(bulk, signature, sy=0.05, reps=2, iterations=1)
    beta = {(r.sample, r.celltype): r.beta for r in fit["beta"].collect()}
    est = np.array([[beta[s, c] for c in range(3)] for s in range(12)])
    est /= est.sum(1, keepdims=True)
    assert np.corrcoef(est.ravel(), f.ravel())[0, 1] > 0.97
    assert fit["nu"].count() == 40 * 12 * 3 and fit["omega"].count() == 40 * 3
    rows = fit["objective"].collect()
    assert len(rows) == 2 and max(rows, key=lambda r: r.value).best
    again = {(r.sample, r.celltype): r.beta for r in V.fit_model(bulk.repartition(5), signature, sy=0.05, reps=2, iterations=1)["beta"].collect()}
    assert all(abs(again[k] - v) < 1e-3 * max(1, v) for k, v in beta.items())


def test_refinement_copes_with_holes(spark):
    bulk, signature, f = planted(spark, 6, 5, 2)
    beta = spark.createDataFrame([(s, c, float(20 * f[s, c]) + 0.01) for s in range(5) for c in range(2) if (s, c) != (0, 1)], "sample int, celltype int, beta double")
    signature = signature.where("not (gene = 1 and celltype = 0)")
    rows = V.refine_genes(bulk.where("not (gene = 2 and sample = 3)"), signature, beta).collect()
    got = {(r.gene, r.celltype, r.sample) for r in rows}
    assert got == {(g, c, s) for g in range(6) for c in range(2) for s in range(5) if (g, c) != (1, 0) and (g, s) != (2, 3)}
    assert all(np.isfinite(r.nu) and r.omega > 0 for r in rows)
    assert V.refine_genes(bulk, signature, beta, genes=spark.createDataFrame([(4,)], "gene int")).select("gene").distinct().collect()[0].gene == 4


def test_genes_in_place_and_gathered_genes_fit_alike(spark, monkeypatch):
    bulk, signature, _ = planted(spark, 10, 5, 2)
    fits = []
    for most in (2_000_000, 0):
        monkeypatch.setattr(V, "PACKED_MOST", most)
        fit = V.fit_model(bulk, signature, reps=2, iterations=2, inner=6, update_sigma=True)
        keys = {"beta": ["sample", "celltype"], "alpha": ["sample", "celltype"], "nu": ["sample", "gene", "celltype"], "omega": ["gene", "celltype"], "sigma": ["gene", "sample"], "objective": ["rep"]}
        fits.append({name: frame.toPandas().sort_values(keys[name], ignore_index=True) for name, frame in fit.items()})
    for name, frame in fits[0].items():
        assert list(frame.columns) == list(fits[1][name].columns)
        for c in frame.columns:
            assert np.allclose(frame[c].to_numpy(float), fits[1][name][c].to_numpy(float), rtol=1e-6, atol=1e-8), (name, c)
