import numpy as np
import pytest
from pyspark.sql import functions as F
from test_variational import planted

from cytomix.functions.minimise import minimise
from cytomix.operators import joint as J
from cytomix.operators import variational as V


def two_loops(steps, changes, q):
    """The recursion on whole vectors."""
    q, trail = q.copy(), []
    for s, y in zip(steps[::-1], changes[::-1], strict=True):
        a = s @ q / (s @ y)
        q -= a * y
        trail.append(a)
    q *= steps[-1] @ changes[-1] / (changes[-1] @ changes[-1])
    for s, y, a in zip(steps, changes, trail[::-1], strict=True):
        q += s * (a - y @ q / (s @ y))
    return q


def test_recursion_on_products_equals_that_on_vectors():
    rnd = np.random.default_rng(2)
    root = rnd.normal(size=(9, 9))
    steps = rnd.normal(size=(4, 9))
    changes, q = steps @ (root @ root.T + np.eye(9)), rnd.normal(size=9)
    basis = np.vstack((steps, changes, q))
    assert np.allclose(J.coefficients(basis @ basis.T, 4) @ basis, two_loops(list(steps), list(changes), q))
    assert J.coefficients(np.array([[0.25]]), 0).tolist() == [1.0] and J.coefficients(np.array([[100.0]]), 0).tolist() == [0.1]


@pytest.fixture(scope="module")
def case(spark):
    rnd = np.random.default_rng(11)
    genes, samples, types = 9, 5, 3
    mu = rnd.normal(2, 1, (genes, types))
    y = np.log(np.exp(mu) @ rnd.dirichlet(np.ones(types), samples).T + 1) + rnd.normal(0, 0.05, (genes, samples))
    beta0, omega = rnd.uniform(5, 20, (genes, types)), rnd.uniform(0.1, 0.4, (genes, types))
    beta = {r: rnd.uniform(0.5, 5, (samples, types)) for r in range(2)}
    rows = [(r, g, y[g].tolist(), [0.3] * samples, np.tile(mu[g], samples).tolist(), omega[g].tolist(), mu[g].tolist(), beta0[g].tolist()) for r in beta for g in range(genes)]
    kind = "rep int, gene int, y array<double>, sigma array<double>, nu array<double>, omega array<double>, mu0 array<double>, beta0 array<double>"
    frame = spark.createDataFrame(rows, kind).repartition(3)
    alpha = {r: np.ones((samples, types)) for r in beta}

    def whole(x, rep_free=None):
        """The objective, negated, and its gradient, of one flat vector: expression and spreads gene by gene, then fractions."""
        b = x[genes * (samples * types + types) :].reshape(samples, types)
        value, by_b = J.fractions_loss(b, alpha[0], 1.7)
        out = []
        for g in range(genes):
            own = x[g * (samples + 1) * types : (g + 1) * (samples + 1) * types]
            v, grad, more = J.gene_loss(y[g], np.full(samples, 0.3), own[: samples * types].reshape(samples, types), own[samples * types :], b, mu[g], beta0[g], 100.0, 1.0, 1.0)
            value, by_b = value + v, by_b + more
            out.append(grad)
        return value, np.concatenate([*out, by_b.ravel()])

    start = {r: np.concatenate([np.concatenate((np.tile(mu[g], samples), omega[g])) for g in range(genes)] + [beta[r].ravel()]) for r in beta}
    one = np.concatenate((np.full(samples * types, -np.inf), np.full(types, V.LEAST)))
    low = np.concatenate([*[one] * genes, np.full(samples * types, V.LEAST)])
    high = np.where(np.isinf(low), np.inf, V.MOST)
    return frame, beta, alpha, whole, start, low, high, genes, samples, types


def flat(ascent, rep, genes):
    rows = sorted(ascent.restarts[rep].rows.where(F.col("rep") == rep).collect(), key=lambda r: r.gene)
    assert len(rows) == genes
    return np.concatenate([np.frombuffer(r.x) for r in rows] + [ascent.restarts[rep].part.x])


def test_joint_ascent_equals_a_local_one(case):
    frame, beta, alpha, whole, start, low, high, genes, *_ = case
    ascent = J.Ascent(frame, beta, 1.7, alpha0=100.0, kappa0=1.0)
    ascent.begin(alpha)
    for r in beta:
        value, grad = whole(start[r])
        assert np.isclose(-ascent.objective()[r], value) and np.isclose(ascent.restarts[r].products[0, 0], (grad * ~J.held(start[r], grad, low, high)) @ grad)
    ascent.ascend(alpha, 25)
    for r in beta:
        x = flat(ascent, r, genes)
        assert np.isclose(whole(x)[0], ascent.restarts[r].value) and (x >= low).all() and (x <= high).all()
        _, best = minimise(whole, start[r], low, high, 25, memory=J.MEMORY)
        begun = whole(start[r])[0]
        assert begun - ascent.restarts[r].value > 0.97 * (begun - best)


def test_fixed_variables_stay(case):
    frame, beta, alpha, whole, start, low, high, genes, samples, types = case
    for fixed in (("beta",), ("nu", "omega")):
        ascent = J.Ascent(frame, beta, 1.7, alpha0=100.0, kappa0=1.0, fixed=fixed)
        ascent.begin(alpha)
        before = ascent.objective()[0]
        ascent.ascend(alpha, 4)
        same = flat(ascent, 0, genes) == start[0]
        own = np.concatenate([np.repeat([True, False], [samples * types, types])] * genes + [np.zeros(samples * types, bool)])
        fractions = np.arange(len(own)) >= genes * (samples + 1) * types
        assert same[fractions].all() == ("beta" in fixed) and same[own].all() == ("nu" in fixed) and ascent.objective()[0] > before
    with pytest.raises(ValueError, match="nothing to fix"):
        J.Ascent(frame, beta, 1.7, alpha0=100.0, kappa0=1.0, fixed=("gamma",))


def test_joint_fit_is_as_good_as_that_in_blocks(spark):
    bulk, signature, f = planted(spark, 12, 6, 2)
    args = {"sy": 0.05, "reps": 1, "iterations": 2, "update_sigma": False}
    joint, blocks = V.fit_model(bulk, signature, method="joint", inner=60, **args), V.fit_model(bulk, signature, **args)
    values = [m["objective"].where("best").head().value for m in (joint, blocks)]
    assert values[0] >= values[1] - 0.01 * abs(values[1])
    for name, frame in blocks.items():
        assert sorted(joint[name].dtypes) == sorted(frame.dtypes), name
        assert joint[name].count() == frame.count()
    got = {(r.sample, r.celltype): r.beta for r in joint["beta"].collect()}
    est = np.array([[got[s, c] for c in range(2)] for s in range(6)])
    assert np.corrcoef((est / est.sum(1, keepdims=True)).ravel(), f.ravel())[0, 1] > 0.97
    with pytest.raises(ValueError, match="method"):
        V.fit_model(bulk, signature, fixed=("nu",))


def test_objective_is_that_under_the_updated_alpha_and_sigma(spark):
    bulk, signature, _ = planted(spark, 8, 4, 2)
    for method in ("blocks", "joint"):
        fit = {k: v.toPandas() for k, v in V.fit_model(bulk, signature, reps=1, iterations=1, inner=5, update_sigma=True, method=method).items()}
        wide = lambda name, keys: fit[name].pivot(index=keys[0], columns=keys[1], values=name).to_numpy()
        beta, alpha, omega, sigma = wide("beta", ("sample", "celltype")), wide("alpha", ("sample", "celltype")), wide("omega", ("gene", "celltype")), wide("sigma", ("gene", "sample"))
        nu = fit["nu"].sort_values(["gene", "sample", "celltype"])["nu"].to_numpy().reshape(8, 4, 2)
        y = np.log1p(bulk.toPandas().pivot(index="gene", columns="sample", values="expr").to_numpy())
        mu = signature.toPandas().pivot(index="gene", columns="celltype", values="mu").to_numpy()
        want = -J.fractions_loss(beta, alpha, np.sqrt(8 / 2))[0] - sum(J.gene_loss(y[g], sigma[g], nu[g], omega[g], beta, mu[g], np.full(2, 1000 * 0.1**2), 1000.0, 1.0, 1.0)[0] for g in range(8))
        assert np.allclose(alpha, beta.mean(0)) and np.isclose(fit["objective"]["value"][0], want, rtol=1e-6)
