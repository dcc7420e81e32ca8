"""Fitting the mixture model of log bulk expression: starts from support vector regression, then ascent of the objective in blocks.

With the fractions given, genes are independent of each other; with the expression given, samples are. So an iteration is a job of small
problems by gene, one by sample, and sums. Restarts (rep) are further groups of the same jobs. The work table has a row for each rep, gene and sample:
y (log expression), sigma (its spread), and arrays over the cell types in one order, nu (mean log expression) and omega (spread over samples); beta has a row for each rep and sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomix.functions.minimise import minimise
from cytomix.functions.special import gamma_terms
from cytomix.functions.support import support_regression
from cytomix.operators.model import alpha_with_prior, mean_alpha, sample_alpha
from cytomix.sources.stored import stored

#: Bounds of omega and beta.
LEAST, MOST = 1e-7, 100.0
#: Numbers (samples by cell types by restarts) of the fractions that are broadcast to genes that stay in place; beyond, genes are gathered from rows by sample.
PACKED_MOST = 2_000_000
#: Shares of errors and support vectors that the regressions for the start are tried with.
NUS = (0.25, 0.5, 0.75)


def moment_terms(y: np.ndarray, sigma: np.ndarray, nu: np.ndarray, omega: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The expected log likelihood of values y (any number of rows) and its gradients by nu, omega and beta, row by row; and the relative spread a + r2 of each row.

    nu, omega and beta have a row for each value and a column for each cell type.
    """
    total = beta.sum(1, keepdims=True)
    b, w = beta / total, omega * omega
    e = np.exp(nu + w / 2)
    square, spread = e * e, b * (1 - b) / (total + 1)
    wide = square * np.exp(w)
    u = b * e
    mean = u.sum(1, keepdims=True)
    own = wide * (spread + b * b)
    cross = (mean * mean - (u * u).sum(1, keepdims=True)) / (1 + total)
    var = (own - u * u).sum(1, keepdims=True) - cross
    a = var / (mean * mean)
    r = y[:, None] - np.log(mean) - a / 2
    scale = -0.5 / (sigma[:, None] ** 2)
    by_var, by_mean = scale * (1 - r) / (mean * mean), scale * (-2 * (1 - r) * a / mean - 2 * r / mean)
    pull = 2 * u * (mean - u) / (1 + total)  # of cross, by nu
    by_nu = by_mean * u + by_var * (2 * own - 2 * u * u - pull)
    by_omega = omega * (by_mean * u + by_var * (4 * own - 2 * u * u - pull))
    slope = by_mean * e + by_var * (wide * ((1 - 2 * b) / (total + 1) + 2 * b) - 2 * b * square - 2 * e * (mean - u) / (1 + total))
    by_total = by_var * (cross - (wide * spread).sum(1, keepdims=True)) / (1 + total)
    by_beta = (slope - (slope * b).sum(1, keepdims=True)) / total + by_total
    miss = a + r * r
    return (scale * miss)[:, 0], by_nu, by_omega, by_beta, miss[:, 0]


def expression_terms(nu: np.ndarray, omega: np.ndarray, mu0: np.ndarray, beta0: np.ndarray, alpha0: float, kappa0: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior less entropy of one gene's expression (px - qx), and its gradients by nu (samples by types) and omega (types)."""
    s = len(nu)
    mean = nu.mean(0)
    w, shift = omega * omega, mean - mu0
    post = beta0 + (s - 1) / 2 * w + kappa0 * s / (2 * (kappa0 + s)) * (w / s + shift * shift) + ((nu - mean) ** 2).sum(0) / 2
    weight = -(alpha0 + s / 2) / post
    by_nu = weight * (kappa0 * shift / (kappa0 + s) + nu - mean)
    by_omega = weight * omega * (s - 1 + kappa0 / (kappa0 + s)) + s / omega
    return float((-(alpha0 + s / 2) * np.log(post)).sum() + s * np.log(omega).sum()), by_nu, by_omega


def fraction_terms(beta: np.ndarray, alpha: np.ndarray) -> tuple[float, np.ndarray]:
    """Expected log density of a sample's fractions under the prior less that under beta itself (pf - qf), and its gradient by beta."""
    at = np.concatenate((beta, [beta.sum()]))
    logs, first, second = gamma_terms(at)
    prior = gamma_terms(np.concatenate((alpha, [alpha.sum()])))[0]
    gap = alpha - beta
    value = prior[-1] - prior[:-1].sum() - logs[-1] + logs[:-1].sum() + (gap * (first[:-1] - first[-1])).sum()
    return float(value), gap * second[:-1] - gap.sum() * second[-1]


def fit_gene(y: np.ndarray, sigma: np.ndarray, nu: np.ndarray, omega: np.ndarray, beta: np.ndarray, mu0: np.ndarray, beta0: np.ndarray, alpha0: float, kappa0: float, weight: float, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """nu and omega of one gene that raise the objective with the fractions held, and its value but for terms of beta alone."""
    s, c = nu.shape

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        n, o = x[: s * c].reshape(s, c), x[s * c :]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            value, by_nu, by_omega, _, _ = moment_terms(y, sigma, n, np.broadcast_to(o, (s, c)), beta)
            prior, prior_nu, prior_omega = expression_terms(n, o, mu0, beta0, alpha0, kappa0)
            return -float(value.sum()) - prior / weight, -np.concatenate(((by_nu + prior_nu / weight).ravel(), by_omega.sum(0) + prior_omega / weight))

    low = np.concatenate((np.full(s * c, -np.inf), np.full(c, LEAST)))
    high = np.concatenate((np.full(s * c, np.inf), np.full(c, MOST)))
    x, value = minimise(loss, np.concatenate((nu.ravel(), omega)), low, high, rounds)
    return x[: s * c].reshape(s, c), x[s * c :], -value


def fit_sample(y: np.ndarray, sigma: np.ndarray, nu: np.ndarray, omega: np.ndarray, beta: np.ndarray, alpha: np.ndarray, balance: float, rounds: int) -> tuple[np.ndarray, float]:
    """beta of one sample that raises the objective with the expression held, and its value but for terms of the expression alone."""

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            value, _, _, by_beta, _ = moment_terms(y, sigma, nu, omega, np.broadcast_to(x, nu.shape))
            gain, by_prior = fraction_terms(x, alpha)
            return -float(value.sum()) - balance * gain, -by_beta.sum(0) - balance * by_prior

    x, value = minimise(loss, beta, LEAST, MOST, rounds)
    return x, -value


def _arrays(signature: DataFrame, types: list) -> DataFrame:
    """(gene, mu, std), arrays over types, for the genes that have all types."""
    rows = signature.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("celltype", "mu", "std"))).alias("s")).where(F.size("s") == len(types))
    return rows.select("gene", F.col("s.mu").alias("mu"), F.col("s.std").alias("std"))


def cell_types(signature: DataFrame) -> list:
    """The cell types in their order; they are few."""
    return [r["celltype"] for r in signature.select("celltype").distinct().orderBy("celltype").collect()]


def regressions(bulk: DataFrame, signature: DataFrame, nus: tuple[float, ...] = NUS) -> DataFrame:
    """(sample, fraction, support, nu, residual): linear expression of each sample regressed on the signature's, by the share nu of least error. fraction holds the coefficients over the cell types in their order, cut
    off at zero and scaled to one, even where none is positive; support the genes that carry the regression; residual the largest violation of its optimality conditions."""
    types = cell_types(signature)
    rows = bulk.join(_arrays(signature, types), "gene").select("sample", "gene", "expr", F.transform("mu", F.expm1).alias("x"))
    kind = {f.name: f.dataType.simpleString() for f in bulk.schema.fields}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("gene", ignore_index=True)
        x, y = np.stack(group["x"].to_list()), group["expr"].to_numpy(float)
        nu, best = min(((nu, support_regression(x, y, nu)) for nu in nus), key=lambda found: found[1].error(x, y))
        share = np.maximum(best.coef, 0.0)
        share = share / share.sum() if share.sum() > 0 else np.full(len(types), 1 / len(types))
        return pd.DataFrame({"sample": group["sample"].iloc[:1], "fraction": [share], "support": [group["gene"].to_numpy()[best.support()]], "nu": nu, "residual": best.residual})

    return rows.groupBy("sample").applyInPandas(fit, f"sample {kind['sample']}, fraction array<double>, support array<{kind['gene']}>, nu double, residual double")


def regression_start(bulk: DataFrame, signature: DataFrame, nus: tuple[float, ...] = NUS) -> DataFrame:
    """(sample, celltype, fraction): the fractions of regressions()."""
    kind = signature.schema["celltype"].dataType.simpleString()
    types = F.array(*[F.lit(t).cast(kind) for t in cell_types(signature)])
    return regressions(bulk, signature, nus).select("sample", F.explode(F.arrays_zip(types.alias("celltype"), F.col("fraction").alias("fraction"))).alias("t")).select("sample", "t.*")


def supported_genes(found: DataFrame, share: float) -> DataFrame:
    """(gene, n): genes that carry the regressions() found of more than this share of the samples, and of how many."""
    samples = found.agg((F.count(F.lit(1)) * share).alias("least"))
    return found.select(F.explode("support").alias("gene")).groupBy("gene").agg(F.count(F.lit(1)).alias("n")).join(samples).where("n > least").select("gene", "n")


def fit_model(
    bulk: DataFrame, signature: DataFrame, *, alpha: float = 1.0, alpha0: float = 1000.0, kappa0: float = 1.0, sy: float = 1.0, reps: int = 10, trust: float = 10.0, update_sigma: bool = False,
    expected: DataFrame | None = None, members: DataFrame | None = None, iterations: int = 100, tolerance: float = 1e-3, inner: int = 40, seed: int = 0, method: str = "blocks", fixed: tuple[str, ...] = (), share: float = 0.0, temperature: tuple[float, float] | None = None,
) -> dict[str, DataFrame]:
    """beta (sample, celltype, beta), alpha, nu (sample, gene, celltype, nu), omega (gene, celltype, omega) and objective (rep, value) of the best of reps restarts.

    bulk is (gene, sample, expr), signature (gene, celltype, mu, std), expected and members a prior by groups as alpha_with_prior takes it. A restart begins with regression fractions times
    trust plus unit gamma noise; then each iteration fits every sample, every gene, the prior alpha, and if wanted sigma. Its objective is that under the updated alpha and sigma. It ends when no restart's
    objective moves by tolerance, or after iterations. Between iterations tables are stored, so that lost executors cost one step. Genes that lack a sample or a cell type take no part.

    With temperature (first, last) the prior alpha anneals: it follows each sample's own fractions, and sums to numbers that run from first to last over the iterations.

    With share over 0 only the genes take part that carry the regressions of more than this share of the samples.

    method blocks raises the objective by samples and by genes in turn, with inner steps in each; joint takes inner steps of all variables together (joint.Ascent), where fixed may name those of nu, omega and
    beta that stay as they begin. A joint fit holds the fractions of all restarts in the driver, and raises an error beyond joint.FRACTIONS_MOST numbers.
    """
    if method not in ("blocks", "joint") or (fixed and method == "blocks"):
        raise ValueError("method is blocks, or joint, which alone can fix variables")
    types = cell_types(signature)
    n_types, n_samples = len(types), bulk.select("sample").distinct().count()
    spark = bulk.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in [*bulk.schema.fields, *signature.schema.fields]}
    start = stored(regressions(bulk, signature), "model-start")
    if share > 0:
        bulk = bulk.join(supported_genes(start, share).select("gene"), "gene", "left_semi")
    whole = bulk.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), (F.stddev_pop(F.log1p("expr")) * sy + 0.1).alias("sigma")).where(F.col("n") == n_samples).select("gene", "sigma")
    prior = _arrays(signature, types).join(whole, "gene").withColumn("beta0", F.transform("std", lambda s: alpha0 * s * s))
    prior = stored(prior, "model-prior")
    n_genes = prior.count()
    if not n_genes:
        raise ValueError("bulk and signature share no gene that has all samples and cell types")
    balance = float(np.sqrt(n_genes / n_types))
    runs = spark.range(reps).select(F.col("id").cast("int").alias("rep"))
    work = bulk.join(prior, "gene").select("gene", "sample", F.log1p("expr").alias("y"), "sigma", F.col("mu").alias("nu"), F.col("std").alias("omega"))
    work = stored(work.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))), "model-work")

    def begin(batches):
        for batch in batches:
            beta = []
            for rep, sample, share in zip(batch["rep"], batch["sample"], batch["fraction"], strict=True):
                noise = np.random.default_rng([seed, int(rep), *str(sample).encode()]).gamma(1.0, size=n_types)
                beta.append(np.clip(noise + trust * np.asarray(share), LEAST, MOST))
            yield pd.DataFrame({"rep": batch["rep"], "sample": batch["sample"], "beta": beta})

    beta = stored(start.select("sample", "fraction").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).mapInPandas(begin, f"rep int, sample {kind['sample']}, beta array<double>"), "model-beta")
    beta = beta.withColumn("alpha", F.transform("beta", lambda b: F.lit(float(alpha))))
    if method == "joint":
        return _fit_jointly(work, prior, beta, types, kind, balance, alpha0=alpha0, kappa0=kappa0, update_sigma=update_sigma, expected=expected, members=members, iterations=iterations, tolerance=tolerance, inner=inner, fixed=fixed, temperature=temperature)

    def raised(y: np.ndarray, sigma: np.ndarray, nu: np.ndarray, omega: np.ndarray, mu: np.ndarray, beta0: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """One gene's sigma, nu and omega after its steps, and its part of the objective."""
        nu, omega, value = fit_gene(y, sigma, nu, omega, now, mu, beta0, alpha0, kappa0, 1.0, inner)
        if update_sigma:
            sigma = np.full(len(y), np.sqrt(np.maximum(moment_terms(y, sigma, nu, np.broadcast_to(omega, nu.shape), now)[4], 1e-12)).mean())
            value = float(moment_terms(y, sigma, nu, np.broadcast_to(omega, nu.shape), now)[0].sum()) + expression_terms(nu, omega, mu, beta0, alpha0, kappa0)[0]
        return sigma, nu, omega, value

    def genes(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sample", ignore_index=True)
        y = group["y"].to_numpy()
        sigma, nu, omega, value = raised(y, group["sigma"].to_numpy(), *(np.stack(group["nu"].to_list()), *(np.array(group[c].iloc[0]) for c in ("omega", "mu", "beta0"))), np.stack(group["beta"].to_list()))
        return pd.DataFrame({"rep": group["rep"], "gene": group["gene"], "sample": group["sample"], "y": y, "sigma": sigma, "nu": list(nu), "omega": [omega] * len(y), "value": value / len(y)})

    def samples(group: pd.DataFrame) -> pd.DataFrame:
        y, sigma, nu, omega = group["y"].to_numpy(), group["sigma"].to_numpy(), np.stack(group["nu"].to_list()), np.stack(group["omega"].to_list())
        alpha = np.array(group["alpha"].iloc[0])
        found, _ = fit_sample(y, sigma, nu, omega, np.array(group["beta"].iloc[0]), alpha, balance, inner)
        return pd.DataFrame({"rep": group["rep"].iloc[:1], "sample": group["sample"].iloc[:1], "beta": [found]})

    def gains(batches):
        for batch in batches:
            yield pd.DataFrame({"rep": batch["rep"], "v": [balance * fraction_terms(np.asarray(b), np.asarray(a))[0] for b, a in zip(batch["beta"], batch["alpha"], strict=True)]})

    def long(b: DataFrame) -> DataFrame:
        entries = F.explode(F.arrays_zip(F.array(*[F.lit(t).cast(kind["celltype"]) for t in types]).alias("celltype"), F.col("beta").alias("beta")))
        return b.select("rep", "sample", entries.alias("t")).select("rep", "sample", "t.celltype", "t.beta")

    row = f"rep int, gene {kind['gene']}, sample {kind['sample']}, y double, sigma double, nu array<double>, omega array<double>, value double"
    whole_row = f"rep int, gene {kind['gene']}, sample array<{kind['sample']}>, y array<double>, sigma array<double>, nu array<array<double>>, omega array<double>, mu array<double>, beta0 array<double>, value double"
    packed = n_samples * n_types * reps <= PACKED_MOST
    if packed:
        v = work.groupBy("rep", "gene").agg(F.sort_array(F.collect_list(F.struct("sample", "y", "sigma", "nu"))).alias("v"), F.first("omega").alias("omega")).join(prior.select("gene", "mu", "beta0"), "gene")
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
        v = v.select("rep", "gene", *[F.col(f"v.{c}").alias(c) for c in ("sample", "y", "sigma", "nu")], "omega", "mu", "beta0")
        work = stored(v.repartition(parts, "rep", "gene"), "model-work")

    def by_sample(work: DataFrame) -> DataFrame:
        """(rep, gene, sample, y, sigma, nu, omega)."""
        if packed:
            work = work.select("rep", "gene", "omega", F.explode(F.arrays_zip("sample", "y", "sigma", "nu")).alias("t")).select("rep", "gene", "omega", "t.*")
        return work.select("rep", "gene", "sample", "y", "sigma", "nu", "omega")

    def in_place(work: DataFrame, fitted: DataFrame) -> DataFrame:
        """Packed rows after their steps: a gene stays where it is, and the fractions come to it."""
        known = fitted.toPandas().sort_values(["rep", "sample"])
        shared = spark.sparkContext.broadcast({int(rep): np.stack(rows["beta"].to_list()) for rep, rows in known.groupby("rep")})

        def run(batches):
            for batch in batches:
                out = batch.drop(columns=["sigma", "nu", "omega"])
                found = [raised(*(np.array(v) for v in (r.y, r.sigma)), np.stack(r.nu), *(np.array(v) for v in (r.omega, r.mu, r.beta0)), shared.value[r.rep]) for r in batch.itertuples()]
                yield out.assign(sigma=[f[0] for f in found], nu=[list(f[1]) for f in found], omega=[f[2] for f in found], value=[f[3] for f in found])

        return work.select("rep", "gene", "sample", "y", "sigma", "nu", "omega", "mu", "beta0").mapInPandas(run, whole_row)

    last = None
    for turn in range(max(1, iterations)):
        ready = by_sample(work).join(beta, ["rep", "sample"])
        fitted = stored(ready.groupBy("rep", "sample").applyInPandas(samples, f"rep int, sample {kind['sample']}, beta array<double>"), "model-beta")
        if packed:
            moved = in_place(work, fitted)
        else:
            moved = by_sample(work).join(fitted.select("rep", "sample", "beta"), ["rep", "sample"]).join(prior.select("gene", "mu", "beta0"), "gene").groupBy("rep", "gene").applyInPandas(genes, row)
        work = stored(moved, "model-work")
        alphas = _alphas(long(fitted), expected, members, _heat(temperature, turn, iterations))
        alphas = alphas.groupBy("rep", "sample").agg(F.transform(F.sort_array(F.collect_list(F.struct("celltype", "alpha"))), lambda t: t["alpha"]).alias("alpha"))
        beta = stored(fitted.select("rep", "sample", "beta").join(alphas, ["rep", "sample"]), "model-beta")
        parts = work.groupBy("rep").agg(F.sum("value").alias("v")).unionByName(beta.mapInPandas(gains, "rep int, v double").groupBy("rep").agg(F.sum("v").alias("v")))
        objective = stored(parts.groupBy("rep").agg(F.sum("v").alias("value")), "model-objective")
        values = {r["rep"]: r["value"] for r in objective.collect()}
        if last is not None and all(abs(values[r] - last[r]) < tolerance for r in values):
            break
        last = values
    best = max((r for r in values if np.isfinite(values[r])), key=lambda r: (values[r], -r))
    chosen, kept = beta.where(F.col("rep") == best), by_sample(work.where(F.col("rep") == best))
    zipped = lambda name, column: F.explode(F.arrays_zip(F.array(*[F.lit(t).cast(kind["celltype"]) for t in types]).alias("celltype"), F.col(column).alias(name))).alias("t")
    return {
        "beta": chosen.select("sample", zipped("beta", "beta")).select("sample", "t.*"),
        "alpha": chosen.select("sample", zipped("alpha", "alpha")).select("sample", "t.*"),
        "nu": kept.select("sample", "gene", zipped("nu", "nu")).select("sample", "gene", "t.*"),
        "omega": kept.groupBy("gene").agg(F.min("omega").alias("omega")).select("gene", zipped("omega", "omega")).select("gene", "t.*"),
        "sigma": kept.select("gene", "sample", "sigma"),
        "objective": objective.withColumn("best", F.col("rep") == best),
    }


def _fit_jointly(work: DataFrame, prior: DataFrame, beta: DataFrame, types: list, kind: dict[str, str], balance: float, *, alpha0: float, kappa0: float, update_sigma: bool, expected: DataFrame | None, members: DataFrame | None, iterations: int, tolerance: float, inner: int, fixed: tuple[str, ...], temperature: tuple[float, float] | None) -> dict[str, DataFrame]:
    """fit_model() by joint ascent: rows of whole genes, fractions in the driver."""
    from cytomix.operators import joint

    spark, n_types = work.sparkSession, len(types)
    if beta.count() * n_types > joint.FRACTIONS_MOST:
        raise ValueError("too many samples for fractions that are broadcast: use method blocks")
    known = beta.toPandas().sort_values(["rep", "sample"])
    samples = list(known["sample"][known["rep"] == known["rep"].min()])
    stacked = lambda column: {int(r): np.stack(rows[column].to_list()) for r, rows in known.groupby("rep")}
    begin, alpha = stacked("beta"), stacked("alpha")
    rows = work.groupBy("rep", "gene").agg(F.sort_array(F.collect_list(F.struct("sample", "y", "sigma", "nu"))).alias("v"), F.first("omega").alias("omega"))
    rows = rows.select("rep", "gene", F.col("v.y").alias("y"), F.col("v.sigma").alias("sigma"), F.flatten("v.nu").alias("nu"), "omega").join(prior.select("gene", F.col("mu").alias("mu0"), "beta0"), "gene")
    ascent = joint.Ascent(rows, begin, balance, alpha0=alpha0, kappa0=kappa0, fixed=fixed)

    def long(values: dict[int, np.ndarray], name: str) -> DataFrame:
        parts = [pd.DataFrame({"rep": rep, "sample": np.repeat(np.array(samples, object), n_types), "celltype": np.tile(np.array(types, object), len(samples)), name: v.ravel()}) for rep, v in values.items()]
        return spark.createDataFrame(pd.concat(parts), f"rep int, sample {kind['sample']}, celltype {kind['celltype']}, {name} double")

    def updated(now: dict[int, np.ndarray], heat: float | None) -> dict[int, np.ndarray]:
        if heat is None and (expected is None or members is None):
            return {rep: np.tile(b.mean(0), (len(b), 1)) for rep, b in now.items()}
        found = _alphas(long(now, "beta"), expected, members, heat).toPandas().sort_values(["rep", "sample", "celltype"])
        return {int(rep): part["alpha"].to_numpy().reshape(len(samples), n_types) for rep, part in found.groupby("rep")}

    ascent.begin(alpha)
    last = ascent.objective()
    for turn in range(max(1, iterations)):
        ascent.ascend(alpha, inner)
        alpha = updated({rep: f.part.x.reshape(-1, n_types) for rep, f in ascent.restarts.items()}, _heat(temperature, turn, iterations))
        if update_sigma:
            ascent.update_sigma()
        ascent.begin(alpha)
        values = ascent.objective()
        moved, last = any(abs(values[r] - last[r]) >= tolerance for r in values), values
        if not moved:
            break
    best = max((r for r in last if np.isfinite(last[r])), key=lambda r: (last[r], -r))
    fitted = stored(ascent.fitted().where(F.col("rep") == best), "model-fitted")
    names = [F.array(*[F.lit(x).cast(kind[k]) for x in of]) for k, of in (("sample", samples), ("celltype", types))]
    by_sample = fitted.select("gene", F.explode(F.arrays_zip(names[0].alias("sample"), F.col("nu").alias("nu"), F.col("sigma").alias("sigma"))).alias("t")).select("gene", "t.*")
    return {
        "beta": long({best: ascent.restarts[best].part.x}, "beta").drop("rep"),
        "alpha": long({best: alpha[best]}, "alpha").drop("rep"),
        "nu": by_sample.select("sample", "gene", F.explode(F.arrays_zip(names[1].alias("celltype"), F.col("nu").alias("nu"))).alias("t")).select("sample", "gene", "t.*"),
        "omega": fitted.select("gene", F.explode(F.arrays_zip(names[1].alias("celltype"), F.col("omega").alias("omega"))).alias("t")).select("gene", "t.*"),
        "sigma": by_sample.select("gene", "sample", "sigma"),
        "objective": spark.createDataFrame([(r, float(v), r == best) for r, v in sorted(last.items())], "rep int, value double, best boolean"),
    }


def _heat(temperature: tuple[float, float] | None, turn: int, iterations: int) -> float | None:
    """What alpha sums to in one of the iterations."""
    return None if temperature is None else temperature[0] + (temperature[1] - temperature[0]) * turn / max(1, iterations - 1)


def _alphas(beta: DataFrame, expected: DataFrame | None, members: DataFrame | None, heat: float | None = None) -> DataFrame:
    """alpha (rep, sample, celltype, alpha) from beta with a column rep: each restart's own."""
    if heat is not None:
        return sample_alpha(beta, expected, members, heat, ["rep"])
    if expected is None or members is None:
        return mean_alpha(beta, ["rep"])
    return alpha_with_prior(beta, expected, members, ["rep"])


def refine_genes(bulk: DataFrame, signature: DataFrame, beta: DataFrame, *, omega: DataFrame | None = None, genes: DataFrame | None = None, weight: float = 100.0, alpha0: float = 1000.0, kappa0: float = 1.0, sy: float = 1.0, iterations: int = 1000, tolerance: float = 1e-3) -> DataFrame:
    """(gene, celltype, sample, nu, omega) with beta (sample, celltype, beta) held: a model for each gene, so genes are independent groups.

    bulk is (gene, sample, expr), signature (gene, celltype, mu, std); omega (gene, celltype, omega) starts the spreads in place of the signature's, and genes (gene) restricts the work. The
    prior counts by 1 / weight. A gene is fitted again until its objective moves by less than tolerance. Samples that a gene lacks are left out of its fit; cell types that the signature lacks for a gene
    have no part in it.
    """
    kind = {f.name: f.dataType.simpleString() for f in [*bulk.schema.fields, *signature.schema.fields]}
    if genes is not None:
        bulk = bulk.join(genes.select("gene").distinct(), "gene", "left_semi")
    spread = signature.select("gene", "celltype", "mu", "std")
    if omega is not None:
        spread = spread.join(omega.select("gene", "celltype", "omega"), ["gene", "celltype"], "left").withColumn("omega", F.coalesce("omega", "std"))
    else:
        spread = spread.withColumn("omega", F.col("std"))
    share = beta.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("celltype", "beta"))).alias("beta"))
    own = spread.join(beta.select("celltype").distinct(), "celltype", "left_semi").groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("celltype", "mu", "std", "omega"))).alias("s"))
    rows = bulk.select("gene", "sample", F.log1p("expr").alias("y")).join(own, "gene").join(share, "sample")
    rows = rows.select("gene", "sample", "y", F.col("s.celltype").alias("celltype"), F.col("s.mu").alias("mu"), F.col("s.std").alias("std"), F.col("s.omega").alias("omega"), F.transform("s", lambda t: F.coalesce(F.try_element_at("beta", t["celltype"]), F.lit(LEAST))).alias("beta"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sample", ignore_index=True)
        y, now = group["y"].to_numpy(), np.maximum(np.stack(group["beta"].to_list()), LEAST)
        mu, std, wide = (np.array(group[c].iloc[0]) for c in ("mu", "std", "omega"))
        nu, sigma, last = np.tile(mu, (len(y), 1)), np.full(len(y), y.std() * sy + 0.1), -np.inf
        for _ in range(iterations):
            nu, wide, value = fit_gene(y, sigma, nu, np.clip(wide, LEAST, MOST), now, mu, alpha0 * std * std, alpha0, kappa0, weight, 100)
            if abs(value - last) < tolerance:
                break
            last = value
        s, c = np.indices(nu.shape)
        return pd.DataFrame({"gene": group["gene"].iloc[0], "celltype": np.array(group["celltype"].iloc[0])[c.ravel()], "sample": group["sample"].to_numpy()[s.ravel()], "nu": nu.ravel(), "omega": wide[c.ravel()]})

    return rows.groupBy("gene").applyInPandas(fit, f"gene {kind['gene']}, celltype {kind['celltype']}, sample {kind['sample']}, nu double, omega double")
