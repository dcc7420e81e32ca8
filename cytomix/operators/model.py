"""The mixture model of log bulk expression: expectations, objective terms, priors and checks. variational.py fits it.

Tables: beta (sample, celltype, beta), nu (sample, gene, celltype, nu), omega (gene, celltype, omega), y (gene, sample, y; log scale),
prior (gene, celltype, mu0, beta0). All sums are aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytomix.functions.special import digamma, lgamma


def fractions(beta: DataFrame) -> DataFrame:
    """beta with total (of the sample) and fraction; null where the total is zero."""
    return beta.withColumn("total", F.sum("beta").over(Window.partitionBy("sample"))).withColumn("fraction", F.try_divide("beta", "total"))


def bulk_moments(nu: DataFrame, omega: DataFrame, beta: DataFrame) -> DataFrame:
    """(gene, sample, mean, var) of linear bulk expression.

    Covariances between all pairs of cell types come from two sums, (sum u)^2 - sum u^2, so no pair is formed.
    """
    b = F.col("fraction")
    rows = nu.join(omega, ["gene", "celltype"]).join(fractions(beta), ["sample", "celltype"]).withColumn("w", F.col("omega") * F.col("omega"))
    u = b * F.exp(F.col("nu") + F.col("w") / 2)
    spread = b * (1 - b) / (F.col("total") + 1)
    own = F.exp(2 * F.col("nu") + 2 * F.col("w")) * (spread + b * b) - F.exp(2 * F.col("nu") + F.col("w")) * b * b
    sums = rows.groupBy("gene", "sample").agg(F.sum(u).alias("mean"), F.sum(u * u).alias("u2"), F.sum(own).alias("own"), F.max("total").alias("total"))
    return sums.select("gene", "sample", "mean", (F.col("own") - (F.col("mean") * F.col("mean") - F.col("u2")) / (1 + F.col("total"))).alias("var"))


def residual_terms(y: DataFrame, moments: DataFrame) -> DataFrame:
    """(gene, sample, a, r2): relative variance and squared residual of log expression under the second-order mean."""
    a = F.col("var") / (F.col("mean") * F.col("mean"))
    r = F.col("y") - F.log("mean") - a / 2
    return y.join(moments, ["gene", "sample"]).select("gene", "sample", a.alias("a"), (r * r).alias("r2"))


def sigma(terms: DataFrame, sample_specific: bool = False) -> DataFrame:
    """(gene, sample, sigma): root of a + r2; by default its mean over the gene's samples."""
    s = F.sqrt(F.col("a") + F.col("r2"))
    return terms.select("gene", "sample", (s if sample_specific else F.avg(s).over(Window.partitionBy("gene"))).alias("sigma"))


def likelihood_y(terms: DataFrame, sigmas: DataFrame | None = None) -> DataFrame:
    """One row, value: expected log likelihood of the bulk, up to constants, under sigmas (gene, sample, sigma), by default those of terms themselves."""
    if sigmas is None:
        miss = F.sqrt(F.col("a") + F.col("r2"))
        rows = terms.withColumn("sigma", F.avg(miss).over(Window.partitionBy("gene")))
    else:
        rows = terms.join(sigmas, ["gene", "sample"])
    return rows.agg(F.sum(-0.5 / (F.col("sigma") * F.col("sigma")) * (F.col("a") + F.col("r2"))).alias("value"))


def posterior_beta(nu: DataFrame, omega: DataFrame, prior: DataFrame, kappa0: float = 1.0) -> DataFrame:
    """(gene, celltype, n, post): the updated rate of each expression prior; n is the number of samples."""
    stats = nu.groupBy("gene", "celltype").agg(F.count("*").alias("n"), F.avg("nu").alias("m"), (F.var_pop("nu") * F.count("*")).alias("ss"))
    rows = stats.join(omega, ["gene", "celltype"]).join(prior.select("gene", "celltype", "mu0", "beta0"), ["gene", "celltype"]).withColumn("w", F.col("omega") * F.col("omega"))
    shift = F.col("w") / F.col("n") + F.pow(F.col("m") - F.col("mu0"), 2)
    post = F.col("beta0") + (F.col("n") - 1) / 2 * F.col("w") + kappa0 * F.col("n") / (2 * (kappa0 + F.col("n"))) * shift + F.col("ss") / 2
    return rows.select("gene", "celltype", "n", post.alias("post"))


def likelihood_x(post: DataFrame, alpha0: float = 1000.0) -> DataFrame:
    return post.agg(F.sum(-(alpha0 + F.col("n") / 2) * F.log("post")).alias("value"))


def entropy_x(omega: DataFrame, nu: DataFrame) -> DataFrame:
    """One row, value; nu (sample, ...) tells the number of samples."""
    samples = nu.agg(F.countDistinct("sample").alias("n"))
    return omega.agg(F.sum(F.log("omega")).alias("s")).join(samples).select((-F.col("n") * F.col("s")).alias("value"))


def dirichlet_terms(beta: DataFrame, alpha: DataFrame) -> DataFrame:
    """One row (pf, qf): expected log density of the fractions under the prior alpha (sample, celltype, alpha) and under beta itself."""
    rows = beta.join(alpha, ["sample", "celltype"]).withColumn("b0", F.sum("beta").over(Window.partitionBy("sample"))).withColumn("elog", digamma("beta") - digamma("b0"))
    by_sample = rows.groupBy("sample").agg(
        (lgamma(F.sum("alpha")) - F.sum(lgamma("alpha")) + F.sum((F.col("alpha") - 1) * F.col("elog"))).alias("p"), (lgamma(F.sum("beta")) - F.sum(lgamma("beta")) + F.sum((F.col("beta") - 1) * F.col("elog"))).alias("q")
    )
    return by_sample.agg(F.sum("p").alias("pf"), F.sum("q").alias("qf"))


def objective(px: DataFrame, qx: DataFrame, py: DataFrame, dirichlet: DataFrame, omega: DataFrame, weight: float = 1.0) -> DataFrame:
    """One row, value: (px - qx) / weight + py + sqrt(G / C) (pf - qf); omega (gene, celltype, ...) tells the numbers of genes and cell types."""
    sizes = omega.agg(F.countDistinct("gene").alias("g"), F.countDistinct("celltype").alias("c"))
    one = px.select(F.col("value").alias("px")).join(qx.select(F.col("value").alias("qx"))).join(py.select(F.col("value").alias("py"))).join(dirichlet).join(sizes)
    return one.select(((F.col("px") - F.col("qx")) / weight + F.col("py") + F.sqrt(F.col("g") / F.col("c")) * (F.col("pf") - F.col("qf"))).alias("value"))


def health(y: DataFrame, beta: DataFrame, alpha: DataFrame | None = None, prior: DataFrame | None = None, objective: DataFrame | None = None) -> DataFrame:
    """One row of what is wrong with a model: odd or negative y (log scale), numbers that must be positive but are not, and, as not_fitted, that there is no objective.

    alpha is (.., alpha); prior holds whichever of alpha0, beta0 and kappa0 vary. What is not given is not looked at.
    """

    def nonpositive(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.bool_or(F.col(name).isNull() | F.isnan(F.col(name).cast("double")) | (F.col(name) <= 0)).alias(f"nonpositive_{name}"))

    odd = F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))
    out = y.agg(F.bool_or(odd).alias("odd_y"), F.bool_or(F.col("y") < 0).alias("negative_y")).join(nonpositive(beta, "beta"))
    if alpha is not None:
        out = out.join(nonpositive(alpha, "alpha"))
    for name in ("alpha0", "beta0", "kappa0"):
        if prior is not None and name in prior.columns:
            out = out.join(nonpositive(prior, name))
    fitted = F.lit(False) if objective is None else None
    if fitted is not None:
        return out.withColumn("not_fitted", ~fitted)
    return out.join(objective.agg((F.count(F.when(~F.isnan("value"), 1)) == 0).alias("not_fitted")))


def mean_alpha(beta: DataFrame, by: list[str] | None = None) -> DataFrame:
    """alpha without a prior: each cell type's mean beta over samples, for every sample; for each group of the columns by on its own."""
    by = by or []
    return beta.join(beta.groupBy(*by, "celltype").agg(F.avg("beta").alias("alpha")), [*by, "celltype"]).select(*by, "sample", "celltype", "alpha")


def expectation_problems(expected: DataFrame, celltypes: DataFrame) -> DataFrame:
    """One row about prior fractions (sample, celltype, prior): whether any is exactly 0 or 1, and how many cell types have none at all."""
    missing = celltypes.join(expected, "celltype", "left_anti").agg(F.count("*").alias("missing_types"))
    return expected.agg(F.bool_or((F.col("prior") == 0) | (F.col("prior") == 1)).alias("any_certain")).join(missing)


def checked_prior(expected: DataFrame, celltypes: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(expected, members) as alpha_with_prior takes them, from prior fractions by cell type (sample, celltype, prior), or by group (sample, group, prior) with members (group, celltype).

    A prior of exactly 0 or 1, one by cell type that lacks a cell type, a group without members or members of unknown groups are errors. Nulls say nothing about a fraction.
    """
    if members is None:
        missing = [r["celltype"] for r in celltypes.select("celltype").distinct().join(expected, "celltype", "left_anti").take(5)]
        if missing:
            raise ValueError(f"the prior says nothing about cell types {missing}")
        expected = expected.select("sample", F.col("celltype").alias("group"), "prior")
        members = celltypes.select(F.col("celltype").alias("group"), "celltype").distinct()
        sums = expected
    else:
        if not expected.join(members, "group", "left_anti").isEmpty() or not members.join(expected, "group", "left_anti").isEmpty():
            raise ValueError("groups with a prior and groups with members differ")
        if not members.join(celltypes, "celltype", "left_anti").isEmpty():
            raise ValueError("a group has a member that is no cell type")
        sums = group_prior(expected, members)
    if not sums.where("prior = 0 or prior = 1").isEmpty():
        raise ValueError("a prior fraction is exactly 0 or 1")
    return expected, members


def group_prior(expected: DataFrame, members: DataFrame) -> DataFrame:
    """(sample, celltype, prior): group expectations (sample, group, prior) summed over the groups (group, celltype) that a type belongs to."""
    return expected.join(members, "group").groupBy("sample", "celltype").agg(F.sum("prior").alias("prior"))


def alpha_with_prior(beta: DataFrame, expected: DataFrame, members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """alpha where groups of cell types have an expected mass in a sample (null: none): within a group the shares of the mean beta keep their proportions, the other
    types share what is left, and the whole is scaled so that the unpinned types keep their mean beta. Each group of the columns by is on its own."""
    by = by or []
    mean = beta.groupBy(*by, "celltype").agg(F.avg("beta").alias("m"))
    mean = mean.withColumn("f", F.try_divide("m", F.sum("m").over(Window.partitionBy(*by))))  # cell types are few
    rows = beta.select(*by, "sample", "celltype").join(mean, [*by, "celltype"]).join(members, "celltype", "left").join(expected.where("prior is not null"), ["sample", "group"], "left")
    w = Window.partitionBy(*by, "sample")
    free = F.col("prior").isNull()
    rows = rows.withColumn("in_group", F.sum("f").over(Window.partitionBy(*by, "sample", "group")))
    rows = rows.withColumn("mass", F.sum(F.when(~free, F.try_divide("f", "in_group") * F.col("prior")).otherwise(0.0)).over(w))
    rows = rows.withColumn("free_f", F.sum(F.when(free, F.col("f")).otherwise(0.0)).over(w)).withColumn("free_m", F.sum(F.when(free, F.col("m")).otherwise(0.0)).over(w))
    share = F.when(free, F.try_divide("f", "free_f") * (1 - F.col("mass"))).otherwise(F.try_divide("f", "in_group") * F.col("prior"))
    scale = F.coalesce(F.try_divide(F.nullif("free_m", F.lit(0.0)), 1 - F.col("mass")), F.sum("m").over(w))
    return rows.select(*by, "sample", "celltype", (share * scale).alias("alpha"))


def sample_alpha(beta: DataFrame, expected: DataFrame | None = None, members: DataFrame | None = None, temperature: float | None = None, by: list[str] | None = None) -> DataFrame:
    """alpha by each sample's own fractions instead of their mean: in proportion to its beta, except that groups of cell types with an expected mass (null: none) get that mass, and the other types share what is left.

    A sample's alpha sums to temperature, or without one to the sum of its beta, so that alpha is beta itself where nothing is expected. Each group of the columns by is on its own.
    """
    keys = [*(by or []), "sample"]
    w = Window.partitionBy(*keys)
    rows = beta.withColumn("total", F.sum("beta").over(w)).select(*keys, "celltype", "total", F.try_divide("beta", F.col("total")).alias("f"))
    share = F.col("f")
    if expected is not None and members is not None:
        rows = rows.join(members, "celltype", "left").join(expected.where("prior is not null"), ["sample", "group"], "left")
        pinned = F.col("prior").isNotNull()
        rows = rows.withColumn("in_group", F.sum("f").over(Window.partitionBy(*keys, "group")))
        rows = rows.withColumn("pinned", F.when(pinned, F.try_divide("f", "in_group") * F.col("prior"))).withColumn("mass", F.coalesce(F.sum("pinned").over(w), F.lit(0.0)))
        rows = rows.withColumn("free_f", F.sum(F.when(pinned, 0.0).otherwise(F.col("f"))).over(w))
        share = F.when(pinned, F.col("pinned")).otherwise(F.try_divide("f", "free_f") * (1 - F.col("mass")))
    return rows.select(*keys, "celltype", (share * (F.col("total") if temperature is None else F.lit(float(temperature)))).alias("alpha"))
