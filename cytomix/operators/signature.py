"""Signatures from single cells: checks, moments, variable genes, markers and variance trend."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytomix.operators.bulk import bland_altman_of, without
from cytomix.sources.stored import stored


def summary(cells: DataFrame) -> DataFrame:
    """One row: extremes, mean, population deviation, median, and what speaks against log values (max over 50, or over 99% of non-zeros whole)."""
    whole = F.avg(F.when(F.col("x") != 0, (F.abs(F.col("x") - F.rint("x")) < 1e-10).cast("double")))
    out = cells.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.avg("x").alias("mean_x"), F.stddev_pop("x").alias("std_x"), F.median("x").alias("median_x"), whole.alias("whole_share"))
    return out.withColumn("not_logged", (F.col("max_x") > 50) | (F.coalesce("whole_share", F.lit(0.0)) > 0.99)).withColumn("any_negative", F.col("min_x") < 0)


def moments(cells: DataFrame) -> DataFrame:
    """(gene, celltype, n, mu, std, var) with 0.01 added to both spreads (population). Rows without a type are left out; every cell has a row for every gene."""
    return cells.where(F.col("celltype").isNotNull()).groupBy("gene", "celltype").agg(F.count("*").alias("n"), F.avg("x").alias("mu"), (F.stddev_pop("x") + 0.01).alias("std"), (F.var_pop("x") + 0.01).alias("var"))


def _with_zeros(stored: DataFrame, cells: Column, keys: list[str]) -> DataFrame:
    """keys with n (cells), m and v: mean and population variance of all cells, from n_s, m_s and v_s of the stored values; the other cells hold zeros. Variances are combined, not differences of squares."""
    n_s, m_s, v_s = (F.coalesce(c, F.lit(0)).cast("double") for c in ("n_s", "m_s", "v_s"))
    zeros = cells - n_s
    return stored.select(*keys, cells.alias("n"), (n_s * m_s / cells).alias("m"), ((n_s * v_s + n_s * zeros / cells * m_s * m_s) / cells).alias("v"))


def _stored(expr: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return expr.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_s"), F.avg(value).alias("m_s"), F.var_pop(value).alias("v_s"))


def _typed(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("celltype").isNotNull()).select("cell_id", "celltype")


def sparse_moments(cells: DataFrame, expr: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """As moments, from cells (cell_id, celltype) and triplets (cell_id, gene, x), one at most for each cell and gene: absent entries are zeros. genes (gene) may name genes without any triplet."""
    cells = _typed(cells)
    sizes = cells.groupBy("celltype").agg(F.count(F.lit(1)).alias("cells"))
    stored = _stored(expr.join(cells, "cell_id"), ["gene", "celltype"], F.col("x"))
    names = stored.select("gene").distinct() if genes is None else genes.select("gene").distinct()
    grid = names.crossJoin(F.broadcast(sizes)).join(stored, ["gene", "celltype"], "left")  # types are few
    out = _with_zeros(grid, F.col("cells"), ["gene", "celltype"])
    return out.select("gene", "celltype", "n", F.col("m").alias("mu"), (F.sqrt("v") + 0.01).alias("std"), (F.col("v") + 0.01).alias("var"))


def sparse_gene_moments(cells: DataFrame, expr: DataFrame, genes: DataFrame | None = None, linear: bool = False) -> DataFrame:
    """(gene, n, m, v): mean and population variance of each gene over all cells that have a type, of the values or, if linear, of exp(x) - 1; absent entries are zeros in both."""
    cells = _typed(cells)
    stored = _stored(expr.join(cells.select("cell_id"), "cell_id", "left_semi"), ["gene"], F.expm1("x") if linear else F.col("x"))
    if genes is not None:
        stored = genes.select("gene").distinct().join(stored, "gene", "left")
    return _with_zeros(stored.crossJoin(F.broadcast(cells.agg(F.count(F.lit(1)).alias("cells")))), F.col("cells"), ["gene"])  # one row


def with_variance_floor(signature: DataFrame) -> DataFrame:
    """0.01 added to every var if any is zero."""
    flag = signature.agg(F.bool_or(F.col("var") == 0).alias("any_zero"))
    return signature.join(flag).withColumn("var", F.when(F.col("any_zero"), F.col("var") + 0.01).otherwise(F.col("var"))).drop("any_zero")


def range_flags(signature: DataFrame) -> DataFrame:
    return signature.agg(F.min("var").alias("min_var"), F.max("var").alias("max_var")).withColumn("odd_range", (F.col("min_var") < 1e-6) | (F.col("max_var") > 10))


def dispersion(cells: DataFrame, n_bins: int = 20) -> DataFrame:
    """(gene, mean, disp, bin, disp_norm): log dispersion of linear expression, standardised within equal-width bins of the log mean.

    Bins are closed on the right and the lowest edge reaches 0.1% further. A bin's single gene has its own dispersion as spread and a mean of zero. A bin's two genes lie at the root of a half, above and below,
    whatever their dispersions; that is written as such, so that the genes of several such bins tie exactly instead of by rounding.
    """
    return dispersion_of(cells.groupBy("gene").agg(F.avg(F.expm1("x")).alias("m"), F.var_pop(F.expm1("x")).alias("v")), n_bins)


def dispersion_of(stats: DataFrame, n_bins: int = 20) -> DataFrame:
    """dispersion() from (gene, m, v), mean and variance of linear expression."""
    stats = stats.withColumn("m", F.when(F.col("m") == 0, 1e-12).otherwise(F.col("m"))).withColumn("d", F.nullif(F.col("v") / F.col("m"), F.lit(0.0)))
    stats = stats.select("gene", F.log1p("m").alias("mean"), F.log("d").alias("disp"))
    ends = stats.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    place = F.ceil((F.col("mean") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / n_bins, F.lit(0.0)))
    binned = stats.join(ends).withColumn("bin", F.least(F.greatest(F.coalesce(place, F.lit(1)), F.lit(1)), F.lit(n_bins)).cast("int"))
    in_bin = binned.groupBy("bin").agg(F.avg("disp").alias("a"), F.stddev_samp("disp").alias("s"), F.count("disp").alias("n"), F.min("disp").alias("low"), F.max("disp").alias("high"))
    out = binned.join(in_bin, "bin")
    single = F.col("s").isNull()
    norm = (F.col("disp") - F.when(single, 0.0).otherwise(F.col("a"))) / F.nullif(F.when(single, F.col("a")).otherwise(F.col("s")), F.lit(0.0))
    gap = F.col("high") - F.col("low")
    two = (F.col("n") == 2) & (gap > 0) & (gap < float("inf"))  # of different, finite dispersions
    side = F.signum((F.col("disp") - F.col("low")) - (F.col("high") - F.col("disp")))
    return out.select("gene", "mean", "disp", "bin", F.when(two, side * 0.5**0.5).otherwise(norm).alias("disp_norm"))


def top_variable(disp: DataFrame, n: int) -> DataFrame:
    """The n genes of the highest standardised dispersion, ties by gene, missing ones last."""
    return disp.orderBy(F.desc_nulls_last("disp_norm"), "gene").limit(n)


def variable(disp: DataFrame, min_disp: float = 0.5, min_mean: float = 0.0125, max_mean: float = 3.0, max_disp: float = float("inf")) -> DataFrame:
    return disp.where((F.col("mean") > min_mean) & (F.col("mean") < max_mean) & (F.col("disp_norm") > min_disp) & (F.col("disp_norm") < max_disp))


def flagged(signature: DataFrame, markers: DataFrame) -> DataFrame:
    """signature with is_marker by membership in markers (gene)."""
    marks = markers.select("gene").distinct().withColumn("m", F.lit(True))
    return signature.drop("is_marker").join(marks, "gene", "left").withColumn("is_marker", F.coalesce("m", F.lit(False))).drop("m")


def density(values: DataFrame, value: str, n_bins: int = 100) -> DataFrame:
    """(bin, density): equal-width histogram whose area is one; the highest value falls into the last bin."""
    ends = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    width: Column = (F.col("hi") - F.col("lo")) / n_bins
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(n_bins - 1)).cast("int")
    rows = values.join(ends).withColumn("bin", F.coalesce(at, F.lit(0)))
    return rows.groupBy("bin").agg((F.count("*") / F.first(F.col("total")) / F.first(F.nullif(width, F.lit(0.0)))).alias("density"))


def marker_ranks(signature: DataFrame, per_type: int) -> DataFrame:
    """Markers by a greedy rule on the signature: for each cell type the genes whose mean stands furthest above the highest other type's, in
    units of their spread. Stands in for a genetic search over gene sets, which has no single right answer."""
    w = Window.partitionBy("gene").orderBy(F.desc("mu"), "celltype")
    best = signature.withColumn("r", F.row_number().over(w)).groupBy("gene").agg(F.max(F.when(F.col("r") == 1, F.struct("celltype", "mu", "std"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("mu"))).alias("b"))
    scored = best.select("gene", "a.celltype", ((F.col("a.mu") - F.coalesce("b", F.lit(0.0))) / F.col("a.std")).alias("margin"))
    rank = F.row_number().over(Window.partitionBy("celltype").orderBy(F.desc("margin"), "gene"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= per_type)


def checked_cells(cells: DataFrame, expr: DataFrame | None = None) -> DataFrame:
    """cells (cell_id, celltype, gene, x) if they can be log-scaled expression, else ValueError: a column is missing, there are no values, some are negative, they look like counts, or the grid of cells
    and genes has holes. With expr, the triplets (cell_id, gene, x) of cells (cell_id, celltype), stored values are judged and holes are zeros."""
    missing = {"celltype", "gene", "x"} - set(cells.columns) if expr is None else ({"cell_id", "celltype"} - set(cells.columns)) | ({"cell_id", "gene", "x"} - set(expr.columns))
    if missing:
        raise ValueError(f"single cells lack the columns {sorted(missing)}")
    row = summary(cells if expr is None else expr).head()
    if row["min_x"] is None:
        raise ValueError("single cells hold no expression")
    if row["any_negative"]:
        raise ValueError("single-cell expression has negative values")
    if row["not_logged"]:
        raise ValueError("single-cell expression looks like counts, not log values")
    if expr is None and "cell_id" in cells.columns:
        sizes = cells.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most")).head()
        if sizes["least"] < sizes["most"]:
            raise ValueError("some cells lack genes: give triplets as expr beside the cells, so that what is absent counts as zero")
    return cells


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> np.ndarray:
    """(a, b, n) for which a x / (x^n + b) is near y in weighted squares, from ones, by damped Gauss-Newton steps; b is at least zero."""
    p, damp = np.ones(3), 1e-3

    def off(p: np.ndarray) -> np.ndarray:
        return weight * (p[0] * x / (x ** p[2] + p[1]) - y)

    miss = off(p)
    for _ in range(rounds):
        bottom = x ** p[2] + p[1]
        slope = weight[:, None] * np.column_stack((x / bottom, -p[0] * x / bottom**2, -p[0] * x * x ** p[2] * np.log(x) / bottom**2))
        square = slope.T @ slope
        step = np.linalg.solve(square + damp * (np.diag(np.diag(square)) + 1e-12 * np.eye(3)), -slope.T @ miss)
        new = p + step
        new[1] = max(new[1], 0.0)
        with np.errstate(all="ignore"):
            ahead = off(new)
        if np.isfinite(ahead).all() and ahead @ ahead < miss @ miss:
            done = miss @ miss - ahead @ ahead < 1e-12 * (miss @ miss)
            p, miss, damp = new, ahead, max(damp / 5, 1e-12)
            if done:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    return p


def _local_lines(x: np.ndarray, y: np.ndarray, share: float, robust: int = 3) -> np.ndarray:
    """y smoothed along rising x: at each point a line through the nearest share of points (three at least) by tricube weights, fitted again with less weight on points far off."""
    n = len(x)
    k = min(n, max(3, int(share * n + 0.5)))
    left = np.zeros(n, int)
    at = 0
    for i in range(n):
        while at + k < n and x[at + k] - x[i] < x[i] - x[at]:
            at += 1
        left[i] = at
    rows = left[:, None] + np.arange(k)
    near, own, trust = x[rows], y[rows], np.ones(n)
    far = np.maximum(np.abs(near - x[:, None]).max(1, keepdims=True), 1e-12)
    base = np.clip(1 - (np.abs(near - x[:, None]) / far) ** 3, 0, None) ** 3
    for turn in range(robust + 1):
        w = base * trust[rows] + 1e-300
        total = w.sum(1)
        mx, my = (w * near).sum(1) / total, (w * own).sum(1) / total
        dx = near - mx[:, None]
        spread = (w * dx * dx).sum(1)
        slope = np.where(spread > 1e-12 * total * (np.ptp(x) + 1e-12) ** 2, (w * dx * own).sum(1) / np.maximum(spread, 1e-300), 0.0)
        fit = my + slope * (x - mx)
        if turn < robust:
            miss = np.abs(y - fit)
            scale = 6 * np.median(miss)
            if scale <= max(1e-7 * miss.mean(), 1e-12 * np.ptp(y)):  # most points are met but for rounding, which must not weigh
                break
            trust = np.clip(1 - (miss / scale) ** 2, 0, None) ** 2
    return fit


def trend(mean: np.ndarray, var: np.ndarray, min_mean: float = 0.1, share: float = 0.025) -> np.ndarray:
    """The variance that each mean has by its trend: the curve a x / (x^n + b), fitted on genes that vary and have min_mean at least, dense stretches of means counting more than sparse ones by their
    histogram, times the exponential of a local regression of the log residuals, held level beyond its ends."""
    usable = (var > 1e-8) & (mean >= min_mean)
    if usable.sum() < 2:
        raise ValueError("a variance trend needs two genes that vary and have the least mean")
    x, y = mean[usable], var[usable]
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    height, edges = np.histogram(x, bins=100, density=True)
    weight = height[np.clip(np.digitize(x, edges[:-1]) - 1, 0, 99)] + 1e-5
    p = _curve(x, y, weight)
    line = lambda z: np.maximum(p[0] * z / (np.maximum(z, 0) ** p[2] + p[1] + 1e-300), 1e-300)
    rest = _local_lines(x, np.log(y) - np.log(line(x)), share)
    return np.exp(np.interp(mean, x, rest)) * line(mean)


def variance_trend(signature: DataFrame, min_mean: float = 0.1, share: float = 0.025) -> DataFrame:
    """(gene, celltype, var): trend() of each cell type's genes, plus 0.01. A group is one cell type's genes, so it is as large as a genome."""
    kind = {f.name: f.dataType.simpleString() for f in signature.schema.fields}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("gene")
        return pd.DataFrame({"gene": group["gene"], "celltype": group["celltype"], "var": trend(group["mu"].to_numpy(float), group["var"].to_numpy(float), min_mean, share) + 0.01})

    return signature.select("gene", "celltype", "mu", "var").groupBy("celltype").applyInPandas(fit, f"gene {kind['gene']}, celltype {kind['celltype']}, var double")


#: Variable genes that a marker search looks at, at most; its tasks hold their centroids.
SEARCH_GENES = 5000


def _objectives(x: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """For each set of genes (row of masks) two numbers to raise: the mean distance between the cell types' centroids (types by genes), as a share of that on all genes, and the negated mean absolute correlation."""
    out = np.empty((len(masks), 2))
    pair = np.triu_indices(len(x), 1)
    whole = np.linalg.norm(x[pair[0]] - x[pair[1]], axis=1).mean() + 1e-12
    for i, mask in enumerate(masks):
        part = x[:, mask]
        centred = part - part.mean(1, keepdims=True)
        size = np.linalg.norm(centred, axis=1)
        out[i] = np.linalg.norm(part[pair[0]] - part[pair[1]], axis=1).mean() / whole, -np.abs((centred @ centred.T)[pair] / np.maximum(size[pair[0]] * size[pair[1]], 1e-12)).mean()
    return out


def fronts(values: np.ndarray) -> np.ndarray:
    """The front of each row of values, all to be raised: 0 for rows that no other dominates, 1 for those that only these dominate, and so on."""
    better = (values[:, None] >= values[None]).all(2) & (values[:, None] > values[None]).any(2)
    rank, left, front = np.zeros(len(values), int), np.ones(len(values), bool), 0
    while left.any():
        top = left & ~(better & left[:, None]).any(0)
        rank[top], front = front, front + 1
        left &= ~top
    return rank


def crowding(values: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """How far a row's neighbours on its own front lie apart, summed over the columns of values; infinite at the ends."""
    out = np.zeros(len(values))
    for front in np.unique(rank):
        own = np.flatnonzero(rank == front)
        for column in values.T:
            order = own[np.argsort(column[own], kind="stable")]
            out[order[[0, -1]]] = np.inf
            spread = column[order[-1]] - column[order[0]]
            if len(order) > 2 and spread > 0:
                out[order[1:-1]] += (column[order[2:]] - column[order[:-2]]) / spread
    return out


def marker_front(centroids: DataFrame, n_genes: int | None = None, islands: int = 8, generations: int = 300, offspring: int = 40, seed: int = 0) -> DataFrame:
    """(solution, distance, correlation, genes): sets of genes of which none is worse than another in both the cell types' mean distance (a share of that on all genes) and their mean absolute correlation, by
    falling distance. centroids is (gene, celltype, mu).

    Islands, one task each, evolve sets from a seed: of a set and its offspring those stay that fewer fronts dominate, and of one front those that lie less crowded. Parents meet in tournaments by the same
    order, swap genes and change a few. The fronts of all islands are then compared as one. n_genes fixes the size of the sets, else it is part of the search. Centroids are those of at most SEARCH_GENES
    variable genes, which the caller selects. What is found depends on the seed only.
    """
    kind = centroids.schema["gene"].dataType.simpleString()
    rows = centroids.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("celltype", "mu"))).alias("s")).select("gene", F.col("s.mu").alias("mu"))
    size = rows.count()
    if size > SEARCH_GENES:
        raise ValueError(f"a marker search takes {SEARCH_GENES} genes at most, not {size}; select variable genes first")
    spread = rows.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))

    def evolve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("gene", ignore_index=True)
        x, island = np.stack(group["mu"].to_list()).T, int(group["island"].iloc[0])
        rnd, n = np.random.default_rng([seed, island]), x.shape[1]
        want = min(n, n_genes) if n_genes else None

        def fixed(masks: np.ndarray) -> np.ndarray:
            for m in masks:
                short = (want if want else max(2, m.sum())) - m.sum()
                if short:
                    m[rnd.choice(np.flatnonzero(~m if short > 0 else m), abs(short), replace=False)] = short > 0
            return masks

        def order(values: np.ndarray) -> np.ndarray:
            rank = fronts(values)
            return np.lexsort((-crowding(values, rank), rank))

        # islands begin with sets of different sizes
        pool = fixed(rnd.random((offspring, n)) < (want or n * (island + 1) / (islands + 1)) / n)
        values = _objectives(x, pool)
        first = order(values)
        pool, values = pool[first], values[first]
        for _ in range(generations):
            met = rnd.integers(0, len(pool), (offspring, 2, 2)).min(2)  # the better of two, twice
            young = np.where(rnd.random((offspring, n)) < 0.5, pool[met[:, 0]], pool[met[:, 1]]) ^ (rnd.random((offspring, n)) < 1.5 / n)
            pool = np.concatenate((pool, fixed(young)))
            pool, at = np.unique(pool, axis=0, return_index=True)
            values = np.concatenate((values, _objectives(x, young)))[at]
            keep = order(values)[:offspring]
            pool, values = pool[keep], values[keep]
        best = fronts(values) == 0
        return pd.DataFrame({"distance": values[best, 0], "correlation": -values[best, 1], "genes": [group["gene"].to_numpy()[m] for m in pool[best]]})

    found = spread.groupBy("island").applyInPandas(evolve, f"distance double, correlation double, genes array<{kind}>").groupBy("genes").agg(F.first("distance").alias("distance"), F.first("correlation").alias("correlation"))
    found = stored(found, "markers-found")  # offspring of each island at most
    other = found.select(F.col("distance").alias("d"), F.col("correlation").alias("c"))
    worse = (F.col("d") >= F.col("distance")) & (F.col("c") <= F.col("correlation")) & ((F.col("d") > F.col("distance")) | (F.col("c") < F.col("correlation")))
    front = found.join(F.broadcast(other), worse, "left_anti")
    return front.select((F.row_number().over(Window.orderBy(F.desc("distance"), "correlation", "genes")) - 1).alias("solution"), "distance", "correlation", "genes")


def marker_search(centroids: DataFrame, n_genes: int | None = None, solution: int | None = None, **search_args) -> DataFrame:
    """(gene): the genes of one set of marker_front(): that of the given number, else the one whose distance less correlation is highest."""
    front = marker_front(centroids, n_genes, **search_args)
    chosen = front.where(F.col("solution") == solution) if solution is not None else front.orderBy(F.desc(F.col("distance") - F.col("correlation")), "solution").limit(1)
    return chosen.select(F.explode("genes").alias("gene"))


def create_signature(cells: DataFrame, *, expr: DataFrame | None = None, genes: DataFrame | None = None, correct_variance: bool = True, n_variable: int = 2000, n_markers: int | None = None, markers: DataFrame | None = None, bulk: DataFrame | None = None, drop_outliers: bool = False) -> DataFrame:
    """(gene, celltype, mu, std, var, is_marker) from cells (cell_id, celltype, gene, x), x being log expression, which hold every gene of every cell; or from cells (cell_id, celltype) and the triplets
    expr (cell_id, gene, x), where absent entries are zeros in every sum, and genes (gene) may name genes without any triplet.

    var is what a model takes as the spread of its prior: the variance by its trend along the mean, or, without correct_variance, the deviation std itself. Markers are the genes given, or those of a search
    on the centroids of the n_variable most variable genes. With bulk (gene, sample, expr) and drop_outliers, genes whose means disagree too much between the two are dropped.
    """
    cells = checked_cells(cells, expr)
    out = moments(cells) if expr is None else sparse_moments(cells, expr, genes)
    if markers is None:
        disp = dispersion(cells.where(F.col("celltype").isNotNull())) if expr is None else dispersion_of(sparse_gene_moments(cells, expr, genes, linear=True))
        markers = marker_search(out.join(top_variable(disp, n_variable).select("gene"), "gene", "left_semi").select("gene", "celltype", "mu"), n_markers)
    if correct_variance:
        out = out.drop("var").join(variance_trend(out), ["gene", "celltype"])
    else:
        out = out.withColumn("var", F.col("std"))
    if bulk is not None and drop_outliers:
        means = cells.where(F.col("celltype").isNotNull()).groupBy("gene").agg(F.avg("x").alias("sc_mean")) if expr is None else sparse_gene_moments(cells, expr, genes).select("gene", F.col("m").alias("sc_mean"))
        out = without(out, bland_altman_of(bulk, means).where("outlier"))
    return flagged(out.select("gene", "celltype", "mu", "std", "var"), markers)
