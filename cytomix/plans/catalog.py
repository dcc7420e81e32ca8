"""Named queries over the given tables, each with SQL that another engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytomix.functions import special
from cytomix.operators import bulk, layout, linkage, model, signature, states, variational
from cytomix.plans.inputs import Inputs
from cytomix.sources.stored import stored

CTE = """
WITH bulk AS (SELECT p_size AS gene, c_nationkey AS sample, sum(l_quantity) AS expr FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON
    l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
scaled AS (SELECT gene, sample, expr / sum(expr) OVER (PARTITION BY sample) * 1e4 AS expr FROM bulk),
cells AS (SELECT vec_id AS cell_id, label AS celltype, i - 1 AS gene, ln(1 + 10 * abs(CAST(embedding[i] AS DOUBLE))) AS x FROM embeddings,
    generate_series(1, 64) AS t(i)),
sig AS (SELECT gene, celltype, count(*) AS n, avg(x) AS mu, stddev_pop(x) + 0.01 AS std, var_pop(x) + 0.01 AS var FROM cells GROUP BY 1, 2),
segments AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS celltype FROM (SELECT DISTINCT c_mktsegment FROM customer) AS d),
beta AS (SELECT n_nationkey AS sample, 2 * s.celltype + h AS celltype, 1.0 + (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND
    c.c_mktsegment = s.c_mktsegment AND c.c_custkey % 2 = h) AS beta FROM nation n, segments s, generate_series(0, 1) AS t(h)),
frac AS (SELECT sample, celltype, CAST(beta AS DOUBLE) AS beta, CAST(sum(beta) OVER (PARTITION BY sample) AS DOUBLE) AS total, CAST(beta AS DOUBLE) /
    CAST(sum(beta) OVER (PARTITION BY sample) AS DOUBLE) AS fraction FROM beta),
prior AS (SELECT gene, celltype, mu AS mu0, 1000 * std * std AS beta0, std AS omega FROM sig WHERE gene IN (SELECT gene FROM bulk)),
nu AS (SELECT f.sample, p.gene, p.celltype, mu0 + 0.01 * ((f.sample + p.gene) % 7) AS nu FROM prior p JOIN frac f ON p.celltype = f.celltype),
y AS (SELECT gene, sample, ln(1 + expr) AS y FROM scaled WHERE gene IN (SELECT gene FROM prior)),
u AS (SELECT n.gene, n.sample, n.celltype, fraction * exp(nu + omega * omega / 2) AS u, exp(2 * nu + 2 * omega * omega) * (fraction * (1 - fraction) /
    (total + 1) + fraction * fraction) - exp(2 * nu + omega * omega) * fraction * fraction AS own, total FROM nu n JOIN prior p ON n.gene = p.gene AND
    n.celltype = p.celltype JOIN frac f ON n.sample = f.sample AND n.celltype = f.celltype),
pairs AS (SELECT a.gene, a.sample, sum(a.u * b.u / (1 + a.total)) AS cov FROM u a JOIN u b ON a.gene = b.gene AND a.sample = b.sample AND a.celltype
    <> b.celltype GROUP BY 1, 2),
moments AS (SELECT s.gene, s.sample, s.mean, s.own - p.cov AS var FROM (SELECT gene, sample, sum(u) AS mean, sum(own) AS own FROM u GROUP BY 1, 2) AS
    s JOIN pairs p ON s.gene = p.gene AND s.sample = p.sample),
terms AS (SELECT y.gene, y.sample, var / (mean * mean) AS a, (y - ln(mean) - var / (mean * mean) / 2) * (y - ln(mean) - var / (mean * mean) / 2) AS r2
    FROM y JOIN moments m ON y.gene = m.gene AND y.sample = m.sample),
sigmas AS (SELECT gene, sample, avg(sqrt(a + r2)) OVER (PARTITION BY gene) AS sigma FROM terms),
stats AS (SELECT gene, celltype, count(*) AS n, avg(nu) AS m, var_pop(nu) * count(*) AS ss FROM nu GROUP BY 1, 2),
post AS (SELECT s.gene, s.celltype, s.n, beta0 + (s.n - 1) / 2.0 * omega * omega + s.n / (2.0 * (1 + s.n)) * (omega * omega / s.n + (m - mu0) * (m -
    mu0)) + ss / 2 AS post FROM stats s JOIN prior p ON s.gene = p.gene AND s.celltype = p.celltype),
centred AS (SELECT celltype, sample, gene, nu - avg(nu) OVER (PARTITION BY celltype, gene) AS c FROM nu),
matrix AS (SELECT c.celltype, c.sample, c.gene, c * omega AS x FROM centred c JOIN prior p ON c.gene = p.gene AND c.celltype = p.celltype),
scores AS (SELECT celltype, c_nationkey AS sample, c_custkey % 3 AS state, avg(abs(c_acctbal)) AS score FROM customer c JOIN segments s ON
    c.c_mktsegment = s.c_mktsegment GROUP BY 1, 2, 3),
loadings AS (SELECT celltype % 2 AS celltype, celltype % 3 AS state, gene, avg(mu) - 0.5 AS loading FROM sig GROUP BY 1, 2, 3),
assigned AS (SELECT year(o_orderdate) AS run, c_nationkey AS sample, count(*) % 3 AS cluster FROM orders JOIN customer ON o_custkey = c_custkey GROUP
    BY 1, 2),
curve AS (SELECT n_regionkey AS celltype, k, avg(CASE WHEN c_acctbal > (k - 3) * 900 - 900 THEN 1.0 ELSE 0.0 END) AS c FROM customer JOIN nation ON
    c_nationkey = n_nationkey, generate_series(2, 9) AS t(k) GROUP BY 1, 2),
disp0 AS (SELECT gene, CASE WHEN avg(exp(x) - 1) = 0 THEN 1e-12 ELSE avg(exp(x) - 1) END AS m, var_pop(exp(x) - 1) AS v FROM cells GROUP BY gene),
disp1 AS (SELECT gene, ln(1 + m) AS mean, ln(nullif(v / m, 0)) AS disp FROM disp0),
disp2 AS (SELECT gene, mean, disp, least(greatest(coalesce(ceil((mean - min(mean) OVER ()) / nullif((max(mean) OVER () - min(mean) OVER ()) / 20, 0)),
    1), 1), 20) AS bin FROM disp1),
disp3 AS (SELECT bin, avg(disp) AS a, stddev_samp(disp) AS s FROM disp2 GROUP BY bin),
disp AS (SELECT gene, mean, disp, CAST(d.bin AS INTEGER) AS bin, (disp - CASE WHEN s IS NULL THEN 0 ELSE a END) / nullif(CASE WHEN s IS NULL THEN a
    ELSE s END, 0) AS disp_norm FROM disp2 d JOIN disp3 b ON d.bin = b.bin),
ba AS (SELECT s.gene, sc_mean, bulk_mean, sc_mean - bulk_mean AS diff FROM (SELECT gene, avg(x) AS sc_mean FROM cells GROUP BY gene) AS s JOIN (SELECT
    gene, avg(expr) AS bulk_mean FROM scaled GROUP BY gene) AS b ON s.gene = b.gene),
expected AS (SELECT s_nationkey AS sample, g AS grp, CASE WHEN s_nationkey % 3 <> 0 THEN count(*) * 5.0 / (SELECT count(*) FROM supplier) / (g + 1)
    END AS prior FROM supplier, generate_series(0, 2) AS t(g) GROUP BY 1, 2),
alphas AS (SELECT sample, celltype, avg(beta) OVER (PARTITION BY celltype) AS alpha, beta, total FROM frac),
outliers AS (SELECT gene, sc_mean, bulk_mean, diff, abs(diff - avg(diff) OVER ()) > 1.96 * stddev_pop(diff) OVER () AS outlier FROM ba)
"""


def _r(name: str, digits: int = 6, of: Column | None = None) -> Column:
    return F.round(F.col(name) if of is None else of, digits).alias(name)


def _digamma_gap(power: int = 1) -> str:
    """SQL for digamma(beta) - digamma(total), or with power 2 trigamma(total) - trigamma(beta): both are whole numbers here, so the gap is a finite sum."""
    return f"(-list_sum(list_transform(generate_series(CAST(beta AS BIGINT), CAST(total AS BIGINT) - 1), lambda k: 1.0::DOUBLE / {'k' if power == 1 else '(k * k)'})))"


_DIRICHLET = f"""(SELECT sum(p) AS pf, sum(q) AS qf FROM (SELECT sample, lgamma(sum(alpha)) - sum(lgamma(alpha)) + sum((alpha - 1) * {_digamma_gap()}) AS p,
lgamma(sum(beta)) - sum(lgamma(beta)) + sum((beta - 1) * {_digamma_gap()}) AS q FROM alphas GROUP BY sample) AS s)"""


def _centres(i: Inputs) -> DataFrame:
    return i.sig().select(F.col("celltype").alias("centre"), "gene", F.col("mu").alias("c"))


def _vectors(i: Inputs) -> DataFrame:
    """Each vector with that of the next id."""
    e = i.raw("embeddings").select("vec_id", "embedding")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


def _states(i: Inputs) -> dict[str, DataFrame]:
    """Cell states of the centred matrix, with their numbers chosen by stability."""
    return states.discover(stored(i.matrix("centering"), "query-matrix"))


def _curve(i: Inputs) -> DataFrame:
    """Stability of 2 to 9 states, by ten restarts each."""
    runs = i.spark.range(10).select(F.col("id").cast("int").alias("run")).withColumn("states", F.explode(F.sequence(F.lit(2), F.lit(9))))
    return states.cophenetic(states.factorise(stored(states.gram(i.matrix("centering")), "query-gram"), runs)).withColumnRenamed("states", "k")


def _retrieved(i: Inputs) -> DataFrame:
    known = i.sig().select("celltype", "gene", F.explode(F.array(F.struct(F.lit(0).alias("state"), F.col("mu").alias("loading")), F.struct(F.lit(1).alias("state"), F.col("std").alias("loading")))).alias("t")).select("celltype", "gene", "t.*")
    return states.retrieve(i.matrix("no_weighing"), known)


def _w(i: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A matrix (genes by nations), loadings and scores whose product approximates it, for residuals."""
    m = i.scaled().select("sample", "gene", F.log1p("expr").alias("x"))
    w = i.sig().select("gene", F.col("celltype").alias("state"), F.col("mu").alias("w"))
    h = model.fractions(i.beta()).select(F.col("celltype").alias("state"), "sample", F.col("fraction").alias("h"))
    return m.join(w.select("gene").distinct(), "gene", "left_semi"), w, h


def _fraction_points(i: Inputs) -> DataFrame:
    """Each nation's fractions, over the cell types in their order."""
    return model.fractions(i.beta()).groupBy("sample").agg(F.transform(F.sort_array(F.collect_list(F.struct("celltype", "fraction"))), lambda t: t["fraction"]).alias("point"))


def _type_points(i: Inputs) -> DataFrame:
    """Each cell type's fractions, over the nations in their order, as one group."""
    rows = model.fractions(i.beta()).groupBy(F.col("celltype").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "fraction"))), lambda t: t["fraction"]).alias("point"))
    return rows.withColumn("one", F.lit("fractions"))


def _expected(i: Inputs) -> DataFrame:
    """Expected mass of three groups of cell types by nation, made from supplier counts; every third nation has none."""
    s = i.raw("supplier").groupBy(F.col("s_nationkey").alias("sample")).agg(F.count("*").alias("n"))
    share = F.col("n") * 5.0 / F.sum("n").over(Window.partitionBy())  # one row a nation
    return s.withColumn("share", share).select("sample", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("group"), "share").select("sample", "group", F.when(F.col("sample") % 3 != 0, F.col("share") / (F.col("group") + 1)).alias("prior"))


def _members(i: Inputs) -> DataFrame:
    """The group of a cell type is its remainder by 4; those with remainder 3 have none."""
    return i.beta().select("celltype").distinct().select((F.col("celltype") % 4).cast("int").alias("group"), "celltype").where("group < 3")


def _loading_weights() -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: 1.0 / i)


KNOTS = ((-1000.0, 0.0), (0.0, 1.0), (2500.0, 1.5), (5000.0, 4.0), (9000.0, 3.0))


# name: (query, SQL after the common table expressions, or None where SQL cannot say it)
QUERIES: dict[str, tuple[Callable[[Inputs], DataFrame], str | None]] = {
    "bulk_long": (lambda i: i.bulk(), "SELECT gene, sample, expr FROM bulk"),
    "bulk_cp10k": (lambda i: i.scaled().select("gene", "sample", _r("expr", 5)), "SELECT gene, sample, round(expr, 5) AS expr FROM scaled"),
    "bulk_format_flags": (
        lambda i: bulk.format_flags(i.bulk()),
        """SELECT max(g.n_genes) AS n_genes, count(*) AS n_samples, bool_and(s > 9999 AND s < 10001) AS all_cp10k, bool_or(s / g.n_genes > 10) AS
        any_mean_over_10, bool_or(lo < 0) AS any_negative, bool_or(n > d) AS any_duplicate, CASE WHEN bool_or(n > d) THEN 'reject' WHEN bool_and(s > 9999 AND s < 10001) THEN 'accept' WHEN
        bool_or(s / g.n_genes > 10) THEN 'rescale' WHEN bool_or(lo < 0) THEN 'reject' ELSE 'keep' END AS action FROM (SELECT sample, sum(expr) AS s,
        min(expr) AS lo, count(*) AS n, count(DISTINCT gene) AS d FROM bulk GROUP BY 1) AS t, (SELECT count(DISTINCT gene) AS n_genes FROM bulk) AS g""",
    ),
    "bulk_checked": (
        lambda i: bulk.checked(i.bulk()).select("gene", "sample", _r("expr", 5)),
        "SELECT gene, sample, round(expr, 5) AS expr FROM scaled",
    ),
    "bulk_pivot": (
        lambda i: (
            i.bulk()
            .groupBy("gene")
            .pivot("sample", list(range(25)))
            .agg(F.first("expr"))
            .select("gene", *[F.col(str(s)).alias(f"s{s}") for s in range(25)])
        ),
        "SELECT gene, " + ", ".join(f"max(CASE WHEN sample = {s} THEN expr END) AS s{s}" for s in range(25)) + " FROM bulk GROUP BY gene",
    ),
    "match_counts": (
        lambda i: bulk.match_counts(i.bulk(), signature.flagged(i.sig(), i.markers())),
        """SELECT (SELECT count(DISTINCT gene) FROM bulk) AS bulk_genes, (SELECT count(DISTINCT gene) FROM sig) AS signature_genes, count(DISTINCT gene)
        AS common_genes, count(DISTINCT CASE WHEN gene % 3 = 0 THEN gene END) AS common_markers FROM sig WHERE gene IN (SELECT gene FROM bulk)""",
    ),
    "cell_subset": (
        lambda i: (
            bulk.cell_subset(i.cells().withColumn("cell_id", F.concat_ws(":", F.col("cell_id") % 7, "cell_id")), "3", 2)
            .select("cell_id", "gene", _r("x"))
        ),
        "SELECT (cell_id % 7) || ':' || cell_id AS cell_id, gene, round(x, 6) AS x FROM cells WHERE cell_id % 7 = 3 AND celltype = 2",
    ),
    "labels_by_appearance": (
        lambda i: bulk.first_seen(i.cells(), "celltype", "cell_id"),
        "SELECT celltype, min(cell_id) AS first, row_number() OVER (ORDER BY min(cell_id), celltype) - 1 AS place FROM cells GROUP BY celltype",
    ),
    "bulk_of_known_samples": (
        lambda i: (
            i.scaled()
            .join(_expected(i).where("prior is not null").select("sample").distinct(), "sample", "left_semi")
            .select("gene", "sample", _r("expr", 5))
        ),
        "SELECT gene, sample, round(expr, 5) AS expr FROM scaled WHERE sample IN (SELECT sample FROM expected WHERE prior IS NOT NULL)",
    ),
    "bulk_log_std": (
        lambda i: bulk.log_std(i.scaled()).select("gene", _r("sigma")),
        "SELECT gene, round(stddev_pop(ln(1 + expr)) + 0.1, 6) AS sigma FROM scaled GROUP BY gene",
    ),
    "signature_moments": (
        lambda i: i.sig().select("gene", "celltype", "n", _r("mu"), _r("std"), _r("var")),
        "SELECT gene, celltype, n, round(mu, 6) AS mu, round(std, 6) AS std, round(var, 6) AS var FROM sig",
    ),
    "signature_sparse_moments": (
        lambda i: (
            signature.sparse_moments(i.cells().select("cell_id", "celltype").distinct(), i.cells().where("x > 0.5").select("cell_id", "gene", "x"))
            .select("gene", "celltype", "n", _r("mu"), _r("var"))
        ),
        """SELECT gene, celltype, count(*) AS n, round(avg(CASE WHEN x > 0.5 THEN x ELSE 0 END), 6) AS mu, round(var_pop(CASE WHEN x > 0.5 THEN x ELSE 0
        END) + 0.01, 6) AS var FROM cells GROUP BY 1, 2""",
    ),
    "create_signature_sparse": (
        lambda i: (
            signature.create_signature(
                i.cells().select("cell_id", "celltype").distinct(), expr=i.cells().where("x > 0.5").select("cell_id", "gene", "x"), markers=i.markers(), correct_variance=False, bulk=i.scaled(), drop_outliers=True
            ).select("gene", "celltype", _r("mu"), _r("std"), _r("var"), "is_marker")
        ),
        """, holes AS (SELECT cell_id, celltype, gene, CASE WHEN x > 0.5 THEN x ELSE 0 END AS x FROM cells), diffs AS (SELECT s.gene, s.m - b.m AS diff FROM (SELECT gene, avg(x) AS m FROM holes
        GROUP BY gene) AS s JOIN (SELECT gene, avg(expr) AS m FROM scaled GROUP BY gene) AS b ON s.gene = b.gene), odd AS (SELECT gene, abs(diff - avg(diff) OVER ()) > 1.96 *
        stddev_pop(diff) OVER () AS outlier FROM diffs) SELECT gene, celltype, round(avg(x), 6) AS mu, round(stddev_pop(x) + 0.01, 6) AS std, round(stddev_pop(x) + 0.01, 6) AS var, gene % 3
        = 0 AS is_marker FROM holes WHERE gene NOT IN (SELECT gene FROM odd WHERE outlier) GROUP BY 1, 2""",
    ),
    "sparse_dispersion": (
        lambda i: (
            signature.dispersion_of(signature.sparse_gene_moments(i.cells().select("cell_id", "celltype").distinct(), i.cells().where("x > 0.5").select("cell_id", "gene", "x"), linear=True))
            .select("gene", _r("mean"), _r("disp"), "bin", _r("disp_norm", 5))
        ),
        """, h0 AS (SELECT gene, avg(CASE WHEN x > 0.5 THEN exp(x) - 1 ELSE 0 END) AS m, var_pop(CASE WHEN x > 0.5 THEN exp(x) - 1 ELSE 0 END) AS v FROM cells GROUP BY gene), h1 AS (SELECT gene, ln(1 +
        m) AS mean, ln(nullif(v / m, 0)) AS disp FROM h0), h2 AS (SELECT gene, mean, disp, least(greatest(coalesce(ceil((mean - min(mean) OVER ()) / nullif((max(mean) OVER () - min(mean)
        OVER ()) / 20, 0)), 1), 1), 20) AS bin FROM h1), h3 AS (SELECT bin, avg(disp) AS a, stddev_samp(disp) AS s FROM h2 GROUP BY bin) SELECT gene, round(mean, 6) AS mean, round(disp,
        6) AS disp, CAST(h2.bin AS INTEGER) AS bin, round((disp - CASE WHEN s IS NULL THEN 0 ELSE a END) / nullif(CASE WHEN s IS NULL THEN a ELSE s END, 0), 5) AS disp_norm FROM h2 JOIN h3
        ON h2.bin = h3.bin""",
    ),
    "signature_var_floor": (
        lambda i: (
            signature.with_variance_floor(i.sig().withColumn("var", F.when(F.col("gene") == 3, 0.0).otherwise(F.col("var"))))
            .select("gene", "celltype", _r("var"))
        ),
        "SELECT gene, celltype, round(CASE WHEN gene = 3 THEN 0.01 ELSE var + 0.01 END, 6) AS var FROM sig",
    ),
    "signature_range_flags": (
        lambda i: signature.range_flags(i.sig()).select(_r("min_var"), _r("max_var"), "odd_range"),
        "SELECT round(min(var), 6) AS min_var, round(max(var), 6) AS max_var, min(var) < 1e-6 OR max(var) > 10 AS odd_range FROM sig",
    ),
    "expression_summary": (
        lambda i: (
            signature.summary(i.cells())
            .select(_r("min_x"), _r("max_x"), _r("mean_x"), _r("std_x"), _r("median_x"), _r("whole_share"), "not_logged", "any_negative")
        ),
        """SELECT round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(avg(x), 6) AS mean_x, round(stddev_pop(x), 6) AS std_x, round(median(x), 6)
        AS median_x, round(avg(CASE WHEN x <> 0 THEN CASE WHEN abs(x - round(x)) < 1e-10 THEN 1.0 ELSE 0.0 END END), 6) AS whole_share, max(x) > 50 OR
        coalesce(avg(CASE WHEN x <> 0 THEN CASE WHEN abs(x - round(x)) < 1e-10 THEN 1.0 ELSE 0.0 END END), 0) > 0.99 AS not_logged, min(x) < 0 AS
        any_negative FROM cells""",
    ),
    "common_genes": (lambda i: bulk.common_genes(i.bulk(), i.sig()), "SELECT DISTINCT gene FROM bulk WHERE gene IN (SELECT gene FROM sig)"),
    "sig_bulk_join": (
        lambda i: bulk.matched(i.scaled(), i.sig()).select("sample", "gene", "celltype", _r("expr", 5), _r("mu"), _r("var")),
        "SELECT sample, b.gene, celltype, round(expr, 5) AS expr, round(mu, 6) AS mu, round(var, 6) AS var FROM scaled b JOIN sig s ON b.gene = s.gene",
    ),
    "hvg_dispersion": (
        lambda i: signature.dispersion(i.cells()).select("gene", _r("mean"), _r("disp"), "bin", _r("disp_norm", 5)),
        "SELECT gene, round(mean, 6) AS mean, round(disp, 6) AS disp, bin, round(disp_norm, 5) AS disp_norm FROM disp",
    ),
    "hvg_top_n": (
        lambda i: signature.top_variable(signature.dispersion(i.cells()), 20).select("gene", _r("disp_norm", 5)),
        "SELECT gene, round(disp_norm, 5) AS disp_norm FROM disp ORDER BY disp.disp_norm DESC NULLS LAST, gene LIMIT 20",
    ),
    "hvg_cutoffs": (
        lambda i: signature.variable(signature.dispersion(i.cells()), 0.0, 0.0125, 30.0).select("gene", _r("mean")),
        "SELECT gene, round(mean, 6) AS mean FROM disp WHERE disp.mean > 0.0125 AND disp.mean < 30 AND disp.disp_norm > 0",
    ),
    "hvg_centroids": (
        lambda i: (
            i.sig()
            .join(signature.top_variable(signature.dispersion(i.cells()), 20).select("gene"), "gene", "left_semi")
            .select("gene", "celltype", _r("mu"))
        ),
        "SELECT gene, celltype, round(mu, 6) AS mu FROM sig WHERE gene IN (SELECT gene FROM disp ORDER BY disp_norm DESC NULLS LAST, gene LIMIT 20)",
    ),
    "bland_altman_outliers": (
        lambda i: bulk.bland_altman(i.scaled(), i.cells()).select("gene", _r("sc_mean"), _r("bulk_mean", 5), _r("diff", 5), "outlier"),
        "SELECT gene, round(sc_mean, 6) AS sc_mean, round(bulk_mean, 5) AS bulk_mean, round(diff, 5) AS diff, outlier FROM outliers",
    ),
    "signature_without_outliers": (
        lambda i: bulk.without(i.sig(), bulk.bland_altman(i.scaled(), i.cells()).where("outlier")).select("gene", "celltype", _r("mu")),
        "SELECT gene, celltype, round(mu, 6) AS mu FROM sig WHERE gene NOT IN (SELECT gene FROM outliers WHERE outlier)",
    ),
    "mean_density": (
        lambda i: signature.density(i.sig(), "mu").select("bin", _r("density")),
        """SELECT CAST(least(floor((mu - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS bin, round(count(*) / max(total) / max((hi - lo) / 100), 6) AS
        density FROM sig, (SELECT min(mu) AS lo, max(mu) AS hi, CAST(count(*) AS DOUBLE) AS total FROM sig) AS e GROUP BY 1""",
    ),
    "marker_override": (
        lambda i: signature.flagged(i.sig(), i.markers()).groupBy("is_marker").agg(F.count("*").alias("n")),
        "SELECT gene % 3 = 0 AS is_marker, count(*) AS n FROM sig GROUP BY 1",
    ),
    "marker_semi": (
        lambda i: i.scaled().join(i.markers(), "gene", "left_semi").select("gene", "sample", _r("expr", 5)),
        "SELECT gene, sample, round(expr, 5) AS expr FROM scaled WHERE gene IN (SELECT gene FROM sig WHERE gene % 3 = 0)",
    ),
    "marker_anti": (
        lambda i: i.scaled().join(i.markers(), "gene", "left_anti").select("gene", "sample", _r("expr", 5)),
        "SELECT gene, sample, round(expr, 5) AS expr FROM scaled WHERE gene NOT IN (SELECT gene FROM sig WHERE gene % 3 = 0)",
    ),
    "marker_ranks": (
        lambda i: signature.marker_ranks(i.sig(), 3).select("celltype", "rank", "gene", _r("margin")),
        """SELECT celltype, rank, gene, round(margin, 6) AS margin FROM (SELECT celltype, gene, margin, row_number() OVER (PARTITION BY celltype ORDER BY
        margin DESC, gene) AS rank FROM (SELECT a.gene, a.celltype, (a.mu - coalesce(b.mu, 0)) / a.std AS margin FROM (SELECT *, row_number() OVER
        (PARTITION BY gene ORDER BY mu DESC, celltype) AS r FROM sig) AS a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY mu DESC,
        celltype) AS r FROM sig) AS b ON a.gene = b.gene AND b.r = 2 WHERE a.r = 1) AS s) AS t WHERE rank <= 3""",
    ),
    "fractions_norm": (
        lambda i: model.fractions(i.beta()).select("sample", "celltype", _r("fraction")),
        "SELECT sample, celltype, round(fraction, 6) AS fraction FROM frac",
    ),
    "expected_bulk": (lambda i: i.moments().select("gene", "sample", _r("mean")), "SELECT gene, sample, round(mean, 6) AS mean FROM moments"),
    "variance_bulk": (lambda i: i.moments().select("gene", "sample", _r("var")), "SELECT gene, sample, round(var, 6) AS var FROM moments"),
    "sigma_y": (lambda i: model.sigma(i.terms()).select("gene", "sample", _r("sigma")), "SELECT gene, sample, round(sigma, 6) AS sigma FROM sigmas"),
    "sigma_y_by_sample": (
        lambda i: model.sigma(i.terms(), True).select("gene", "sample", _r("sigma")),
        "SELECT gene, sample, round(sqrt(a + r2), 6) AS sigma FROM terms",
    ),
    "elbo_py": (
        lambda i: model.likelihood_y(i.terms()).select(_r("value", 4)),
        "SELECT round(sum(-0.5 / (sigma * sigma) * (a + r2)), 4) AS value FROM terms t JOIN sigmas s ON t.gene = s.gene AND t.sample = s.sample",
    ),
    "posterior_beta": (
        lambda i: model.posterior_beta(i.nu(), i.omega(), i.prior()).select("gene", "celltype", _r("post", 5)),
        "SELECT gene, celltype, round(post, 5) AS post FROM post",
    ),
    "elbo_px": (
        lambda i: model.likelihood_x(model.posterior_beta(i.nu(), i.omega(), i.prior())).select(_r("value", 3)),
        "SELECT round(sum(-(1000 + n / 2.0) * ln(post)), 3) AS value FROM post",
    ),
    "elbo_qx": (
        lambda i: model.entropy_x(i.omega(), i.nu()).select(_r("value", 4)),
        "SELECT round(-(SELECT count(DISTINCT sample) FROM nu) * sum(ln(omega)), 4) AS value FROM prior",
    ),
    "dirichlet_norms": (
        lambda i: (
            i.beta()
            .groupBy("sample")
            .agg((special.lgamma(F.sum("beta")) - F.sum(special.lgamma("beta"))).alias("v"))
            .select("sample", _r("v", 5))
        ),
        "SELECT sample, round(lgamma(CAST(sum(beta) AS DOUBLE)) - sum(lgamma(CAST(beta AS DOUBLE))), 5) AS v FROM beta GROUP BY sample",
    ),
    "elbo_dirichlet": (
        lambda i: model.dirichlet_terms(i.beta(), model.mean_alpha(i.beta())).select(_r("pf", 3), _r("qf", 3)),
        f"SELECT round(pf, 3) AS pf, round(qf, 3) AS qf FROM {_DIRICHLET} AS d",
    ),
    "log_fractions": (
        lambda i: (
            model.fractions(i.beta())
            .select("sample", "celltype", _r("mean", 6, special.digamma("beta") - special.digamma("total")), _r("var", 6, special.trigamma("beta") - special.trigamma("total")))
        ),
        f"SELECT sample, celltype, round({_digamma_gap()}, 6) AS mean, round(-{_digamma_gap(2)}, 6) AS var FROM frac",
    ),
    "elbo": (
        lambda i: (
            model.objective(model.likelihood_x(model.posterior_beta(i.nu(), i.omega(), i.prior())), model.entropy_x(i.omega(), i.nu()), model.likelihood_y(i.terms()), model.dirichlet_terms(i.beta(), model.mean_alpha(i.beta())), i.omega())
            .select(_r("value", 2))
        ),
        f"""SELECT round((SELECT sum(-(1000 + n / 2.0) * ln(post)) FROM post) + (SELECT count(DISTINCT sample) FROM nu) * (SELECT sum(ln(omega)) FROM prior) + (SELECT sum(-0.5 / (sigma * sigma) * (a + r2)) FROM terms t JOIN sigmas s ON t.gene = s.gene AND t.sample = s.sample)
        + sqrt((SELECT count(DISTINCT gene) FROM prior) / CAST((SELECT count(DISTINCT celltype) FROM prior) AS DOUBLE)) * (pf - qf), 2) AS value FROM {_DIRICHLET} AS d""",
    ),
    "model_health": (
        lambda i: model.health(i.y(), i.beta(), model.mean_alpha(i.beta()), i.prior().withColumns({"alpha0": F.lit(1000.0), "kappa0": F.lit(1.0)})),
        """SELECT bool_or(y IS NULL OR isnan(y) OR isinf(y)) AS odd_y, bool_or(y < 0) AS negative_y, (SELECT bool_or(beta <= 0) FROM beta) AS
        nonpositive_beta, (SELECT bool_or(alpha <= 0) FROM alphas) AS nonpositive_alpha, false AS nonpositive_alpha0, (SELECT bool_or(beta0 <= 0) FROM
        prior) AS nonpositive_beta0, false AS nonpositive_kappa0, true AS not_fitted FROM y""",
    ),
    "mean_alpha": (
        lambda i: model.mean_alpha(i.beta()).select("sample", "celltype", _r("alpha")),
        "SELECT sample, celltype, round(avg(CAST(beta AS DOUBLE)) OVER (PARTITION BY celltype), 6) AS alpha FROM beta",
    ),
    "expectation_problems": (
        lambda i: model.expectation_problems(_expected(i).withColumnRenamed("group", "celltype"), i.beta().select("celltype").distinct()),
        """SELECT bool_or(prior = 0 OR prior = 1) AS any_certain, (SELECT count(DISTINCT celltype) FROM beta WHERE celltype > 2) AS missing_types FROM
        expected""",
    ),
    "group_prior": (
        lambda i: model.group_prior(_expected(i).where("prior is not null"), _members(i)).select("sample", "celltype", _r("prior")),
        """SELECT sample, celltype, round(sum(prior), 6) AS prior FROM expected JOIN (SELECT DISTINCT celltype FROM beta) AS b ON celltype % 4 = grp
        WHERE prior IS NOT NULL GROUP BY 1, 2""",
    ),
    "alpha_with_prior": (
        lambda i: (
            model.alpha_with_prior(i.beta(), *model.checked_prior(_expected(i), i.beta().select("celltype").distinct(), _members(i)))
            .select("sample", "celltype", _r("alpha", 5))
        ),
        """, means AS (SELECT celltype, avg(beta) AS m, avg(beta) / sum(avg(beta)) OVER () AS f FROM frac GROUP BY celltype), pinned AS (SELECT f.sample,
        m.celltype, m, f, e.prior, sum(CASE WHEN e.prior IS NOT NULL THEN m.f END) OVER (PARTITION BY f.sample, m.celltype % 4) AS in_group FROM
        (SELECT DISTINCT sample FROM frac) AS f CROSS JOIN means m LEFT JOIN expected e ON e.sample = f.sample AND e.grp = m.celltype % 4), sums AS
        (SELECT sample, 1 - sum(CASE WHEN prior IS NULL THEN 0 ELSE f / in_group * prior END) AS rest, sum(CASE WHEN prior IS NULL THEN f END) AS
        free_f, sum(CASE WHEN prior IS NULL THEN m END) AS free_m FROM pinned GROUP BY 1) SELECT p.sample, celltype, round((CASE WHEN prior IS NULL
        THEN f / free_f * rest ELSE f / in_group * prior END) * free_m / rest, 5) AS alpha FROM pinned p JOIN sums s ON p.sample = s.sample""",
    ),
    "sample_alpha": (
        lambda i: (
            model.sample_alpha(i.beta(), *model.checked_prior(_expected(i), i.beta().select("celltype").distinct(), _members(i)), temperature=20.0)
            .select("sample", "celltype", _r("alpha", 5))
        ),
        """, pinned AS (SELECT f.sample, f.celltype, f.fraction AS f, e.prior, sum(f.fraction) OVER (PARTITION BY f.sample, f.celltype % 4) AS in_group FROM frac f LEFT JOIN expected e ON
        e.sample = f.sample AND e.grp = f.celltype % 4), sums AS (SELECT sample, 1 - sum(CASE WHEN prior IS NULL THEN 0 ELSE f / in_group * prior END) AS rest, sum(CASE WHEN prior IS NULL
        THEN f END) AS free_f FROM pinned GROUP BY 1) SELECT p.sample, celltype, round(20 * CASE WHEN prior IS NULL THEN f / free_f * rest ELSE f / in_group * prior END, 5) AS alpha FROM
        pinned p JOIN sums s ON p.sample = s.sample""",
    ),
    "fraction_neighbours": (
        lambda i: (
            layout.neighbours(stored(_fraction_points(i), "query-fractions").select(F.col("sample").cast("long").alias("at"), "point"), 5)
            .select(F.col("at").alias("sample"), F.posexplode(F.arrays_zip("near", "dist")).alias("place", "t"))
            .select("sample", "place", F.col("t.near").alias("near"), _r("dist", 6, F.col("t.dist")))
        ),
        """, gaps AS (SELECT a.sample, b.sample AS near, sqrt(sum((a.fraction - b.fraction) * (a.fraction - b.fraction))) AS dist FROM frac a JOIN frac b ON a.celltype = b.celltype AND a.sample <>
        b.sample GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(dist, 9), near) - 1 AS place FROM gaps) SELECT CAST(sample AS BIGINT) AS sample,
        CAST(place AS INTEGER) AS place, CAST(near AS BIGINT) AS near, round(dist, 6) AS dist FROM ranked WHERE place < 5""",
    ),
    "fraction_leaves": (
        lambda i: linkage.leaf_order(_type_points(i), "one").select(F.col("id").alias("celltype"), "place"),
        """, gaps AS (SELECT a.celltype AS a, b.celltype AS b, sqrt(sum((a.fraction - b.fraction) * (a.fraction - b.fraction))) AS dist FROM frac a JOIN frac b ON a.sample = b.sample GROUP BY 1, 2),
        trees AS (SELECT 0 AS step, (SELECT list({'num': celltype, 'leaves': [celltype]} ORDER BY celltype) FROM (SELECT DISTINCT CAST(celltype AS BIGINT) AS celltype FROM frac) AS t) AS cl
        UNION ALL SELECT step + 1, (SELECT list_append(list_filter(m.cl, lambda c: c.num <> p.x AND c.num <> p.y), {'num': CAST(10 + m.step AS BIGINT), 'leaves': list_concat(p.xs, p.ys)}) FROM
        (SELECT x.c.num AS x, y.c.num AS y, x.c.leaves AS xs, y.c.leaves AS ys FROM (SELECT unnest(m.cl) AS c) AS x, (SELECT unnest(m.cl) AS c) AS y, gaps g WHERE x.c.num < y.c.num AND
        list_contains(x.c.leaves, g.a) AND list_contains(y.c.leaves, g.b) GROUP BY ALL ORDER BY round(avg(g.dist), 9), x, y LIMIT 1) AS p) FROM trees m WHERE len(m.cl) > 1)
        SELECT CAST(unnest(cl[1].leaves) AS INTEGER) AS celltype, CAST(generate_subscripts(cl[1].leaves, 1) - 1 AS INTEGER) AS place FROM trees WHERE len(cl) = 1""",
    ),
    "cluster_matrix_omega": (
        lambda i: i.matrix("Omega").select("celltype", "sample", "gene", _r("x")),
        "SELECT celltype, sample, gene, round(x, 6) AS x FROM matrix",
    ),
    "cluster_matrix_omegafractions": (
        lambda i: i.matrix("OmegaFractions").select("celltype", "sample", "gene", _r("x")),
        "SELECT m.celltype, m.sample, gene, round(x * fraction, 6) AS x FROM matrix m JOIN frac f ON m.sample = f.sample AND m.celltype = f.celltype",
    ),
    "cluster_matrix_centering": (
        lambda i: i.matrix("centering").select("celltype", "sample", "gene", _r("x")),
        "SELECT celltype, sample, gene, round(c, 6) AS x FROM centred",
    ),
    "cluster_matrix_none": (
        lambda i: i.matrix("no_weighing").select("celltype", "sample", "gene", _r("x")),
        "SELECT celltype, sample, gene, round(nu, 6) AS x FROM nu",
    ),
    "gram_matrix": (
        lambda i: states.gram(i.matrix()).select("celltype", "s1", "s2", _r("k")),
        """SELECT a.celltype, a.sample AS s1, b.sample AS s2, round(sum(a.x * b.x), 6) AS k FROM matrix a JOIN matrix b ON a.celltype = b.celltype AND
        a.gene = b.gene AND a.sample <= b.sample GROUP BY 1, 2, 3""",
    ),
    "gram_eigenvalues": (
        lambda i: (
            states.eigenpairs(states.gram(i.matrix()), 25, least=0.0)
            .select("celltype", "place", "value")
            .distinct()
            .groupBy("celltype")
            .agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("square"))
            .select("celltype", _r("total", 5), _r("square", 5))
        ),
        """, gram AS (SELECT a.celltype, a.sample AS s1, b.sample AS s2, sum(a.x * b.x) AS k FROM matrix a JOIN matrix b ON a.celltype = b.celltype AND a.gene = b.gene GROUP BY 1, 2, 3)
        SELECT celltype, round(sum(CASE WHEN s1 = s2 THEN k END), 5) AS total, round(sum(k * k), 5) AS square FROM gram GROUP BY 1""",
    ),
    "connectivity": (
        lambda i: states.connectivity(i.assigned()),
        """SELECT a.run, a.sample AS s1, b.sample AS s2 FROM assigned a JOIN assigned b ON a.run = b.run AND a.cluster = b.cluster AND a.sample <=
        b.sample""",
    ),
    "consensus": (
        lambda i: states.consensus(i.assigned()).select("s1", "s2", _r("share")),
        """SELECT a.sample AS s1, b.sample AS s2, round(count(*) / CAST((SELECT count(DISTINCT run) FROM assigned) AS DOUBLE), 6) AS share FROM assigned
        a JOIN assigned b ON a.run = b.run AND a.cluster = b.cluster AND a.sample <= b.sample GROUP BY 1, 2""",
    ),
    "state_scores_norm": (
        lambda i: states.normalized(i.scores()).select("celltype", "sample", "state", _r("score")),
        "SELECT celltype, sample, state, round(score / sum(score) OVER (PARTITION BY celltype, sample), 6) AS score FROM scores",
    ),
    "dominant_state": (
        lambda i: states.dominant(i.scores()).select("celltype", "sample", "state"),
        """SELECT celltype, sample, state FROM (SELECT *, row_number() OVER (PARTITION BY celltype, sample ORDER BY score DESC, state) AS r FROM scores)
        AS t WHERE r = 1""",
    ),
    "top_loadings_per_state": (
        lambda i: states.top_per_state(i.loadings(), 3).select("celltype", "state", "rank", "gene", _r("loading")),
        """SELECT celltype, state, rank, gene, round(loading, 6) AS loading FROM (SELECT *, row_number() OVER (PARTITION BY celltype, state ORDER BY
        loading DESC, gene) AS rank FROM loadings) AS t WHERE rank <= 3""",
    ),
    "top_abs_loadings": (
        lambda i: states.top_absolute(i.loadings(), 5).select("celltype", "state", "gene", _r("loading")),
        """SELECT celltype, state, gene, round(loading, 6) AS loading FROM loadings WHERE gene IN (SELECT gene FROM loadings GROUP BY gene ORDER BY
        max(abs(loading)) DESC, gene LIMIT 5)""",
    ),
    "fraction_order": (
        lambda i: states.fraction_order(model.fractions(i.beta())).select("celltype", _r("value"), "place"),
        """SELECT celltype, round(median(fraction), 6) AS value, row_number() OVER (ORDER BY median(fraction) DESC, celltype) AS place FROM frac GROUP BY
        celltype""",
    ),
    "fraction_order_mean": (
        lambda i: states.fraction_order(model.fractions(i.beta()), "mean").select("celltype", _r("value"), "place"),
        """SELECT celltype, round(avg(fraction), 6) AS value, row_number() OVER (ORDER BY avg(fraction) DESC, celltype) AS place FROM frac GROUP BY
        celltype""",
    ),
    "fraction_boxes": (
        lambda i: states.fraction_boxes(model.fractions(i.beta())).select("celltype", *[_r(c) for c in ("q1", "q2", "q3", "lo", "hi", "mean")]),
        """SELECT celltype, round(quantile_cont(fraction, 0.25), 6) AS q1, round(quantile_cont(fraction, 0.5), 6) AS q2, round(quantile_cont(fraction,
        0.75), 6) AS q3, round(min(fraction), 6) AS lo, round(max(fraction), 6) AS hi, round(avg(fraction), 6) AS mean FROM frac GROUP BY celltype""",
    ),
    "score_fraction_corr": (
        lambda i: states.score_fraction_correlation(i.scores(), model.fractions(i.beta())).select("celltype", "state", "other", _r("r", 5)),
        """SELECT s.celltype, state, f.celltype AS other, round(corr(score, fraction), 5) AS r FROM scores s JOIN frac f ON s.sample = f.sample GROUP BY
        1, 2, 3""",
    ),
    "constant_genes": (
        lambda i: states.constant_genes(i.matrix().withColumn("x", F.when(F.col("gene") == 4, 1.0).otherwise(F.col("x")))),
        """SELECT celltype, gene FROM (SELECT celltype, gene, CASE WHEN gene = 4 THEN 1.0 ELSE x END AS x FROM matrix) AS t GROUP BY 1, 2 HAVING
        var_pop(x) = 0""",
    ),
    "find_threshold": (
        lambda i: states.pick_k(i.curve()),
        """, steps AS (SELECT celltype, k, c, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(k, 1) OVER w AS k1, lag(k, 2) OVER w AS k2 FROM curve
        WINDOW w AS (PARTITION BY celltype ORDER BY k)), falls AS (SELECT celltype, CASE WHEN abs(c1 - 0.9) <= abs(c - 0.9) THEN k2 ELSE k1 END AS
        pick, row_number() OVER (PARTITION BY celltype ORDER BY k DESC) AS r FROM steps WHERE c < 0.9 AND c1 >= 0.9 AND c2 >= 0.9) SELECT m.celltype,
        coalesce(f.pick, m.k) AS chosen FROM (SELECT celltype, max(k) AS k FROM curve GROUP BY 1) AS m LEFT JOIN falls f ON f.celltype = m.celltype
        AND f.r = 1""",
    ),
    "biggest_drop": (
        lambda i: states.biggest_drop(i.curve()),
        """SELECT celltype, k FROM (SELECT celltype, k, row_number() OVER (PARTITION BY celltype ORDER BY d DESC, k) AS r FROM (SELECT celltype, k, c -
        lead(c) OVER (PARTITION BY celltype ORDER BY k) AS d FROM curve) AS t WHERE d IS NOT NULL) AS s WHERE r = 1""",
    ),
    "nearest_centre": (
        lambda i: (
            states.nearest_centre(i.cells().select(F.col("cell_id").alias("id"), "gene", "x"), _centres(i))
            .select("id", "centre", _r("dist", 5))
        ),
        """SELECT id, centre, round(dist, 5) AS dist FROM (SELECT c.cell_id AS id, s.celltype AS centre, sqrt(sum((x - mu) * (x - mu))) AS dist,
        row_number() OVER (PARTITION BY c.cell_id ORDER BY sqrt(sum((x - mu) * (x - mu))), s.celltype) AS r FROM cells c JOIN sig s ON c.gene = s.gene
        GROUP BY 1, 2) AS t WHERE r = 1""",
    ),
    "residual": (
        lambda i: states.residual(*_w(i)).select(_r("residual", 5), _r("frobenius", 4)),
        """SELECT round(100 * sum(abs(x - p)) / sum(abs(x)), 5) AS residual, round(sqrt(sum((x - p) * (x - p))), 4) AS frobenius FROM (SELECT b.gene,
        b.sample, max(ln(1 + expr)) AS x, sum(mu * fraction) AS p FROM scaled b JOIN sig s ON b.gene = s.gene JOIN frac f ON f.sample = b.sample AND
        f.celltype = s.celltype GROUP BY 1, 2) AS t""",
    ),
    "distances": (
        lambda i: (
            _vectors(i)
            .select("vec_id", _r("l1", 5, special.l1_distance("a", "b")), _r("l2", 5, special.l2_distance("a", "b")), _r("cosine", 5, special.cosine_distance("a", "b")), _r("abs_cosine", 5, special.abs_cosine_distance("a", "b")), _r("weighted", 5, special.weighted_abs_cosine_distance("a", "b", _loading_weights())), _r("kl", 5, special.kl_divergence("a", "b")))
        ),
        """SELECT vec_id, round(l1, 5) AS l1, round(sqrt(l2), 5) AS l2, round(1 - ab / (sqrt(aa) * sqrt(bb) + 1e-9), 5) AS cosine, round(1 - abs(ab) /
        (sqrt(aa) * sqrt(bb) + 1e-9), 5) AS abs_cosine, round(1 - abs(wab) / (sqrt(waa) * sqrt(wbb) + 1e-9), 5) AS weighted, round(kl, 5) AS kl FROM
        (SELECT vec_id, sum(x * y / i / i) AS wab, sum(x * x / i / i) AS waa, sum(y * y / i / i) AS wbb, sum(abs(x - y)) AS l1, sum((x - y) * (x - y))
        AS l2, sum(x * y) AS ab, sum(x * x) AS aa, sum(y * y) AS bb, sum(CASE WHEN x <> 0 AND y <> 0 AND x / y > 0 THEN x * ln(x / y) ELSE 0 END - x +
        y) AS kl FROM (SELECT a.vec_id, i, CAST(a.embedding[i] AS DOUBLE) AS x, CAST(b.embedding[i] AS DOUBLE) AS y FROM embeddings a JOIN embeddings
        b ON b.vec_id = a.vec_id + 1, generate_series(1, 64) AS t(i)) AS e GROUP BY vec_id) AS d""",
    ),
    "smallest_label": (
        lambda i: i.cells().groupBy("celltype").agg(F.countDistinct("cell_id").alias("n")).orderBy("n", "celltype").limit(1),
        "SELECT celltype, count(DISTINCT cell_id) AS n FROM cells GROUP BY 1 ORDER BY 2, 1 LIMIT 1",
    ),
    "state_names": (
        lambda i: (
            i.loadings()
            .select(F.concat_ws("_", F.lit("type"), "celltype", "state").alias("name"))
            .distinct()
            .select("name", F.regexp_replace("name", "_[^_]*$", "").alias("kind"), F.element_at(F.split("name", "_"), -1).alias("number"))
        ),
        "SELECT DISTINCT 'type_' || celltype || '_' || state AS name, 'type_' || celltype AS kind, CAST(state AS VARCHAR) AS number FROM loadings",
    ),
    "parts_by_sign": (
        lambda i: (
            i.raw("embeddings")
            .select("vec_id", F.explode("embedding").alias("x"))
            .groupBy("vec_id")
            .agg(F.sum(special.positive_part("x")).alias("up"), F.sum(special.negative_part("x")).alias("down"))
            .select("vec_id", _r("up", 5), _r("down", 5))
        ),
        """SELECT vec_id, round(sum(greatest(x, 0)), 5) AS up, round(sum(greatest(-x, 0)), 5) AS down FROM (SELECT vec_id, CAST(unnest(embedding) AS
        DOUBLE) AS x FROM embeddings) AS t GROUP BY vec_id""",
    ),
    "balance_curve": (
        lambda i: (
            i.raw("customer")
            .select("c_custkey", _r("y", 6, special.interpolated("c_acctbal", F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in KNOTS]))))
        ),
        """SELECT c_custkey, round(CASE WHEN c_acctbal <= -1000 THEN 0 WHEN c_acctbal < 0 THEN (c_acctbal + 1000) / 1000 WHEN c_acctbal < 2500 THEN 1 +
        c_acctbal / 5000 WHEN c_acctbal < 5000 THEN 1.5 + (c_acctbal - 2500) / 1000 WHEN c_acctbal < 9000 THEN 4 - (c_acctbal - 5000) / 4000 ELSE 3
        END, 6) AS y FROM customer""",
    ),
    "ordered_loadings": (
        lambda i: states.ordered_loadings(i.loadings()).select("celltype", "state", "place", "gene", _r("loading")),
        """SELECT celltype, state, row_number() OVER (PARTITION BY celltype, state ORDER BY loading DESC, gene) AS place, gene, round(loading, 6) AS
        loading FROM loadings""",
    ),
    "wide_scores": (
        lambda i: states.wide(i.scores().select("celltype", "sample", "state", _r("score", 4)), "sample", "score", [f"{c}_{s}" for c in range(5) for s in range(3)]),
        "SELECT sample, " + ", ".join(f'max(CASE WHEN celltype = {c} AND state = {s} THEN round(score, 4) END) AS "{c}_{s}"' for c in range(5) for s in range(3)) + " FROM scores GROUP BY sample",
    ),
    "state_points": (
        lambda i: (
            states.state_points(i.scores())
            .select("celltype", "sample", F.posexplode("points").alias("at", "v"))
            .select("celltype", "sample", "at", _r("v", 4))
        ),
        """SELECT f.celltype, f.sample, r.at, round(coalesce(score, 0), 4) AS v FROM (SELECT DISTINCT celltype, sample FROM scores) AS f JOIN (SELECT
        celltype, state, row_number() OVER (PARTITION BY celltype ORDER BY state) - 1 AS at FROM scores GROUP BY celltype, state HAVING var_pop(score)
        > 0) AS r ON r.celltype = f.celltype LEFT JOIN scores s ON s.celltype = f.celltype AND s.sample = f.sample AND s.state = r.state""",
    ),
    "state_layout": (
        lambda i: states.layout(states.state_points(i.scores())).select("celltype", "sample", F.posexplode("at").alias("axis", "v")),
        None,
    ),
    "neighbour_layout": (lambda i: layout.neighbour_layout(states.state_points(i.scores())), None),
    "marker_front": (lambda i: signature.marker_front(i.sig().select("gene", "celltype", "mu")).drop("genes"), None),
    "regression_support": (lambda i: variational.supported_genes(variational.regressions(i.scaled(), i.sig()), 0.0), None),
    "deconvolve_joint": (
        lambda i: model.fractions(variational.fit_model(i.scaled(), i.sig(), reps=1, iterations=1, inner=5, method="joint")["beta"]).select("sample", "celltype", "fraction"),
        None,
    ),
    "variance_trend": (lambda i: signature.variance_trend(i.sig()), None),
    "marker_search": (lambda i: signature.marker_search(i.sig().select("gene", "celltype", "mu")), None),
    "create_signature": (lambda i: signature.create_signature(i.cells(), bulk=i.scaled(), drop_outliers=True), None),
    "regression_start": (lambda i: variational.regression_start(i.scaled(), i.sig()), None),
    "deconvolve": (
        lambda i: model.fractions(variational.fit_model(i.scaled(), i.sig(), reps=3, iterations=3)["beta"]).select("sample", "celltype", "fraction"),
        None,
    ),
    "refine": (lambda i: variational.refine_genes(i.scaled(), i.sig(), i.beta()), None),
    "cnmf": (lambda i: _states(i)["scores"], None),
    "cnmf_loadings": (lambda i: _states(i)["loadings"], None),
    "cophenetic": (_curve, None),
    "chosen_k": (lambda i: states.pick_k(_curve(i)), None),
    "retrieve": (_retrieved, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Inputs(spark, sf_dir))) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    start = lambda sql: CTE.strip().replace("WITH", "WITH RECURSIVE", 1) if "FROM trees" in sql else CTE.strip()
    return {name: start(sql) + ("" if sql.startswith(",") else "\n") + sql for name, (_, sql) in QUERIES.items() if sql}
