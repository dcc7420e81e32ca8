import duckdb
import numpy as np
import pandas as pd
import pytest

from cytomix.functions.support import support_regression
from cytomix.operators import bulk, signature
from cytomix.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(round(float(v), 4) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v else str(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=lambda r: [(isinstance(v, str), v) for v in r])


#: Queries whose rounded values must be the same to the last digit.
ROUNDED = ("log_fractions", "create_signature_sparse", "sparse_dispersion", "elbo_dirichlet", "sample_alpha", "fraction_neighbours", "fraction_leaves")


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    a, b = rows(got), rows(want)
    if name in ROUNDED:
        assert sorted(map(str, got[sorted(got.columns)].itertuples(index=False))) == sorted(map(str, want[sorted(want.columns)].itertuples(index=False)))
    for x, y in zip(a, b, strict=True):
        assert all((abs(p - q) <= 2e-4 * max(1, abs(p))) if isinstance(p, float) and isinstance(q, float) else str(p) == str(q) for p, q in zip(x, y, strict=True)), (x, y)


def test_duplicates_are_told_alike(spark, duck):
    """The flags of a table with a gene twice in a sample, by the query's own SQL over it."""
    frame = pd.DataFrame({"gene": [1, 1, 2, 1, 2], "sample": [0, 0, 0, 1, 1], "expr": [1.0, 2.0, 3.0, 4.0, 5.0]})
    sql = catalog.oracle_sql()["bulk_format_flags"].removeprefix(catalog.CTE.strip())
    con = duckdb.connect()
    con.register("bulk", frame)
    assert rows(con.execute(sql).df()) == rows(bulk.format_flags(spark.createDataFrame(frame)).toPandas()) and con.execute(sql).df()["any_duplicate"][0]


def wide(duck, sql, index, columns, values):
    return duck.execute(f"{catalog.CTE.strip()} SELECT {index}, {columns}, {values} FROM {sql}").df().pivot(index=index, columns=columns, values=values).sort_index(axis=0).sort_index(axis=1)


def test_regression_start_equals_plain_regressions(spark, duck):
    x, y = np.expm1(wide(duck, "sig", "gene", "celltype", "mu")), wide(duck, "scaled", "gene", "sample", "expr")
    x = x.loc[y.index].to_numpy()
    got = catalog.queries()["regression_start"](spark, SF).toPandas().pivot(index="sample", columns="celltype", values="fraction")
    for s in y.columns:
        best = min((support_regression(x, y[s].to_numpy(), nu) for nu in (0.25, 0.5, 0.75)), key=lambda r: r.error(x, y[s].to_numpy()))
        share = np.maximum(best.coef, 0)
        assert np.allclose(got.loc[s], share / share.sum(), atol=1e-6) and best.residual < 1e-6


def test_retrieved_scores_equal_plain_updates(spark, duck):
    got = catalog.queries()["retrieve"](spark, SF).toPandas().set_index(["celltype", "sample", "state"])["score"]
    mu, std = (wide(duck, "sig", "gene", "celltype", c) for c in ("mu", "std"))
    for c in (0, 4, 9):
        nu = wide(duck, f"nu WHERE celltype = {c}", "gene", "sample", "nu")
        w = np.column_stack((mu.loc[nu.index, c], std.loc[nu.index, c]))
        a = w.T @ w
        for s in nu.columns:
            b, h = w.T @ nu[s].to_numpy(), np.full(2, 0.5)
            for _ in range(300):
                h = h * np.sqrt((np.maximum(b, 0) + np.maximum(-a, 0) @ h) / (np.maximum(-b, 0) + np.maximum(a, 0) @ h + 1e-9))
            assert np.allclose(got.loc[c, s], h / h.sum(), atol=1e-6)


def test_variance_trend_equals_that_of_the_sql_moments(spark, duck):
    got = catalog.queries()["variance_trend"](spark, SF).toPandas().pivot(index="gene", columns="celltype", values="var")
    mu, var = (wide(duck, "sig", "gene", "celltype", c) for c in ("mu", "var"))
    for c in mu.columns:
        assert np.allclose(got.sort_index()[c], signature.trend(mu[c].to_numpy(), var[c].to_numpy()) + 0.01, rtol=1e-4)


#: Rows of the queries without SQL: 25 nations, 64 genes, of which the bulk has 50, ten cell types, and eight numbers of states.
ROWS = {"state_layout": 5 * 25 * 2, "variance_trend": 640, "regression_start": 250, "deconvolve": 250, "refine": 50 * 25 * 10, "cophenetic": 80, "chosen_k": 10, "retrieve": 500, "neighbour_layout": 125, "deconvolve_joint": 250}
SUMS = {"regression_start": "fraction", "deconvolve": "fraction", "deconvolve_joint": "fraction", "cnmf": "score", "retrieve": "score"}


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_queries_without_sql(spark, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got) == ROWS.get(name, len(got)) > 0 and not got.isna().any().any()
    for c in got.select_dtypes("number"):
        assert pd.Series(got[c]).abs().max() < 1e12
    if name in SUMS:
        totals = got.groupby(["celltype", "sample"] if SUMS[name] == "score" else ["sample"])[SUMS[name]].sum()
        assert np.allclose(totals, 1.0)
