import numpy as np
import pytest

from cytomix.operators import bulk, signature
from cytomix.plans import study


@pytest.fixture(scope="module")
def tables(spark):
    """Cells with half their entries absent, as triplets and as the grid of zeros filled in."""
    rnd = np.random.default_rng(8)
    x = np.where(rnd.random((60, 40)) < 0.5, 0.0, rnd.gamma(2.0, 0.8, (60, 40)))
    x[:, 7] = 0.0
    kinds = [None if c % 10 == 9 else f"t{c % 3}" for c in range(60)]
    cells = spark.createDataFrame([(c, kinds[c]) for c in range(60)], "cell_id int, celltype string")
    expr = spark.createDataFrame([(c, f"g{g:02d}", float(x[c, g])) for c in range(60) for g in range(40) if x[c, g]], "cell_id int, gene string, x double")
    grid = spark.createDataFrame([(c, kinds[c], f"g{g:02d}", float(x[c, g])) for c in range(60) for g in range(40)], "cell_id int, celltype string, gene string, x double")
    genes = spark.createDataFrame([(f"g{g:02d}",) for g in range(40)], "gene string")
    mixed = spark.createDataFrame([(f"g{g:02d}", f"s{s}", float(rnd.gamma(2.0, 50.0))) for g in range(40) for s in range(6)], "gene string, sample string, expr double")
    return cells, expr, grid, genes, mixed


def near(a, b, keys, least=1e-9):
    a, b = (f.toPandas().sort_values(keys, ignore_index=True) for f in (a, b))
    assert list(a[keys].itertuples()) == list(b[keys].itertuples()) and len(a)
    for c in b.select_dtypes("number").columns:
        assert np.allclose(a[c], b[c], atol=least, rtol=0, equal_nan=True), c


@pytest.mark.parametrize("correct", [True, False])
def test_signature_of_triplets_equals_that_of_the_filled_grid(tables, correct):
    cells, expr, grid, genes, mixed = tables
    args = {"correct_variance": correct, "n_variable": 30, "bulk": mixed, "drop_outliers": True}
    sparse, dense = signature.create_signature(cells, expr=expr, genes=genes, **args), signature.create_signature(grid, **args)
    near(sparse, dense, ["gene", "celltype", "is_marker"])


def test_each_sum_carries_the_zeros(tables):
    cells, expr, grid, genes, mixed = tables
    near(signature.sparse_moments(cells, expr, genes), signature.moments(grid), ["gene", "celltype"])
    typed = grid.where("celltype is not null")
    near(signature.dispersion_of(signature.sparse_gene_moments(cells, expr, genes, linear=True)), signature.dispersion(typed), ["gene", "bin"])
    means = signature.sparse_gene_moments(cells, expr).selectExpr("gene", "m as sc_mean")
    near(bulk.bland_altman_of(mixed, means), bulk.bland_altman(mixed, typed.where("gene <> 'g07'")), ["gene", "outlier"])
    far = expr.selectExpr("cell_id", "gene", "x + 1e6 as x")
    got = signature.sparse_gene_moments(cells.limit(0).union(cells), far).where("gene = 'g00'").head()
    values = np.array([r.x for r in far.where("gene = 'g00'").join(cells.where("celltype is not null"), "cell_id").collect()])
    full = np.concatenate((values, np.zeros(54 - len(values))))
    assert abs(got.v / full.var() - 1) < 1e-12


def test_a_grid_with_holes_is_an_error(tables):
    cells, expr, grid, *_ = tables
    with pytest.raises(ValueError, match="lack genes"):
        signature.create_signature(expr.join(cells, "cell_id"))
    with pytest.raises(ValueError, match="lack the columns"):
        signature.create_signature(cells, expr=expr.drop("gene"))
    with pytest.raises(ValueError, match="negative"):
        signature.create_signature(cells, expr=expr.selectExpr("cell_id", "gene", "-x as x"))


def test_a_study_on_triplets_equals_one_on_the_grid_and_on_its_signature(spark, tables):
    cells, expr, grid, genes, mixed = tables
    marks = genes.where("gene < 'g20'")
    for correct in (True, False):
        a = study.begin(mixed, cells=cells, expr=expr, genes=genes, markers=marks, correct_variance=correct)
        b = study.begin(mixed, cells=grid, markers=marks, correct_variance=correct)
        c = study.begin(mixed, signature_table=signature.create_signature(grid, markers=marks, correct_variance=correct).drop("std"))
        near(a.signature, b.signature, ["gene", "celltype", "is_marker"])
        fits = [s.deconvolve(reps=1, iterations=1).fraction for s in (a, b, c)]
        near(fits[0], fits[1], ["sample", "celltype"], 1e-5)
        near(fits[2], fits[1], ["sample", "celltype"], 1e-5)
