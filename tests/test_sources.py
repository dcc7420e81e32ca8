import numpy as np
import pytest
from pyspark.sql import functions as F

from cytomix.operators import signature
from cytomix.plans import study
from cytomix.sources import tables


def save_rows(path, x):
    """A matrix as compressed sparse rows, with the arrays that such files have."""
    row, column = np.nonzero(x)
    np.savez_compressed(path, indptr=np.concatenate(([0], np.cumsum((x != 0).sum(1)))).astype(np.int32), indices=column.astype(np.int32), data=x[row, column], shape=x.shape, format=np.array(b"csr"))


@pytest.mark.parametrize("values", [500_000, 7])
def test_sparse_rows_round_trip(spark, tmp_path, monkeypatch, values):
    monkeypatch.setattr(tables, "VALUES", values)
    rnd = np.random.default_rng(3)
    chunks = [np.where(rnd.random((n, 12)) < 0.6, 0.0, rnd.gamma(2.0, 1.0, (n, 12))) for n in (5, 9, 1)]
    for i, x in enumerate(chunks):
        save_rows(tmp_path / f"rows-{i}.npz", x)
    (tmp_path / "notes.txt").write_text("not a matrix")
    cells = spark.createDataFrame([(f"rows-{i}.npz", r, f"c{i}:{r}", None if r == 4 else f"t{r % 2}") for i, x in enumerate(chunks) for r in range(len(x))], "file string, row long, cell_id string, celltype string")
    genes = spark.createDataFrame([(g, f"g{g}") for g in range(12)], "at long, gene string")
    kept, expr = tables.read_sparse_rows(spark, str(tmp_path), cells, genes)
    want = {(f"c{i}:{r}", f"g{g}"): x[r, g] for i, x in enumerate(chunks) for r in range(len(x)) for g in range(12) if x[r, g] and r != 4}
    assert {(r.cell_id, r.gene): r.x for r in expr.collect()} == want and kept.count() == 13
    some = genes.where("at in (2, 5)")
    assert {(r.cell_id, r.gene) for r in tables.read_sparse_rows(spark, str(tmp_path), cells, genes, some)[1].collect()} == {k for k in want if k[1] in ("g2", "g5")}
    made = {(r.gene, r.celltype): r.mu for r in signature.create_signature(kept, expr=expr, genes=genes, markers=some, correct_variance=False).collect()}
    rows = [(x[r], f"t{r % 2}") for x in chunks for r in range(len(x)) if r != 4]
    assert all(np.isclose(made[f"g{g}", t], np.mean([v[g] for v, k in rows if k == t])) for g in range(12) for t in ("t0", "t1"))
    np.savez(tmp_path / "rows-9.npz", format=np.array(b"csc"))
    with pytest.raises(Exception, match="no compressed sparse rows"):
        tables.read_sparse_rows(spark, str(tmp_path), cells, genes)[1].collect()


def test_other_layouts_are_read_as_far_as_they_go(spark, tmp_path):
    bulk = spark.createDataFrame([(g, s, float(g + s + 1)) for g in range(3) for s in range(2)], "gene int, sample int, expr double")
    table = spark.createDataFrame([(g, c, 1.0, 0.5, True) for g in range(3) for c in range(2)], "gene int, celltype int, mu double, var double, is_marker boolean")
    beta = spark.createDataFrame([(s, c, 1.0 + c) for s in range(2) for c in range(2)], "sample int, celltype int, beta double")
    path = str(tmp_path / "old")
    with pytest.raises(ValueError, match="no study"):
        study.load(spark, path)
    bulk.write.parquet(f"{path}/bulk")
    table.write.parquet(f"{path}/signature")
    beta.write.parquet(f"{path}/unheard_of")
    stage = study.load(spark, path)
    assert type(stage) is study.Study and stage.counts.head().common_genes == 3 and stage.signature.where("std = var").count() == 6
    beta.write.parquet(f"{path}/fit_beta")
    stage = study.load(spark, path)
    assert type(stage) is study.Fractions and {round(r.fraction, 6) for r in stage.fraction.collect()} == {0.333333, 0.666667}
    gex = spark.range(12).select((F.col("id") % 2).alias("celltype"), (F.col("id") % 3).alias("gene"), F.floor(F.col("id") / 6).alias("sample"), F.rand(1).alias("nu"))
    gex.write.parquet(f"{path}/gex")
    gex.select("celltype", "gene", F.lit(0.5).alias("omega")).distinct().write.parquet(f"{path}/omega")
    for name in ("scores", "loadings"):
        gex.write.parquet(f"{path}/states_{name}")
    spark.createDataFrame([('{"layout": 99, "tables": ["x"]}',)], "about string").write.text(f"{path}/about")
    stage = study.load(spark, path)
    assert type(stage) is study.States and stage.matrix.count() == 12 and stage.expression.omega.count() == 6
