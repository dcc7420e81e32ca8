"""A study from bulk expression to cell states. Each stage is its own type, so a later one cannot be asked for before the earlier is done, and no stage changes another."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomix.operators import bulk as bulks
from cytomix.operators import model, signature, states, variational
from cytomix.sources import tables
from cytomix.sources.stored import stored

LAYOUT = 1


@dataclass(frozen=True)
class Study:
    """Checked inputs that share their genes: bulk (gene, sample, expr), and signature (gene, celltype, mu, std, var, is_marker). Models take var as the spread of their prior, whatever made it."""

    bulk: DataFrame
    signature: DataFrame
    counts: DataFrame

    def deconvolve(self, *, genes: DataFrame | None = None, expected: DataFrame | None = None, members: DataFrame | None = None, **model_args) -> Fractions:
        """Fractions of cell types by the mixture model on the marker genes, or on genes (gene) where given.

        expected is a prior: (sample, celltype, prior), or (sample, group, prior) with members (group, celltype). model_args go to variational.fit_model.
        """
        used = self.signature.where("is_marker") if genes is None else self.signature.join(genes.select("gene").distinct(), "gene", "left_semi")
        if expected is not None:
            expected, members = model.checked_prior(expected, self.signature.select("celltype").distinct(), members)
        fit = variational.fit_model(self.bulk, used.select("gene", "celltype", "mu", F.col("var").alias("std")), expected=expected, members=members, **model_args)
        fit = {name: stored(df, f"study-{name}") for name, df in fit.items()}
        return Fractions(self, fit, model.fractions(fit["beta"]).select("sample", "celltype", "fraction"))


@dataclass(frozen=True)
class Fractions:
    """A fitted model: its tables, and fraction (sample, celltype, fraction)."""

    study: Study
    fit: dict[str, DataFrame] = field(repr=False)
    fraction: DataFrame

    def refine(self, *, weight: float = 100.0, genes: DataFrame | None = None, **model_args) -> Expression:
        """Expression by sample and cell type of all common genes, or those of genes (gene), with the fractions held. model_args go to variational.refine_genes."""
        spread = self.study.signature.select("gene", "celltype", "mu", F.col("var").alias("std"))
        rows = stored(variational.refine_genes(self.study.bulk, spread, self.fit["beta"], omega=self.fit["omega"], genes=genes, weight=weight, **model_args), "study-refined")
        return Expression(self, rows.select("celltype", "sample", "gene", "nu"), rows.select("celltype", "gene", "omega").distinct())


@dataclass(frozen=True)
class Expression:
    """gex (celltype, sample, gene, nu), log expression, and omega (celltype, gene, omega)."""

    fractions: Fractions
    gex: DataFrame
    omega: DataFrame

    def extract(self, celltype) -> DataFrame:
        """One cell type's expression (sample, gene, nu); ValueError that names the known types for another."""
        return _of(self.gex, celltype)

    def discover_states(self, celltypes: list | str | None = None, k: int | list | dict | None = None, *, weighing: str = "Omega", **state_args) -> States:
        """Cell states of the given cell types, by default all. k is their number: one for all cell types (celltypes is then ignored), a list beside celltypes, or by cell type, for its keys only; None chooses it
        by stability. state_args go to states.discover."""
        matrix = stored(states.cluster_matrix(self.gex, self.omega, self.fractions.fraction, weighing), "study-matrix")
        return States(self, matrix, states.discover(matrix, wanted_states(self.gex, celltypes, k), **state_args))


@dataclass(frozen=True)
class States:
    """The cluster matrix, and scores (celltype, sample, state, score), loadings (celltype, gene, state, loading) and cophenetic (celltype, k, c, chosen)."""

    expression: Expression
    matrix: DataFrame
    found: dict[str, DataFrame] = field(repr=False)

    def scores(self, celltype=None) -> DataFrame:
        return self.found["scores"] if celltype is None else _of(self.found["scores"], celltype)

    def loadings(self, celltype=None) -> DataFrame:
        return self.found["loadings"] if celltype is None else _of(self.found["loadings"], celltype)

    def cophenetic(self) -> DataFrame:
        return self.found["cophenetic"]

    def wide_scores(self) -> DataFrame:
        """A row for each sample, and a column celltype_state for each state of any cell type."""
        return states.wide(self.found["scores"], "sample", "score", _names(self.found["scores"]))

    def wide_loadings(self) -> DataFrame:
        return states.wide(self.found["loadings"], "gene", "loading", _names(self.found["loadings"]))

    def retrieve(self, gex: DataFrame, omega: DataFrame, fraction: DataFrame, weighing: str = "Omega") -> DataFrame:
        """Scores of new samples (celltype, sample, gene, nu) under these loadings."""
        return states.retrieve(states.cluster_matrix(gex, omega, fraction, weighing), self.found["loadings"])


def _names(rows: DataFrame) -> list[str]:
    """Columns of a wide export; states are few."""
    return [f"{r['celltype']}_{r['state']}" for r in rows.select("celltype", "state").distinct().orderBy("celltype", "state").collect()]


def _of(rows: DataFrame, celltype) -> DataFrame:
    found = rows.where(F.col("celltype") == F.lit(celltype))
    if found.isEmpty():
        known = [r["celltype"] for r in rows.select("celltype").distinct().orderBy("celltype").collect()]
        raise ValueError(f"no cell type {celltype!r}; there are {known}")
    return found.drop("celltype")


def wanted_states(gex: DataFrame, celltypes: list | str | None, k: int | list | dict | None) -> DataFrame | None:
    """(celltype, k) for states.discover, null k where it is to be chosen."""
    if isinstance(k, bool) or not (k is None or isinstance(k, (int, list, dict))):
        raise TypeError("k must be a number, a list, a dict or None")
    named = [celltypes] if isinstance(celltypes, str) else None if celltypes is None else list(celltypes)
    kind = gex.schema["celltype"].dataType.simpleString()
    every = gex.select("celltype").distinct()
    if isinstance(k, int):
        return every.withColumn("k", F.lit(k))
    if isinstance(k, dict):
        pairs = list(k.items())
    elif isinstance(k, list):
        named = named if named is not None else [r["celltype"] for r in every.orderBy("celltype").collect()]
        if len(k) != len(named):
            raise ValueError("k must have as many numbers as there are cell types")
        pairs = list(zip(named, k, strict=True))
    else:
        if named is None:
            return None
        pairs = [(c, None) for c in named]
    wanted = gex.sparkSession.createDataFrame(pairs, f"celltype {kind}, k int")
    unknown = [r["celltype"] for r in wanted.join(every, "celltype", "left_anti").take(5)]
    if unknown:
        raise ValueError(f"no cell types {unknown}")
    return wanted


def begin(bulk: DataFrame, *, signature_table: DataFrame | None = None, cells: DataFrame | None = None, catalog: str | None = None, tumor_type: str | None = None, n_celltypes: int | None = None, markers: DataFrame | None = None, **signature_args) -> Study:
    """A study of bulk (gene, sample, expr), which its format rules check and scale.

    The signature is one of: signature_table (gene, celltype, mu, var, is_marker), one made from cells (cell_id, celltype, gene, x) with signature_args, or that of a tumor type in a catalog. markers (gene)
    override which genes are markers. A study needs a common gene.
    """
    if (signature_table is not None) + (cells is not None) + (tumor_type is not None) != 1:
        raise ValueError("give a signature, single cells, or a tumor type, and only one of them")
    bulk = bulks.checked(bulk)
    if signature_table is not None:
        missing = {"gene", "celltype", "mu", "var", "is_marker"} - set(signature_table.columns)
        if missing:
            raise ValueError(f"the signature lacks the columns {sorted(missing)}")
        table = signature.with_variance_floor(signature_table)
    elif cells is not None:
        table = signature.create_signature(cells, markers=markers, bulk=bulk, **signature_args)
    else:
        if catalog is None:
            raise ValueError("a tumor type needs a catalog")
        table = signature.with_variance_floor(tables.fetch_signature(bulk.sparkSession, catalog, tumor_type, n_celltypes))
    if markers is not None:
        table = signature.flagged(table, markers)
    if "std" not in table.columns:
        table = table.withColumn("std", F.col("var"))
    table = stored(table, "study-signature")
    common = bulks.common_genes(bulk, table)
    kept, used = stored(bulk.join(common, "gene", "left_semi"), "study-bulk"), stored(table.join(common, "gene", "left_semi"), "study-matched")
    if kept.isEmpty():
        raise ValueError("bulk and signature have no gene in common")
    return Study(kept, used, bulks.match_counts(bulk, table))


def save(stage: Study | Fractions | Expression | States, path: str) -> None:
    """All tables of a stage and of those before it, each as Parquet, and a row that says what they are."""
    spark = _first(stage).bulk.sparkSession
    for name, df in _tables(stage).items():
        df.write.parquet(f"{path}/{name}")
    about = {"layout": LAYOUT, "stage": type(stage).__name__, "tables": sorted(_tables(stage)), "saved": datetime.now(timezone.utc).isoformat()}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{path}/about")


#: Tables that a saved stage may have.
SAVED = "bulk signature counts fit_beta fit_alpha fit_nu fit_omega fit_sigma fit_objective fraction gex omega matrix states_scores states_loadings states_cophenetic".split()


def load(spark: SparkSession, path: str) -> Study | Fractions | Expression | States:
    """The stage that save wrote, with all before it.

    What another layout wrote is read as far as it goes: tables that are known by name, whatever else is there; counts and fractions are made again where they are lacking, a signature's std is its var, and a
    cluster matrix weighs by omega. The stage is the last one whose own results are there. Without bulk and signature it is an error.
    """
    about = _about(spark, path)
    names = about["tables"] if about and about.get("layout") == LAYOUT else SAVED
    found = {}
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException:
            if names is not SAVED:
                raise
    if not {"bulk", "signature"} <= found.keys():
        raise ValueError(f"{path} holds no study: bulk or signature is missing")
    part = lambda prefix: {k.removeprefix(prefix): v for k, v in found.items() if k.startswith(prefix)}
    table = found["signature"]
    table = table if "std" in table.columns else table.withColumn("std", F.col("var"))
    stage: Study | Fractions | Expression | States = Study(found["bulk"], table, found["counts"] if "counts" in found else bulks.match_counts(found["bulk"], table))
    if "fit_beta" in found:
        stage = Fractions(stage, part("fit_"), found["fraction"] if "fraction" in found else model.fractions(found["fit_beta"]).select("sample", "celltype", "fraction"))
        if {"gex", "omega"} <= found.keys():
            stage = Expression(stage, found["gex"], found["omega"])
            if {"states_scores", "states_loadings"} <= found.keys():
                matrix = found["matrix"] if "matrix" in found else states.cluster_matrix(found["gex"], found["omega"], stage.fractions.fraction)
                stage = States(stage, matrix, part("states_"))
    return stage


def _about(spark: SparkSession, path: str) -> dict | None:
    """What save wrote about the tables; None if it is not there or not to be read."""
    try:
        return json.loads(spark.read.text(f"{path}/about").head()[0])
    except (AnalysisException, TypeError, ValueError):
        return None


def _first(stage) -> Study:
    while not isinstance(stage, Study):
        stage = stage.expression if isinstance(stage, States) else stage.fractions if isinstance(stage, Expression) else stage.study
    return stage


def _tables(stage) -> dict[str, DataFrame]:
    if isinstance(stage, Study):
        return {"bulk": stage.bulk, "signature": stage.signature, "counts": stage.counts}
    if isinstance(stage, Fractions):
        return _tables(stage.study) | {f"fit_{k}": v for k, v in stage.fit.items()} | {"fraction": stage.fraction}
    if isinstance(stage, Expression):
        return _tables(stage.fractions) | {"gex": stage.gex, "omega": stage.omega}
    return _tables(stage.expression) | {"matrix": stage.matrix} | {f"states_{k}": v for k, v in stage.found.items()}
