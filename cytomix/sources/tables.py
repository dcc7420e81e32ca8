"""Reading and writing expression tables: wide text files, triplets, a signature catalog, and stage results."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_wide(spark: SparkSession, path: str, key: str, name: str, value: str, sep: str = "\t") -> DataFrame:
    """A wide text file (a key column, then a numeric column for each name) as rows (key, name, value). NaN becomes null."""
    first, *rest = spark.read.csv(path, sep=sep, header=True).columns
    schema = T.StructType([T.StructField(first, T.StringType()), *(T.StructField(c, T.DoubleType()) for c in rest)])
    wide = spark.read.csv(path, sep=sep, header=True, schema=schema)
    long = wide.select(F.col(f"`{first}`").alias(key), *[F.col(f"`{c}`").alias(c) for c in rest]).unpivot(key, rest, name, value)
    return long.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def write_wide(long: DataFrame, path: str, key: str, name: str, value: str, names: list[str]) -> None:
    """Rows (key, name, value) as a wide text file with the given names as columns, one row for each key."""
    long.groupBy(key).pivot(name, names).agg(F.first(value)).write.csv(path, sep="\t", header=True)


def read_triplets(spark: SparkSession, cells: str, expr: str) -> tuple[DataFrame, DataFrame]:
    """Single-cell data: cells (cell_id, celltype) without those that lack a type, and expression (cell_id, gene, x) of the rest."""
    kept = spark.read.parquet(cells).where(F.col("celltype").isNotNull())
    return kept, spark.read.parquet(expr).join(kept.select("cell_id"), "cell_id", "left_semi")


#: Values of a sparse matrix that a task hands on at once.
VALUES = 500_000


def read_sparse_rows(spark: SparkSession, path: str, cells: DataFrame, genes: DataFrame, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Single-cell data from files of compressed sparse rows: cells (cell_id, celltype) without those that lack a type, and expression (cell_id, gene, x) of the rest.

    path names .npz files with the arrays indptr, indices, data, shape and format (csr), as sparse matrices are commonly saved: a file holds the rows of some cells, so a cell matrix is as many files as it has chunks,
    and each is read by the task that gets it. cells (file, row, cell_id, celltype) tells which cell a row of a file is, file being its name without folders; genes (at, gene) names the columns; only (gene) restricts them, inside
    the tasks. Zeros that are stored are dropped, and values stored twice for one entry are added up. A file that is no such matrix is an error.
    """
    wanted = genes if only is None else genes.join(only.select("gene").distinct(), "gene", "left_semi")
    kept = None if only is None else np.sort(wanted.select("at").toPandas()["at"].to_numpy())  # numbers of columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    kind = held["format"].item() if "format" in held else None
                    if (kind.decode() if isinstance(kind, bytes) else kind) != "csr":
                        raise ValueError(f"{name} holds no compressed sparse rows")
                    starts, at, x = held["indptr"].astype(np.int64), held["indices"], held["data"]
                for begin in range(0, len(x), VALUES):
                    own = np.arange(begin, min(begin + VALUES, len(x)))
                    row = np.searchsorted(starts, own, side="right") - 1
                    use = x[own] != 0 if kept is None else (x[own] != 0) & np.isin(at[own], kept)
                    yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "row": row[use], "at": at[own][use].astype(np.int64), "x": x[own][use].astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    values = files.mapInPandas(read, "file string, row long, at long, x double")
    typed = cells.where(F.col("celltype").isNotNull())
    expr = values.join(typed.select("file", "row", "cell_id"), ["file", "row"]).join(wanted.select("at", "gene"), "at")
    return typed.select("cell_id", "celltype"), expr.groupBy("cell_id", "gene").agg(F.sum("x").alias("x"))


def signature_from_wide(wide: DataFrame, gene: str = "Gene", marker: str = "IsMarker", mean: str = "scExp_", var: str = "scVar_") -> DataFrame:
    """(gene, celltype, mu, var, is_marker) from columns named by prefix and cell type."""
    types = [c.removeprefix(mean) for c in wide.columns if c.startswith(mean)]
    entries = F.array(*[F.struct(F.lit(t).alias("celltype"), F.col(f"`{mean}{t}`").cast("double").alias("mu"), F.col(f"`{var}{t}`").cast("double").alias("var")) for t in types])
    return wide.select(F.col(gene).alias("gene"), F.col(marker).cast("boolean").alias("is_marker"), F.inline(entries)).select("gene", "celltype", "mu", "var", "is_marker")


def save_signature(signature: DataFrame, catalog: str, tumor_type: str) -> None:
    """Add a signature to a catalog: Parquet partitioned by tumor type and number of cell types."""
    n = signature.select("celltype").distinct().count()
    signature.withColumns({"tumor_type": F.lit(tumor_type), "n_celltypes": F.lit(n)}).write.mode("append").partitionBy("tumor_type", "n_celltypes").parquet(catalog)


def available_signatures(spark: SparkSession, catalog: str) -> DataFrame:
    return spark.read.parquet(catalog).select("tumor_type", "n_celltypes").distinct()


def fetch_signature(spark: SparkSession, catalog: str, tumor_type: str, n_celltypes: int | None = None) -> DataFrame:
    """The signature of a tumor type, by default the one with the fewest cell types. An unknown type is an error that names the known ones."""
    options = available_signatures(spark, catalog)
    if n_celltypes is None:
        n_celltypes = options.where(F.col("tumor_type") == tumor_type).agg(F.min(F.col("n_celltypes").cast("int"))).head()[0]
    found = spark.read.parquet(catalog).where((F.col("tumor_type") == tumor_type) & (F.col("n_celltypes") == F.lit(n_celltypes)))
    if n_celltypes is None or found.isEmpty():
        known = sorted({r["tumor_type"] for r in options.collect()})
        raise ValueError(f"no signature of {tumor_type!r} with {n_celltypes} cell types; there are {known}")
    return found.drop("tumor_type", "n_celltypes")


def save_results(results: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each named result of a stage."""
    for name, df in results.items():
        df.write.parquet(f"{path}/{name}")


def load_results(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def bulk_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's sales as bulk expression: gene is the part's size, sample the customer's nation, expr the quantity sold."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("p_size").alias("gene"), F.col("c_nationkey").alias("sample")).agg(F.sum("l_quantity").alias("expr"))


def cell_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's vectors as single cells: (cell_id, celltype, gene, x), x = ln(1 + 10 |component|)."""
    x: Column = F.log1p(10 * F.abs(F.col("e").cast("double")))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("gene", "e"))
    return rows.select(F.col("vec_id").alias("cell_id"), F.col("label").alias("celltype"), "gene", x.alias("x"))
