"""Bulk expression: format rules, library size, gene matching and agreement with single cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cp10k(bulk: DataFrame) -> DataFrame:
    """expr scaled to a sum of 10,000 in each sample; null where that sum is zero."""
    total = F.sum("expr").over(Window.partitionBy("sample"))
    return bulk.withColumn("expr", F.try_divide("expr", total) * 1e4)


def format_flags(bulk: DataFrame) -> DataFrame:
    """One row with what decides how a bulk table is read; action is accept, rescale, reject or keep, by the first rule that holds.

    Accept: every sample sums to strictly between 9999 and 10001. Rescale: some sample's mean over all genes exceeds 10. Reject:
    some value is negative. The number of genes counts for every sample, so absent rows are zeros.
    """
    genes = bulk.agg(F.countDistinct("gene").alias("n_genes"))
    samples = bulk.groupBy("sample").agg(F.sum("expr").alias("s"), F.min("expr").alias("lo"), F.count("*").alias("n"), F.countDistinct("gene").alias("d"))
    flags = samples.join(genes).agg(
        F.max("n_genes").alias("n_genes"), F.count("*").alias("n_samples"), F.bool_and((F.col("s") > 9999) & (F.col("s") < 10001)).alias("all_cp10k"), F.bool_or(F.col("s") / F.col("n_genes") > 10).alias("any_mean_over_10"), F.bool_or(F.col("lo") < 0).alias("any_negative"), F.bool_or(F.col("n") > F.col("d")).alias("any_duplicate")
    )
    action = F.when(F.col("any_duplicate"), "reject").when(F.col("all_cp10k"), "accept").when(F.col("any_mean_over_10"), "rescale").when(F.col("any_negative"), "reject").otherwise("keep")
    return flags.withColumn("action", action)


def checked(bulk: DataFrame) -> DataFrame:
    """bulk as its format rules say: as it is, or scaled; ValueError if they reject it or it is empty."""
    flags = format_flags(bulk).head()
    if flags is None or not flags["n_samples"]:
        raise ValueError("bulk expression is empty")
    if flags["action"] == "reject":
        raise ValueError("bulk expression has duplicate genes in a sample" if flags["any_duplicate"] else "bulk expression has negative values")
    return cp10k(bulk) if flags["action"] == "rescale" else bulk


def common_genes(bulk: DataFrame, signature: DataFrame) -> DataFrame:
    return bulk.select("gene").distinct().join(signature.select("gene").distinct(), "gene", "left_semi")


def match_counts(bulk: DataFrame, signature: DataFrame) -> DataFrame:
    """One row: genes of the bulk, of the signature, and of both, and how many of the last are markers (0 without is_marker)."""
    marks = F.max("is_marker") if "is_marker" in signature.columns else F.lit(False)
    both = bulk.select("gene").distinct().withColumn("in_bulk", F.lit(1)).join(signature.groupBy("gene").agg(F.lit(1).alias("in_signature"), marks.alias("marker")), "gene", "full")
    common = F.col("in_bulk").isNotNull() & F.col("in_signature").isNotNull()
    return both.agg(F.count("in_bulk").alias("bulk_genes"), F.count("in_signature").alias("signature_genes"), F.count(F.when(common, 1)).alias("common_genes"), F.count(F.when(common & F.col("marker"), 1)).alias("common_markers"))


def first_seen(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values of column with their place by first appearance in order, from 0."""
    first = rows.groupBy(column).agg(F.min(order).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("first", column)) - 1)  # labels are few


def cell_subset(cells: DataFrame, patient: str, celltype: str, id_col: str = "cell_id") -> DataFrame:
    """Cells of one type and patient, the patient being what stands before the first colon of the cell's id."""
    return cells.where((F.split_part(F.col(id_col).cast("string"), F.lit(":"), F.lit(1)) == patient) & (F.col("celltype") == celltype))


def matched(bulk: DataFrame, signature: DataFrame) -> DataFrame:
    """Each bulk value with the signature rows of its gene."""
    return bulk.join(signature, "gene")


def log_std(bulk: DataFrame, scale: float = 1.0) -> DataFrame:
    """Spread of a gene's log expression over samples (population), times scale, plus 0.1."""
    return bulk.groupBy("gene").agg((F.stddev_pop(F.log1p("expr")) * scale + 0.1).alias("sigma"))


def bland_altman(bulk: DataFrame, cells: DataFrame, cutoff: float = 1.96) -> DataFrame:
    """(gene, sc_mean, bulk_mean, diff, outlier): outlier where the difference of means lies beyond cutoff population deviations of its own mean."""
    return bland_altman_of(bulk, cells.groupBy("gene").agg(F.avg("x").alias("sc_mean")), cutoff)


def bland_altman_of(bulk: DataFrame, means: DataFrame, cutoff: float = 1.96) -> DataFrame:
    """bland_altman() from the single cells' means (gene, sc_mean)."""
    both = means.join(bulk.groupBy("gene").agg(F.avg("expr").alias("bulk_mean")), "gene").withColumn("diff", F.col("sc_mean") - F.col("bulk_mean"))
    limits = both.agg(F.avg("diff").alias("m"), F.stddev_pop("diff").alias("s"))
    return both.join(limits).withColumn("outlier", F.abs(F.col("diff") - F.col("m")) > cutoff * F.col("s")).drop("m", "s")


def without(df: DataFrame, genes: DataFrame) -> DataFrame:
    return df.join(genes.select("gene"), "gene", "left_anti")
