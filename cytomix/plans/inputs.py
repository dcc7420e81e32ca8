"""Model tables derived from the given tables by fixed rules, so that Spark and SQL see the same numbers."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomix.operators import bulk, model, signature, states
from cytomix.sources import tables


class Inputs:
    """Lazily built inputs of the named queries.

    Samples are nations. Cell types of the model are the ten vector labels, paired with market segments, numbered 0 to 4 by name, in two halves by the customers' keys.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cache
    def bulk(self) -> DataFrame:
        return tables.bulk_expression(self.spark, self.sf_dir)

    @cache
    def scaled(self) -> DataFrame:
        return bulk.cp10k(self.bulk())

    @cache
    def cells(self) -> DataFrame:
        return tables.cell_expression(self.spark, self.sf_dir)

    @cache
    def sig(self) -> DataFrame:
        return signature.moments(self.cells())

    def markers(self) -> DataFrame:
        return self.sig().select("gene").distinct().where("gene % 3 = 0")

    @cache
    def beta(self) -> DataFrame:
        """1 + customers of each nation in each half of a segment, on the whole grid."""
        segments = self.raw("customer").select("c_mktsegment").distinct().withColumn("segment", F.expr("row_number() over (order by c_mktsegment) - 1"))
        rows = self.raw("customer").join(segments, "c_mktsegment").groupBy(F.col("c_nationkey").alias("sample"), (2 * F.col("segment") + F.col("c_custkey") % 2).cast("int").alias("celltype")).agg(F.count("*").alias("n"))
        grid = self.raw("nation").select(F.col("n_nationkey").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("celltype"))
        return grid.join(rows, ["sample", "celltype"], "left").select("sample", "celltype", (1.0 + F.coalesce("n", F.lit(0))).alias("beta"))

    @cache
    def prior(self) -> DataFrame:
        """(gene, celltype, mu0, beta0, omega) of the genes that bulk and signature share."""
        both = self.sig().join(self.bulk().select("gene").distinct(), "gene", "left_semi")
        return both.select("gene", "celltype", F.col("mu").alias("mu0"), (1000 * F.col("std") * F.col("std")).alias("beta0"), F.col("std").alias("omega"))

    def omega(self) -> DataFrame:
        return self.prior().select("gene", "celltype", "omega")

    @cache
    def nu(self) -> DataFrame:
        """Signature means, shifted a little by sample."""
        return self.prior().join(self.beta().select("sample", "celltype"), "celltype").select("sample", "gene", "celltype", (F.col("mu0") + 0.01 * ((F.col("sample") + F.col("gene")) % 7)).alias("nu"))

    @cache
    def y(self) -> DataFrame:
        return self.scaled().join(self.prior().select("gene").distinct(), "gene", "left_semi").select("gene", "sample", F.log1p("expr").alias("y"))

    @cache
    def moments(self) -> DataFrame:
        return model.bulk_moments(self.nu(), self.omega(), self.beta())

    @cache
    def terms(self) -> DataFrame:
        return model.residual_terms(self.y(), self.moments())

    def gex(self) -> DataFrame:
        return self.nu().select("celltype", "sample", "gene", "nu")

    def matrix(self, weighing: str = "Omega") -> DataFrame:
        return states.cluster_matrix(self.gex(), self.omega(), model.fractions(self.beta()).select("sample", "celltype", "fraction"), weighing)

    @cache
    def scores(self) -> DataFrame:
        """Customers' mean balance magnitude by nation, segment and key modulo 3, standing for state scores."""
        segments = self.raw("customer").select("c_mktsegment").distinct().withColumn("celltype", F.expr("row_number() over (order by c_mktsegment) - 1"))
        rows = self.raw("customer").join(F.broadcast(segments), "c_mktsegment")
        return rows.groupBy("celltype", F.col("c_nationkey").alias("sample"), (F.col("c_custkey") % 3).alias("state")).agg(F.avg(F.abs("c_acctbal")).alias("score"))

    @cache
    def loadings(self) -> DataFrame:
        """Signature means by label and gene, state being the label's remainder by 3."""
        return self.sig().groupBy(F.expr("celltype % 2").alias("celltype"), F.expr("celltype % 3").alias("state"), "gene").agg((F.avg("mu") - 0.5).alias("loading"))

    @cache
    def assigned(self) -> DataFrame:
        """Clusters of nations: how many orders their customers placed in a year, modulo 3; a run is a year."""
        rows = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return rows.groupBy(F.year("o_orderdate").alias("run"), F.col("c_nationkey").alias("sample")).agg((F.count("*") % 3).alias("cluster"))

    @cache
    def curve(self) -> DataFrame:
        """A falling curve for each region: the share of customers with a balance over k * 900."""
        rows = self.raw("customer").join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(9))))
        return rows.groupBy(F.col("n_regionkey").alias("celltype"), "k").agg(F.avg((F.col("c_acctbal") > (F.col("k") - 3) * 900 - 900).cast("double")).alias("c"))
