"""Connected components by parallel union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomix.llm.common import materialize


def _jump(forest: DataFrame, roots: DataFrame) -> DataFrame:
    """forest (node, parent) with each parent replaced by its own parent in roots."""
    up = roots.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    return forest.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))


def _compressed(forest: DataFrame) -> DataFrame:
    """Path compression: pointers double until every parent is a root."""
    while not forest.join(forest.select(F.col("node").alias("parent")), "parent", "left_semi").isEmpty():
        forest = materialize(_jump(forest, forest), "uf-jump")
    return forest


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round hooks every node on its smallest smaller neighbour, compresses the paths,
    and relabels the edges by root; edges inside one tree vanish. Rows with a null or two equal
    ends are ignored. Every join is between two stored tables, so a hub's rows can be split.
    """
    node = edges.schema["a"].dataType
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "uf-edges")
    total = None
    while not edges.isEmpty():
        forest = _compressed(materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "uf-hook"))
        for end in ("a", "b"):
            up = forest.select(F.col("node").alias(end), F.col("parent").alias("root"))
            edges = edges.join(up, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "uf-edges")
        if total is None:
            total = forest
        elif not forest.isEmpty():
            moved = _jump(total, forest)
            fresh = forest.join(total, "node", "left_anti")
            total = materialize(moved.unionByName(fresh), "uf-total")
    if total is None:
        return edges.select(F.col("a").cast(node).alias("node"), F.col("b").cast(node).alias("component"))
    roots = total.select(F.col("parent").alias("node")).distinct()
    return total.unionByName(roots.select("node", F.col("node").alias("parent"))).select("node", F.col("parent").alias("component"))
