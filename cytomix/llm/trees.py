"""Gradient-boosted trees: fitted by Spark on a feature table, applied inside tasks as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Trees:
    """Nodes of all trees in one set of arrays; a leaf has feature -1. bias alone stands for an empty model."""

    roots: list[int]
    weights: list[float]
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float = 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of x."""
        margin = np.full(len(x), self.bias)
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                go = x[inner, f[inner]] <= self.threshold[at[inner]]
                at[inner] = np.where(go, self.left[at[inner]], self.right[at[inner]])
            margin += weight * self.value[at]
        return 1.0 / (1.0 + np.exp(-2.0 * margin))


def fit(rows: DataFrame, rounds: int = 20, depth: int = 3, step: float = 0.3, seed: int = 7) -> Trees:
    """Fit on columns features (array<double>) and label (0 or 1). With one label only, or no rows, the model is a constant."""
    table = rows.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    seen = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    none = np.empty(0, np.int64)
    if len(seen) < 2:
        chance = 0.01 if not seen.get(1.0) else 0.99
        return Trees([], [], none, none, none, none, none, 0.5 * np.log(chance / (1 - chance)))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, maxBins=64, seed=seed, cacheNodeIds=False, checkpointInterval=-1, minInstancesPerNode=3).fit(table)
    nodes: list[list] = []

    def add(node) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            nodes[at][:2] = split.featureIndex(), split.threshold()
            nodes[at][2:4] = add(node.leftChild()), add(node.rightChild())
        return at

    roots = [add(t._call_java("rootNode")) for t in model.trees]
    columns = list(zip(*nodes, strict=True))
    return Trees(roots, list(model.treeWeights), np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[3]), np.array(columns[4]))
