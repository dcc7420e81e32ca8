"""A two-dimensional layout in which near neighbours stay near: affinities of each point to its nearest others, and forces between points, row by row.

Points stay in Spark. Their neighbours are found by comparing all of them with one block after another, which is broadcast; the affinities are rows; and only places in the layout, two numbers for each
point, go to every task. Repulsion comes from points drawn by hash, so that a row's move depends on its number, the round and the seed, not on the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytomix.sources.stored import stored

#: Numbers of the points that are broadcast at once, and points that repel another in a step.
NUMBERS, DRAWN = 4_000_000, 64


def neighbours(points: DataFrame, count: int, numbers: int = NUMBERS) -> DataFrame:
    """(at, near, dist): for points (at, point), at from 0 without gaps, the count nearest others by Euclidean distance, nearest first, ties by number."""
    spark, n = points.sparkSession, points.count()
    width = len(points.head()["point"]) if n else 0
    block = max(1, numbers // max(1, width))
    found = None
    for begin in range(0, n, block):
        part = points.where((F.col("at") >= begin) & (F.col("at") < begin + block)).toPandas().sort_values("at")
        shared = spark.sparkContext.broadcast((part["at"].to_numpy(), np.array(part["point"].to_list(), float).reshape(len(part), -1)))

        def near(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, y = shared.value
            for batch in batches:
                for cut in range(0, len(batch), 512):
                    rows = batch.iloc[cut : cut + 512]
                    x = np.array(rows["point"].to_list(), float).reshape(len(rows), -1)
                    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))
                    d[rows["at"].to_numpy()[:, None] == ids] = np.inf
                    order = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :count]
                    ok = np.isfinite(np.take_along_axis(d, order, 1))
                    yield pd.DataFrame({"at": rows["at"], "near": [ids[o[k]] for o, k in zip(order, ok, strict=True)], "dist": [v[o[k]] for v, o, k in zip(d, order, ok, strict=True)]})

        part = points.mapInPandas(near, "at long, near array<long>, dist array<double>")
        if found is None:
            found = stored(part, "layout-near")
            continue
        both = found.join(part.withColumnsRenamed({"near": "near2", "dist": "dist2"}), "at").select("at", F.slice(F.array_sort(F.concat(F.arrays_zip(F.col("dist").alias("d"), F.col("near").alias("i")), F.arrays_zip(F.col("dist2").alias("d"), F.col("near2").alias("i")))), 1, count).alias("t"))
        found = stored(both.select("at", F.col("t.i").alias("near"), F.col("t.d").alias("dist")), "layout-near")
    return found if found is not None else spark.createDataFrame([], "at long, near array<long>, dist array<double>")


def bandwidth(squares: np.ndarray, perplexity: float, rounds: int = 60) -> np.ndarray:
    """Weights of neighbours at the given squared distances, exp(-b d) over their sum, with the b for which the weights' entropy is the logarithm of perplexity (or of their number, if less), by bisection."""
    if not len(squares):
        return squares
    gap, want = squares - squares.min(), np.log(min(perplexity, len(squares)))
    if not gap.any():
        return np.full(len(gap), 1 / len(gap))
    low, high = 0.0, np.inf
    b = 1.0 / max(gap.mean(), 1e-300)
    for _ in range(rounds):
        w = np.exp(-b * gap)
        p = w / w.sum()
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum()
        low, high = (b, high) if entropy > want else (low, b)
        b = b * 2 if np.isinf(high) else (low + high) / 2
    return p


def affinities(near: DataFrame, perplexity: float) -> DataFrame:
    """(at, to, p): weights of neighbours both ways; a pair's is the mean of the two, and all sum to the number of points."""

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"at": batch["at"], "to": batch["near"], "p": [bandwidth(np.asarray(d) ** 2, perplexity) for d in batch["dist"]]})

    rows = near.mapInPandas(weigh, "at long, to array<long>, p array<double>").select("at", F.explode(F.arrays_zip("to", "p")).alias("t")).select("at", "t.to", (F.col("t.p") / 2).alias("p"))
    return rows.unionByName(rows.select(F.col("to").alias("at"), F.col("at").alias("to"), "p")).groupBy("at", "to").agg(F.sum("p").alias("p"))


def _drawn(rows: np.ndarray, step: int, seed: int, n: int) -> np.ndarray:
    """DRAWN points for each row, by a hash of its number, the step and the seed."""
    mask = np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (rows.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step * 1_000_003 + seed) * np.uint64(0xD1B54A32D192ED03) + np.arange(DRAWN, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)) & mask
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def embed(weights: DataFrame, begin: np.ndarray, rounds: int = 40, inner: int = 10, seed: int = 42) -> np.ndarray:
    """Places (points by 2) after rounds passes of inner steps each, from the places begin: rows attract by their weights (at, to, p) and repel as inverse squares of distances do.

    In a pass each row moves by itself, against the places that all others had at its beginning. The first quarter of the passes attracts more, so that clusters gather first.
    """
    spark, n = weights.sparkSession, len(begin)
    packed = weights.groupBy("at").agg(F.collect_list(F.struct("to", "p")).alias("v")).select("at", F.col("v.to").alias("to"), F.col("v.p").alias("p"))
    packed = stored(packed.repartition(max(1, min(spark.sparkContext.defaultParallelism, n // 64)), "at"), "layout-weights")
    places = begin / max(begin.std(), 1e-300) * 1e-1
    for turn in range(rounds):
        shared, pull = spark.sparkContext.broadcast(places), 4.0 if turn < rounds // 4 else 1.0

        def move(batches: Iterator[pd.DataFrame], shared=shared, pull=pull, turn=turn) -> Iterator[pd.DataFrame]:
            y = shared.value
            for batch in batches:
                own = batch["at"].to_numpy()
                at = y[own].copy()
                row, to, p = np.repeat(np.arange(len(own)), batch["to"].map(len)), np.concatenate(batch["to"].to_list()), np.concatenate(batch["p"].to_list())
                for step in range(inner):
                    gap = at[row] - y[to]
                    force = (p / (1 + (gap * gap).sum(1)))[:, None] * gap
                    attract = np.stack([np.bincount(row, weights=force[:, k], minlength=len(own)) for k in range(2)], axis=1)
                    other = _drawn(own, turn * inner + step, seed, n)
                    away = at[:, None] - y[other]
                    w = np.where(other == own[:, None], 0.0, 1 / (1 + (away * away).sum(2)))
                    repel = (w * w)[:, :, None] * away
                    shift = -pull * attract + repel.sum(1) / np.maximum(w.sum(1), 1e-12)[:, None]
                    size = np.linalg.norm(shift, axis=1, keepdims=True)
                    at = at + shift * np.minimum(1.0, 2.0 / np.maximum(size, 1e-12)) * 0.5 * (1 - 0.9 * turn / rounds)
                yield pd.DataFrame({"at": own, "x": at[:, 0], "y": at[:, 1]})

        moved = packed.mapInPandas(move, "at long, x double, y double").toPandas()  # two numbers for each point
        places = places.copy()
        places[moved["at"].to_numpy()] = moved[["x", "y"]].to_numpy()
        shared.destroy()
    return places


def neighbour_layout(points: DataFrame, perplexity: float = 30.0, rounds: int = 40, seed: int = 42, numbers: int = NUMBERS) -> DataFrame:
    """points (celltype, sample, points) with x and y: a layout of all samples by their neighbours. perplexity, how many neighbours count, is at most the number of points less one over three.

    It begins at the first principal axes. Fewer than four points stay there. Order of rows and partitions change nothing but rounding.
    """
    from cytomix.operators.states import layout as principal

    spark, axes = points.sparkSession, 2
    ordered = points.select(F.struct("celltype", "sample").alias("key"), F.col("points").alias("point"))
    parts = stored(ordered.repartitionByRange(F.col("key")).sortWithinPartitions("key").select("key", "point", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "layout-ordered")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    placed = stored(parts.join(F.broadcast(before), "part").select("key", "point", (F.col("row") - F.col("first") + F.col("before")).alias("at")), "layout-points")
    n, start = placed.count(), np.zeros((0, axes))
    if n:
        width = len(placed.head()["point"])
        start = np.zeros((n, axes))
        if width:
            found = principal(placed.select(F.col("at").alias("number"), F.col("point").alias("points")), min(axes, width)).select("number", "at").toPandas().sort_values("number")
            start[:, : min(axes, width)] = np.array(found["at"].to_list())
    if n > 3:
        most = min(perplexity, (n - 1) / 3)
        weights = affinities(neighbours(placed.select("at", "point"), min(n - 1, int(3 * most) + 1), numbers), most)
        start = embed(weights, start, rounds, seed=seed)
    out = spark.createDataFrame(pd.DataFrame({"at": np.arange(n), "x": start[:, 0], "y": start[:, 1]}), "at long, x double, y double")
    return placed.join(out, "at").select("key.celltype", "key.sample", "x", "y")
