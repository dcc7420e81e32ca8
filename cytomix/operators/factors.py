"""Convex factorisation of one large cell type in blocks of its Gram matrix.

The matrix stays in tasks, as dense blocks of BLOCK by BLOCK samples. What an iteration needs of it are products of its positive and negative parts with the factors, which are thin: a row for each sample and a
column for each state of each restart. They are broadcast, the products of a row of blocks are summed where the row is, and all the rest are sums of states by states.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytomix.sources.stored import stored

#: Samples along a block, and cells (samples by states of restarts) of the factors that are worked on at once.
BLOCK, CELLS = 512, 2_000_000


class Products:
    """Blocks of one cell type's Gram rows (s1, s2, k), s1 <= s2, and products with them."""

    def __init__(self, gram_rows: DataFrame, block: int = BLOCK):
        self.spark, self.block = gram_rows.sparkSession, block
        diagonal = gram_rows.where("s1 = s2").select(F.col("s1").alias("sample"), "k")
        placed = stored(diagonal.withColumn("at", F.row_number().over(Window.orderBy("sample")) - 1), "factors-samples")  # two numbers for each sample
        known = placed.toPandas().sort_values("at")
        self.samples, self.diagonal = known["sample"].to_numpy(), known["k"].to_numpy()
        at = placed.select("sample", "at")
        rows = gram_rows.join(at.withColumnsRenamed({"sample": "s1", "at": "a"}), "s1").join(at.withColumnsRenamed({"sample": "s2", "at": "b"}), "s2")
        both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        rows = rows.select("k", F.explode(both).alias("t")).select((F.col("t.a") / block).cast("int").alias("i"), (F.col("t.b") / block).cast("int").alias("j"), (F.col("t.a") % block).alias("r"), (F.col("t.b") % block).alias("c"), "k")
        packed = rows.groupBy("i", "j").agg(F.collect_list(F.struct("r", "c", "k")).alias("v")).select("i", "j", F.col("v.r").alias("r"), F.col("v.c").alias("c"), F.col("v.k").alias("k"))
        n = len(self.samples)

        def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    data = np.zeros((min(block, n - row.i * block), min(block, n - row.j * block)))
                    data[row.r, row.c] = row.k
                    yield pd.DataFrame({"i": [row.i], "j": [row.j], "data": [data.tobytes()]})

        blocks = packed.mapInPandas(dense, "i int, j int, data binary")
        self.blocks = stored(blocks.repartition("i").sortWithinPartitions("i", "j"), "factors-blocks")

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positive part of the matrix times x, and the negative part times x."""
        shared, n, block, width = self.spark.sparkContext.broadcast(x), len(self.samples), self.block, x.shape[1]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, sums = None, None
            for batch in batches:
                for i, j, data in zip(batch["i"], batch["j"], batch["data"], strict=True):
                    if i != held:
                        if held is not None:
                            yield pd.DataFrame({"i": [held], "sums": [sums.tobytes()]})
                        held, sums = i, np.zeros((2, min(block, n - i * block), width))
                    own = shared.value[j * block : (j + 1) * block]
                    k = np.frombuffer(data).reshape(-1, len(own))
                    up = np.maximum(k, 0) @ own
                    sums[0] += up
                    sums[1] += up - k @ own
            if held is not None:
                yield pd.DataFrame({"i": [held], "sums": [sums.tobytes()]})

        up, down = np.zeros(x.shape), np.zeros(x.shape)
        for row in self.blocks.mapInPandas(run, "i int, sums binary").toLocalIterator(prefetchPartitions=True):
            sums, own = np.frombuffer(row["sums"]).reshape(2, -1, width), slice(row["i"] * block, (row["i"] + 1) * block)
            up[own] += sums[0]
            down[own] += sums[1]
        shared.destroy()
        return up, down


def start(products: Callable, diagonal: np.ndarray, plan: list[tuple[int, int]], rounds: int = 10) -> list[np.ndarray]:
    """Clusters of samples by k-means for each (states, seed) of plan, by distances to means: diagonal - 2 K m + m' K m."""
    n = len(diagonal)
    means = []
    for states, seed in plan:
        m = np.zeros((states, n))
        m[np.arange(states), np.sort(np.random.default_rng(seed).choice(n, states, replace=False))] = 1.0
        means.append(m)
    near = []
    for _ in range(rounds):
        up, down = products(np.concatenate(means).T)
        mk, at, near = (up - down).T, 0, []
        for m in means:
            own = mk[at : at + len(m)]
            at += len(m)
            near.append((diagonal[None] - 2 * own + (own * m).sum(1)[:, None]).argmin(0))
            for s in range(len(m)):
                if (near[-1] == s).any():
                    m[s] = (near[-1] == s) / (near[-1] == s).sum()
    return near


def factorised(products: Callable, diagonal: np.ndarray, plan: list[tuple[int, int]], rounds: int = 1000) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(h, g, error) for each (states, seed) of plan: multiplicative updates of all restarts together, two products an iteration; a restart that stands still leaves the products."""
    n, whole = len(diagonal), diagonal.sum()
    h, g = [], []
    for (states, _), near in zip(plan, start(products, diagonal, plan), strict=True):
        one = (near == np.arange(states)[:, None]).astype(float)
        h.append(one + 0.2)
        g.append(((one + 0.01) / np.maximum(one.sum(1, keepdims=True), 1)).T)
    err, live = [np.inf] * len(plan), list(range(len(plan)))

    def parts(columns: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        up, down = products(np.concatenate(columns, axis=1))
        cuts = np.cumsum([c.shape[1] for c in columns])[:-1]
        return list(zip(np.split(up, cuts, axis=1), np.split(down, cuts, axis=1), strict=True))

    of_g = dict(zip(live, parts(g), strict=True))
    for _ in range(rounds):
        for r in live:
            ub, db = of_g[r]
            h[r] = h[r] * np.sqrt((ub.T + g[r].T @ db @ h[r]) / (db.T + g[r].T @ ub @ h[r] + 1e-9))
        for r, (ua, da) in zip(live, parts([h[r].T for r in live]), strict=True):
            hh, (ub, db) = h[r] @ h[r].T, of_g[r]
            g[r] = g[r] * np.sqrt((ua + db @ hh) / (da + ub @ hh + 1e-9))
        of_g, left = dict(zip(live, parts([g[r] for r in live]), strict=True)), []
        for r in live:
            kb = of_g[r][0] - of_g[r][1]
            square = whole - 2 * np.einsum("ij,ji->", kb, h[r]) + np.einsum("ij,ji->", h[r] @ h[r].T, g[r].T @ kb)
            now = float(np.sqrt(max(square, 0)))
            if abs(err[r] - now) / n >= 1e-12:
                left.append(r)
            err[r] = now
        live = left
        if not live:
            break
    return list(zip(h, g, err, strict=True))


def factorise(gram_rows: DataFrame, runs: list[tuple[int, int]], *, rounds: int = 1000, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """(states, run, sample, state, h, g, err) for runs (states, run) of one cell type's Gram rows (s1, s2, k). Restarts are worked on as many at a time as have cells cells together, and stored."""
    spark, kind = gram_rows.sparkSession, gram_rows.schema["s1"].dataType.simpleString()
    products = Products(gram_rows, block)
    n, found, at = len(products.samples), None, 0
    runs = [(min(states, n), states, run) for states, run in sorted(runs)]
    while at < len(runs):
        to = at + 1
        while to < len(runs) and n * sum(r[0] for r in runs[at : to + 1]) <= cells:
            to += 1
        frames = []
        for (states, named, run), (h, g, err) in zip(runs[at:to], factorised(products, products.diagonal, [(s, run) for s, _, run in runs[at:to]], rounds), strict=True):
            frames.append(pd.DataFrame({"states": named, "run": run, "sample": np.repeat(products.samples, states), "state": np.tile(np.arange(states), n), "h": h.T.ravel(), "g": g.ravel(), "err": err}))
        part = stored(spark.createDataFrame(pd.concat(frames), f"states int, run int, sample {kind}, state int, h double, g double, err double"), "factors-part")
        found = part if found is None else found.unionByName(part)
        at = to
    return found


def eigenpairs(gram_rows: DataFrame, count: int, *, least: float = 1e-8, rounds: int = 200, extra: int = 8, seed: int = 0, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples, values, vectors): the count largest eigenvalues of one cell type's Gram rows (s1, s2, k), falling, and their vectors as columns; those under least times the largest are dropped.

    Subspace iteration: products of the blocks with a thin matrix, made orthogonal each time, until the values stand still. The sign of a vector makes its largest entry positive.
    """
    products = Products(gram_rows, block)
    n = len(products.samples)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(n, count + extra))))[0]
    last = np.zeros(x.shape[1])
    for _ in range(rounds):
        up, down = products(x)
        y = up - down
        values, turn = np.linalg.eigh(x.T @ y)
        values, x = values[::-1], np.linalg.qr(y @ turn[:, ::-1])[0]
        if np.abs(values - last)[: min(count, n)].max(initial=0.0) <= 1e-14 * max(abs(values[0]), 1e-300):
            break
        last = values
    up, down = products(x)
    values, turn = np.linalg.eigh(x.T @ (up - down))
    values, vectors = values[::-1][:count], (x @ turn[:, ::-1])[:, :count]
    kept = values > max(least * max(values.max(initial=0.0), 0.0), 1e-300)
    values, vectors = values[kept], vectors[:, kept]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))]) if len(values) else 1.0
    return products.samples, values, vectors * sign
