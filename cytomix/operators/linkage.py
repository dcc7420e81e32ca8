"""Average linkage of points by rounds of reciprocal nearest neighbours.

Average linkage never brings a merged cluster nearer to others than its parts were, so all pairs that are each other's nearest cluster can be merged at once, and a round takes one pass. Groups of few points are
linked inside a task. Of larger ones the sums of distances between clusters are kept as blocks of rows: a round reads them twice, for the nearest cluster of each row and to add up
what was merged, and no task or driver holds more than a block of rows and some numbers for each point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytomix.sources.stored import stored

#: Points whose distances one task holds; distances in a block of rows.
POINTS, CELLS = 1024, 2_000_000
#: Decimals to which distances are compared, so that rounding decides no tie; the lower index wins.
DECIMALS = 9


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x and y."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def _nearest(sums: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest other cluster of each row of sums, and its average distance. own: the rows' clusters among all."""
    mean = sums / (sizes[own][:, None] * sizes)
    told = np.round(mean, DECIMALS)
    told[np.arange(len(own)), own] = np.inf
    near = told.argmin(1)
    return near, mean[np.arange(len(own)), near]


def _pairs(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero((near[near] == np.arange(len(near))) & (np.arange(len(near)) < near))
    return first, near[first]


def linked(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Merges of points x (rows) that stand for sizes points each: rows (a, b, height, size, pairs), a and b being the least places of the two clusters, by rounds; pairs is how many pairs of points a merge brings together."""
    sizes, alive, out = sizes.astype(float), np.arange(len(x)), []
    sums = distances(x, x) * np.outer(sizes, sizes)
    while len(alive) > 1:
        near, height = _nearest(sums, np.arange(len(alive)), sizes)
        a, b = _pairs(near)
        out.append(np.column_stack((alive[a], alive[b], height[a], sizes[a] + sizes[b], sizes[a] * sizes[b])))
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        sizes[a] += sizes[b]
        keep = np.delete(np.arange(len(alive)), b)
        sums, sizes, alive = sums[np.ix_(keep, keep)], sizes[keep], alive[keep]
    return np.concatenate(out) if out else np.zeros((0, 5))


def _placed(points: DataFrame, group: str) -> DataFrame:
    """points with at, the place of their id within the group; a row has one number for each point of the group at most."""
    return points.withColumn("at", F.row_number().over(Window.partitionBy(group).orderBy("id")) - 1)


def linkage(points: DataFrame, group: str = "celltype", most: int = POINTS, cells: int = CELLS) -> DataFrame:
    """(group, step, a, b, height, size, pairs): the merges of each group's points (group, id, n, point), n being how many points a row stands for, and a and b places in the order of ids. No merge has a lower step than those of its parts.

    Groups of up to most rows are linked in one task each; larger ones one after the other, by blocks of cells distances. Both ways give the same merges.
    """
    kind = points.schema[group].dataType.simpleString()
    names = ["a", "b", "height", "size", "pairs"]
    shape = f"{group} {kind}, step int, a long, b long, height double, size double, pairs double"

    def framed(key, merges: np.ndarray) -> pd.DataFrame:
        frame = pd.DataFrame(merges, columns=names).astype({"a": int, "b": int})
        frame.insert(0, "step", np.arange(len(frame)))
        frame.insert(0, group, key)
        return frame

    placed = stored(_placed(points, group), "linkage-points")
    sizes = stored(placed.groupBy(group).agg(F.count(F.lit(1)).alias("rows")), "linkage-groups")

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        return framed(rows[group].iloc[0], linked(np.stack(rows["point"].to_list()), rows["n"].to_numpy()))

    few = placed.join(sizes.where(F.col("rows") <= most).select(group), group, "left_semi").groupBy(group).applyInPandas(whole, shape)
    spark, found = points.sparkSession, [few]
    for r in sizes.where(F.col("rows") > most).toLocalIterator():
        merges = _by_blocks(placed.where(F.col(group) == F.lit(r[group])), int(r["rows"]), most, cells)
        found.append(stored(spark.createDataFrame(framed(r[group], merges), shape), "linkage-merges"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _by_blocks(placed: DataFrame, n: int, most: int, cells: int) -> np.ndarray:
    """The merges of one large group. The driver has some numbers for each point: sizes, nearest clusters, merges, and the points themselves (narrow rows), which it sends to the tasks."""
    spark = placed.sparkSession
    rows = placed.select("at", F.col("n").cast("double").alias("n"), "point").toPandas().sort_values("at", ignore_index=True)
    sizes, alive, out = rows["n"].to_numpy(), np.arange(n), []
    x = spark.sparkContext.broadcast(np.stack(rows["point"].to_list()))
    weight = spark.sparkContext.broadcast(sizes)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["id"]:
                own = slice(at * high, min((at + 1) * high, n))
                sums = distances(x.value[own], x.value) * weight.value[own, None] * weight.value
                yield pd.DataFrame({"first": [own.start], "data": [sums.tobytes()]})

    high = max(1, cells // n)
    blocks = spark.range(0, -(-n // high), 1, -(-n // high)).mapInPandas(begin, "first long, data binary")
    blocks = stored(blocks, "linkage-blocks")
    while True:
        count = len(alive)
        shared = spark.sparkContext.broadcast(sizes)

        def nearest(batches: Iterator[pd.DataFrame], count: int = count, shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for first, data in zip(batch["first"], batch["data"], strict=True):
                    sums = np.frombuffer(data).reshape(-1, count)
                    own = np.arange(first, first + len(sums))
                    near, height = _nearest(sums, own, shared.value)
                    yield pd.DataFrame({"row": own, "near": near, "height": height})

        found = blocks.mapInPandas(nearest, "row long, near long, height double").toPandas().sort_values("row")
        near, height = found["near"].to_numpy(), found["height"].to_numpy()
        a, b = _pairs(near)
        out.append(np.column_stack((alive[a], alive[b], height[a], sizes[a] + sizes[b], sizes[a] * sizes[b])))
        keep = np.delete(np.arange(count), b)
        sizes = sizes.copy()
        sizes[a] += sizes[b]
        to = np.zeros(count, int)
        to[keep] = np.arange(len(keep))
        to[b] = to[a]
        alive, sizes = alive[keep], sizes[keep]
        if len(alive) == 1:
            return np.concatenate(out)
        moves = spark.sparkContext.broadcast((keep, a, b, to))
        high = max(1, cells // len(alive))

        def contract(batches: Iterator[pd.DataFrame], count: int = count, moves=moves, high: int = high) -> Iterator[pd.DataFrame]:
            keep, a, b, to = moves.value
            for batch in batches:
                for first, data in zip(batch["first"], batch["data"], strict=True):
                    sums = np.frombuffer(data).reshape(-1, count).copy()
                    sums[:, a] += sums[:, b]
                    sums, row = sums[:, keep], to[first : first + len(sums)]
                    for block in np.unique(row // high):
                        own = row // high == block
                        yield pd.DataFrame({"block": [block], "rows": [row[own]], "data": [sums[own].tobytes()]})

        def gather(batches: Iterator[pd.DataFrame], left: int = len(alive), high: int = high) -> Iterator[pd.DataFrame]:
            held, sums = None, None
            for batch in batches:
                for block, rows, data in zip(batch["block"], batch["rows"], batch["data"], strict=True):
                    if block != held:
                        if held is not None:
                            yield pd.DataFrame({"first": [held * high], "data": [sums.tobytes()]})
                        held, sums = block, np.zeros((min(high, left - block * high), left))
                    np.add.at(sums, np.asarray(rows) - block * high, np.frombuffer(data).reshape(-1, left))
            if held is not None:
                yield pd.DataFrame({"first": [held * high], "data": [sums.tobytes()]})

        parts = blocks.mapInPandas(contract, "block long, rows array<long>, data binary")
        blocks = stored(parts.repartition(-(-len(alive) // high), "block").sortWithinPartitions("block").mapInPandas(gather, "first long, data binary"), "linkage-blocks")


def dendrogram(merges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(tree, leaves) of the merges (a, b, height) of n points, in the order of their steps: rows (left, right, height, size) by rising height, in which points are 0 to n - 1 and the cluster of row i is
    n + i, the lower number to the left; and the points in the order in which the tree shows them."""
    top, height = np.zeros(n), np.zeros(len(merges))
    for k, (a, b, h, *_) in enumerate(merges):  # no cluster below its parts, not even by rounding
        top[int(a)] = height[k] = max(round(h, DECIMALS), top[int(a)], top[int(b)])
    name, size, tree = list(range(n)), np.ones(n), np.zeros((max(n - 1, 0), 4))
    for i, k in enumerate(np.argsort(height, kind="stable")):
        a, b = int(merges[k, 0]), int(merges[k, 1])
        size[a] += size[b]
        tree[i] = (min(name[a], name[b]), max(name[a], name[b]), merges[k, 2], size[a])
        name[a] = n + i
    leaves, waiting = [], [2 * n - 2]
    while waiting:
        at = waiting.pop()
        if at < n:
            leaves.append(at)
        else:
            waiting += [int(tree[at - n, 1]), int(tree[at - n, 0])]
    return tree, np.array(leaves)


def leaf_order(points: DataFrame, group: str = "celltype", **args) -> DataFrame:
    """(group, id, place): the points (group, id, point) of each group in the order of their tree's leaves, from 0. What a task holds of a group is its merges, a narrow row for each point."""
    points = points.withColumn("n", F.lit(1.0))
    kind = points.schema[group].dataType.simpleString()
    merges = linkage(points, group, **args)

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("step")
        _, leaves = dendrogram(rows[["a", "b", "height"]].to_numpy(float), len(rows) + 1)
        return pd.DataFrame({group: rows[group].iloc[0], "at": leaves, "place": np.arange(len(leaves))})

    places = merges.groupBy(group).applyInPandas(order, f"{group} {kind}, at int, place int")
    return _placed(points, group).select(group, "id", "at").join(places, [group, "at"], "left").select(group, "id", F.coalesce("place", F.lit(0)).alias("place"))


def cophenetic_correlation(points: DataFrame, merges: DataFrame, group: str = "celltype") -> DataFrame:
    """(group, c): the correlation over all pairs of points of their distance and the height at which linkage() joins them; 1 where either does not vary.

    A merge at height t joins pairs whose mean distance is t. So distances and heights have one mean, the sum of their products is that of the squared heights, and the correlation is the root of
    the ratio of the variances: sums over merges, and over coordinates for the squared distances. No pair is formed.
    """
    sums = points.select(group, "n", F.posexplode("point").alias("i", "v")).groupBy(group, "i").agg(F.sum(F.col("n") * F.col("v") * F.col("v")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("s"))
    squares = sums.groupBy(group).agg(F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s")).alias("s2"))
    total = points.groupBy(group).agg(F.sum("n").alias("size"))
    heights = merges.groupBy(group).agg(F.sum(F.col("pairs") * F.col("height")).alias("y"), F.sum(F.col("pairs") * F.col("height") * F.col("height")).alias("y2"))
    rows = total.join(squares, group).join(heights, group, "left").fillna(0.0, ["y", "y2"])
    count = F.col("size") * (F.col("size") - 1) / 2
    mean = F.try_divide("y", count)
    var_x, var_y = F.try_divide(F.col("size") * F.col("q") - F.col("s2"), count) - mean * mean, F.try_divide("y2", count) - mean * mean
    return rows.select(group, F.when((var_x > 1e-12) & (var_y > 1e-12), F.sqrt(var_y / var_x)).otherwise(1.0).alias("c"))
