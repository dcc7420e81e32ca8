"""Near-duplicate embeddings: robust-pruned flat graphs on overlapping shards, joined, then searched from medoids; audited recall."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomix.llm.common import materialize
from cytomix.llm.components import components

#: Nodes a shard should hold before overlap, and from how many members on it is cut further.
SHARD, SHARD_MOST = 800, 2000
#: Vectors on which the first centres are fitted, the most centres of a level, and nodes of a crowded shard on which its own are fitted.
FIT_SAMPLE, CENTRES, CROWDED_SAMPLE = 16_000, 1024, 4000
#: Graph: candidates and chance members looked at for each node, its most neighbours, and the slack of the pruning rule.
CANDIDATES, CHANCE, DEGREE, ALPHA = 48, 24, 32, 1.2
BEAM = 48
#: Least vectors that a ball stands for.
BALL = 16
#: Vectors compared with all others at first to measure recall, those with a partner that the measure needs, and the recall wanted.
AUDIT, PARTNERED, RECALL = 200, 200, 0.99
#: Vectors compared with all others at most, before the draw turns to those that have a found partner.
AUDIT_MOST = 3200
#: Radians by which bounds on angles are widened, over rounding.
SLACK = 1e-6

_FOUND = "kind string, a long, b long"


def _unit(vectors: pd.Series | list) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)  # keeps the squares of very large or small components finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def pruned_graph(sims: np.ndarray, rnd: np.random.Generator) -> np.ndarray:
    """Out-neighbours of each node (rows padded by -1), for the cosines between all nodes of a shard.

    Candidates are a node's nearest and some chance members, for long edges. They are taken nearest first; each one taken rules out
    those that it is nearer to, by the factor ALPHA, than the node is. Edges are then made to go both ways, as far as 2 * DEGREE at a node.
    """
    n = len(sims)
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return np.full((n, 1), -1)
    near = np.empty((n, k), np.int64)
    for i in range(0, n, 256):  # blocks of rows, as copies of all would be large
        far = -sims[i : i + 256]
        far[np.arange(len(far)), np.arange(i, i + len(far))] = 8.0
        near[i : i + 256] = np.argpartition(far, k - 1, axis=1)[:, :k]
    pool = np.concatenate((near, rnd.integers(0, n, (n, CHANCE))), 1)
    rows = np.arange(n)[:, None]
    dist = 1.0 - sims[rows, pool]
    order = np.argsort(dist, 1, kind="stable")
    pool, dist = pool[rows, order], dist[rows, order]
    alive = (pool != rows) & np.concatenate((np.ones((n, 1), bool), pool[:, 1:] != pool[:, :-1]), 1)
    edges = []
    for _ in range(DEGREE):
        at = alive.argmax(1)
        some = np.flatnonzero(alive[np.arange(n), at])
        if not len(some):
            break
        taken = pool[some, at[some]]
        edges.append(np.column_stack((some, taken)))
        alive[some, at[some]] = False
        alive[some] &= ALPHA * (1.0 - sims[taken[:, None], pool[some]]) > dist[some]
    pairs = np.concatenate(edges)
    pairs = np.unique(np.concatenate((pairs, pairs[:, ::-1])), axis=0)
    pairs = pairs[np.lexsort((-sims[pairs[:, 0], pairs[:, 1]], pairs[:, 0]))]
    rank = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
    pairs, rank = pairs[rank < 2 * DEGREE], rank[rank < 2 * DEGREE]
    out = np.full((n, rank.max() + 1), -1)
    out[pairs[:, 0], rank] = pairs[:, 1]
    return out


def greedy_search(q: np.ndarray, x: np.ndarray, graph: np.ndarray, start: int) -> np.ndarray:
    """For each query the BEAM nearest nodes that a best-first walk from start finds, -1 where fewer. Only nodes met are compared."""
    n, width = len(x), min(BEAM, len(x))
    beam = np.full((len(q), width), -1)
    score = np.full((len(q), width), -np.inf)
    open_ = np.zeros((len(q), width), bool)
    beam[:, 0], score[:, 0], open_[:, 0] = start, q @ x[start], True
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, start] = seen[:, n] = True
    live = np.arange(len(q))
    while len(live):
        best = np.where(open_[live], score[live], -np.inf).argmax(1)
        open_[live, best] = False
        around = graph[beam[live, best]]
        line, slot = np.nonzero(~seen[live[:, None], around])
        met = around[line, slot]
        seen[live[:, None], around] = True
        value = np.full(around.shape, -np.inf)
        value[line, slot] = np.einsum("ij,ij->i", q[live[line]], x[met])
        nodes, scores = np.concatenate((beam[live], around), 1), np.concatenate((score[live], value), 1)
        opened = np.concatenate((open_[live], np.isfinite(value)), 1)
        keep = np.argpartition(-scores, width - 1, axis=1)[:, :width]
        line = np.arange(len(live))[:, None]
        beam[live], score[live], open_[live] = nodes[line, keep], scores[line, keep], opened[line, keep] & np.isfinite(scores[line, keep])
        live = live[open_[live].any(1)]
    return np.where(np.isfinite(score), beam, -1)


def range_search(q: np.ndarray, x: np.ndarray, graph: np.ndarray, start: int, own: np.ndarray, reach: np.ndarray, more: np.ndarray) -> list[np.ndarray]:
    """For each query, whose own node is own, the other nodes found within reach (of the node, in radians) plus more (of the query). What the walk ends on,
    and the own node, are expanded: neighbours of nodes in range are compared too, until no new ones are in range."""
    hits, n = [], len(x)
    least = np.cos(np.minimum(reach[None, :] + more[:, None], np.pi)) if more.any() else np.broadcast_to(np.cos(np.minimum(reach, np.pi)), (len(q), n))
    beams = greedy_search(q, x, graph, start)
    for i in range(len(q)):
        seen = np.zeros(n + 1, bool)
        seen[n] = seen[own[i]] = True
        front = beams[i][beams[i] >= 0]
        front = front[~seen[front]]
        seen[front] = True
        front, found = np.append(front[x[front] @ q[i] >= least[i, front]], own[i]), []
        while len(front):
            found.append(front)
            around = np.unique(graph[front])
            around = around[~seen[around]]
            seen[around] = True
            front = around[x[around] @ q[i] >= least[i, around]]
        found = np.concatenate(found)
        hits.append(found[found != own[i]])
    return hits


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (a, b) lead to."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _told(nodes: np.ndarray, size: np.ndarray, radius: np.ndarray, a: np.ndarray, b: np.ndarray, cosines: np.ndarray, least: float, counted: np.ndarray) -> pd.DataFrame:
    """Findings about pairs of places (a, b), a being the query: its count of vectors linked, edges of a spanning forest, and pairs of balls whose bounds leave
    open which of their vectors link. counted tells whether b's vectors count for a."""
    balls = (radius[a] > 0) | (radius[b] > 0)
    angle = _angle(cosines)
    sure = np.where(balls, angle + radius[a] + radius[b] <= np.arccos(least) - SLACK, cosines >= least)
    maybe = balls & ~sure & (angle <= np.arccos(least) + radius[a] + radius[b] + SLACK)
    links = np.bincount(a[sure & counted], size[b[sure & counted]], len(nodes)).astype(np.int64)
    root = _forest(a[sure], b[sure], len(nodes))
    some, joined, u, v = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(nodes))), nodes[a[maybe]], nodes[b[maybe]]
    return pd.concat([
        pd.DataFrame({"kind": "count", "a": nodes[some], "b": links[some]}), pd.DataFrame({"kind": "edge", "a": nodes[joined], "b": nodes[root[joined]]}),
        pd.DataFrame({"kind": "maybe", "a": np.minimum(u, v), "b": np.maximum(u, v)}).drop_duplicates(),
    ])


def _usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _centres(sample: np.ndarray, k: int) -> np.ndarray:
    rnd = np.random.default_rng(3)
    c = sample[rnd.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(6):
        near = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def _share(part: Column) -> Column:
    """Whether a node is in the sample that part, a share, asks for."""
    return F.pmod(F.xxhash64("node", F.lit(9)), F.lit(1_000_000)) < F.greatest(F.lit(1), F.ceil(part * 1_000_000))


def place(nodes: DataFrame, overlap: int) -> DataFrame:
    """nodes (node, vec, ...) with shards: those of the overlap nearest centres. Vectors of different lengths have no shard in common.

    Centres are fitted on a sample, some for each length. A shard with over SHARD_MOST members gets centres of its own, on a sample of it, and its members
    go to the nearest of those, so the number of shards grows with that of nodes.
    """
    n = max(1, nodes.count())
    known = nodes.where(_share(F.lit(min(1.0, FIT_SAMPLE / n)))).select("vec").collect()
    by: dict[int, list] = {}
    for r in known:
        by.setdefault(len(r["vec"]), []).append(r["vec"])
    fitted = {d: _centres(_unit(v), min(CENTRES, -(-n * len(v) // len(known) // SHARD))) for d, v in by.items()}
    shared = nodes.sparkSession.sparkContext.broadcast(fitted)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch["vec"].map(len)):
                c = shared.value.get(d)
                near = np.zeros((len(part), 1), int) if c is None else np.argsort(-(_unit(part["vec"]) @ c.T), 1, kind="stable")[:, :overlap]
                yield part.assign(shards=[[f"{d}/{i}" for i in row] for row in near])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    placed = materialize(nodes.mapInPandas(first, f"{kind}, shards array<string>"), "vectors-placed")
    sizes = placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SHARD_MOST)
    sizes = materialize(sizes, "vectors-crowded")
    if sizes.isEmpty():
        return placed

    crowded = placed.withColumn("shard", F.explode("shards")).join(sizes, "shard")
    sample = crowded.where(_share(F.least(F.lit(1.0), CROWDED_SAMPLE / F.col("c")))).select("shard", "c", "vec")
    own = sample.groupBy("shard").applyInPandas(lambda g: pd.DataFrame({"shard": [g["shard"].iloc[0]], "centres": [_centres(_unit(g["vec"]), min(CENTRES, -(-int(g["c"].iloc[0]) // SHARD))).tolist()]}), "shard string, centres array<array<double>>")
    salts = F.ceil(F.col("c") / (4 * SHARD_MOST)).cast("int")
    own = own.join(sizes, "shard").select("shard", "centres", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    crowded = crowded.select("shard", "node", "vec", F.pmod(F.xxhash64("node", F.lit(2)), salts).cast("int").alias("salt"))

    def second(group: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if group.empty or centres.empty:
            return pd.DataFrame([], columns=["node", "shard", "subs"])
        c = np.stack([np.asarray(v) for v in centres["centres"].iloc[0]])
        near = np.argsort(-(_unit(group["vec"]) @ c.T), 1, kind="stable")[:, :overlap]
        return pd.DataFrame({"node": group["node"], "shard": group["shard"], "subs": [[f"{s}/{i}" for i in row] for s, row in zip(group["shard"], near, strict=True)]})

    subs = crowded.groupBy("shard", "salt").cogroup(own.groupBy("shard", "salt")).applyInPandas(second, "node long, shard string, subs array<string>")
    subs = materialize(subs.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("shard", "subs"))).alias("subs")), "vectors-subs")
    out = placed.join(subs, "node", "left")
    lists = F.transform("shards", lambda s: F.coalesce(F.try_element_at("subs", s), F.array(s)))
    deeper = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(overlap - 1)), lambda i: F.transform(lists, lambda subs: F.get(subs, i))))
    deeper = F.slice(F.filter(deeper, lambda s: s.isNotNull()), 1, overlap + overlap // 2)  # each shard's nearest first
    return materialize(out.withColumn("shards", F.when(F.col("subs").isNull(), F.col("shards")).otherwise(deeper)).drop("subs"), "vectors-placed")


def balls(nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(items, members): BALL or more vectors that all link with each other, seen from a centre of theirs, become one item, and every other vector is its own.

    Items are (node, vec, radius, size); members (node, item). A vector is at most the radius from its item, which is at most half the
    angle of a link. Balls are formed in blocks of a shard, then balls of balls, as long as shards are crowded, so a group of any size is shared out among tasks and still ends as
    few items.
    """
    half = np.arccos(least) / 2 - SLACK

    def form(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        x, radius, held = _unit(group["vec"]), group["radius"].to_numpy(), group["held"].to_numpy()
        near = x @ x.T >= least
        free, item = np.ones(len(x), bool), group["node"].to_numpy().copy()
        vec, bound = list(group["vec"]), radius.copy()
        for v in np.argsort(-near.sum(1), kind="stable"):
            around = near[v] & free
            if free[v] and around.sum() >= 2 and held[around].sum() >= BALL:
                centre = x[around].mean(0)
                centre /= np.linalg.norm(centre)
                far = _angle(x @ centre) + radius
                inside = np.flatnonzero(free & (far <= half))
                if len(inside) >= 2 and held[inside].sum() >= BALL:
                    free[inside] = False
                    item[inside], bound[inside] = item[inside[0]], max(far[inside].max(), SLACK)
                    for i in inside:
                        vec[i] = centre
        return pd.DataFrame({"node": group["node"], "item": item, "vec": vec, "radius": bound, "size": group["size"], "held": held})

    items = nodes.withColumn("radius", F.lit(0.0)).withColumn("held", F.lit(1).cast("long"))
    members = None
    while True:
        placed = place(items, 1).withColumn("shard", F.get("shards", F.lit(0))).drop("shards")
        sizes = materialize(placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_MOST).cast("int").alias("blocks")), "vectors-sizes")
        before, crowded = placed.count(), not sizes.where("blocks > 1").isEmpty()
        blocked = placed.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        found = blocked.select("shard", "block", "node", "vec", "radius", "size", "held").groupBy("shard", "block").applyInPandas(form, "node long, item long, vec array<double>, radius double, size long, held long")
        found = materialize(found, "vectors-formed")
        step = found.select("node", "item")
        members = step if members is None else members.withColumnRenamed("item", "up").join(step.withColumnRenamed("node", "up"), "up").select("node", "item")
        members = materialize(members, "vectors-members")
        items = found.groupBy(F.col("item").alias("node")).agg(F.min_by("vec", "node").alias("vec"), F.max("radius").alias("radius"), F.sum("size").alias("size"), F.sum("held").alias("held"))
        items = materialize(items, "vectors-items")
        if not crowded or items.count() > 0.9 * before:
            return items.drop("held"), members


def _lists(members: DataFrame, least: float) -> DataFrame:
    """(node, around, near): the joined adjacency lists that the graphs of all shards give a node, and those of the list that one query can have in range together with the node."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        x, nodes, radius = _unit(group["vec"]), group["node"].to_numpy(), group["radius"].to_numpy()
        sims = np.clip(x @ x.T, -1.0, 1.0)
        graph = pruned_graph(sims, np.random.default_rng(17))
        around = [g[g >= 0] for g in graph]
        near = [g[_angle(sims[i, g]) <= 2 * np.arccos(least) + radius[i] + radius[g]] for i, g in enumerate(around)]
        return pd.DataFrame({"node": nodes, "around": [nodes[g] for g in around], "near": [nodes[g] for g in near]})

    built = members.groupBy("shard", "block").applyInPandas(build, "node long, around array<long>, near array<long>")
    return materialize(built.groupBy("node").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("around", "near")]), "vectors-lists")


def search(items: DataFrame, least: float, overlap: int) -> DataFrame:
    """Findings (kind, a, b), as _told gives them, about items (node, vec, radius, size).

    Every item joins the shards of its overlap nearest centres. Each shard, or block of one that stays crowded, makes a robust-pruned graph; the lists of a node from all its shards are joined. An item
    is a query in its nearest shard, over the shard's members and the nodes near to them that their joined lists lead to.
    """
    placed = place(items, overlap)
    of = placed.select("node", "vec", "radius", "size", F.posexplode("shards").alias("nth", "shard"))
    sizes = materialize(of.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_MOST).cast("int").alias("blocks")), "vectors-sizes")
    of = of.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    of = materialize(of, "vectors-shards")
    lists = _lists(of, least)

    # A region is what one task searches: a block of a shard's queries with a block of its nodes, and the nodes that these lead to.
    cells = F.filter(F.sequence(F.lit(0), F.col("blocks") * F.col("blocks") - 1), lambda c: (F.floor(c / F.col("blocks")) == F.col("block")) | (c % F.col("blocks") == F.col("block")))
    inside = of.withColumn("cell", F.explode(cells)).select("shard", "cell", "node", "vec", "radius", "size", ((F.col("nth") == 0) & (F.floor(F.col("cell") / F.col("blocks")) == F.col("block"))).alias("asks"), (F.col("cell") % F.col("blocks") == F.col("block")).alias("here"))
    inside = inside.join(lists, "node").select("shard", "cell", "node", "vec", "radius", "size", "asks", "here", "around")
    plain = of.where("blocks = 1")
    beyond = plain.select("shard", "node").join(lists, "node").select("shard", F.explode("near").alias("node")).distinct().join(plain.select("shard", "node"), ["shard", "node"], "left_anti")
    beyond = beyond.join(items, "node").join(lists, "node").select("shard", F.lit(0).alias("cell"), "node", "vec", "radius", "size", F.lit(False).alias("asks"), F.lit(True).alias("here"), "around")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["here"] | group["asks"]].sort_values("node", ignore_index=True)
        asks = np.flatnonzero(group["asks"])
        if not len(asks):
            return pd.DataFrame([], columns=["kind", "a", "b"])
        x, nodes, radius, size = _unit(group["vec"]), group["node"].to_numpy(), group["radius"].to_numpy(), group["size"].to_numpy()
        width = max(1, max(map(len, group["around"])))
        graph = np.full((len(x), width), len(x))
        for i, around in enumerate(group["around"]):
            at = np.minimum(np.searchsorted(nodes, around), len(nodes) - 1)
            at = at[nodes[at] == around]
            graph[i, : len(at)] = at
        medoid = int((x @ x.mean(0)).argmax())
        reach = np.arccos(least) + radius + SLACK
        hits = [h for i in range(0, len(asks), 256) for h in range_search(x[asks[i : i + 256]], x, graph, medoid, asks[i : i + 256], reach, radius[asks[i : i + 256]])]
        a, b = np.repeat(asks, [len(h) for h in hits]), np.concatenate(hits)
        cosines = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 100_000]], x[b[i : i + 100_000]]) for i in range(0, len(a) + 1, 100_000)])
        return _told(nodes, size, radius, a, b, cosines, least, group["here"].to_numpy()[b])

    return materialize(inside.unionByName(beyond).groupBy("shard", "cell").applyInPandas(run, _FOUND), "vectors-found")


def exact(items: DataFrame, least: float) -> DataFrame:
    """Findings as search gives them, by comparing each block of items with each of the same length."""
    d = F.size("vec")
    sizes = items.groupBy(d.alias("d")).agg(F.ceil(F.count(F.lit(1)) / SHARD_MOST).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = items.withColumn("d", d).join(materialize(sizes, "vectors-sizes"), "d").withColumn("mine", mine)
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "mine").alias("i"), F.greatest(o, "mine").alias("j")))
    rows = rows.select("d", "node", "vec", "radius", "size", "mine", F.explode(cells).alias("cell")).select("d", "node", "vec", "radius", "size", "mine", "cell.*")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        x, radius = _unit(group["vec"]), group["radius"].to_numpy()
        first = (group["mine"] == group["i"]).to_numpy()
        across = group["i"].iloc[0] != group["j"].iloc[0]
        found = []
        for i in range(0, len(x), 256):  # blocks of rows
            sims = x[i : i + 256] @ x.T
            a, b = np.nonzero(sims >= np.cos(np.minimum(np.arccos(least) + SLACK + radius[i : i + 256, None] + radius, np.pi)))
            fine = (a + i != b) & (first[a + i] != first[b] if across else True)
            found.append((a[fine] + i, b[fine], sims[a[fine], b[fine]]))
        a, b, sims = (np.concatenate(f) for f in zip(*found, strict=True))
        return _told(group["node"].to_numpy(), group["size"].to_numpy(), radius, a, b, sims, least, np.ones(len(a), bool))

    return materialize(rows.groupBy("d", "i", "j").applyInPandas(compare, _FOUND), "vectors-found")


def settle(pairs: DataFrame, members: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Findings about the vectors of pairs of items (a, b): a block of one item's vectors meets a block of all that the item is paired with.

    Counts are by vector (kind vector), edges by item.
    """
    rows = members.join(vectors, "node").select("node", "item", "vec", "size")
    few = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.select("a", "b").distinct().join(few.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(few.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    big = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = materialize(pairs.select(F.when(big, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(big, F.col("b")).otherwise(F.col("a")).alias("guest"), F.greatest("na", "nb").alias("n"), F.least("na", "nb").alias("m")), "vectors-maybe")
    hosts = materialize(pairs.groupBy("host").agg(F.ceil(F.max("n") / SHARD_MOST).cast("int").alias("is"), F.ceil(F.sum("m") / SHARD_MOST).cast("int").alias("js")), "vectors-hosts")
    own = rows.join(hosts, rows["item"] == hosts["host"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("is")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("js") - 1)))
    met = rows.join(pairs.select(F.col("guest").alias("item"), "host"), "item").join(hosts, "host").withColumn("j", F.pmod(F.xxhash64("node"), F.col("js")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("is") - 1)))
    columns = ["host", "i", "j", "node", "item", "vec", "size"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        home = (group["item"] == group["host"]).to_numpy()
        p, q = group[home], group[~home]
        if p.empty or q.empty:
            return pd.DataFrame([], columns=["kind", "a", "b"])
        near = _unit(p["vec"]) @ _unit(q["vec"]).T >= least
        counts = [pd.DataFrame({"kind": "vector", "a": x["node"], "b": n.astype(np.int64)}) for x, n in ((p, near @ q["size"].to_numpy()), (q, near.T @ p["size"].to_numpy()))]
        met = q["item"].to_numpy()[near.any(0)]
        return pd.concat([*(c[c["b"] > 0] for c in counts), pd.DataFrame({"kind": "edge", "a": p["item"].iloc[0], "b": np.unique(met)})])

    return materialize(own.select(columns).unionByName(met.select(columns)).groupBy("host", "i", "j").applyInPandas(compare, _FOUND), "vectors-settled")


def _counts(found: DataFrame, settled: DataFrame, vectors: DataFrame, items: DataFrame, members: DataFrame) -> DataFrame:
    """(node, links): how many rows each vector links with: those of equal vectors, of its ball, and those found."""
    by_item = found.where("kind = 'count'").groupBy(F.col("a").alias("item")).agg(F.sum("b").alias("by_item"))
    by_node = settled.where("kind = 'vector'").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("by_node"))
    rows = members.join(items.select(F.col("node").alias("item"), F.col("size").alias("own")), "item").join(by_item, "item", "left").join(by_node, "node", "left")
    return materialize(rows.select("node", "item", (F.col("own") - 1 + F.coalesce("by_item", F.lit(0)) + F.coalesce("by_node", F.lit(0))).alias("links")), "vectors-counts")


def audit(vectors: DataFrame, counts: DataFrame, least: float) -> float:
    """Recall of the links in counts (node, links), averaged over vectors (node, vec, size) that have a partner: about AUDIT vectors chosen by hash are sent to every task and compared with
    all, then four times as many, until PARTNERED of them have a partner, all are compared, or AUDIT_MOST were drawn. Where partners are so rare, AUDIT more are drawn among the vectors that the search gave a
    partner, so that at least what it missed of their partners is seen. So what is collected and compared is bounded, whatever the table.
    """
    n, drawn, total = vectors.count(), AUDIT, [0, 0.0]

    def judged(queries: list) -> tuple[int, float]:
        by: dict[int, list] = {}
        for q in queries:
            by.setdefault(len(q["vec"]), []).append(q)
        shared = vectors.sparkSession.sparkContext.broadcast({d: ([q["node"] for q in qs], _unit([q["vec"] for q in qs])) for d, qs in by.items()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {d: np.zeros(len(ids)) for d, (ids, _) in shared.value.items()}
            for batch in batches:
                for d, rows in batch.groupby(batch["vec"].map(len)):
                    if d in total:
                        total[d] += (_unit(rows["vec"]) @ shared.value[d][1].T >= least).T @ rows["size"].to_numpy()
            for d, t in total.items():
                yield pd.DataFrame({"node": shared.value[d][0], "true": t}).astype("int64")

        true = vectors.mapInPandas(run, "node long, true long").groupBy("node").agg((F.sum("true") - 1).alias("true")).where(F.col("true") > 0)  # less the row itself
        row = true.join(counts, "node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(F.lit(1.0), F.col("links") / F.col("true"))).alias("recall")).head()
        return row["n"], row["recall"] or 0.0

    at = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1_000_000_000))
    while True:
        part = min(1.0, drawn / max(1, n))
        total = judged(vectors.where(at < math.ceil(1_000_000_000 * part)).collect())
        if total[0] >= PARTNERED or part >= 1.0:
            break
        if drawn >= AUDIT_MOST:
            linked = vectors.join(counts.where("links > 0").select("node"), "node", "left_semi").where(at >= math.ceil(1_000_000_000 * part))
            more = judged(linked.orderBy(at, "node").limit(AUDIT).collect())
            total = (total[0] + more[0], total[1] + more[1])
            break
        drawn *= 4
    return total[1] / total[0] if total[0] else 1.0


def near_duplicates(rows: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept, recall) for each row: other rows with a cosine of least or more, the smallest id reachable by links, and the audited recall of the search.

    Equal vectors are one node, and large groups of vectors that all link become one item, so no pairs are stored and a dense group costs rows in proportion to its size. Items are searched on
    joined graphs. Recall is audited against brute force on a sample of rows, and the search repeated with more overlap where it is below RECALL; where three tries are not
    enough, all items are compared. Only vectors compared in double precision, or within bounds on angles so compared, are links.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; others with those of their length only.
    So do rows with a null id, whose component is null. Repeated rows count each. Rows that share an id but no vector are searched each on its own. An empty table gives an empty result.
    """
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    work = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    usable = _usable(F.col("vec")) & F.col("id").isNotNull()
    work = work.withColumn("key", F.when(usable, F.struct(F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("i"))))
    classes = work.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("vec").alias("vec"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors-classes")
    vectors = classes.select("node", "vec", "size")
    items, members = balls(vectors, least)
    for overlap in (2, 4, 8, None):
        found = search(items, least, overlap) if overlap else exact(items, least)
        settled = settle(found.where("kind = 'maybe'"), members, vectors, least)
        counts = _counts(found, settled, vectors, items, members)
        recall = audit(vectors, counts, least)
        logging.getLogger(__name__).info("overlap %s: recall %.4f", overlap, recall)
        if recall >= RECALL:
            break
    edges = found.unionByName(settled).where("kind = 'edge'").select("a", "b")
    groups = components(edges)
    facts = counts.join(classes.select("node", "key", "id"), "node").join(groups.select(F.col("node").alias("item"), "component"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    facts = materialize(facts.select("key", "links", "component", "id"), "vectors-facts")
    low = materialize(facts.groupBy("component").agg(F.min("id").alias("low")), "vectors-groups")
    out = work.select("id", "key").join(facts.join(low, "component").select("key", "links", "low"), "key", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))).withColumn("recall", F.lit(float(recall)))
