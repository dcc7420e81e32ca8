"""Cell states: cluster matrices, Gram matrices, convex factorisation, consensus, and reports on scores and loadings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytomix.operators import factors, linkage
from cytomix.sources.stored import small, stored


def cluster_matrix(gex: DataFrame, omega: DataFrame, fraction: DataFrame, weighing: str = "Omega") -> DataFrame:
    """(celltype, sample, gene, x) from gex (celltype, sample, gene, nu): centred per gene and weighted by omega, or by omega and fraction, or only centred, or as it is.

    Genes without omega, and samples without a fraction, have no weight and are left out.
    """
    centred = F.col("nu") - F.avg("nu").over(Window.partitionBy("celltype", "gene"))
    if weighing == "no_weighing":
        return gex.select("celltype", "sample", "gene", F.col("nu").alias("x"))
    if weighing == "centering":
        return gex.select("celltype", "sample", "gene", centred.alias("x"))
    if weighing not in ("Omega", "OmegaFractions"):
        raise ValueError(f"unknown weighing {weighing!r}")
    rows = gex.select("celltype", "sample", "gene", centred.alias("c")).join(omega, ["celltype", "gene"])
    if weighing == "Omega":
        return rows.select("celltype", "sample", "gene", (F.col("c") * F.col("omega")).alias("x"))
    return rows.join(fraction, ["sample", "celltype"]).select("celltype", "sample", "gene", (F.col("c") * F.col("omega") * F.col("fraction")).alias("x"))


def gram(matrix: DataFrame) -> DataFrame:
    """(celltype, s1, s2, k), s1 <= s2: inner products of samples over genes; pairs of samples without a common gene are left out.

    A task turns the genes it holds into one block of sums for each cell type, so what is shuffled is a row for each pair of samples and task, not for each gene too.
    """
    kind = {f.name: f.dataType.simpleString() for f in matrix.schema.fields}
    rows = matrix.groupBy("celltype", "gene").agg(F.collect_list(F.struct("sample", "x")).alias("v")).select("celltype", F.col("v.sample").alias("samples"), F.col("v.x").alias("x")).sortWithinPartitions("celltype")

    def block(celltype, genes: list[tuple]) -> pd.DataFrame:
        samples = np.unique(np.concatenate([s for s, _ in genes]))
        wide, there = np.zeros((len(genes), len(samples))), np.zeros((len(genes), len(samples)))
        for i, (s, x) in enumerate(genes):
            at = np.searchsorted(samples, s)
            wide[i, at], there[i, at] = x, 1.0
        i, j = np.nonzero(np.triu(there.T @ there))
        return pd.DataFrame({"celltype": celltype, "s1": samples[i], "s2": samples[j], "k": (wide.T @ wide)[i, j]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, of = [], None
        for batch in batches:
            for celltype, samples, x in zip(batch["celltype"], batch["samples"], batch["x"], strict=True):
                if held and (celltype != of or len(held) >= 4096):
                    yield block(of, held)
                    held = []
                of = celltype
                held.append((samples, x))
        if held:
            yield block(of, held)

    parts = rows.mapInPandas(run, f"celltype {kind['celltype']}, s1 {kind['sample']}, s2 {kind['sample']}, k double")
    return parts.groupBy("celltype", "s1", "s2").agg(F.sum("k").alias("k"))


def connectivity(assigned: DataFrame) -> DataFrame:
    """(run, s1, s2), s1 <= s2, for samples of one cluster, from assigned (run, sample, cluster)."""
    a = assigned.select("run", "cluster", F.col("sample").alias("s1"))
    return a.join(assigned.select("run", "cluster", F.col("sample").alias("s2")), ["run", "cluster"]).where("s1 <= s2").select("run", "s1", "s2")


def consensus(assigned: DataFrame) -> DataFrame:
    """(s1, s2, share): share of runs that put both samples into one cluster, where that ever happens."""
    runs = assigned.agg(F.countDistinct("run").alias("n"))
    return connectivity(assigned).groupBy("s1", "s2").agg(F.count("*").alias("c")).join(runs).select("s1", "s2", (F.col("c") / F.col("n")).alias("share"))


def normalized(scores: DataFrame) -> DataFrame:
    """scores (celltype, sample, state, score) with the score of a sample summing to one in each cell type."""
    return scores.withColumn("score", F.try_divide("score", F.sum("score").over(Window.partitionBy("celltype", "sample"))))


def dominant(scores: DataFrame) -> DataFrame:
    """(celltype, sample, state, score): the highest score, the lowest state on ties."""
    top = scores.groupBy("celltype", "sample").agg(F.max(F.struct("score", (-F.col("state")).alias("s"))).alias("t"))
    return top.select("celltype", "sample", (-F.col("t.s")).alias("state"), "t.score")


def top_per_state(loadings: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("celltype", "state").orderBy(F.desc("loading"), "gene"))
    return loadings.withColumn("rank", rank).where(F.col("rank") <= n)


def top_absolute(loadings: DataFrame, n: int) -> DataFrame:
    """Loadings of the n genes whose largest absolute loading in any state is highest."""
    best = loadings.groupBy("gene").agg(F.max(F.abs("loading")).alias("top")).orderBy(F.desc("top"), "gene").limit(n)
    return loadings.join(best.select("gene"), "gene", "left_semi")


def fraction_order(fraction: DataFrame, by: str = "median") -> DataFrame:
    """(celltype, value, place): cell types by falling median or mean fraction."""
    value = F.median("fraction") if by == "median" else F.avg("fraction")
    rows = fraction.groupBy("celltype").agg(value.alias("value"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "celltype")))  # cell types are few


def fraction_boxes(fraction: DataFrame) -> DataFrame:
    q = lambda p: F.percentile("fraction", F.lit(p))
    return fraction.groupBy("celltype").agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.min("fraction").alias("lo"), F.max("fraction").alias("hi"), F.avg("fraction").alias("mean"))


def score_fraction_correlation(scores: DataFrame, fraction: DataFrame) -> DataFrame:
    """(celltype, state, other, r): Pearson correlation of a state's scores with each cell type's fractions over samples."""
    other = fraction.select("sample", F.col("celltype").alias("other"), "fraction")
    return scores.join(other, "sample").groupBy("celltype", "state", "other").agg(F.corr("score", "fraction").alias("r"))


def constant_genes(matrix: DataFrame) -> DataFrame:
    """Genes (celltype, gene) without variance over samples."""
    return matrix.groupBy("celltype", "gene").agg(F.var_pop("x").alias("v")).where("v = 0").select("celltype", "gene")


def pick_k(curve: DataFrame, least: float = 0.9) -> DataFrame:
    """(celltype, chosen) from curve (celltype, k, c): at the last k whose c falls under least after two at or above it, the one of the k one
    and two before whose step is nearer in value, the smaller on ties; the largest k where no such fall exists."""
    w = Window.partitionBy("celltype").orderBy("k")
    rows = curve.withColumns({"c1": F.lag("c", 1).over(w), "c2": F.lag("c", 2).over(w), "k1": F.lag("k", 1).over(w), "k2": F.lag("k", 2).over(w)})
    fall = (F.col("c") < least) & (F.col("c1") >= least) & (F.col("c2") >= least)
    nearer = F.when(F.abs(F.col("c1") - least) <= F.abs(F.col("c") - least), F.col("k2")).otherwise(F.col("k1"))
    found = rows.groupBy("celltype").agg(F.max(F.when(fall, F.struct("k", nearer.alias("pick")))).alias("f"), F.max("k").alias("most"))
    return found.select("celltype", F.coalesce("f.pick", "most").alias("chosen"))


def biggest_drop(curve: DataFrame) -> DataFrame:
    """(celltype, k): the k before the largest fall of c; the first on ties."""
    w = Window.partitionBy("celltype").orderBy("k")
    rows = curve.withColumn("drop", F.col("c") - F.lead("c").over(w)).where("drop is not null")
    return rows.groupBy("celltype").agg(F.max(F.struct("drop", (-F.col("k")).alias("m"))).alias("t")).select("celltype", (-F.col("t.m")).alias("k"))


def nearest_centre(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, centre, dist): Euclidean nearest of few centres (centre, gene, c) for points (id, gene, x); the lowest centre on ties."""
    d = points.join(small(centres), "gene").groupBy("id", "centre").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("c"), 2))).alias("dist"))
    return d.groupBy("id").agg(F.min(F.struct("dist", "centre")).alias("b")).select("id", "b.centre", "b.dist")


def residual(matrix: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """One row (residual, frobenius) of x (sample, gene, x) against the product of w (gene, state, w) and h (state, sample, h)."""
    fitted = w.join(h, "state").groupBy("gene", "sample").agg(F.sum(F.col("w") * F.col("h")).alias("p"))
    miss = F.col("x") - F.coalesce("p", F.lit(0.0))
    return matrix.join(fitted, ["gene", "sample"], "left").agg((100 * F.sum(F.abs(miss)) / F.sum(F.abs("x"))).alias("residual"), F.sqrt(F.sum(miss * miss)).alias("frobenius"))


def _kmeans(k: np.ndarray, states: int, rnd: np.random.Generator) -> np.ndarray:
    """Clusters of samples from their Gram matrix alone; the distance to a mean m is k_jj - 2 (k m)_j + m'k m."""
    n = len(k)
    m = np.zeros((states, n))
    m[np.arange(states), np.sort(rnd.choice(n, states, replace=False))] = 1.0
    for _ in range(10):
        mk = m @ k
        near = (np.diag(k)[None] - 2 * mk + (mk * m).sum(1)[:, None]).argmin(0)
        for s in range(states):
            if (near == s).any():
                m[s] = (near == s) / (near == s).sum()
    return near


def _factorised(k: np.ndarray, states: int, seeds: list[int], rounds: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Convex factors of X = X g h from k = X'X, for each seed: multiplicative updates of the positive and negative parts, from a k-means start.

    Returns h (seeds, states, samples), g (seeds, samples, states) and the errors.
    """
    n = len(k)
    near = np.stack([_kmeans(k, states, np.random.default_rng(seed)) for seed in seeds])
    one = (near[:, None] == np.arange(states)[None, :, None]).astype(float)
    h, g = one + 0.2, np.swapaxes((one + 0.01) / np.maximum(one.sum(2, keepdims=True), 1), 1, 2)
    up, down, whole = np.maximum(k, 0), np.maximum(-k, 0), np.trace(k)
    err, live = np.full(len(seeds), np.inf), np.arange(len(seeds))
    for _ in range(rounds):
        a, b = h[live], g[live]
        bt = np.swapaxes(b, 1, 2)
        ub, db = up @ b, down @ b
        a = a * np.sqrt((np.swapaxes(ub, 1, 2) + bt @ db @ a) / (np.swapaxes(db, 1, 2) + bt @ ub @ a + 1e-9))
        at = np.swapaxes(a, 1, 2)
        hh = a @ at
        b = b * np.sqrt((up @ at + db @ hh) / (down @ at + ub @ hh + 1e-9))
        kb = k @ b
        square = whole - 2 * np.einsum("rij,rji->r", kb, a) + np.einsum("rij,rji->r", hh, np.swapaxes(b, 1, 2) @ kb)
        h[live], g[live] = a, b
        now = np.sqrt(np.maximum(square, 0))
        moved = np.abs(err[live] - now) / n >= 1e-12
        err[live] = now
        live = live[moved]
        if not len(live):
            break
    return h, g, err


def factorise(gram_rows: DataFrame, runs: DataFrame, block: int = factors.BLOCK) -> DataFrame:
    """(celltype, states, run, sample, state, h, g, err): convex factorisations of each cell type's Gram matrix (celltype, s1, s2, k), for runs (states, run), or (celltype, states, run).

    Genes have been summed away. A cell type whose samples fit into one block goes to tasks whole, with the restarts of one number of states, ten at a time; one of more samples is cut into blocks, and its
    iterations are products of these with the factors. Both take the same steps from the same starts. run is also the seed.
    """
    kind = {f.name: f.dataType.simpleString() for f in gram_rows.schema.fields}
    counts = gram_rows.where("s1 = s2").groupBy("celltype").agg(F.count(F.lit(1)).alias("n"))
    wide = [r["celltype"] for r in counts.where(F.col("n") > block).collect()]  # cell types are few
    few = gram_rows.where(~F.col("celltype").isin(wide)) if wide else gram_rows
    packed = few.groupBy("celltype").agg(F.collect_list(F.struct("s1", "s2", "k")).alias("v")).select("celltype", F.col("v.s1").alias("s1"), F.col("v.s2").alias("s2"), F.col("v.k").alias("k"))
    batches = runs.withColumn("batch", F.floor(F.col("run") / 10)).groupBy(*[c for c in runs.columns if c != "run"], "batch").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    rows = packed.join(batches, "celltype") if "celltype" in runs.columns else packed.crossJoin(small(batches))  # batches of restarts are few, and each needs the matrix
    parts = max(gram_rows.sparkSession.sparkContext.defaultParallelism, int(gram_rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "celltype", "states", "batch")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                samples = np.unique(np.concatenate((row.s1, row.s2)))
                k = np.zeros((len(samples), len(samples)))
                i, j = np.searchsorted(samples, row.s1), np.searchsorted(samples, row.s2)
                k[i, j] = k[j, i] = row.k
                h, g, err = _factorised(k, min(int(row.states), len(samples)), [int(r) for r in row.runs])
                for r, run in enumerate(row.runs):
                    s, t = np.indices(g[r].shape)
                    yield pd.DataFrame({"celltype": row.celltype, "states": int(row.states), "run": int(run), "sample": samples[s.ravel()], "state": t.ravel(), "h": h[r].T.ravel(), "g": g[r].ravel(), "err": err[r]})

    out = rows.mapInPandas(fit, f"celltype {kind['celltype']}, states int, run int, sample {kind['s1']}, state int, h double, g double, err double")
    for celltype in wide:
        own = runs.where(F.col("celltype") == F.lit(celltype)) if "celltype" in runs.columns else runs
        plan = [(int(r["states"]), int(r["run"])) for r in own.select("states", "run").collect()]
        if plan:
            found = factors.factorise(gram_rows.where(F.col("celltype") == F.lit(celltype)).select("s1", "s2", "k"), plan, block=block)
            out = out.unionByName(found.withColumn("celltype", F.lit(celltype).cast(kind["celltype"])))
    return out


def eigenpairs(gram_rows: DataFrame, count: int, *, least: float = 1e-8, block: int = factors.BLOCK) -> DataFrame:
    """(celltype, place, value, sample, entry): the count largest eigenvalues of each cell type's Gram matrix (celltype, s1, s2, k), place 0 being the largest, with the entries of their vectors, of which the largest is positive. Values under
    least times the largest are dropped.

    As in factorise, a cell type of one block is solved in a task, and a larger one by products of its blocks.
    """
    kind = {f.name: f.dataType.simpleString() for f in gram_rows.schema.fields}
    shape = f"celltype {kind['celltype']}, place int, value double, sample {kind['s1']}, entry double"
    counts = gram_rows.where("s1 = s2").groupBy("celltype").agg(F.count(F.lit(1)).alias("n"))
    wide = [r["celltype"] for r in counts.where(F.col("n") > block).collect()]  # cell types are few

    def framed(celltype, samples: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
        n = len(samples)
        return pd.DataFrame({"celltype": celltype, "place": np.repeat(np.arange(len(values)), n), "value": np.repeat(values, n), "sample": np.tile(samples, len(values)), "entry": vectors.T.ravel()})

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        samples = np.unique(np.concatenate((rows["s1"], rows["s2"])))
        k = np.zeros((len(samples), len(samples)))
        i, j = np.searchsorted(samples, rows["s1"]), np.searchsorted(samples, rows["s2"])
        k[i, j] = k[j, i] = rows["k"]
        values, vectors = np.linalg.eigh(k)
        values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
        kept = values > max(least * max(values.max(initial=0.0), 0.0), 1e-300)
        values, vectors = values[kept], vectors[:, kept]
        sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))]) if len(values) else 1.0
        return framed(rows["celltype"].iloc[0], samples, values, vectors * sign)

    few = gram_rows.where(~F.col("celltype").isin(wide)) if wide else gram_rows
    out = few.groupBy("celltype").applyInPandas(solve, shape)
    for celltype in wide:
        found = factors.eigenpairs(gram_rows.where(F.col("celltype") == F.lit(celltype)).select("s1", "s2", "k"), count, least=least, block=block)
        out = out.unionByName(gram_rows.sparkSession.createDataFrame(framed(celltype, *found), shape))
    return out


def best_run(factors: DataFrame) -> DataFrame:
    """The factors of the restart with the least error, the first on ties, for each cell type and number of states."""
    best = factors.groupBy("celltype", "states").agg(F.min(F.struct("err", "run")).alias("b")).select("celltype", "states", F.col("b.run").alias("run"))
    return factors.join(best, ["celltype", "states", "run"], "left_semi")


def loadings(matrix: DataFrame, factors: DataFrame) -> DataFrame:
    """(celltype, gene, state, loading): the matrix times g."""
    return matrix.join(factors.select("celltype", "sample", "state", "g"), ["celltype", "sample"]).groupBy("celltype", "gene", "state").agg(F.sum(F.col("x") * F.col("g")).alias("loading"))


def consensus_points(factors: DataFrame, chunk: int = 2048) -> DataFrame:
    """(celltype, states, id, n, point): points whose distances are those of the rows of the restarts' consensus matrix; id numbers the ways in which samples were assigned, n counts the samples of each.

    With z the indicator of a sample's cluster in every restart, the consensus of two samples is z z' over the number of restarts, and the product of two of its rows is z (Z'Z) z' over the square of that. So the root
    of Z'Z, clusters by clusters, places samples with the right distances, and no matrix of samples by samples is made. Samples that all restarts assign alike are one point.
    """
    kind = factors.schema["celltype"].dataType.simpleString()
    assigned = factors.groupBy("celltype", "states", "run", "sample").agg(F.max(F.struct("h", (-F.col("state")).alias("m"))).alias("t")).select("celltype", "states", "run", "sample", (-F.col("t.m")).alias("state"))
    ways = assigned.groupBy("celltype", "states", "sample").agg(F.transform(F.sort_array(F.collect_list(F.struct("run", "state"))), lambda t: t["state"]).alias("way"))
    ways = ways.groupBy("celltype", "states", "way").agg(F.count(F.lit(1)).cast("double").alias("n"))
    ways = stored(ways.withColumn("id", F.row_number().over(Window.partitionBy("celltype", "states").orderBy("way")) - 1), "states-ways")
    packs = ways.groupBy("celltype", "states", F.floor(F.col("id") / chunk).alias("chunk")).agg(F.collect_list(F.struct("id", "n", "way")).alias("v"))
    packs = stored(packs.select("celltype", "states", F.col("v.id").alias("id"), F.col("v.n").alias("n"), F.col("v.way").alias("way")), "states-packs")

    def indicators(way: np.ndarray, states: int) -> np.ndarray:
        z = np.zeros((len(way), way.shape[1] * states))
        z[np.arange(len(way))[:, None], way + states * np.arange(way.shape[1])] = 1.0
        return z

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                z = indicators(np.stack(row.way), int(row.states))
                yield pd.DataFrame({"celltype": [row.celltype], "states": int(row.states), "data": [(z.T @ (z * np.asarray(row.n)[:, None])).tobytes()]})

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = None, None

        def out() -> pd.DataFrame:
            values, vectors = np.linalg.eigh(total.reshape(int(np.sqrt(len(total))), -1))
            root = vectors * np.sqrt(np.maximum(values, 0))
            return pd.DataFrame({"celltype": [held[0]], "states": held[1], "root": [root.tobytes()]})

        for batch in batches:
            for celltype, states, data in zip(batch["celltype"], batch["states"], batch["data"], strict=True):
                if held is not None and held != (celltype, states):
                    yield out()
                    total = None
                held = (celltype, states)
                total = np.frombuffer(data) if total is None else total + np.frombuffer(data)
        if held is not None:
            yield out()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                way = np.stack(row.way)
                root = np.frombuffer(row.root).reshape(way.shape[1] * int(row.states), -1)
                point = indicators(way, int(row.states)) @ root / way.shape[1]
                yield pd.DataFrame({"celltype": row.celltype, "states": int(row.states), "id": row.id, "n": row.n, "point": list(point)})

    parts = packs.mapInPandas(products, f"celltype {kind}, states int, data binary").repartition("celltype", "states").sortWithinPartitions("celltype", "states")
    roots_ = stored(parts.mapInPandas(roots, f"celltype {kind}, states int, root binary"), "states-roots")
    return packs.join(roots_, ["celltype", "states"]).mapInPandas(place, f"celltype {kind}, states int, id int, n double, point array<double>")


def cophenetic(factors: DataFrame, **linkage_args) -> DataFrame:
    """(celltype, states, c): how well the restarts agree: the correlation of the distances between the consensus matrix' rows with the heights at which average linkage joins them."""
    points = consensus_points(factors).withColumn("group", F.struct("celltype", "states"))
    keys = stored(points.select("group").distinct().withColumn("key", F.row_number().over(Window.orderBy("group"))), "states-groups")  # cell types and numbers of states are few
    points = stored(points.join(small(keys), "group").select("key", "id", "n", "point"), "states-points")
    found = linkage.cophenetic_correlation(points, linkage.linkage(points, "key", **linkage_args), "key")
    return found.join(keys, "key").select("group.celltype", "group.states", "c")


def retrieve(matrix: DataFrame, known: DataFrame, rounds: int = 300) -> DataFrame:
    """(celltype, sample, state, score): scores of new samples under known loadings (celltype, gene, state, loading), summing to one.

    Common genes only. Samples are independent: each minimises its own misfit over h >= 0 by multiplicative updates on sums that Spark makes.
    """
    ww = known.join(matrix.select("celltype", "gene").distinct(), ["celltype", "gene"], "left_semi")
    wide = ww.groupBy("celltype", "gene").agg(F.transform(F.sort_array(F.collect_list(F.struct("state", "loading"))), lambda t: t["loading"]).alias("w"))
    rows = matrix.join(wide, ["celltype", "gene"])
    kind = {f.name: f.dataType.simpleString() for f in matrix.schema.fields}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        w, x = np.stack(group["w"].to_list()), group["x"].to_numpy()
        a, b = w.T @ w, w.T @ x
        h = np.full(w.shape[1], 1.0 / w.shape[1])
        up, down = np.maximum(a, 0), np.maximum(-a, 0)
        for _ in range(rounds):
            h = h * np.sqrt((np.maximum(b, 0) + down @ h) / (np.maximum(-b, 0) + up @ h + 1e-9))
        total = h.sum() or 1.0
        return pd.DataFrame({"celltype": group["celltype"].iloc[0], "sample": group["sample"].iloc[0], "state": np.arange(len(h)), "score": h / total})

    return rows.groupBy("celltype", "sample").applyInPandas(fit, f"celltype {kind['celltype']}, sample {kind['sample']}, state int, score double")


def ordered_loadings(loadings: DataFrame) -> DataFrame:
    """loadings (celltype, gene, state, loading) with their place within cell type and state by falling loading, ties by gene."""
    return loadings.withColumn("place", F.row_number().over(Window.partitionBy("celltype", "state").orderBy(F.desc("loading"), "gene")))


def wide(rows: DataFrame, key: str, value: str, names: list[str]) -> DataFrame:
    """rows (celltype, key, state, value) with a column celltype_state for each of names, and a row for each key of any cell type; null where a type lacks it."""
    return rows.withColumn("name", F.concat_ws("_", "celltype", "state")).groupBy(key).pivot("name", names).agg(F.first(value))


def state_points(scores: DataFrame) -> DataFrame:
    """(celltype, sample, points): each sample's scores without the states that do not vary over samples, NaN and absent as zero, padded by zeros to one length: what a layout of all samples starts from."""
    clean = scores.withColumn("score", F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(0.0)))
    varied = clean.groupBy("celltype", "state").agg(F.var_pop("score").alias("v")).where("v > 0").withColumn("at", F.row_number().over(Window.partitionBy("celltype").orderBy("state")))
    longest = varied.agg(F.coalesce(F.max("at"), F.lit(0)).alias("width"))
    rows = clean.join(varied.select("celltype", "state", "at"), ["celltype", "state"], "left").groupBy("celltype", "sample").agg(F.map_from_entries(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "score")))).alias("m"))
    cells = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return rows.join(longest).select("celltype", "sample", F.when(F.col("width") > 0, cells).otherwise(F.array().cast("array<double>")).alias("points"))


def layout(points: DataFrame, axes: int = 2) -> DataFrame:
    """points with the coordinates of its first principal axes; stands in for a neighbour embedding, which has no single right answer."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = points.withColumn("vec", array_to_vector("points"))
    return PCA(k=axes, inputCol="vec", outputCol="at").fit(rows).transform(rows).withColumn("at", vector_to_array("at")).drop("vec")


def discover(matrix: DataFrame, wanted: DataFrame | None = None, *, runs: int = 10, final_runs: int = 100, least: float = 0.9, most: int = 10) -> dict[str, DataFrame]:
    """Cell states of a cluster matrix (celltype, sample, gene, x): scores, loadings, and cophenetic (celltype, k, c, chosen).

    wanted (celltype, k) fixes the number of states of the cell types it names, and leaves all other types out; null k, or no wanted at all, asks for a sweep over 2 to most - 1 states with runs restarts each, from which pick_k chooses. The
    chosen number is then fitted with final_runs restarts, of which the one with the least error counts. Types with fixed k have one cophenetic row, of the final restarts.
    """
    spark = matrix.sparkSession
    products = stored(gram(matrix), "states-gram")
    types = products.select("celltype").distinct()
    wanted = types.withColumn("k", F.lit(None).cast("int")) if wanted is None else wanted.select("celltype", F.col("k").cast("int").alias("k")).join(types, "celltype", "left_semi")
    wanted = stored(wanted, "states-wanted")
    open_, fixed = wanted.where("k is null").select("celltype"), wanted.where("k is not null")
    run = lambda n: spark.range(n).select(F.col("id").cast("int").alias("run"))
    plan = open_.crossJoin(run(runs)).withColumn("states", F.explode(F.sequence(F.lit(2), F.lit(most - 1))))
    curve = stored(cophenetic(factorise(products.join(open_, "celltype", "left_semi"), plan)).withColumnRenamed("states", "k"), "states-curve")
    chosen = stored(pick_k(curve, least).select("celltype", F.col("chosen").cast("int").alias("k")).unionByName(fixed), "states-chosen")
    final = stored(factorise(products, chosen.select("celltype", F.col("k").alias("states")).crossJoin(run(final_runs))), "states-final")
    best = stored(best_run(final), "states-best")
    own = cophenetic(final.join(fixed.select("celltype"), "celltype", "left_semi")).withColumnRenamed("states", "k")
    curve = curve.unionByName(own).join(chosen.withColumnRenamed("k", "pick"), "celltype")
    return {
        "scores": normalized(best.select("celltype", "sample", "state", F.col("h").alias("score"))),
        "loadings": loadings(matrix, best),
        "cophenetic": curve.select("celltype", "k", "c", (F.col("k") == F.col("pick")).alias("chosen")),
    }
