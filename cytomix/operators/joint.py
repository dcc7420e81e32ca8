"""Joint ascent of the mixture model: bounded limited-memory BFGS over expression, spreads and fractions together, on vectors that stay in Spark.

A gene's part of every vector (nu, omega, their gradient, and the last steps) is one row of a table, and rows never move: an iteration reads them, takes the step, evaluates the objective and writes them again. The
part of the fractions, a number for each sample and cell type, is held by the driver and broadcast. The two-loop recursion runs on inner products alone: all products of the last steps, of the
gradients' changes and of the gradient are summed in the same pass that evaluates a step, and the direction is a combination of these vectors that each row makes for itself. Sums go
through two levels, so that the driver gets a few rows however many genes there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomix.operators.variational import LEAST, MOST, expression_terms, fraction_terms, moment_terms
from cytomix.sources.stored import stored

#: Steps that the recursion remembers, and numbers (restarts by samples by cell types) that the fractions may have.
MEMORY, FRACTIONS_MOST = 5, 20_000_000
BLOCKS = ("nu", "omega", "beta")
#: Leading entries of a row's sums: value, slope of the step, and products of the step and of the gradient's change.
HEAD = 5


def gene_loss(y: np.ndarray, sigma: np.ndarray, nu: np.ndarray, omega: np.ndarray, beta: np.ndarray, mu0: np.ndarray, beta0: np.ndarray, alpha0: float, kappa0: float, weight: float) -> tuple[float, np.ndarray, np.ndarray]:
    """One gene's part of the objective, negated, with its gradient by nu and omega in one vector, and by beta."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        value, by_nu, by_omega, by_beta, _ = moment_terms(y, sigma, nu, np.broadcast_to(omega, nu.shape), beta)
        prior, prior_nu, prior_omega = expression_terms(nu, omega, mu0, beta0, alpha0, kappa0)
        return -float(value.sum()) - prior / weight, -np.concatenate(((by_nu + prior_nu / weight).ravel(), by_omega.sum(0) + prior_omega / weight)), -by_beta


def fractions_loss(beta: np.ndarray, alpha: np.ndarray, balance: float) -> tuple[float, np.ndarray]:
    """The fractions' own part of the objective, negated, for rows of samples."""
    found = [fraction_terms(b, a) for b, a in zip(beta, alpha, strict=True)]
    return -balance * sum(v for v, _ in found), -balance * np.stack([g for _, g in found])


def held(x: np.ndarray, grad: np.ndarray, low: np.ndarray | float, high: np.ndarray | float, fixed: np.ndarray | bool = False) -> np.ndarray:
    """Where a variable may not move: at a bound that the gradient pushes against, or fixed."""
    return ((x <= low) & (grad > 0)) | ((x >= high) & (grad < 0)) | fixed


def coefficients(products: np.ndarray, steps: int) -> np.ndarray | None:
    """The two-loop recursion on inner products of the basis (steps, as many changes of the gradient, the gradient): coefficients of the vector to go against; None if that would not lead down."""
    s, y, q = np.arange(steps), steps + np.arange(steps), 2 * steps
    delta, trail = np.zeros(2 * steps + 1), {}
    delta[q] = 1.0
    for i in reversed(range(steps)):
        trail[i] = products[s[i]] @ delta / products[s[i], y[i]]
        delta[y[i]] -= trail[i]
    delta *= products[s[-1], y[-1]] / products[y[-1], y[-1]] if steps else 1 / max(1.0, np.sqrt(products[q, q]))
    for i in range(steps):
        delta[s[i]] += trail[i] - products[y[i]] @ delta / products[s[i], y[i]]
    return delta if products[q] @ delta > 0 else None


@dataclass
class Part:
    """One vector's part that is held in one place, with its bounds: x, gradient, remembered steps and changes."""

    x: np.ndarray
    grad: np.ndarray
    low: np.ndarray
    high: np.ndarray
    fixed: np.ndarray
    steps: np.ndarray
    changes: np.ndarray

    def basis(self) -> np.ndarray:
        return np.concatenate((self.steps, self.changes, np.where(held(self.x, self.grad, self.low, self.high, self.fixed), 0.0, self.grad)[None]))

    def step(self, delta: np.ndarray, t: float) -> np.ndarray:
        """Where a step of length t leads, within the bounds."""
        stop = held(self.x, self.grad, self.low, self.high, self.fixed)
        return np.clip(self.x - t * np.where(stop, 0.0, delta @ self.basis()), self.low, self.high)

    def after(self, new: np.ndarray, grad: np.ndarray) -> Part:
        return Part(new, grad, self.low, self.high, self.fixed, np.vstack((self.steps, new - self.x)), np.vstack((self.changes, grad - self.grad)))

    def kept(self, use: list[int]) -> Part:
        return Part(self.x, self.grad, self.low, self.high, self.fixed, self.steps[use], self.changes[use])

    def sums(self, before: Part, value: float) -> np.ndarray:
        """value, slope of the step taken, its square, its product with the gradient's change, the square of that, and the products of the basis."""
        move, change, basis = self.x - before.x, self.grad - before.grad, self.basis()
        return np.concatenate(([value, before.grad @ move, move @ move, move @ change, change @ change], (basis @ basis.T).ravel()))


@dataclass
class Restart:
    """What the driver knows of a restart: its fractions' part, its objective (negated), the products of its basis, which of the steps are in use, and where its rows are."""

    part: Part
    value: float
    products: np.ndarray
    use: list[int]
    rows: DataFrame = field(repr=False)
    genes: float = 0.0
    done: bool = False


def _bounds(c: int, samples: int, fixed: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = samples * c
    low, high = np.concatenate((np.full(n, -np.inf), np.full(c, LEAST))), np.concatenate((np.full(n, np.inf), np.full(c, MOST)))
    return low, high, np.concatenate((np.full(n, "nu" in fixed), np.full(c, "omega" in fixed)))


def _tree_sums(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums by rep of rows (rep, sums as bytes): within partitions, then within about the root of their number, then here."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for rep, data in zip(batch["rep"], batch["sums"], strict=True):
                totals[rep] = totals[rep] + np.frombuffer(data) if rep in totals else np.frombuffer(data)
        for rep, total in totals.items():
            yield pd.DataFrame({"rep": [rep], "sums": [total.tobytes()]})

    kind, n = "rep int, sums binary", rows.rdd.getNumPartitions()
    once = rows.mapInPandas(add, kind)
    if n > 16:
        once = once.repartition(int(np.sqrt(n)) + 1).mapInPandas(add, kind)
    found: dict[int, np.ndarray] = {}
    for r in once.collect():
        found[r["rep"]] = found[r["rep"]] + np.frombuffer(r["sums"]) if r["rep"] in found else np.frombuffer(r["sums"])
    return found


class Ascent:
    """All restarts of one model. rows has a row for each rep and gene: gene, y, sigma (a number for each sample, in one order), nu (samples by types), omega, mu0, beta0, as arrays; beta[rep] is samples by types."""

    def __init__(self, rows: DataFrame, beta: dict[int, np.ndarray], balance: float, *, alpha0: float, kappa0: float, weight: float = 1.0, fixed: tuple[str, ...] = (), memory: int = MEMORY):
        unknown = set(fixed) - set(BLOCKS)
        if unknown:
            raise ValueError(f"nothing to fix in {sorted(unknown)}; there are {BLOCKS}")
        shape = next(iter(beta.values())).shape
        if len(beta) * shape[0] * shape[1] > FRACTIONS_MOST:
            raise ValueError("too many samples for fractions that are broadcast: fit in blocks instead")
        self.spark, self.shape, self.balance, self.memory, self.fixed = rows.sparkSession, shape, balance, memory, frozenset(fixed)
        self.args = (alpha0, kappa0, weight)
        self.kind = f"rep int, gene {rows.schema['gene'].dataType.simpleString()}, y binary, sigma binary, mu0 binary, beta0 binary, x binary, grad binary, steps binary, changes binary, sums binary"
        self.rows, self.start, self.restarts = rows, beta, {}

    def begin(self, alpha: dict[int, np.ndarray]) -> None:
        """Evaluates every restart where it is; forgets all steps."""
        beta = {r: f.part.x.reshape(self.shape) for r, f in self.restarts.items()} or self.start
        rows = self._together(list(beta)) if self.restarts else self.rows
        shared, shape, args, fresh, fixed = self.spark.sparkContext.broadcast(beta), self.shape, self.args, not self.restarts, self.fixed

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            low, high, stop = _bounds(shape[1], shape[0], fixed)
            for batch in batches:
                for row in batch.itertuples():
                    read = (lambda v: np.asarray(v, float)) if fresh else np.frombuffer
                    y, sigma, mu0, beta0 = (read(v) for v in (row.y, row.sigma, row.mu0, row.beta0))
                    x = np.clip(np.concatenate((read(row.nu), read(row.omega))) if fresh else read(row.x), low, high)
                    now = shared.value[row.rep]
                    value, grad, by_beta = gene_loss(y, sigma, x[: now.size].reshape(shape), x[now.size :], now, mu0, beta0, *args)
                    none = np.zeros((0, len(x)))
                    part = Part(x, grad, low, high, stop, none, none)
                    yield _row(row.rep, row.gene, y, sigma, mu0, beta0, part, np.concatenate((part.sums(part, value), by_beta.ravel())))

        table = stored(rows.mapInPandas(run, self.kind), "joint-rows")
        totals = _tree_sums(table.select("rep", "sums"))
        low, high, stop = np.full(shape[0] * shape[1], LEAST), np.full(shape[0] * shape[1], MOST), np.full(shape[0] * shape[1], "beta" in self.fixed)
        for rep, total in totals.items():
            x = np.clip(beta[rep], LEAST, MOST)
            own, grad = fractions_loss(x, alpha[rep], self.balance)
            none = np.zeros((0, x.size))
            part = Part(x.ravel(), grad.ravel() + total[HEAD + 1 :], low, high, stop, none, none)
            both = total[: HEAD + 1] + part.sums(part, own)
            self.restarts[rep] = Restart(part, both[0], both[HEAD:].reshape(1, 1), [], table, total[0])

    def _together(self, reps: list[int]) -> DataFrame:
        """The rows of some restarts, from the tables where they are."""
        tables: dict[int, tuple[DataFrame, list[int]]] = {}
        for rep in reps:
            tables.setdefault(id(self.restarts[rep].rows), (self.restarts[rep].rows, []))[1].append(rep)
        found = [table.where(F.col("rep").isin(own)) for table, own in tables.values()]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def ascend(self, alpha: dict[int, np.ndarray], rounds: int, tol: float = 1e-9) -> None:
        """After begin(), up to rounds accepted steps of each restart. A step that does not raise the objective enough is halved and tried again, with that of other restarts that need it."""
        for f in self.restarts.values():
            f.done = False
        for _ in range(rounds):
            trial = {}
            for rep, f in self.restarts.items():
                q = f.products[-1, -1]
                if f.done or np.sqrt(q) < tol * max(1.0, abs(f.value)):
                    f.done = True
                    continue
                delta = coefficients(f.products, len(f.use))
                if delta is None:
                    f.use, f.products = [], f.products[-1:, -1:]
                    delta = coefficients(f.products, 0)
                trial[rep] = (delta, 1.0)
            if not trial:
                break
            while trial:
                trial = self._try(trial, alpha, tol)

    def _try(self, trial: dict[int, tuple[np.ndarray, float]], alpha: dict[int, np.ndarray], tol: float) -> dict[int, tuple[np.ndarray, float]]:
        """Takes the step of each restart in trial (coefficients, length); returns those that have to try a shorter one."""
        new = {rep: self.restarts[rep].part.kept(self.restarts[rep].use).step(delta, t) for rep, (delta, t) in trial.items()}
        plan = {rep: (delta, t, self.restarts[rep].use, new[rep].reshape(self.shape)) for rep, (delta, t) in trial.items()}
        shared, shape, args, fixed = self.spark.sparkContext.broadcast(plan), self.shape, self.args, self.fixed

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            low, high, stop = _bounds(shape[1], shape[0], fixed)
            for batch in batches:
                for row in batch.itertuples():
                    delta, t, use, beta = shared.value[row.rep]
                    y, sigma, mu0, beta0, x, grad = (np.frombuffer(v) for v in (row.y, row.sigma, row.mu0, row.beta0, row.x, row.grad))
                    before = Part(x, grad, low, high, stop, *(np.frombuffer(v).reshape(-1, len(x))[use] for v in (row.steps, row.changes)))
                    to = before.step(delta, t)
                    value, slope, by_beta = gene_loss(y, sigma, to[: beta.size].reshape(shape), to[beta.size :], beta, mu0, beta0, *args)
                    after = before.after(to, slope)
                    yield _row(row.rep, row.gene, y, sigma, mu0, beta0, after, np.concatenate((after.sums(before, value), by_beta.ravel())))

        table = stored(self._together(list(trial)).mapInPandas(run, self.kind), "joint-rows")
        again = {}
        for rep, total in _tree_sums(table.select("rep", "sums")).items():
            f, (delta, t) = self.restarts[rep], trial[rep]
            before, width = f.part.kept(f.use), (2 * (len(f.use) + 1) + 1) ** 2
            own, grad = fractions_loss(new[rep].reshape(self.shape), alpha[rep], self.balance)
            after = before.after(new[rep], grad.ravel() + total[HEAD + width :])
            value, slope, square, bend, change, *products = total[: HEAD + width] + after.sums(before, own)
            if not (np.isfinite(value) and value <= f.value + 1e-4 * slope):
                if t > 1e-12:
                    again[rep] = (delta, t / 2)
                else:
                    f.done = True
                continue
            n = len(f.use) + 1
            use = list(range(n)) if bend > 1e-12 * np.sqrt(square * change) else list(range(n - 1))
            use = use[-self.memory :]
            at = [*use, *(n + u for u in use), 2 * n]
            f.done = f.value - value <= tol * max(1.0, abs(f.value))
            f.part, f.value, f.products, f.use, f.rows, f.genes = after, value, np.array(products).reshape(2 * n + 1, -1)[np.ix_(at, at)], use, table, total[0]
        return again

    def update_sigma(self) -> None:
        """Each gene's sigma from its residuals under the fitted values, the same for all samples."""
        beta = {r: f.part.x.reshape(self.shape) for r, f in self.restarts.items()}
        shared, shape = self.spark.sparkContext.broadcast(beta), self.shape

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sigma = []
                for row in batch.itertuples():
                    y, old, x, now = np.frombuffer(row.y), np.frombuffer(row.sigma), np.frombuffer(row.x), shared.value[row.rep]
                    miss = moment_terms(y, old, x[: now.size].reshape(shape), np.broadcast_to(x[now.size :], shape), now)[4]
                    sigma.append(np.full(len(y), np.sqrt(np.maximum(miss, 1e-12)).mean()).tobytes())
                yield batch.assign(sigma=sigma)

        table = stored(self._together(list(beta)).mapInPandas(run, self.kind), "joint-rows")
        for f in self.restarts.values():
            f.rows = table

    def objective(self) -> dict[int, float]:
        return {rep: -f.value for rep, f in self.restarts.items()}

    def fitted(self) -> DataFrame:
        """(rep, gene, sigma, nu, omega): arrays over samples, over samples by types, and over types."""
        shape = self.shape

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = [np.frombuffer(v) for v in batch["x"]]
                n = shape[0] * shape[1]
                yield pd.DataFrame({"rep": batch["rep"], "gene": batch["gene"], "sigma": [np.frombuffer(v) for v in batch["sigma"]], "nu": [list(v[:n].reshape(shape)) for v in x], "omega": [v[n:] for v in x]})

        gene = self.kind.split(", ")[1].split(" ", 1)[1]
        return self._together(list(self.restarts)).select("rep", "gene", "sigma", "x").mapInPandas(run, f"rep int, gene {gene}, sigma array<double>, nu array<array<double>>, omega array<double>")


def _row(rep: int, gene, y: np.ndarray, sigma: np.ndarray, mu0: np.ndarray, beta0: np.ndarray, part: Part, sums: np.ndarray) -> pd.DataFrame:
    data = {"y": y, "sigma": sigma, "mu0": mu0, "beta0": beta0, "x": part.x, "grad": part.grad, "steps": part.steps, "changes": part.changes, "sums": sums}
    return pd.DataFrame({"rep": [rep], "gene": [gene], **{k: [v.tobytes()] for k, v in data.items()}})
