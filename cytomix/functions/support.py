"""Linear support vector regression with a share of support vectors, solved exactly inside a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Regression:
    """coef and intercept of the fit, half width of its tube, the rows' dual weights, and the largest violation of an optimality condition, relative to the data."""

    coef: np.ndarray
    intercept: float
    width: float
    dual: np.ndarray
    residual: float

    def support(self) -> np.ndarray:
        """The rows that carry the fit: those with dual weight."""
        return np.flatnonzero(np.abs(self.dual) > 1e-7 * max(np.abs(self.dual).max(initial=0.0), 1e-300))

    def error(self, x: np.ndarray, y: np.ndarray) -> float:
        """Mean squared error on rows."""
        return float(((y - x @ self.coef - self.intercept) ** 2).mean())


def support_regression(x: np.ndarray, y: np.ndarray, nu: float, cost: float = 1.0, rounds: int = 100, tol: float = 1e-10) -> Regression:
    """The coefficients w that minimise |w|^2 / 2 + cost * (n nu e + what residuals exceed the tube's half width e), by the dual problem.

    The dual has a weight from 0 to cost for each row above and below the tube; weights of both kinds have one sum, and together n nu cost. A primal-dual interior point method solves it: with a linear kernel each
    step is a system of as many equations as columns, so it takes time in proportion to the rows. Columns and values are scaled before, which changes no solution.
    """
    n, c = x.shape
    size = float(np.abs(y).max(initial=0.0))
    if not size:
        return Regression(np.zeros(c), 0.0, 0.0, np.zeros(n), 0.0)
    d, q = np.vstack((x, -x)) * np.sqrt(cost / size), -np.concatenate((y, -y)) / size  # weights in units of cost, the objective in units of cost * size
    a = np.vstack((np.concatenate((np.ones(n), -np.ones(n))), np.ones(2 * n)))
    wide = np.column_stack((d, -a.T))  # a step's equations: as many as there are columns and sums
    b = np.array([0.0, min(max(nu, 1e-6), 1.0) * n])
    z = np.full(2 * n, b[1] / (2 * n))
    low, high, lam = np.ones(2 * n), np.ones(2 * n), np.zeros(2)
    best_gap, reached, worse = np.inf, (z, lam, low, high), 0
    for _ in range(rounds):
        z = np.clip(z, 1e-15, 1 - 1e-15)
        slack = 1 - z
        dual_gap = d @ (d.T @ z) + q - a.T @ lam - low + high
        prime_gap, mu = b - a @ z, (z @ low + slack @ high) / (4 * n)
        gap = max(np.abs(dual_gap).max(), np.abs(prime_gap).max() / n, mu)
        if gap < best_gap:
            best_gap, reached, worse = gap, (z, lam, low, high), 0
        worse += 1
        if gap < tol or worse > 4:  # close to the solution rounding takes over
            break
        theta = low / z + high / slack
        square = wide.T @ (wide / theta[:, None])
        square[np.arange(c), np.arange(c)] += 1.0
        even = 1 / np.sqrt(np.maximum(np.diag(square), 1e-300))
        inverse = np.linalg.pinv(square * even[:, None] * even, rcond=1e-15, hermitian=True) * even[:, None] * even

        def move(to: float, bend_low: np.ndarray, bend_high: np.ndarray, slack=slack, dual_gap=dual_gap, prime_gap=prime_gap, theta=theta, inverse=inverse) -> tuple[np.ndarray, ...]:
            r_low, r_high = (to - bend_low) / z - low, (to - bend_high) / slack - high
            rhs = -dual_gap + r_low - r_high
            v = inverse @ (wide.T @ (rhs / theta) + np.concatenate((np.zeros(c), prime_gap)))
            step = (rhs - wide @ v) / theta
            return step, v[c:], r_low - low / z * step, r_high + high / slack * step

        def reach(step: np.ndarray, s_low: np.ndarray, s_high: np.ndarray, slack=slack) -> float:
            least = min((-v[s < 0] / s[s < 0]).min(initial=np.inf) for v, s in ((z, step), (slack, -step), (low, s_low), (high, s_high)))
            return min(1.0, least)

        step, _, s_low, s_high = move(0.0, np.zeros(2 * n), np.zeros(2 * n))
        t = reach(step, s_low, s_high)
        ahead = ((z + t * step) @ (low + t * s_low) + (slack - t * step) @ (high + t * s_high)) / (4 * n)
        step, step_lam, s_low, s_high = move((ahead / mu) ** 3 * mu, step * s_low, -step * s_high)
        t = min(1.0, 0.995 * reach(step, s_low, s_high))
        if not (np.isfinite(t) and t > 1e-10):
            break
        z, lam, low, high = z + t * step, lam + t * step_lam, low + t * s_low, high + t * s_high
    z, lam, low, high = reached
    z = np.where(low > z, 0.0, np.where(high > 1 - z, 1.0, z))  # strict complementarity tells which bounds hold
    plain = (x.T @ (cost * (z[:n] - z[n:])), -lam[0] * size, max(-lam[1] * size, 0.0), z)
    best, tried, seen, single = (violation(x, y, nu, cost, plain[3] * cost, *plain[:3]), plain), z, set(), False
    for _ in range(4 * rounds):
        got, wanted = polished(x, y, b[1], cost, tried)
        off = violation(x, y, nu, cost, got[3] * cost, *got[:3])
        if off < best[0]:
            best = off, got
        if best[0] < 1e-12:
            break
        over = np.concatenate((y - x @ got[0] - got[1] - got[2], -(y - x @ got[0] - got[1]) - got[2])) / size
        wrong = np.where(tried == 0, over, np.where(tried == 1, -over, np.maximum(-wanted, wanted - 1)))  # bounds that should not hold, and bounds that should
        if tried.tobytes() in seen:  # all at once goes in circles: the worst alone
            single = True
        seen.add(tried.tobytes())
        change = wrong > 1e-13
        if single:
            change &= wrong == wrong.max()
        to = np.where((tried == 0) | (tried == 1), 0.5, np.where(wanted < 0.5, 0.0, 1.0))
        if not change.any():
            break
        tried = np.where(change, to, tried)
    residual, (coef, intercept, width, z) = best
    return Regression(coef, float(intercept), float(width), cost * (z[:n] - z[n:]), residual)


def polished(x: np.ndarray, y: np.ndarray, total: float, cost: float, z: np.ndarray) -> tuple[tuple[np.ndarray, float, float, np.ndarray], np.ndarray]:
    """(coef, intercept, width, weights) that meet the optimality conditions exactly, given which weights are 0 and which are 1: the rows of all others lie on the tube's edge. And what these weights would be
    without their bounds."""
    (n, c), free = x.shape, np.flatnonzero((z > 0) & (z < 1))
    side, row = np.where(np.arange(2 * n) < n, 1.0, -1.0), np.arange(2 * n) % n
    reach, size = max(float(np.abs(x).max(initial=0.0)), 1e-300), max(float(np.abs(y).max(initial=0.0)), 1e-300)
    grow, full, k = reach * reach * cost / size, np.flatnonzero(z == 1), len(free)
    x_, y_ = x / reach, y / size
    m, r = np.zeros((c + k + 2, c + 2 + k)), np.zeros(c + k + 2)
    m[:c, :c], m[:c, c + 2 :] = np.eye(c) / grow, -(side[free, None] * x_[row[free]]).T
    r[:c] = (side[full, None] * x_[row[full]]).sum(0)
    m[c : c + k, :c], m[c : c + k, c], m[c : c + k, c + 1], r[c : c + k] = x_[row[free]], 1.0, side[free], y_[row[free]]
    m[-2, c + 2 :], r[-2] = side[free], -side[full].sum()
    m[-1, c + 2 :], r[-1] = 1.0, total - len(full)
    got = np.linalg.lstsq(m, r, rcond=None)[0]
    wanted = z.copy()
    wanted[free] = got[c + 2 :]
    return (got[:c] * size / reach, got[c] * size, max(got[c + 1] * size, 0.0), np.clip(wanted, 0.0, 1.0)), wanted


def violation(x: np.ndarray, y: np.ndarray, nu: float, cost: float, weights: np.ndarray, coef: np.ndarray, intercept: float, width: float) -> float:
    """The largest violation of the optimality conditions, relative to values and weights: sums of weights, and for each row and side no weight inside the tube and full weight outside."""
    n = len(y)
    miss, size = y - x @ coef - intercept, max(np.abs(y).max(initial=0.0), 1e-300)
    over = np.concatenate((miss - width, -miss - width)) / size
    share = weights / cost
    sides = np.minimum(np.maximum(over, 0), 1 - share) + np.minimum(np.maximum(-over, 0), share)
    sums = [abs(share[:n].sum() - share[n:].sum()) / n, abs(share.sum() - min(max(nu, 1e-6), 1.0) * n) / n]
    return float(max(sides.max(initial=0.0), *sums))
