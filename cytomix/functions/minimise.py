"""A bounded quasi-Newton minimiser for the small problems that one group of rows poses."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(fun: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, low: np.ndarray | float, high: np.ndarray | float, rounds: int = 100, memory: int = 10, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """(x, value) of a local minimum within low <= x <= high; fun gives value and gradient.

    Limited-memory BFGS on the variables that are not held at a bound, with projected steps shortened until the value falls enough. Every step accepted lowers the value.
    """
    x = np.clip(x, low, high)
    value, grad = fun(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        free = ~(((x <= low) & (grad > 0)) | ((x >= high) & (grad < 0)))
        if not free.any() or np.abs(grad[free]).max() < tol * max(1.0, abs(value)):
            break
        q, trail = np.where(free, grad, 0.0), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            q = q - a * y
            trail.append(a)
        if steps:
            s, y = steps[-1]
            q = q * ((s @ y) / (y @ y))
        else:
            q = q / max(1.0, np.abs(q).max())
        for (s, y), a in zip(steps, reversed(trail), strict=True):
            q = q + s * (a - (y @ q) / (s @ y))
        direction = np.where(free, -q, 0.0)
        if direction @ grad >= 0:
            direction, steps = np.where(free, -grad, 0.0), []
        t = 1.0
        while True:
            new = np.clip(x + t * direction, low, high)
            move = new - x
            new_value, new_grad = fun(new)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * (grad @ move):
                break
            t /= 2
            if t < 1e-12:
                return x, value
        y = new_grad - grad
        if move @ y > 1e-12 * np.sqrt((move @ move) * (y @ y)):
            steps = [*steps, (move, y)][-memory:]
        done = value - new_value <= tol * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x, value
