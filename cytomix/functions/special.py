"""Column functions that Spark lacks: gamma family, and distances between arrays."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 8


def _num(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lgamma(x: Column | str) -> Column:
    """log Gamma(x) for x > 0: raised by recurrence, then Stirling's series. Null elsewhere."""
    x = _num(x).cast("double")
    z = x + _SHIFT
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    return F.when(x > 0, series - F.log(reduce(lambda a, b: a * b, [x + i for i in range(_SHIFT)])))


def digamma(x: Column | str) -> Column:
    x = _num(x).cast("double")
    z = x + _SHIFT
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * F.pow(z, 2)) + 1 / (120 * F.pow(z, 4)) - 1 / (252 * F.pow(z, 6)) + 1 / (240 * F.pow(z, 8))
    return F.when(x > 0, series - reduce(lambda a, b: a + b, [1 / F.nullif(x + i, F.lit(0.0)) for i in range(_SHIFT)]))


def trigamma(x: Column | str) -> Column:
    x = _num(x).cast("double")
    z = x + _SHIFT
    series = 1 / z + 1 / (2 * F.pow(z, 2)) + 1 / (6 * F.pow(z, 3)) - 1 / (30 * F.pow(z, 5)) + 1 / (42 * F.pow(z, 7)) - 1 / (30 * F.pow(z, 9))
    return F.when(x > 0, series + reduce(lambda a, b: a + b, [1 / F.nullif(F.pow(x + i, 2), F.lit(0.0)) for i in range(_SHIFT)]))


def gamma_terms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Gamma and its first two derivatives of positive numbers, as lgamma, digamma and trigamma, inside a task."""
    rising = x[..., None] + np.arange(_SHIFT)
    z = x + _SHIFT
    logs = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    first = np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
    second = 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) - 1 / (30 * z**9)
    return logs - np.log(rising).sum(-1), first - (1 / rising).sum(-1), second + (1 / rising**2).sum(-1)


def positive_part(x: Column | str) -> Column:
    """x where it is positive, else 0; NaN counts as 0."""
    return F.greatest(F.nanvl(_num(x).cast("double"), F.lit(0.0)), F.lit(0.0))


def negative_part(x: Column | str) -> Column:
    """-x where x is negative, else 0; NaN counts as 0."""
    return positive_part(-_num(x).cast("double"))


def interpolated(x: Column | str, knots: Column | str) -> Column:
    """The value at x on the line through knots, an array of struct(x, y) by rising x; the first or last value beyond its ends."""
    x, knots = _num(x), _num(knots)
    before = F.element_at(F.filter(knots, lambda k: k["x"] <= x), -1)
    after = F.get(F.filter(knots, lambda k: k["x"] >= x), F.lit(0))
    inside = before["y"] + F.coalesce(F.try_divide(x - before["x"], after["x"] - before["x"]), F.lit(0.0)) * (after["y"] - before["y"])
    return F.when(x <= F.get(knots, F.lit(0))["x"], F.get(knots, F.lit(0))["y"]).when(x >= F.element_at(knots, -1)["x"], F.element_at(knots, -1)["y"]).otherwise(inside)


def _fold(a: Column | str, b: Column | str, term) -> Column:
    return F.aggregate(F.zip_with(_num(a), _num(b), term), F.lit(0.0), lambda t, x: t + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def l1_distance(a: Column | str, b: Column | str) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; the product of the norms is raised by 1e-9."""
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def abs_cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - F.abs(dot(a, b)) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def weighted_abs_cosine_distance(a: Column | str, b: Column | str, w: Column | str) -> Column:
    scale = lambda v: F.zip_with(_num(v), _num(w), lambda x, k: x.cast("double") * k)
    return abs_cosine_distance(scale(a), scale(b))


def kl_divergence(a: Column | str, b: Column | str) -> Column:
    """Sum of a ln(a / b) - a + b; the logarithm counts where the ratio is positive, and the rest of the term everywhere."""
    return _fold(a, b, lambda x, y: F.when(((x > 0) & (y > 0)) | ((x < 0) & (y < 0)), x * F.log(x / y)).otherwise(0.0) - x + y)
