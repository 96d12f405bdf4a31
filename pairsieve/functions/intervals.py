"""Intervals and 2x2 tests as column expressions over aggregated counts."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def z_value(alpha: float = 0.05) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def wilson(successes: Column, trials: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson bounds of a rate; NULL without trials or with impossible counts."""
    valid = (trials > 0) & (successes >= 0) & (successes <= trials)
    n = trials.cast("double")
    return _wilson(successes.cast("double") / n, n, z_value(alpha), valid)


def wilson_of_rate(rate: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The variant over a given rate: (0, 1) without trials."""
    low, high = _wilson(rate, trials.cast("double"), z, trials > 0)
    return F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(1.0))


def _wilson(p: Column, n: Column, z: float, valid: Column) -> tuple[Column, Column]:
    square = z * z
    denominator = 1.0 + square / n
    centre = p + square / (2.0 * n)
    half = z * F.sqrt((p * (1.0 - p) + square / (4.0 * n)) / n)
    low, high = (centre - half) / denominator, (centre + half) / denominator
    return (F.when(valid, F.greatest(F.lit(0.0), low)), F.when(valid, F.least(F.lit(1.0), high)))


def odds_ratio(a: Column, b: Column, c: Column, d: Column, alpha: float = 0.05) -> tuple[Column, Column, Column]:
    """Odds ratio with its log interval; half a count is added everywhere if a cell is zero."""
    empty = (a == 0) | (b == 0) | (c == 0) | (d == 0)
    a, b, c, d = (x.cast("double") + F.when(empty, 0.5).otherwise(0.0) for x in (a, b, c, d))
    value = (a * d) / (b * c)
    spread = z_value(alpha) * F.sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)
    return value, F.exp(F.log(value) - spread), F.exp(F.log(value) + spread)


def rate_difference(
    p1: Column, n1: Column, p2: Column, n2: Column, alpha: float = 0.05
) -> tuple[Column, Column, Column]:
    """Difference of two rates, bounded by the Wilson bounds of both."""
    low1, high1 = wilson(F.bround(p1 * n1, 0), n1, alpha)
    low2, high2 = wilson(F.bround(p2 * n2, 0), n2, alpha)
    valid = (n1 > 0) & (n2 > 0)
    return F.when(valid, p1 - p2), F.when(valid, low1 - high2), F.when(valid, high1 - low2)


def chi_square(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """2x2 statistic without correction, and the smallest expected cell."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    rows, cols = (a + b, c + d), (a + c, b + d)
    product = rows[0] * rows[1] * cols[0] * cols[1]
    cross = a * d - b * c
    statistic = F.when(product > 0, n * cross * cross / product)
    smallest = F.least(*[F.try_divide(r * k, n) for r in rows for k in cols])
    return statistic, smallest


# The two functions below run on aggregated 2x2 rows only.  They are built on use, so that the
# workers receive them by value and need no installed package.


def chi_square_p(statistic: Column) -> Column:
    """Upper tail with one degree of freedom."""

    @F.pandas_udf(T.DoubleType())
    def tail(values: pd.Series) -> pd.Series:
        from math import erfc, sqrt

        return values.map(lambda x: erfc(sqrt(x / 2.0)), na_action="ignore").astype("float64")

    return tail(statistic)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact test: total probability of the tables no more likely than the observed."""

    @F.pandas_udf(T.DoubleType())
    def exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        from math import lgamma

        def log_choose(n, k):
            return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

        def one(w, x, y, z):
            if pd.isna(w):
                return np.nan
            first, second, column = int(w + x), int(y + z), int(w + y)
            cells = range(max(0, column - second), min(first, column) + 1)
            logs = np.array([log_choose(first, i) + log_choose(second, column - i) for i in cells])
            logs -= log_choose(first + second, column)
            seen = logs[int(w) - cells.start]
            return float(min(1.0, np.exp(logs[logs <= seen + 1e-7]).sum()))

        return pd.Series([one(*row) for row in zip(a, b, c, d)], index=a.index, dtype="float64")

    return exact(a, b, c, d)
