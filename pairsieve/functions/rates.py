"""Rates from confusion counts, with zero for an empty denominator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """``num / den``; ``empty`` (NULL when None) where the denominator is not positive."""
    value = F.when(den > 0, num.cast("double") / den.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def precision(tp: Column, fp: Column, empty: float | None = 0.0) -> Column:
    return ratio(tp, tp + fp, empty)


def recall(tp: Column, fn: Column, empty: float | None = 0.0) -> Column:
    return ratio(tp, tp + fn, empty)


def f_beta(tp: Column, fp: Column, fn: Column, beta: Column | float = 1.0) -> Column:
    square = beta * beta if isinstance(beta, Column) else F.lit(float(beta) * float(beta))
    top = (1.0 + square) * tp
    return ratio(top, top + square * fn + fp)
