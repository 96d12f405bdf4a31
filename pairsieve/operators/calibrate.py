"""Match probabilities from the comparator score.

The logistic fits are driver loops over an aggregate.  The pair table is reduced once to
``(group, score, n, pos)``; every Newton step is one aggregation of that table that returns
five sums per group, and the 2x2 system is solved on the driver.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pairsieve.config import Anchors, Calibration
from pairsieve.functions.values import clip, number, ref
from pairsieve.operators.histograms import histogram


@dataclass(frozen=True)
class Platt:
    intercept: float
    slope: float
    converged: bool = True
    steps: int = 0


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def logit(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def stub_probability(score: Column, calibration: Calibration) -> Column:
    """A tenth of the score, clipped."""
    return clip(score / 10.0, calibration.clip_min, calibration.clip_max)


def platt_probability(score: Column, model: Platt, calibration: Calibration) -> Column:
    z = F.lit(model.intercept) + F.lit(model.slope) * score
    return clip(sigmoid(z), calibration.clip_min, calibration.clip_max)


def _newton_sums(hist: DataFrame, groups: list[str], state: DataFrame | None, start) -> list:
    """The five sums of one Newton step, per group."""
    if groups:
        rows = hist.join(F.broadcast(state), groups)
        w0, w1 = F.col("w0"), F.col("w1")
    else:
        rows = hist
        w0, w1 = F.lit(start[0]), F.lit(start[1])
    x, n = F.col("value"), F.col("n")
    p = sigmoid(w0 + w1 * x)
    miss, weight = n * p - F.col("pos"), n * p * (1.0 - p)
    return rows.groupBy(*groups).agg(
        F.sum(miss).alias("g0"),
        F.sum(miss * x).alias("g1"),
        F.sum(weight).alias("h00"),
        F.sum(weight * x).alias("h01"),
        F.sum(weight * x * x).alias("h11"),
    ).collect()


def _solve(row, slope: float, l2: float) -> tuple[float, float]:
    g0, g1 = row["g0"], row["g1"] + l2 * slope
    a, b, d = row["h00"], row["h01"], row["h11"] + l2
    det = a * d - b * b
    if det == 0.0 or not math.isfinite(det):
        raise RuntimeError("the calibration's Hessian is singular")
    return (d * g0 - b * g1) / det, (a * g1 - b * g0) / det


def fit_platt(
    df: DataFrame, score: str, label: str, calibration: Calibration = Calibration(),
    groups: list[str] | None = None,
) -> dict[tuple, Platt]:
    """Two-parameter logistic fits, one per group (key ``()`` without groups).

    The number of groups is the number of evaluation runs or bands, so the parameters fit the
    driver; all groups share each aggregation.
    """
    groups = groups or []
    hist = histogram(df, score, groups, {"pos": F.sum(ref(label).cast("double"))}).persist()
    try:
        spark = df.sparkSession
        sizes = hist.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()
        state: dict[tuple, list] = {}
        for row in sizes:
            if row["n"] < 10:
                raise ValueError("at least 10 rows are needed to fit a calibration")
            base = (row["pos"] + 0.5) / (row["n"] + 1.0)
            state[tuple(row[g] for g in groups)] = [math.log(base / (1.0 - base)), 0.0, False, 0]
        if not state:
            raise ValueError("at least 10 rows are needed to fit a calibration")
        for _ in range(calibration.max_iter):
            open_keys = [k for k, s in state.items() if not s[2]]
            if not open_keys:
                break
            table = None
            if groups:
                fields = [f"{g} {hist.schema[g].dataType.simpleString()}" for g in groups]
                rows = [(*k, state[k][0], state[k][1]) for k in open_keys]
                table = spark.createDataFrame(rows, ", ".join([*fields, "w0 double", "w1 double"]))
            first = state[open_keys[0]]
            for row in _newton_sums(hist, groups, table, (first[0], first[1])):
                s = state[tuple(row[g] for g in groups)]
                step0, step1 = _solve(row, s[1], calibration.l2)
                s[0], s[1], s[3] = s[0] - step0, s[1] - step1, s[3] + 1
                s[2] = max(abs(step0), abs(step1)) < calibration.tol
        return {k: Platt(*s) for k, s in state.items()}
    finally:
        hist.unpersist()


def fit_anchors(
    df: DataFrame, anchors: Anchors, score: str = "nota final", max_iter: int = 60,
    tol: float = 1e-12,
) -> Platt:
    """Label-free fit: mean probability 0.98 on the high anchor and 0.001 on the low one.

    Newton's method on the two mean equations, again over the score histogram.
    """
    hist = histogram(df, score).withColumn(
        "anchor",
        F.when(F.col("value") >= anchors.high_score, 1).when(F.col("value") < anchors.low_score, 0),
    ).filter("anchor is not null").persist()
    try:
        sizes = {r["anchor"]: r["n"] for r in hist.groupBy("anchor").agg(F.sum("n").alias("n")).collect()}
        if sizes.get(1, 0) < anchors.high_rows or sizes.get(0, 0) < anchors.low_rows:
            raise ValueError(f"too few anchor rows: {sizes}")
        goal = {1: anchors.high_mean, 0: anchors.low_mean}
        middle = (anchors.high_score + anchors.low_score) / 2.0
        slope = 1.0
        intercept = -slope * middle
        for step in range(max_iter):
            x, n = F.col("value"), F.col("n")
            p = sigmoid(F.lit(intercept) + F.lit(slope) * x)
            w = n * p * (1.0 - p)
            rows = hist.groupBy("anchor").agg(
                F.sum(n * p).alias("p"), F.sum(w).alias("d0"), F.sum(w * x).alias("d1")
            ).collect()
            # Work on the log-odds of the means: close to linear in the parameters.
            eq, jac = [], []
            for row in sorted(rows, key=lambda r: -r["anchor"]):
                size = sizes[row["anchor"]]
                mean = min(max(row["p"] / size, 1e-300), 1.0 - 1e-16)
                scale = 1.0 / (mean * (1.0 - mean))
                target = goal[row["anchor"]]
                eq.append(math.log(mean / (1.0 - mean)) - math.log(target / (1.0 - target)))
                jac.append((row["d0"] / size * scale, row["d1"] / size * scale))
            det = jac[0][0] * jac[1][1] - jac[0][1] * jac[1][0]
            if det == 0.0:
                raise RuntimeError("the anchor equations are singular")
            move0 = (jac[1][1] * eq[0] - jac[0][1] * eq[1]) / det
            move1 = (jac[0][0] * eq[1] - jac[1][0] * eq[0]) / det
            intercept, slope = intercept - move0, slope - move1
            if max(abs(move0), abs(move1)) < tol:
                return Platt(intercept, slope, True, step + 1)
        return Platt(intercept, slope, False, max_iter)
    finally:
        hist.unpersist()


def bounded_step(previous: Platt, new: Platt, limit: float = 0.5) -> Platt:
    """Keep a window's parameters within ``limit`` of the previous window's."""
    def move(old: float, value: float) -> float:
        return min(max(value, old - limit), old + limit)

    return Platt(move(previous.intercept, new.intercept), move(previous.slope, new.slope),
                 new.converged, new.steps)


def model_frame(spark, model: Platt) -> DataFrame:
    return spark.createDataFrame(
        [("platt", model.intercept, model.slope)], "method string, intercept double, slope double"
    )


def save_platt(spark, model: Platt, path: str) -> None:
    model_frame(spark, model).coalesce(1).write.mode("overwrite").json(path)


def load_platt(spark, path: str) -> Platt:
    rows = spark.read.schema("method string, intercept double, slope double").json(path).take(1)
    if not rows or rows[0]["method"] != "platt":
        raise ValueError("unsupported calibration method in file")
    return Platt(rows[0]["intercept"], rows[0]["slope"])


def platt_json(model: Platt) -> str:
    return json.dumps({"intercept": model.intercept, "method": "platt", "slope": model.slope})


def with_probability(
    df: DataFrame, method: str = "stub", calibration: Calibration = Calibration(),
    model: Platt | None = None, score: str = "nota final", out: str = "p_cal",
) -> DataFrame:
    """Add ``p_cal`` by the stub rule or by a fitted logistic."""
    value = number(df, score)
    if method == "stub":
        return df.withColumn(out, stub_probability(value, calibration))
    if method == "platt":
        if model is None:
            raise ValueError("a fitted model is required")
        return df.withColumn(out, platt_probability(value, model, calibration))
    raise ValueError("method must be 'stub' or 'platt'")
