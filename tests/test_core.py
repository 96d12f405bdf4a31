import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsieve.config import Calibration, Mode, default_settings
from pairsieve.operators import histograms as H
from pairsieve.operators import ranking as K
from pairsieve.operators.calibrate import fit_platt, load_platt, save_platt
from pairsieve.operators.guardrails import apply_guardrails
from pairsieve.operators.metrics import pareto_front
from pairsieve.operators.split import group_holdout, stratified_holdout
from pairsieve.operators.triage import selection_rank, score_decisions, triage


def test_guardrail_order(spark):
    d = dt.date
    rows = [
        (1, 8.0, 0.0, 1.0, d(2020, 1, 1), d(2021, 1, 1), False, 0, 1, 1, 1, 1),
        (2, 2.0, 0.0, 1.0, None, None, False, 0, 1, 1, 1, 1),
        (3, 7.5, 10.0, 0.5, None, None, True, 1, 0, 0, 0, 0),
        (4, 10.5, 0.0, 1.0, None, None, False, 0, 1, 1, 1, 1),
        (5, None, None, None, None, None, None, None, None, None, None, None),
    ]
    schema = ("k int, `nota final` double, diff_ano double, `NOME qtd frag iguais` double, R_DTOBITO_dt date, C_DTDIAG_dt date, "
              "dtnasc_all_zero boolean, endereco_zero int, `NOME prim frag igual` int, `NOME ult frag igual` int, `DTNASC dt iguais` int, "
              "`CODMUNRES local igual` int")
    got = {r["k"]: (r["guardrail"], r["guardrail_reason"]) for r in apply_guardrails(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("ALWAYS_NONMATCH", "temporal_filter"), 2: ("ALWAYS_NONMATCH", "nota_final_low"),
                   3: ("FORCE_REVIEW", "homonimia_risk"), 4: ("ALWAYS_MATCH", "nota_final_high"), 5: (None, None)}


def candidates(spark, n=400, seed=1):
    rng = random.Random(seed)
    bands = [b.name for b in default_settings().bands]
    rows = [(i, rng.choice([0.1, 0.3, 0.5, 0.9, rng.random()]), rng.choice(bands), rng.choice([None, None, "FORCE_REVIEW", "ALWAYS_MATCH"])) for i in range(n)]
    return spark.createDataFrame(rows, "k long, p_cal double, band string, guardrail string"), rows


def greedy(rows, mode: Mode, rates, budget):
    """The selection as a plain loop."""
    scored = []
    for k, p, band, guard in rows:
        lm, ln = (1 - p) * mode.false_positive, p * mode.false_negative
        base = "MATCH" if lm <= ln else "NONMATCH"
        evr = min(lm, ln) - (mode.review + (1 - p) * rates[band].e_fp * mode.false_positive + p * rates[band].e_fn * mode.false_negative)
        cap = (base == "MATCH" and p < mode.min_auto_match) or (base == "NONMATCH" and p > mode.max_auto_nonmatch)
        tier = 1 if guard == "FORCE_REVIEW" else 2 if cap else 3 if evr > 0 else None
        if guard not in ("ALWAYS_MATCH", "ALWAYS_NONMATCH") and tier:
            scored.append((tier, -evr, k))
    return [k for _, _, k in sorted(scored)][:budget]


@pytest.mark.parametrize("left", [70, 3])
def test_triage_equals_greedy_loop(spark, left):
    """The cut-off far inside the order and near its start."""
    df, rows = candidates(spark)
    s = default_settings()
    want = greedy(rows, s.mode("vigilancia"), s.band_errors(), left)
    got = triage(df, s, "vigilancia", "k", budget=left + 10, used=10).filter("action = 'LLM_REVIEW'")
    assert sorted(r["k"] for r in got.collect()) == sorted(want)
    ranked = selection_rank(score_decisions(df, s.mode("vigilancia"), s.band_errors()), "k").filter(f"review_rank <= {left}")
    assert [r["k"] for r in ranked.orderBy("review_rank").collect()] == want


def test_unknown_band_raises(spark):
    df = spark.createDataFrame([(1, 0.5, "nowhere")], "k long, p_cal double, band string")
    with pytest.raises(Exception, match="no review error rates"):
        triage(df, default_settings(), "vigilancia", "k").collect()


def test_rank_by_value_with_hot_ties(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice([1.0, 1.0, 1.0, -2.5, rng.random()])) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    got = {r["k"]: r["r"] for r in K.rank_by_value(df, ["g"], "v", "k", "r").collect()}
    for g in "ab":
        ordered = sorted((v, k) for k, gg, v in rows if gg == g)
        assert [got[k] for _, k in ordered] == list(range(1, len(ordered) + 1))


def test_quantiles_and_auc(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=500), 2)
    y = (x + rng.normal(size=500) > 0.5).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    got = H.exact_quantiles(df, "x", {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    assert np.allclose([got["a"], got["b"], got["c"]], np.percentile(x, [10, 50, 99]))
    pairs = (x[y == 1][:, None] > x[y == 0]).sum() + 0.5 * (x[y == 1][:, None] == x[y == 0]).sum()
    quality = H.ranking_quality(df, "x", "y").first()
    assert quality["roc_auc"] == pytest.approx(pairs / ((y == 1).sum() * (y == 0).sum()))
    assert H.ranking_quality(df.filter("y = 0"), "x", "y").first()["roc_auc"] is None


def test_pareto_against_brute_force(spark):
    rng = random.Random(9)
    points = [(i, rng.randrange(12) / 12, rng.randrange(12) / 12) for i in range(80)]
    want = {i for i, p, r in points if not any(q >= p and s >= r and (q > p or s > r) for _, q, s in points)}
    df = spark.createDataFrame(points, "i int, precision double, recall double")
    assert {r["i"] for r in pareto_front(df).collect()} == want


def test_platt_matches_newton_and_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 12, 300)
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-(x - 6)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    model = fit_platt(df, "x", "y", Calibration())[()]
    w = np.array([0.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        g = np.array([(p - y).sum(), ((p - y) * x).sum() + 1e-3 * w[1]])
        v = p * (1 - p)
        w = w - np.linalg.solve([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-3]], g)
    assert np.allclose([model.intercept, model.slope], w, atol=1e-6) and model.converged
    save_platt(spark, model, str(tmp_path / "m"))
    assert load_platt(spark, str(tmp_path / "m")).slope == pytest.approx(model.slope)
    with pytest.raises(ValueError):
        fit_platt(df.limit(3), "x", "y")


def test_splits(spark):
    df = spark.range(40).select(F.col("id").alias("k"), (F.col("id") < 10).cast("int").alias("y"), (F.col("id") % 12).alias("g"))
    sizes = {(r["y"], r["split"]): r["count"] for r in stratified_holdout(df, "y", "k", 0.3, 42).groupBy("y", "split").count().collect()}
    assert sizes == {(0, "test"): 9, (0, "train"): 21, (1, "test"): 3, (1, "train"): 7}
    sides = group_holdout(df, "y", "g", 0.3, 42).groupBy("g").agg(F.countDistinct("split").alias("n"))
    assert sides.filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        stratified_holdout(df, "y", "k", 1.5)
    with pytest.raises(Exception, match="two rows"):
        stratified_holdout(df.filter("k <= 10"), "y", "k").collect()
