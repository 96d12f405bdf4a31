"""The decision plan: scan, features, band, probability, guardrails, triage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pairsieve import columns as C
from pairsieve.config import Settings
from pairsieve.functions.values import ref
from pairsieve.operators.bands import assign_bands
from pairsieve.operators.calibrate import Platt, fit_platt, load_platt, save_platt, with_probability
from pairsieve.operators.features import pair_features
from pairsieve.operators.guardrails import apply_guardrails
from pairsieve.operators.metrics import check_binary
from pairsieve.operators.ranking import _null_safe_join
from pairsieve.operators.triage import triage
from pairsieve.session import materialise


def prepare(
    pairs: DataFrame, settings: Settings, birth_distance: bool = True, guardrails: bool = True,
    risk_rules: bool = False,
) -> DataFrame:
    """Features, band and guardrail: one projection over the scan."""
    wide = assign_bands(pair_features(pairs, birth_distance), settings)
    if guardrails:
        return apply_guardrails(wide, settings.guardrails, risk_rules)
    empty = F.lit(None).cast("string")
    return wide.withColumns({"guardrail": empty, "guardrail_reason": empty})


@dataclass
class Decided:
    pairs: DataFrame
    method: str
    model: Platt | None = None


def decide(
    pairs: DataFrame, settings: Settings, mode: str, key: str, method: str = "fit_platt",
    used: int = 0, model_path: str | None = None, save_to: str | None = None, check: bool = True,
    **options,
) -> Decided:
    """Decide every candidate pair.

    ``method``: ``stub``, ``fit_platt``, ``load_platt``, ``fit_forest`` or ``load_forest``.
    """
    spark = pairs.sparkSession
    ready = prepare(pairs, settings, **options)
    if check:
        check_binary(ready, C.TARGET, C.SCORE, "band")
    model = None
    if method == "stub":
        ready = with_probability(ready, "stub", settings.calibration)
    elif method in ("fit_platt", "load_platt"):
        if method == "fit_platt":
            model = fit_platt(ready, C.SCORE, C.TARGET, settings.calibration)[()]
            if save_to:
                save_platt(spark, model, save_to)
        else:
            if model_path is None:
                raise ValueError("model_path is required")
            model = load_platt(spark, model_path)
        ready = with_probability(ready, "platt", settings.calibration, model)
    elif method in ("fit_forest", "load_forest"):
        from pairsieve.operators.models import CalibratedForest

        if method == "fit_forest":
            forest = CalibratedForest().fit(ready, key)
            if save_to:
                forest.save(save_to)
        else:
            if model_path is None:
                raise ValueError("model_path is required")
            forest = CalibratedForest.load(spark, model_path)
        # a thousand trees a row: each row goes through them once, not once for every use of its probability
        found = materialise(forest.score(ready, "p_cal").select(ref(key), "p_cal"))
        ready = _null_safe_join(ready, found, [key])
    else:
        raise ValueError("method must be stub, fit_platt, load_platt, fit_forest or load_forest")
    return Decided(triage(ready, settings, mode, key, used), method, model)


def run_summary(decided: DataFrame, method: str = "stub") -> DataFrame:
    """Rows, requests and counts per action and guardrail, as one long table."""
    def counts(column: str, kind: str) -> DataFrame:
        return decided.groupBy(F.lit(kind).alias("kind"),
                               F.coalesce(ref(column), F.lit("none")).alias("name")).agg(
            F.count("*").alias("n_rows"))

    requested = decided.agg(
        F.lit("total").alias("kind"), F.lit("review_requested").alias("name"),
        F.sum(F.col("review_requested").cast("bigint")).alias("n_rows"),
    )
    return counts("action", "action").unionByName(counts("guardrail", "guardrail")).unionByName(requested)


__all__ = ["prepare", "decide", "run_summary", "Decided"]
