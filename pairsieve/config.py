"""Validated settings, read from a mapping or a YAML/JSON file on the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pairsieve.session import small_table


@dataclass(frozen=True)
class Band:
    name: str
    low: float | None = None
    high: float | None = None
    closed_high: bool = False


@dataclass(frozen=True)
class Mode:
    false_positive: float
    false_negative: float
    review: float
    budget: int
    min_auto_match: float | None = None
    max_auto_nonmatch: float | None = None


@dataclass(frozen=True)
class ErrorRate:
    e_fp: float
    e_fn: float


@dataclass(frozen=True)
class GuardrailLimits:
    temporal_days: int = 180
    always_match: float = 10.0
    always_nonmatch: float = 3.0
    namesake_score: float = 7.0
    namesake_years: float = 5.0


@dataclass(frozen=True)
class Calibration:
    clip_min: float = 1e-6
    clip_max: float = 0.999999
    l2: float = 1e-3
    max_iter: int = 100
    tol: float = 1e-10


@dataclass(frozen=True)
class Evaluation:
    test_size: float = 0.3
    seeds: tuple[int, ...] = (42,)
    split_by: str = "row"
    group_stratify: bool = True


@dataclass(frozen=True)
class Monitoring:
    enabled: bool = False
    metrics: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    slices: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Anchors:
    high_score: float = 9.0
    high_mean: float = 0.98
    high_rows: int = 50
    low_score: float = 5.0
    low_mean: float = 0.001
    low_rows: int = 200


@dataclass(frozen=True)
class Settings:
    version: str
    bands: tuple[Band, ...]
    modes: Mapping[str, Mode]
    review_enabled: bool
    error_rates: Mapping[str, ErrorRate]
    guardrails: GuardrailLimits = GuardrailLimits()
    calibration: Calibration = Calibration()
    evaluation: Evaluation = Evaluation()
    monitoring: Monitoring = Monitoring()
    anchors: Anchors = Anchors()
    conflict_margin: float = 0.03

    def mode(self, name: str) -> Mode:
        if name not in self.modes:
            raise KeyError(f"unknown mode {name!r}; known: {', '.join(sorted(self.modes))}")
        return self.modes[name]

    def budget(self, mode: str) -> int:
        """Reviews allowed per window; none while review is switched off."""
        return self.mode(mode).budget if self.review_enabled else 0

    def band_errors(self) -> dict[str, ErrorRate]:
        """Error rates of every band, zero while review is switched off."""
        if not self.review_enabled:
            return {b.name: ErrorRate(0.0, 0.0) for b in self.bands}
        lost = [b.name for b in self.bands if b.name not in self.error_rates]
        if lost:
            raise ValueError(f"no review error rates for bands: {', '.join(lost)}")
        return {b.name: self.error_rates[b.name] for b in self.bands}

    def dimensions(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The three small tables behind the settings: bands, modes, error rates."""
        bands = [
            (i, b.name, b.low, b.high, b.closed_high) for i, b in enumerate(self.bands)
        ]
        modes = [
            (n, m.false_positive, m.false_negative, m.review, m.min_auto_match,
             m.max_auto_nonmatch, self.budget(n))
            for n, m in self.modes.items()
        ]
        rates = [(n, r.e_fp, r.e_fn) for n, r in self.band_errors().items()]
        return {
            "bands": small_table(
                spark, bands, "position int, band string, low double, high double, closed_high boolean"
            ),
            "modes": small_table(
                spark, modes,
                "mode string, cost_fp double, cost_fn double, cost_review double, "
                "min_auto_match double, max_auto_nonmatch double, budget int",
            ),
            "error_rates": small_table(spark, rates, "band string, e_fp double, e_fn double"),
        }


def _section(data: Mapping[str, Any], *path: str) -> Mapping[str, Any]:
    for step in path:
        data = data.get(step) or {}
        if not isinstance(data, Mapping):
            raise TypeError(f"{'.'.join(path)} must be a mapping")
    return data


def _given(data: Mapping[str, Any], key: str, default: Any) -> Any:
    value = data.get(key)
    return default if value is None else value


def _optional(value: Any) -> float | None:
    return None if value is None else float(value)


def _bands(data: Mapping[str, Any]) -> tuple[Band, ...]:
    raw = _section(data, "bands").get("definitions")
    if not raw:
        raise ValueError("bands.definitions is required")
    if isinstance(raw, Mapping):
        items = [(str(name), body or {}) for name, body in raw.items()]
    elif isinstance(raw, list):
        items = [(str(body.get("name") or ""), body) for body in raw]
    else:
        raise TypeError("bands.definitions must be a mapping or a list")
    bands = []
    for name, body in items:
        name = name.strip()
        if not name:
            raise ValueError("a band needs a name")
        band = Band(name, _optional(body.get("min")), _optional(body.get("max")),
                    bool(body.get("inclusive_max", False)))
        if band.low is not None and band.high is not None and band.low >= band.high:
            raise ValueError(f"band {name!r} is empty: {band.low} >= {band.high}")
        bands.append(band)
    names = [b.name for b in bands]
    if len(set(names)) != len(names):
        raise ValueError("band names must be unique")
    if sum(b.closed_high for b in bands) > 1:
        raise ValueError("only one band may include its upper limit")
    return tuple(bands)


def _modes(data: Mapping[str, Any]) -> dict[str, Mode]:
    raw = _section(data, "decision_policy", "modes")
    if not raw:
        raise ValueError("decision_policy.modes is required")
    modes = {}
    for name, body in raw.items():
        costs, auto, budget = (_section(body, k) for k in ("costs", "auto", "llm_budget"))
        modes[str(name)] = Mode(
            false_positive=float(costs["false_positive"]),
            false_negative=float(costs["false_negative"]),
            review=float(costs["llm_review"]),
            budget=int(budget["max_calls_per_window"]),
            min_auto_match=_optional(auto.get("min_auto_match_threshold")),
            max_auto_nonmatch=_optional(auto.get("max_auto_nonmatch_threshold")),
        )
    return modes


def _guardrails(data: Mapping[str, Any]) -> GuardrailLimits:
    outer = _section(data, "guardrails")
    body = _section(outer, "params") or outer
    return GuardrailLimits(
        temporal_days=int(_given(body, "temporal_days", 180)),
        always_match=float(_given(body, "nota_always_match", 10.0)),
        always_nonmatch=float(_given(body, "nota_always_nonmatch", 3.0)),
        namesake_score=float(_given(body, "homonimia_min_nota", 7.0)),
        namesake_years=float(_given(body, "homonimia_year_gap", 5.0)),
    )


def _calibration(data: Mapping[str, Any]) -> Calibration:
    body, platt = _section(data, "calibration"), _section(data, "calibration", "platt")
    return Calibration(
        clip_min=float(_given(body, "clip_min", 1e-6)),
        clip_max=float(_given(body, "clip_max", 0.999999)),
        l2=float(_given(platt, "l2", 1e-3)),
        max_iter=int(_given(platt, "max_iter", 100)),
        tol=float(_given(platt, "tol", 1e-10)),
    )


def _evaluation(data: Mapping[str, Any]) -> Evaluation:
    body = _section(data, "evaluation")
    seeds = body.get("seeds", (42,))
    seeds = (seeds,) if isinstance(seeds, int) else seeds
    if not isinstance(seeds, (list, tuple)) or not seeds:
        raise ValueError("evaluation.seeds must be a whole number or a non-empty list")
    size = float(body.get("test_size", 0.3))
    if not 0.0 < size < 1.0:
        raise ValueError("evaluation.test_size must lie between 0 and 1")
    return Evaluation(
        size, tuple(int(s) for s in seeds), str(body.get("split_by", "row")).strip().lower(),
        bool(body.get("group_stratify", True)),
    )


def _monitoring(data: Mapping[str, Any]) -> Monitoring:
    outer, drift = _section(data, "monitoring"), _section(data, "monitoring", "drift")
    if not drift.get("enabled", False):
        return Monitoring()
    actions = drift.get("actions_on_critical_drift") or outer.get("actions_on_critical_drift") or []
    return Monitoring(
        True,
        {str(k): {str(n): float(v) for n, v in _section(drift, "metrics", k).items()}
         for k in _section(drift, "metrics")},
        tuple(str(x) for x in drift.get("slices") or []),
        tuple(str(x) for x in drift.get("monitored_fields") or []),
        tuple(str(x) for x in actions),
    )


def settings_from(data: Mapping[str, Any]) -> Settings:
    """Validate a nested mapping and turn it into ``Settings``."""
    if not isinstance(data, Mapping):
        raise TypeError("the configuration must be a mapping")
    version = str(data.get("version", "")).strip()
    if not version:
        raise ValueError("version is required")
    review = _section(data, "llm_review")
    rates = _section(review, "reliability", "error_rates_by_band")
    high, low = _section(data, "anchors", "pos_anchor"), _section(data, "anchors", "neg_anchor")
    return Settings(
        version=version,
        bands=_bands(data),
        modes=_modes(data),
        review_enabled=bool(review.get("enabled", False)),
        error_rates={str(b): ErrorRate(float(r["e_fp"]), float(r["e_fn"])) for b, r in rates.items()},
        guardrails=_guardrails(data),
        calibration=_calibration(data),
        evaluation=_evaluation(data),
        monitoring=_monitoring(data),
        anchors=Anchors(
            high_mean=float(high.get("target_mean_probability", 0.98)),
            high_rows=int(high.get("min_count", 50)),
            low_mean=float(low.get("target_mean_probability", 0.001)),
            low_rows=int(low.get("min_count", 200)),
        ),
        conflict_margin=float(_section(data, "consistency").get("conflict_margin_delta", 0.03)),
    )


def load_settings(path: str | Path) -> Settings:
    """Read a YAML or JSON configuration file."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return settings_from(json.loads(text))
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs the yaml package; pass JSON instead") from missing
    return settings_from(yaml.safe_load(text) or {})


# The published default policy (bands, costs, limits, budgets, error rates).
DEFAULT_POLICY: dict[str, Any] = {
    "version": 3,
    "bands": {
        "definitions": {
            "low": {"min": 0.0, "max": 5.0},
            "grey_low": {"min": 5.0, "max": 6.0},
            "grey_mid": {"min": 6.0, "max": 7.0},
            "grey_high": {"min": 7.0, "max": 8.0},
            "near_high": {"min": 8.0, "max": 9.0},
            "high": {"min": 9.0, "max": 999.0, "inclusive_max": True},
        }
    },
    "decision_policy": {
        "modes": {
            "vigilancia": {
                "costs": {"false_positive": 10.0, "false_negative": 50.0, "llm_review": 0.25},
                "auto": {"min_auto_match_threshold": 0.85, "max_auto_nonmatch_threshold": 0.15},
                "llm_budget": {"max_calls_per_window": 2000},
            },
            "confirmacao": {
                "costs": {"false_positive": 100.0, "false_negative": 20.0, "llm_review": 0.25},
                "auto": {"min_auto_match_threshold": 0.95, "max_auto_nonmatch_threshold": 0.10},
                "llm_budget": {"max_calls_per_window": 1000},
            },
        }
    },
    "llm_review": {
        "enabled": True,
        "reliability": {
            "error_rates_by_band": {
                "low": {"e_fp": 0.10, "e_fn": 0.15},
                "grey_low": {"e_fp": 0.08, "e_fn": 0.12},
                "grey_mid": {"e_fp": 0.06, "e_fn": 0.10},
                "grey_high": {"e_fp": 0.04, "e_fn": 0.08},
                "near_high": {"e_fp": 0.02, "e_fn": 0.06},
                "high": {"e_fp": 0.01, "e_fn": 0.03},
            }
        },
    },
    "evaluation": {"test_size": 0.3, "seeds": [42, 123, 456, 789, 2024], "split_by": "row"},
    "monitoring": {
        "drift": {
            "enabled": True,
            "metrics": {
                "psi": {"threshold_warn": 0.15, "threshold_critical": 0.25},
                "ks": {"threshold_warn": 0.10, "threshold_critical": 0.20},
            },
            "slices": ["band", "step"],
            "monitored_fields": [
                "nota_final", "p_base", "p_cal", "nome_score_total", "mae_score_total",
                "dtnasc_score_total", "endereco_score_total", "municipio_score", "mae_missing",
            ],
        },
        "actions_on_critical_drift": [
            "tighten_auto_thresholds", "increase_llm_budget_if_possible", "emit_alert",
            "freeze_calibration",
        ],
    },
}


def default_settings() -> Settings:
    return settings_from(DEFAULT_POLICY)
