import pytest

from pairsieve.config import DEFAULT_POLICY, default_settings, settings_from


def test_defaults():
    s = default_settings()
    assert [b.name for b in s.bands] == ["low", "grey_low", "grey_mid", "grey_high", "near_high", "high"]
    assert s.bands[-1].closed_high and s.budget("vigilancia") == 2000
    assert s.monitoring.enabled and s.monitoring.metrics["psi"]["threshold_warn"] == 0.15
    assert "freeze_calibration" in s.monitoring.actions


def test_list_form_flat_guardrails_and_no_drift():
    data = {**DEFAULT_POLICY, "bands": {"definitions": [{"name": "a", "max": 1}, {"name": "b", "min": 1}]},
            "guardrails": {"temporal_days": 30}, "monitoring": {}, "llm_review": {"enabled": False}}
    s = settings_from(data)
    assert s.guardrails.temporal_days == 30 and not s.monitoring.enabled
    assert s.budget("confirmacao") == 0 and s.band_errors()["a"].e_fp == 0.0


@pytest.mark.parametrize("bad", [
    {"a": {"min": 2, "max": 1}}, [{"name": "a"}, {"name": "a"}], [{"name": " "}],
    {"a": {"inclusive_max": True}, "b": {"inclusive_max": True}}, None,
])
def test_bad_bands(bad):
    with pytest.raises(ValueError):
        settings_from({**DEFAULT_POLICY, "bands": {"definitions": bad}})


def test_missing_error_rates_and_mode():
    s = settings_from({**DEFAULT_POLICY, "llm_review": {"enabled": True}})
    with pytest.raises(ValueError):
        s.band_errors()
    with pytest.raises(KeyError):
        s.mode("other")


def test_dimensions(spark):
    d = default_settings().dimensions(spark)
    assert d["bands"].count() == 6 and d["modes"].count() == 2 and d["error_rates"].count() == 6
