"""The evaluation entries without SQL run every mode and seed of the settings."""

from pairsieve.plans import queries_metrics as Q
from pairsieve.plans.registry import ENTRIES

SMALL = "/root/testdata/sf0.001"


def test_platt_evaluation_runs_all(spark):
    rows = ENTRIES["platt_evaluation"].run(spark, SMALL).select("mode", "seed").collect()
    assert sorted(map(tuple, rows)) == sorted((m, s) for m in Q.SETTINGS.modes for s in Q.SETTINGS.evaluation.seeds)


def test_cost_ratios_run_all(spark):
    rows = ENTRIES["cost_ratio_sensitivity"].run(spark, SMALL).select("mode", "fp_fn_ratio", "n_runs").collect()
    assert len(rows) == len(Q.SETTINGS.modes) * len(Q.RATIOS) and {r.n_runs for r in rows} == {5}
