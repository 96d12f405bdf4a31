"""A cross-section of the registered queries against SQL; ``ORACLE=all`` runs every one."""

import os

import pytest

from oracle import compare, connect

SMALL = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SOME = ["triage_action_counts", "review_order", "pair_features", "threshold_sweep", "ranking_quality", "pareto_front",
        "stratified_folds", "group_holdout", "psi_drift", "ks_drift", "group_metrics", "consensus_live", "citation_contexts",
        "uncited_blocks", "nearest_neighbours", "window_budgets", "quantile_bins"]


def names():
    import __spark_entry__ as entry

    return list(entry.oracle_sql()) if os.environ.get("ORACLE") == "all" else SOME


@pytest.mark.parametrize("name", names())
def test_query_agrees(spark, name):
    import __spark_entry__ as entry

    assert compare(entry.queries()[name](spark, SMALL), connect(SMALL), entry.oracle_sql()[name]) == ""


def test_catalogue():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120
