"""Registered queries: bands, probabilities, guardrails, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsieve.config import default_settings
from pairsieve.operators.bands import assign_bands, assign_bands_by_join, sample_band
from pairsieve.operators.calibrate import with_probability
from pairsieve.operators.triage import (
    action_counts, consistent_per_left, score_decisions, selection_rank, triage,
)
from pairsieve.plans.registry import register
from pairsieve.plans.run import prepare, run_summary
from pairsieve.plans.views import BAND_SQL, FEATURES_SQL, GUARD_SQL, PAIRS_SQL, pairs, triage_sql

BUDGET = 500
SETTINGS = default_settings()


def ready(spark, sf_dir):
    return with_probability(prepare(pairs(spark, sf_dir), SETTINGS), "stub", SETTINGS.calibration)


def decided(spark, sf_dir, budget: int = BUDGET):
    return triage(ready(spark, sf_dir), SETTINGS, "vigilancia", "k", budget=budget)


@register("triage_action_counts", f"""WITH {GUARD_SQL}, {triage_sql()}
SELECT band, action, COUNT(*) AS n_rows, CAST(SUM(CASE WHEN review_requested THEN 1 ELSE 0 END) AS BIGINT)
  AS review_requested, CAST(SUM(k) AS BIGINT) AS key_sum FROM decided GROUP BY band, action""")
def triage_action_counts(spark, sf_dir):
    rows = decided(spark, sf_dir)
    return rows.groupBy("band", "action").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.col("review_requested").cast("bigint")).alias("review_requested"),
        F.sum("k").alias("key_sum"),
    )


@register("band_counts", f"""WITH pairs AS ({PAIRS_SQL})
SELECT {BAND_SQL} AS band, COUNT(*) AS n_rows,
  CAST(SUM(CASE WHEN par IN (1, 2) THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM pairs GROUP BY 1""")
def band_counts(spark, sf_dir):
    banded = assign_bands(pairs(spark, sf_dir), SETTINGS)
    return banded.groupBy("band").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.col("PAR").isin(1, 2).cast("bigint")).alias("positives"),
    )


@register("band_table_join", f"""WITH pairs AS ({PAIRS_SQL})
SELECT k, {BAND_SQL} AS band FROM pairs""")
def band_table_join(spark, sf_dir):
    bands = SETTINGS.dimensions(spark)["bands"]
    return assign_bands_by_join(pairs(spark, sf_dir), bands).select("k", "band")


@register("sample_band_counts", f"""WITH pairs AS ({PAIRS_SQL})
SELECT CASE WHEN nota >= 9 THEN 'high' WHEN nota >= 7 THEN 'near_high' WHEN nota >= 5 THEN 'grey_mid'
  WHEN nota >= 3 THEN 'grey_low' ELSE 'low' END AS band, COUNT(*) AS n_rows FROM pairs GROUP BY 1""")
def sample_band_counts(spark, sf_dir):
    score = F.col("`nota final`")
    return pairs(spark, sf_dir).groupBy(sample_band(score).alias("band")).agg(
        F.count("*").alias("n_rows")
    )


@register("stub_probability", f"""WITH pairs AS ({PAIRS_SQL})
SELECT k, ROUND(LEAST(GREATEST(nota / 10, 0.000001E0), 0.999999E0), 6) AS p_cal FROM pairs""")
def stub_probability(spark, sf_dir):
    scored = with_probability(pairs(spark, sf_dir), "stub", SETTINGS.calibration)
    return scored.select("k", F.round("p_cal", 6).alias("p_cal"))


@register("guardrail_rows", f"""WITH {GUARD_SQL} SELECT k, guardrail, guardrail_reason FROM labelled""")
def guardrail_rows(spark, sf_dir):
    return prepare(pairs(spark, sf_dir), SETTINGS).select("k", "guardrail", "guardrail_reason")


@register("risk_rule_counts", f"""WITH {GUARD_SQL}
SELECT reason, COUNT(*) AS n_rows FROM (SELECT COALESCE(guardrail_reason,
  CASE WHEN band IN ('grey_low', 'grey_mid', 'grey_high') AND mae_missing = 1 THEN 'grey_mother_missing'
       WHEN nome_score_total < 0.25E0 AND dtnasc_score_total < 0.25E0 THEN 'low_name_and_low_dob' END) AS reason
  FROM labelled) t GROUP BY reason""")
def risk_rule_counts(spark, sf_dir):
    guarded = prepare(pairs(spark, sf_dir), SETTINGS, risk_rules=True)
    return guarded.groupBy(F.col("guardrail_reason").alias("reason")).agg(F.count("*").alias("n_rows"))


@register("expected_losses", f"""WITH {GUARD_SQL}, {triage_sql()}
SELECT k, base_choice, ROUND(base_loss, 6) AS base_loss, ROUND(loss_llm, 6) AS loss_llm, ROUND(evr, 6) AS evr,
  review_requested, tier FROM tiered""")
def expected_losses(spark, sf_dir):
    scored = score_decisions(ready(spark, sf_dir), SETTINGS.mode("vigilancia"), SETTINGS.band_errors())
    return scored.select(
        "k", "base_choice", *[F.round(c, 6).alias(c) for c in ("base_loss", "loss_llm", "evr")],
        "review_requested", "tier",
    )


@register("review_selection", f"""WITH {GUARD_SQL}, {triage_sql()}
SELECT k, band, tier, action FROM decided WHERE action = 'LLM_REVIEW'""")
def review_selection(spark, sf_dir):
    return decided(spark, sf_dir).filter("action = 'LLM_REVIEW'").select("k", "band", "tier", "action")


@register("review_order", f"""WITH {GUARD_SQL}, {triage_sql()}
SELECT k, review_rank FROM picked""")
def review_order_rows(spark, sf_dir):
    scored = score_decisions(ready(spark, sf_dir), SETTINGS.mode("vigilancia"), SETTINGS.band_errors())
    return selection_rank(scored, "k").select("k", "review_rank")


@register("confirmation_action_counts", f"""WITH {GUARD_SQL},
{triage_sql(cfp=100.0, cfn=20.0, auto_match=0.95, auto_non=0.10, budget=1000)}
SELECT action, COUNT(*) AS n_rows, CAST(SUM(CASE WHEN review_requested THEN 1 ELSE 0 END) AS BIGINT)
  AS review_requested FROM decided GROUP BY action""")
def confirmation_action_counts(spark, sf_dir):
    return action_counts(triage(ready(spark, sf_dir), SETTINGS, "confirmacao", "k"))


@register("run_summary", f"""WITH {GUARD_SQL}, {triage_sql(budget=2000)}
SELECT 'action' AS kind, action AS name, COUNT(*) AS n_rows FROM decided GROUP BY action
UNION ALL SELECT 'guardrail', COALESCE(guardrail, 'none'), COUNT(*) FROM decided GROUP BY guardrail
UNION ALL SELECT 'total', 'review_requested', CAST(SUM(CASE WHEN review_requested THEN 1 ELSE 0 END) AS BIGINT)
FROM decided""")
def run_summary_rows(spark, sf_dir):
    return run_summary(triage(ready(spark, sf_dir), SETTINGS, "vigilancia", "k"))


@register("left_record_consistency", f"""WITH {FEATURES_SQL},
scored AS (SELECT comprec, k, LEAST(GREATEST(nota / 10, 0.000001E0), 0.999999E0) AS p FROM features),
ranked AS (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY comprec ORDER BY p DESC, k) AS rn FROM scored s),
top AS (SELECT comprec, MAX(CASE WHEN rn = 1 THEN p END) AS p1, MAX(CASE WHEN rn = 2 THEN p END) AS p2
        FROM ranked GROUP BY comprec)
SELECT r.k, CASE WHEN rn <= 2 AND p1 - p2 < 0.03E0 THEN 'REVIEW' WHEN rn = 1 THEN 'KEEP' ELSE 'DROP' END
  AS consistency FROM ranked r JOIN top t ON r.comprec = t.comprec""")
def left_record_consistency(spark, sf_dir):
    return consistent_per_left(ready(spark, sf_dir), "k", margin=SETTINGS.conflict_margin).select(
        "k", "consistency"
    )
