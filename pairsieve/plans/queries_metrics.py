"""Registered queries: metrics, sweeps, studies, splits, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsieve import columns as C
from pairsieve.functions.values import ref
from pairsieve.operators import evaluate as E
from pairsieve.operators import histograms as H
from pairsieve.operators import metrics as M
from pairsieve.operators import split as S
from pairsieve.operators import study as T
from pairsieve.operators.calibrate import fit_anchors, fit_platt
from pairsieve.operators.features import pair_features, rule_score
from pairsieve.operators.models import join_scores, soft_vote, unanimity
from pairsieve.operators.ranking import rank_by_value
from pairsieve.plans.queries_features import WITH_PAIRS
from pairsieve.plans.queries_triage import SETTINGS, ready
from pairsieve.plans.registry import register
from pairsieve.plans.run import prepare
from pairsieve.plans.views import FEATURES_SQL, GUARD_SQL, pairs, triage_sql
from pairsieve.session import small_table

# A probability that is not a function of the score alone, exact in both engines.
PROB_SQL = "CAST((k * 245489 + (k % 89) * 17) % 1000 AS DOUBLE) / 1000"
SCORED_SQL = f"""WITH {FEATURES_SQL},
scored AS (SELECT k, nota, target, rules, passo, situence, par, r_dtnasc, r_dtobito,
  LEAST(0.999E0, 0.5E0 * nota / 12.0E0 + 0.5E0 * ({PROB_SQL})) AS p, {PROB_SQL} AS q FROM features)"""


def scored(spark, sf_dir):
    """Pairs with label, score, rule score and two probabilities ``p`` and ``q``."""
    df = pairs(spark, sf_dir)
    q = PROB_SQL
    return df.withColumn("rules", rule_score(df)).selectExpr(
        "k", "`nota final` AS nota", "CASE WHEN PAR IN (1, 2) THEN 1 ELSE 0 END AS target", "rules", "PASSO AS passo",
        "C_SITUENCE AS situence", "PAR AS par", "R_DTNASC AS r_dtnasc", "R_DTOBITO AS r_dtobito",
        f"least(0.999D, 0.5D * `nota final` / 12.0D + 0.5D * ({q})) AS p", f"{q} AS q",
    )


def round_all(df, names, digits=6):
    return df.withColumns({n: F.round(ref(n), digits) for n in names})


RATES_SQL = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
  ROUND(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS precision,
  ROUND(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS recall,
  ROUND(CASE WHEN 2 * tp + fn + fp > 0 THEN 2.0E0 * tp / (2 * tp + fn + fp) ELSE 0 END, 6) AS f1"""


def counts_sql(hit: str, label: str = "target") -> str:
    cells = (("tp", "1", ""), ("fp", "0", ""), ("fn", "1", "NOT "), ("tn", "0", "NOT "))
    return ", ".join(
        f"SUM(CASE WHEN {label} = {y} AND {no}({hit}) THEN 1 ELSE 0 END) AS {n}" for n, y, no in cells
    )


RATE_NAMES = ["precision", "recall", "f1"]


@register("fixed_threshold_metrics", f"""{SCORED_SQL}, t AS (SELECT UNNEST([7, 8, 9]) AS threshold),
c AS (SELECT threshold, {counts_sql('nota >= threshold')} FROM scored, t GROUP BY threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, {RATES_SQL} FROM c""")
def fixed_threshold_metrics(spark, sf_dir):
    return round_all(M.threshold_sweep(scored(spark, sf_dir), "nota", "target", [7, 8, 9]), RATE_NAMES)


@register("grey_zone_metrics", f"""{SCORED_SQL}, c AS (SELECT passo, {counts_sql('nota >= 6.5E0')} FROM scored
WHERE nota >= 5 AND nota < 8 GROUP BY passo) SELECT passo, {RATES_SQL} FROM c""")
def grey_zone_metrics(spark, sf_dir):
    rows = T.grey_zone(scored(spark, sf_dir), "nota").withColumn("hit", (F.col("nota") >= 6.5).cast("int"))
    return round_all(M.add_rates(M.confusion(rows, "target", "hit", ["passo"])), RATE_NAMES)


@register("confusion_rates", f"""{SCORED_SQL}, c AS (SELECT passo, {counts_sql('p >= 0.5E0')} FROM scored GROUP BY passo)
SELECT passo, {RATES_SQL}, ROUND(5.0E0 * tp / (5 * tp + 4 * fn + fp), 6) AS fbeta,
  ROUND(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy, ROUND(CAST(fp AS DOUBLE) / NULLIF(fp + tn, 0), 6) AS fpr,
  ROUND(CAST(fn AS DOUBLE) / NULLIF(fn + tp, 0), 6) AS fnr FROM c""")
def confusion_rates(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("hit", (F.col("p") >= 0.5).cast("int"))
    out = M.add_error_rates(M.add_rates(M.confusion(rows, "target", "hit", ["passo"]), beta=2.0))
    return round_all(out, [*RATE_NAMES, "fbeta", "accuracy", "fpr", "fnr"])


@register("ranking_quality", f"""{SCORED_SQL}, h AS (SELECT p AS v, COUNT(*) AS n, SUM(target) AS pos FROM scored GROUP BY p),
c AS (SELECT v, n, pos, SUM(n) OVER w AS n_to, SUM(pos) OVER w AS pos_to FROM h WINDOW w AS (ORDER BY v DESC))
SELECT ROUND(SUM((n - pos) * (pos_to - pos / 2.0E0)) / (SUM(n - pos) * CAST(SUM(pos) AS DOUBLE)), 6) AS roc_auc,
  ROUND(SUM(pos * (CAST(pos_to AS DOUBLE) / n_to)) / SUM(pos), 6) AS average_precision FROM c""")
def ranking_quality(spark, sf_dir):
    return round_all(H.ranking_quality(scored(spark, sf_dir), "p", "target"), ["roc_auc", "average_precision"])


@register("ranking_quality_by_step", f"""{SCORED_SQL},
h AS (SELECT passo, q AS v, COUNT(*) AS n, SUM(target) AS pos FROM scored GROUP BY passo, q),
c AS (SELECT passo, v, n, pos, SUM(n) OVER w AS n_to, SUM(pos) OVER w AS pos_to FROM h
      WINDOW w AS (PARTITION BY passo ORDER BY v DESC))
SELECT passo, ROUND(SUM((n - pos) * (pos_to - pos / 2.0E0)) / (SUM(n - pos) * CAST(SUM(pos) AS DOUBLE)), 6) AS roc_auc,
  ROUND(SUM(pos * (CAST(pos_to AS DOUBLE) / n_to)) / SUM(pos), 6) AS average_precision FROM c GROUP BY passo""")
def ranking_quality_by_step(spark, sf_dir):
    return round_all(H.ranking_quality(scored(spark, sf_dir), "q", "target", ["passo"]), ["roc_auc", "average_precision"])


@register("curve_points", f"""{SCORED_SQL}, h AS (SELECT q AS v, COUNT(*) AS n, SUM(target) AS pos FROM scored GROUP BY q),
c AS (SELECT v, SUM(n) OVER w AS n_to, SUM(pos) OVER w AS tp, SUM(n) OVER () AS n_all, SUM(pos) OVER () AS p_all FROM h
      WINDOW w AS (ORDER BY v DESC))
SELECT v AS threshold, CAST(tp AS BIGINT) AS tp, CAST(n_to - tp AS BIGINT) AS fp, ROUND(CAST(tp AS DOUBLE) / n_to, 6) AS precision,
  ROUND(CAST(tp AS DOUBLE) / p_all, 6) AS recall, ROUND(CAST(n_to - tp AS DOUBLE) / (n_all - p_all), 6) AS fpr FROM c""")
def curve_points(spark, sf_dir):
    points = H.curve(scored(spark, sf_dir), "q", "target")
    return round_all(points.select("threshold", "tp", "fp", "precision", "recall", "fpr"), ["precision", "recall", "fpr"])


SWEEP = M.grid_values(1, 99, 100)


@register("threshold_sweep", f"""{SCORED_SQL}, t AS (SELECT CAST(UNNEST(RANGE(1, 100)) AS DOUBLE) / 100 AS threshold),
c AS (SELECT threshold, {counts_sql('p >= threshold')} FROM scored, t GROUP BY threshold)
SELECT threshold, {RATES_SQL} FROM c WHERE tp + fp > 0""")
def threshold_sweep(spark, sf_dir):
    return round_all(M.threshold_sweep(scored(spark, sf_dir), "p", "target", SWEEP), RATE_NAMES)


@register("best_thresholds", f"""{SCORED_SQL}, t AS (SELECT CAST(UNNEST(RANGE(1, 100)) AS DOUBLE) / 100 AS threshold),
c AS (SELECT threshold, {counts_sql('p >= threshold')} FROM scored, t GROUP BY threshold),
r AS (SELECT threshold, {RATES_SQL} FROM c WHERE tp + fp > 0),
a AS (SELECT 'f1' AS objective, threshold, f1 AS value FROM r ORDER BY f1 DESC, threshold LIMIT 1),
b AS (SELECT 'recall' AS objective, threshold, recall AS value FROM r WHERE precision > 0.01 ORDER BY recall DESC, threshold LIMIT 1),
d AS (SELECT 'precision' AS objective, threshold, precision AS value FROM r WHERE recall > 0.3 ORDER BY precision DESC, threshold LIMIT 1)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d""")
def best_thresholds(spark, sf_dir):
    sweep = round_all(M.threshold_sweep(scored(spark, sf_dir), "p", "target", SWEEP), RATE_NAMES)
    parts = [
        M.best_threshold(sweep, o).select(F.lit(o).alias("objective"), "threshold", F.col(o).alias("value"))
        for o in ("f1", "recall", "precision")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


GRID_P, GRID_R = M.grid_values(2, 19, 20), M.grid_values(0, 25, 2)
GRID_SQL = f"""{SCORED_SQL}, g AS (SELECT a AS ml_threshold, b AS rules_threshold FROM
  (SELECT CAST(UNNEST(RANGE(2, 20)) AS DOUBLE) / 20 AS a) x, (SELECT CAST(UNNEST(RANGE(0, 26)) AS DOUBLE) / 2 AS b) y),
c AS (SELECT ml_threshold, rules_threshold, {counts_sql('p >= ml_threshold AND rules >= rules_threshold')}
      FROM scored, g GROUP BY ml_threshold, rules_threshold),
grid AS (SELECT ml_threshold, rules_threshold, {RATES_SQL} FROM c WHERE tp + fp > 0)"""


def grid(spark, sf_dir):
    return round_all(M.rule_grid(scored(spark, sf_dir), "p", "rules", "target", GRID_P, GRID_R), RATE_NAMES)


@register("probability_rule_grid", f"{GRID_SQL} SELECT * FROM grid")
def probability_rule_grid(spark, sf_dir):
    return grid(spark, sf_dir)


FRONT_SQL = f"""{GRID_SQL}, front AS (SELECT * FROM grid a WHERE NOT EXISTS (SELECT 1 FROM grid b
  WHERE b.precision >= a.precision AND b.recall >= a.recall AND (b.precision > a.precision OR b.recall > a.recall)))"""


@register("pareto_front", f"{FRONT_SQL} SELECT * FROM front")
def pareto_front(spark, sf_dir):
    return M.pareto_front(grid(spark, sf_dir))


@register("front_profiles", f"""{FRONT_SQL}, named AS (SELECT *, ROUND(precision, 3) AS p3, ROUND(recall, 3) AS r3,
  CASE WHEN recall >= 0.98 THEN 'Máx. revocação' WHEN precision >= 0.97 THEN 'Máx. precisão'
       WHEN f1 >= 0.94 THEN 'Equilíbrio ótimo' ELSE 'Intermediário' END AS profile FROM front),
one AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY p3, r3 ORDER BY recall DESC, precision DESC, rules_threshold + 100 * ml_threshold) AS rn FROM named)
SELECT p3, r3, profile FROM one WHERE rn = 1 ORDER BY recall DESC, precision DESC LIMIT 8""")
def front_profiles(spark, sf_dir):
    front = M.pareto_front(grid(spark, sf_dir)).withColumn(
        "tie", F.col("rules_threshold") + 100 * F.col("ml_threshold"))
    return M.front_summary(front, 8, "tie").select("p3", "r3", "profile")


@register("operating_region", f"""{GRID_SQL} SELECT ml_threshold, rules_threshold, precision, recall, f1 FROM grid
WHERE precision >= 0.6 AND recall >= 0.3 ORDER BY f1 DESC, ml_threshold, rules_threshold LIMIT 10""")
def operating_region(spark, sf_dir):
    best = M.operating_region(grid(spark, sf_dir), 0.6, 0.3, 10, ["ml_threshold", "rules_threshold"])
    return best.select("ml_threshold", "rules_threshold", "precision", "recall", "f1")


def study_configurations():
    """Threshold, rule, probability, hybrid, cascade and consensus rules of the study."""
    out = {}
    for t in (7, 8, 9):
        out[f"Naive score>={t}"] = ("naive-threshold", f"nota >= {t}")
    for t in (6, 7, 8, 9):
        out[f"Rules-only (>={t})"] = ("rules-only", f"rules >= {t}")
    for m in ("p", "q"):
        for t in (0.3, 0.5, 0.7):
            out[f"ML-only {m} (>={t})"] = ("ml-only", f"{m} >= {t!r}")
        for t in (0.5, 0.6, 0.7):
            for r in (5, 6, 7, 8):
                out[f"Hybrid-AND {m} >={t} + Rules>={r}"] = ("hybrid-and", f"{m} >= {t!r} AND rules >= {r}")
        for t in (0.7, 0.9):
            for r in (8, 9):
                out[f"Hybrid-OR {m} >={t} + Rules>={r}"] = ("hybrid-or", f"{m} >= {t!r} OR rules >= {r}")
        for t in (0.3, 0.5):
            for r in (7, 8):
                out[f"Cascade ML to rules {m} >={t}, Rules>={r}"] = ("cascade-ml-rules", f"{m} >= {t!r} AND rules >= {r}")
        for r in (5, 6):
            for t in (0.5, 0.7):
                out[f"Cascade rules to ML Rules>={r}, {m} >={t}"] = ("cascade-rules-ml", f"rules >= {r} AND {m} >= {t!r}")
    for t in (0.5, 0.7):
        votes = f"CAST(p >= {t!r} AS INT) + CAST(q >= {t!r} AS INT) + CAST(nota / 12 >= {t!r} AS INT)"
        out[f"Consensus majority (th={t})"] = ("consensus-ml", f"({votes}) >= 1.5")
        for r in (6, 7):
            out[f"Consensus (th={t}) AND Rules>={r}"] = ("consensus-hybrid", f"({votes}) >= 1.5 AND rules >= {r}")
    return out


STUDY = study_configurations()
CUTS = {"nota": [6.0, 7.0, 8.0, 8.4, 9.0], "rules": [5.0, 6.0, 7.0, 8.0, 9.0], "p": [0.3, 0.5, 0.6, 0.7, 0.9],
        "q": [0.3, 0.5, 0.6, 0.7, 0.9]}


def study_cells(df):
    """Decision inputs rounded down to the thresholds in use, then counted."""
    def floor_to(name):
        steps = CUTS[name]
        reached = M.steps_reached(name, steps)
        return F.element_at(F.array(F.lit(-1.0), *[F.lit(s) for s in steps]), reached + 1)

    cut = df.select(F.col("target"), *[floor_to(n).alias(n) for n in CUTS])
    return T.compact(cut, "target", list(CUTS))


def _study_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS config, '{c}' AS category, {counts_sql(h)} FROM scored" for n, (c, h) in STUDY.items()
    )
    return f"{SCORED_SQL}, c AS ({rows}), study AS (SELECT config, category, {RATES_SQL} FROM c)"


def study(spark, sf_dir):
    return round_all(T.configuration_study(study_cells(scored(spark, sf_dir)), STUDY), RATE_NAMES)


@register("configuration_study", f"{_study_sql()} SELECT * FROM study")
def configuration_study(spark, sf_dir):
    return study(spark, sf_dir)


@register("best_per_category", f"""{_study_sql()}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY f1 DESC, config) AS rn FROM study)
SELECT category, config, f1 FROM r WHERE rn = 1""")
def best_per_category(spark, sf_dir):
    return M.best_per_category(study(spark, sf_dir), "category", "f1", "config").select("category", "config", "f1")


@register("model_selection", f"""{_study_sql()} SELECT config, precision, recall FROM study WHERE recall > 0
ORDER BY CASE WHEN precision >= 0.5 AND recall >= 0.2 THEN 1 ELSE 0 END DESC, precision DESC, config LIMIT 1""")
def model_selection(spark, sf_dir):
    return M.select_model(study(spark, sf_dir), "precision", "config").select("config", "precision", "recall")


@register("best_by_metric", f"{_study_sql()} SELECT config, f1 FROM study ORDER BY f1 DESC, config LIMIT 1")
def best_by_metric(spark, sf_dir):
    return M.best_by(study(spark, sf_dir), "f1", "config").select("config", "f1")


@register("model_ranking", f"""{_study_sql()}, m AS (SELECT category AS model, AVG(f1) AS f1_mean, AVG(precision) AS precision_mean,
  AVG(recall) AS recall_mean, STDDEV_POP(f1) AS f1_std, COUNT(*) AS n_runs FROM study GROUP BY category)
SELECT model, ROUND(f1_mean, 6) AS f1_mean, ROUND(f1_std, 6) AS f1_std, n_runs,
  CAST(ROW_NUMBER() OVER (ORDER BY f1_mean DESC, precision_mean DESC, recall_mean DESC, model) AS INT) AS rank FROM m""")
def model_ranking(spark, sf_dir):
    return ranked_models(study(spark, sf_dir).withColumnRenamed("category", "model"))


def ranked_models(runs):
    """Models by their mean rates.

    The rates have six digits, so they are averaged as decimals: sums of doubles depend on the
    order of the rows, and a mean that ends in a half then falls to either side.
    """
    exact = runs.withColumns({n: ref(n).cast("decimal(22,12)") for n in RATE_NAMES})
    ranked = M.rank_models(M.summarize_runs(exact, ["model"], ["f1", "precision", "recall"], population=True), ["f1_mean", "precision_mean", "recall_mean"])
    doubles = ranked.withColumn("f1_mean", F.col("f1_mean").cast("double"))
    return round_all(doubles.select("model", "f1_mean", "f1_std", "n_runs", "rank"), ["f1_mean", "f1_std"])


METHODS = {
    "Naive threshold >=7": "nota >= 7", "Naive threshold >=8": "nota >= 8", "Naive threshold >=9": "nota >= 9",
    "Rules >=7": "rules >= 7", "Rules >=8": "rules >= 8", "ML >=0.5": "p >= 0.5", "ML >=0.7": "p >= 0.7",
    "Hybrid-OR ML>=0.7+Rules>=8": "p >= 0.7 OR rules >= 8", "Hybrid-AND ML>=0.5+Rules>=7": "p >= 0.5 AND rules >= 7",
    "Nobody": "p >= 2",
}
_METHOD_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS method, {counts_sql(h)} FROM scored" for n, h in METHODS.items())


@register("impact_per_method", f"""{SCORED_SQL}, c AS ({_METHOD_ROWS}),
r AS (SELECT method, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM c)
SELECT method, tp, fp, fn, tn, tp AS detected, fn AS missed, tp + fp AS to_review,
  ROUND(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 4) AS precision,
  ROUND(CAST(tp AS DOUBLE) / (tp + fn), 4) AS recall, ROUND(2.0E0 * tp / (2 * tp + fp + fn), 4) AS f1,
  ROUND(CAST(tp * 100 AS DOUBLE) / (tp + fp + fn + tn), 4) AS rate_detected_pct,
  ROUND(CAST((tp + fn) * 100 AS DOUBLE) / (tp + fp + fn + tn), 4) AS rate_true_pct,
  ROUND(CAST(tp * 100 AS DOUBLE) / (tp + fn), 1) AS pct_of_true_found,
  CASE WHEN tp > 0 THEN ROUND(CAST(tp + fp AS DOUBLE) / tp, 2) END AS cost_per_death FROM r""")
def impact_per_method(spark, sf_dir):
    return T.impact_table(study_cells(scored(spark, sf_dir)), METHODS)


MODELS = {"half": "p >= 0.5", "score": "nota >= 8"}
_BANDED = """CASE WHEN nota < 3 THEN '0-3' WHEN nota < 5 THEN '3-5' WHEN nota < 6 THEN '5-6' WHEN nota < 7 THEN '6-7'
  WHEN nota < 8 THEN '7-8' WHEN nota < 9 THEN '8-9' WHEN nota < 10 THEN '9-10' ELSE '10+' END"""
_BAND_ROWS = " UNION ALL ".join(
    f"SELECT {_BANDED} AS band, '{m}' AS model, {counts_sql(h)} FROM scored GROUP BY 1" for m, h in MODELS.items())


@register("score_band_report", f"""{SCORED_SQL}, c AS ({_BAND_ROWS})
SELECT band, model, CAST(tp + fp + fn + tn AS BIGINT) AS n, CAST(tp + fn AS BIGINT) AS pairs,
  ROUND(CAST((tp + fn) * 100 AS DOUBLE) / (tp + fp + fn + tn), 6) AS pct_pairs, {RATES_SQL} FROM c""")
def score_band_report(spark, sf_dir):
    return round_all(T.band_report(scored(spark, sf_dir), "nota", "target", MODELS), ["pct_pairs", *RATE_NAMES])


@register("missed_pairs", f"""{SCORED_SQL} SELECT k, ROUND(p, 6) AS p, rules,
  CASE WHEN p >= 0.7 AND rules >= 7 THEN 'high' ELSE 'medium' END AS tier FROM scored
WHERE par = 0 AND p >= 0.6 AND rules >= 5""")
def missed_pairs(spark, sf_dir):
    found = T.missed_pairs(scored(spark, sf_dir), "p", 0.6, "rules", 5, "par")
    tier = F.when((F.col("p") >= 0.7) & (F.col("rules") >= 7), "high").otherwise("medium")
    return found.select("k", F.round("p", 6).alias("p"), "rules", tier.alias("tier"))


@register("top_candidates", f"""{SCORED_SQL} SELECT k, ROUND(p, 6) AS p FROM scored WHERE par = 0 AND p >= 0.5 ORDER BY scored.p DESC, k LIMIT 200""")
def top_candidates(spark, sf_dir):
    found = T.missed_pairs(scored(spark, sf_dir), "p", 0.5, label="par")
    return found.orderBy(F.desc("p"), "k").limit(200).select("k", F.round("p", 6).alias("p"))


_AGED = """aged AS (SELECT *, DATE_DIFF('day', r_dtnasc, r_dtobito) / 365.25E0 AS age,
  CASE WHEN k % 2 = 0 THEN 'F' ELSE 'M' END AS sex FROM scored)"""


@register("recovered_profile", f"""{SCORED_SQL}, {_AGED},
g AS (SELECT *, CASE WHEN nota >= 8 THEN 'found' ELSE 'recovered' END AS grp FROM aged WHERE target = 1 AND p >= 0.4)
SELECT grp AS "group", COUNT(*) AS n, ROUND(AVG(age), 6) AS age_mean, ROUND(AVG(nota), 6) AS score_mean,
  CAST(SUM(CASE WHEN sex = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_female, CAST(SUM(CASE WHEN sex = 'M' THEN 1 ELSE 0 END) AS BIGINT) AS n_male,
  CAST(SUM(CASE WHEN nota >= 7 AND nota < 8 THEN 1 ELSE 0 END) AS BIGINT) AS band_7_8,
  ROUND(SUM(CASE WHEN nota >= 7 AND nota < 8 THEN 1 ELSE 0 END) * 100.0E0 / COUNT(*), 6) AS band_7_8_pct,
  ROUND(QUANTILE_CONT(age, 0.5), 6) AS age_median, ROUND(QUANTILE_CONT(nota, 0.5), 6) AS score_median FROM g GROUP BY grp""")
def recovered_profile(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumns({
        "age": F.datediff("r_dtobito", "r_dtnasc") / 365.25, "sex": F.when(F.col("k") % 2 == 0, "F").otherwise("M")})
    out = T.recovered_profile(rows, F.col("p") >= 0.4, F.col("nota") >= 8, "target", "age", "sex", "nota")
    real = ["age_mean", "score_mean", "band_7_8_pct", "age_median", "score_median"]
    return round_all(out.select("group", "n", "n_female", "n_male", "band_7_8", *real), real)


@register("candidate_means", f"""{SCORED_SQL}, m AS (SELECT AVG(CASE WHEN target = 1 THEN nota END) AS t0, AVG(CASE WHEN par = 0 AND p >= 0.6 THEN nota END) AS c0,
  AVG(CASE WHEN target = 1 THEN rules END) AS t1, AVG(CASE WHEN par = 0 AND p >= 0.6 THEN rules END) AS c1 FROM scored)
SELECT 'nota' AS feature, ROUND(t0, 6) AS mean_true, ROUND(c0, 6) AS mean_candidate, ROUND((c0 - t0) / t0 * 100, 6) AS diff_pct FROM m
UNION ALL SELECT 'rules', ROUND(t1, 6), ROUND(c1, 6), ROUND((c1 - t1) / t1 * 100, 6) FROM m""")
def candidate_means(spark, sf_dir):
    out = T.mean_comparison(scored(spark, sf_dir), ["nota", "rules"],
                            (F.col("par") == 0) & (F.col("p") >= 0.6), F.col("target") == 1)
    return round_all(out, ["mean_true", "mean_candidate", "diff_pct"])


@register("impact_estimate", f"""{SCORED_SQL}, c AS (SELECT SUM(target) AS pairs, SUM(CASE WHEN par = 0 AND p >= 0.6 THEN 1 ELSE 0 END) AS candidates FROM scored)
SELECT CAST(pairs AS BIGINT) AS pairs, CAST(candidates AS BIGINT) AS candidates, CAST(FLOOR(candidates * 0.25E0) AS BIGINT) AS expected_new,
  ROUND(FLOOR(candidates * 0.25E0) * 100 / pairs, 6) AS gain_pct FROM c""")
def impact_estimate(spark, sf_dir):
    out = T.impact_estimate(scored(spark, sf_dir), (F.col("par") == 0) & (F.col("p") >= 0.6), F.col("target") == 1, 0.25)
    return round_all(out, ["gain_pct"])


@register("step_counts", f"{SCORED_SQL} SELECT passo, COUNT(*) AS n FROM scored WHERE par = 0 AND p >= 0.5 GROUP BY passo")
def step_counts(spark, sf_dir):
    return T.value_counts(T.missed_pairs(scored(spark, sf_dir), "p", 0.5, label="par"), "passo")


@register("cascade_funnel", f"""WITH {GUARD_SQL}, {triage_sql()}, s AS (
SELECT 0 AS position, 'all' AS stage, COUNT(*) AS pairs, SUM(target) AS positives FROM decided UNION ALL
SELECT 1, 'grey or higher', COUNT(*), SUM(target) FROM decided WHERE nota >= 5 UNION ALL
SELECT 2, 'not fixed', COUNT(*), SUM(target) FROM decided WHERE nota >= 5 AND tier IS NOT NULL UNION ALL
SELECT 3, 'reviewed', COUNT(*), SUM(target) FROM decided WHERE nota >= 5 AND tier IS NOT NULL AND action = 'LLM_REVIEW')
SELECT position, stage, pairs, CAST(positives AS BIGINT) AS positives, ROUND(positives * 100.0E0 / pairs, 6) AS prevalence_pct,
  ROUND((LAG(pairs) OVER (ORDER BY position) - pairs) * 100.0E0 / LAG(pairs) OVER (ORDER BY position), 6) AS reduction_pct FROM s""")
def cascade_funnel(spark, sf_dir):
    from pairsieve.plans.queries_triage import decided

    grey = ref(C.SCORE) >= 5
    open_ = grey & F.col("tier").isNotNull()
    stages = {"all": F.lit(True), "grey or higher": grey, "not fixed": open_,
              "reviewed": open_ & (F.col("action") == "LLM_REVIEW")}
    return round_all(T.funnel(decided(spark, sf_dir), stages, C.TARGET), ["prevalence_pct", "reduction_pct"])


@register("average_ranks", f"""{SCORED_SQL}, h AS (SELECT q, COUNT(*) AS n FROM scored GROUP BY q)
SELECT q AS value, n, SUM(n) OVER (ORDER BY q DESC) - (n - 1) / 2.0E0 AS rank FROM h""")
def average_ranks(spark, sf_dir):
    return H.average_ranks(scored(spark, sf_dir), "q")


@register("rank_by_value", f"""{SCORED_SQL} SELECT k, ROW_NUMBER() OVER (PARTITION BY passo ORDER BY q, k) AS position FROM scored""")
def rank_by_value_rows(spark, sf_dir):
    return rank_by_value(scored(spark, sf_dir), ["passo"], "q", "k", "position").select("k", "position")


@register("score_distribution", f"""{SCORED_SQL}, h AS (SELECT passo, q AS value, COUNT(*) AS n FROM scored GROUP BY passo, q)
SELECT passo, value, n, ROUND(CAST(SUM(n) OVER (PARTITION BY passo ORDER BY value) AS DOUBLE) / SUM(n) OVER (PARTITION BY passo), 6) AS cdf FROM h""")
def score_distribution(spark, sf_dir):
    return round_all(H.cumulative_distribution(scored(spark, sf_dir), "q", ["passo"]), ["cdf"])


@register("exact_quantiles", f"""{SCORED_SQL} SELECT passo, COUNT(*) AS n, ROUND(QUANTILE_CONT(p, 0.25), 6) AS q25,
ROUND(QUANTILE_CONT(p, 0.5), 6) AS q50, ROUND(QUANTILE_CONT(p, 0.9), 6) AS q90 FROM scored GROUP BY passo""")
def exact_quantiles(spark, sf_dir):
    out = H.exact_quantiles(scored(spark, sf_dir), "p", {"q25": 0.25, "q50": 0.5, "q90": 0.9}, ["passo"])
    return round_all(out, ["q25", "q50", "q90"])


def split_sql(label: str, share: str, seed: str = "42", key: str = "k", source: str = "scored") -> str:
    size = f"COUNT(*) OVER (PARTITION BY {label})"
    wanted = f"ROUND_EVEN({size} * {share}, 0)"
    return f"""(SELECT s.*, CASE WHEN ROW_NUMBER() OVER (PARTITION BY {label} ORDER BY MD5(CONCAT('{seed}|', CAST({key} AS VARCHAR))), {key})
  <= GREATEST(1, LEAST({size} - 1, {wanted})) THEN 'test' ELSE 'train' END AS split FROM {source} s)"""


@register("stratified_holdout", f"{SCORED_SQL} SELECT k, split FROM {split_sql('target', '0.3')} t")
def stratified_holdout(spark, sf_dir):
    return S.stratified_holdout(scored(spark, sf_dir), "target", "k").select("k", "split")


@register("group_holdout", f"""WITH {FEATURES_SQL}, g AS (SELECT CAST(comprec AS VARCHAR) AS grp, MAX(target) AS y FROM features GROUP BY 1),
s AS (SELECT grp, split FROM {split_sql('y', '0.3', key='grp', source='g')} t)
SELECT f.k, s.split FROM features f JOIN s ON CAST(f.comprec AS VARCHAR) = s.grp""")
def group_holdout(spark, sf_dir):
    df = pair_features(pairs(spark, sf_dir), birth_distance=False)
    return S.split_by(df, C.TARGET, "k", "comprec").select("k", "split")


@register("stratified_folds", f"""{SCORED_SQL} SELECT k, CAST((ROW_NUMBER() OVER (PARTITION BY target ORDER BY MD5(CONCAT('42|', CAST(k AS VARCHAR))), k) - 1) % 5 AS INT) AS fold FROM scored""")
def stratified_folds(spark, sf_dir):
    return S.stratified_folds(scored(spark, sf_dir), "target", "k").select("k", "fold")


@register("repeated_folds", f"""{SCORED_SQL}, r AS (SELECT CAST(UNNEST(RANGE(0, 5)) AS INT) AS repeat)
SELECT k, repeat, CAST((ROW_NUMBER() OVER (PARTITION BY repeat, target ORDER BY MD5(CONCAT(CAST(repeat + 42 AS VARCHAR), '|', CAST(k AS VARCHAR))), k) - 1) % 5 AS INT) AS fold
FROM scored, r""")
def repeated_folds(spark, sf_dir):
    return S.repeated_folds(scored(spark, sf_dir), "target", "k").select("k", "repeat", "fold")


@register("proportional_sample", f"""{SCORED_SQL}, b AS (SELECT *, {_BANDED} AS band FROM scored),
c AS (SELECT band, COUNT(*) AS n FROM b GROUP BY band),
a AS (SELECT band, n, CAST(ROUND_EVEN(n * 517.0E0 / SUM(n) OVER (), 0) AS BIGINT) AS take FROM c),
f AS (SELECT band, CASE WHEN ROW_NUMBER() OVER (ORDER BY n DESC, band) = 1 THEN take + 517 - SUM(take) OVER () ELSE take END AS take FROM a),
r AS (SELECT k, band, ROW_NUMBER() OVER (PARTITION BY band ORDER BY MD5(CONCAT('42|', CAST(k AS VARCHAR))), k) AS rn FROM b)
SELECT r.k, r.band FROM r JOIN f ON r.band = f.band WHERE rn <= take""")
def proportional_sample(spark, sf_dir):
    banded = scored(spark, sf_dir).withColumn("band", T.range_label(F.col("nota")))
    return S.proportional_sample(banded, "band", "k", 517).select("k", "band")


@register("range_sample", f"""{SCORED_SQL}, r AS (SELECT k, CAST(FLOOR(nota) AS INT) AS b,
  ROW_NUMBER() OVER (PARTITION BY FLOOR(nota) ORDER BY MD5(CONCAT('42|', CAST(k AS VARCHAR))), k) AS rn FROM scored WHERE nota >= 4 AND nota < 8)
SELECT k FROM r WHERE rn <= 10""")
def range_sample(spark, sf_dir):
    return S.range_sample(scored(spark, sf_dir), "nota", [4, 5, 6, 7, 8], 40, "k").select("k")


@register("head_per_band", f"""{SCORED_SQL}, b AS (SELECT *, {_BANDED} AS band FROM scored),
r AS (SELECT k, band, ROW_NUMBER() OVER (PARTITION BY band ORDER BY MD5(CONCAT('head|', CAST(k AS VARCHAR))), k) AS rn FROM b)
SELECT k, band FROM r WHERE rn <= 3 ORDER BY band, rn LIMIT 20""")
def head_per_band(spark, sf_dir):
    banded = scored(spark, sf_dir).withColumn("band", T.range_label(F.col("nota")))
    return S.head_per_band(banded, "band", "k", 3, 20).select("k", "band")


@register("temporal_split", f"{SCORED_SQL} SELECT CASE WHEN EXTRACT(YEAR FROM r_dtobito) <= 1996 THEN 'train' ELSE 'test' END AS split, COUNT(*) AS n FROM scored GROUP BY 1")
def temporal_split(spark, sf_dir):
    return S.temporal_split(scored(spark, sf_dir), "r_dtobito", 1996).groupBy("split").agg(F.count("*").alias("n"))


# Newton's steps of the two-parameter logistic fit, over the score histogram.
PLATT_SQL = f"""WITH RECURSIVE {FEATURES_SQL},
h AS (SELECT nota AS x, COUNT(*) AS n, SUM(target) AS pos FROM features GROUP BY nota),
start AS (SELECT LN(((SUM(pos) + 0.5E0) / (SUM(n) + 1.0E0)) / (1 - (SUM(pos) + 0.5E0) / (SUM(n) + 1.0E0))) AS w0 FROM h),
newton AS (SELECT 0 AS step, w0, 0.0E0 AS w1 FROM start UNION ALL
  SELECT step + 1, w0 - (d * g0 - b * g1) / (a * d - b * b), w1 - (a * g1 - b * g0) / (a * d - b * b) FROM (
    SELECT step, w0, w1, SUM(n * pr - pos) AS g0, SUM((n * pr - pos) * x) + 0.001E0 * w1 AS g1,
      SUM(n * pr * (1 - pr)) AS a, SUM(n * pr * (1 - pr) * x) AS b, SUM(n * pr * (1 - pr) * x * x) + 0.001E0 AS d
    FROM (SELECT nt.step, nt.w0, nt.w1, h.x, h.n, h.pos, 1.0E0 / (1.0E0 + EXP(-(nt.w0 + nt.w1 * h.x))) AS pr FROM newton nt, h) q
    GROUP BY step, w0, w1) s WHERE step < 25)"""


@register("platt_fit", f"{PLATT_SQL} SELECT 'platt' AS method, ROUND(w0, 6) AS intercept, ROUND(w1, 6) AS slope FROM newton WHERE step = 25")
def platt_fit(spark, sf_dir):
    wide = pair_features(pairs(spark, sf_dir), birth_distance=False)
    model = fit_platt(wide, C.SCORE, C.TARGET, SETTINGS.calibration)[()]
    return small_table(spark, [("platt", round(model.intercept, 6), round(model.slope, 6))],
                       "method string, intercept double, slope double")


@register("anchor_fit")
def anchor_fit(spark, sf_dir):
    """Mean probability on both anchors under the label-free fit."""
    from pairsieve.operators.calibrate import with_probability

    df = pairs(spark, sf_dir)
    model = fit_anchors(df, SETTINGS.anchors)
    rows = with_probability(df, "platt", SETTINGS.calibration, model)
    high, low = ref(C.SCORE) >= 9, ref(C.SCORE) < 5
    return rows.agg(F.round(F.avg(F.when(high, F.col("p_cal"))), 6).alias("high_mean"),
                    F.round(F.avg(F.when(low, F.col("p_cal"))), 6).alias("low_mean"))


SEEDS = list(SETTINGS.evaluation.seeds)


def eval_sql(method: str = "platt", split_by: str = "row", seeds: list[int] = SEEDS, share: float = 0.3) -> str:
    """CTEs up to ``tests``: every seed's test rows with ``p_cal``, fitted on that seed's training rows."""
    size = "GREATEST(1, LEAST({n} - 1, ROUND_EVEN({n} * " + repr(share) + "E0, 0)))"
    order = "MD5(CONCAT(CAST(seed AS VARCHAR), '|', CAST({key} AS VARCHAR))), {key}"
    head = f"WITH RECURSIVE {GUARD_SQL}, seeds AS (SELECT UNNEST({seeds}) AS seed),"
    if split_by == "row":
        head += f"""
parts AS (SELECT s.*, CASE WHEN ROW_NUMBER() OVER (PARTITION BY seed, target ORDER BY {order.format(key='k')})
  <= {size.format(n='COUNT(*) OVER (PARTITION BY seed, target)')} THEN 'test' ELSE 'train' END AS split FROM (SELECT l.*, seed FROM labelled l, seeds) s),"""
    else:
        head += f"""
groups AS (SELECT {split_by} AS g, MAX(target) AS y, seed FROM labelled, seeds GROUP BY 1, 3),
sides AS (SELECT g, seed, ROW_NUMBER() OVER (PARTITION BY seed, y ORDER BY {order.format(key='CAST(g AS VARCHAR)')})
  <= {size.format(n='COUNT(*) OVER (PARTITION BY seed, y)')} AS test FROM groups),
parts AS (SELECT l.*, seed, CASE WHEN test THEN 'test' ELSE 'train' END AS split FROM labelled l JOIN sides ON g = {split_by}),"""
    if method == "stub":
        return head + " tests AS (SELECT * FROM parts WHERE split = 'test')"
    return head + """
th AS (SELECT seed, nota AS x, COUNT(*) AS n, SUM(target) AS pos FROM parts WHERE split = 'train' GROUP BY 1, 2),
newton AS (SELECT seed, 0 AS step, LN(((SUM(pos) + 0.5E0) / (SUM(n) + 1.0E0)) / (1 - (SUM(pos) + 0.5E0) / (SUM(n) + 1.0E0))) AS w0, 0.0E0 AS w1 FROM th GROUP BY seed
  UNION ALL SELECT seed, step + 1, w0 - (d * g0 - b * g1) / (a * d - b * b), w1 - (a * g1 - b * g0) / (a * d - b * b) FROM (
    SELECT seed, step, w0, w1, SUM(n * pr - pos) AS g0, SUM((n * pr - pos) * x) + 0.001E0 * w1 AS g1,
      SUM(n * pr * (1 - pr)) AS a, SUM(n * pr * (1 - pr) * x) AS b, SUM(n * pr * (1 - pr) * x * x) + 0.001E0 AS d
    FROM (SELECT nt.*, h.x, h.n, h.pos, 1.0E0 / (1.0E0 + EXP(-(nt.w0 + nt.w1 * h.x))) AS pr FROM newton nt JOIN th h ON h.seed = nt.seed) q
    GROUP BY seed, step, w0, w1) s WHERE step < 25),
tests AS (SELECT p.* REPLACE (LEAST(GREATEST(1.0E0 / (1.0E0 + EXP(-(f.w0 + f.w1 * nota))), 0.000001E0), 0.999999E0) AS p_cal)
  FROM parts p JOIN (SELECT * FROM newton WHERE step = 25) f ON f.seed = p.seed WHERE split = 'test')"""


def runs_sql(mode: str, by: str = "seed", budgets: list[int] | None = None, source: str = "tests", cfp: str | None = None) -> str:
    """One mode's runs over ``tests`` as a query: counts and qualities per group and budget."""
    m, limits = SETTINGS.mode(mode), budgets or [SETTINGS.budget(mode)]
    steps = triage_sql(source, m.false_positive, m.false_negative, m.review, m.min_auto_match, m.max_auto_nonmatch, 0, by)
    if cfp:
        steps = steps.replace(f"* {m.false_positive!r}E0", f"* {cfp}")
    bb = E.mode_beta(mode) ** 2
    return f"""(WITH {steps},
acted AS (SELECT p.*, llm_max, CASE WHEN review_rank <= llm_max THEN 'LLM_REVIEW' WHEN guardrail = 'ALWAYS_MATCH' THEN 'MATCH'
  WHEN guardrail = 'ALWAYS_NONMATCH' THEN 'NONMATCH' ELSE base_choice END AS action FROM picked p, (SELECT UNNEST({limits}) AS llm_max) b),
counted AS (SELECT {by}, llm_max, COUNT(*) AS n_test, CAST(SUM(target) AS BIGINT) AS pos_test,
  CAST(SUM(CASE WHEN review_requested THEN 1 ELSE 0 END) AS BIGINT) AS review_requested,
  CAST(SUM(CASE WHEN action = 'LLM_REVIEW' THEN 1 ELSE 0 END) AS BIGINT) AS review_selected,
  CAST(SUM(CASE WHEN action = 'MATCH' AND target = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS auto_tp,
  CAST(SUM(CASE WHEN action <> 'NONMATCH' AND target = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS oracle_tp, {EXPECTED_SQL} FROM acted GROUP BY {by}, llm_max)
SELECT '{mode}' AS mode, *, CAST(n_test - review_selected AS DOUBLE) / n_test AS auto_coverage,
  COALESCE(exp_tp / NULLIF(exp_tp + exp_fp, 0), 0) AS exp_precision, COALESCE(exp_tp / NULLIF(exp_tp + exp_fn, 0), 0) AS exp_recall,
  COALESCE(2 * exp_tp / NULLIF(2 * exp_tp + exp_fn + exp_fp, 0), 0) AS exp_f1,
  COALESCE({1 + bb} * exp_tp / NULLIF({1 + bb} * exp_tp + {bb} * exp_fn + exp_fp, 0), 0) AS exp_fbeta FROM counted)"""


def all_modes_sql(**options) -> str:
    return "runs AS (" + " UNION ALL ".join(runs_sql(mode, **options) for mode in SETTINGS.modes) + ")"


_X = """CAST(SUM(CASE WHEN action = '{auto}' AND target = {y} THEN 1 WHEN action = 'LLM_REVIEW' AND target = {y} THEN {share} ELSE 0 END) AS DOUBLE)"""
EXPECTED_SQL = ", ".join([
    _X.format(auto="MATCH", y=1, share="1 - e_fn") + " AS exp_tp", _X.format(auto="MATCH", y=0, share="e_fp") + " AS exp_fp",
    _X.format(auto="NONMATCH", y=1, share="e_fn") + " AS exp_fn", _X.format(auto="NONMATCH", y=0, share="1 - e_fp") + " AS exp_tn"])


_ROUNDED = ["auto_coverage", "exp_tp", "exp_fp", "exp_fn", "exp_tn", "exp_precision", "exp_recall", "exp_fbeta"]


def evaluation_columns(df, by=("mode",)):
    out = df.select(*by, "seed", "llm_max", "n_test", "pos_test", "review_requested", "review_selected", "auto_tp", "oracle_tp", *_ROUNDED)
    return round_all(out, _ROUNDED)


def evaluation_columns_sql(by: str = "mode") -> str:
    return f"SELECT {by}, seed, llm_max, n_test, pos_test, review_requested, review_selected, auto_tp, oracle_tp, " + ", ".join(
        f"ROUND({c}, 6) AS {c}" for c in _ROUNDED) + " FROM runs"


_POINTS = ["exp_precision_mean", "exp_recall_mean", "exp_f1_mean", "exp_f1_std", "llm_used_mean"]


def points_sql(by: str) -> str:
    return f"""SELECT {by}, ROUND(AVG(exp_precision), 6) AS exp_precision_mean, ROUND(AVG(exp_recall), 6) AS exp_recall_mean, ROUND(AVG(exp_f1), 6) AS exp_f1_mean,
  ROUND(STDDEV_SAMP(exp_f1), 6) AS exp_f1_std, ROUND(AVG(review_selected), 6) AS llm_used_mean, COUNT(*) AS n_runs FROM runs GROUP BY {by}"""


def points(records, by):
    return round_all(E.mean_points(records, by).select(*by, *_POINTS, "n_runs"), _POINTS)


@register("evaluation_runs", f"{eval_sql()}, {all_modes_sql()} {evaluation_columns_sql()}")
def evaluation_runs(spark, sf_dir):
    base = prepare(pairs(spark, sf_dir), SETTINGS, birth_distance=False)
    return evaluation_columns(E.evaluate(base, SETTINGS, "k"))


BUDGETS = [0, 50, 100, 200, 500, 1000, 2000, 5000]


@register("budget_sensitivity", f"{eval_sql()}, {all_modes_sql(budgets=BUDGETS)} {points_sql('mode, llm_max')}")
def budget_sensitivity(spark, sf_dir):
    base = prepare(pairs(spark, sf_dir), SETTINGS, birth_distance=False)
    return points(E.evaluate(base, SETTINGS, "k", budgets=BUDGETS), ["mode", "llm_max"])


RATIOS = [0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0]


def _ratio_sql() -> str:
    rows = f"varied AS (SELECT t.*, fp_fn_ratio FROM tests t, (SELECT CAST(UNNEST({RATIOS}) AS DOUBLE) AS fp_fn_ratio) r)"
    parts = " UNION ALL ".join(
        runs_sql(mode, "seed, fp_fn_ratio", source="varied", cfp=f"(fp_fn_ratio * {SETTINGS.mode(mode).false_negative!r}E0)") for mode in SETTINGS.modes)
    return f"{eval_sql()}, {rows}, runs AS ({parts}) {points_sql('fp_fn_ratio, mode')}"


@register("cost_ratio_sensitivity", _ratio_sql())
def cost_ratio_sensitivity(spark, sf_dir):
    base = prepare(pairs(spark, sf_dir), SETTINGS, birth_distance=False)
    ev, records = SETTINGS.evaluation, None
    rows = E.calibrated_test_rows(base, SETTINGS, "k", list(ev.seeds), ev.test_size, ev.split_by, "platt", ev.group_stratify)
    for mode in SETTINGS.modes:
        record = E.cost_sensitivity(rows, SETTINGS, "k", mode, RATIOS)
        records = record if records is None else records.unionByName(record)
    return points(records, ["fp_fn_ratio", "mode"])


@register("platt_evaluation", f"{eval_sql(split_by='comprec')}, {all_modes_sql()} {evaluation_columns_sql()}")
def platt_evaluation(spark, sf_dir):
    """Evaluation with left records held out as groups."""
    base = prepare(pairs(spark, sf_dir), SETTINGS, birth_distance=False)
    return evaluation_columns(E.evaluate(base, SETTINGS, "k", split_by="comprec"))


def _ablation_sql() -> str:
    platt = eval_sql()
    stub = "LEAST(GREATEST(nota / 10, 0.000001E0), 0.999999E0)"
    rows = f"""varied AS (SELECT t.* REPLACE (CASE WHEN calibration = 'stub' THEN {stub} ELSE p_cal END AS p_cal, CASE WHEN guardrails THEN guardrail END AS guardrail),
  calibration, birth_distance, guardrails FROM tests t, (SELECT UNNEST(['stub', 'platt']) AS calibration) c, (SELECT UNNEST([TRUE, FALSE]) AS birth_distance) b, (SELECT UNNEST([TRUE, FALSE]) AS guardrails) g)"""
    by = "seed, calibration, birth_distance, guardrails"
    return f"{platt}, {rows}, {all_modes_sql(by=by, source='varied')} {evaluation_columns_sql('mode, calibration, birth_distance, guardrails')}"


@register("component_ablation", _ablation_sql())
def component_ablation(spark, sf_dir):
    records = E.ablation(pairs(spark, sf_dir), SETTINGS, "k")
    return evaluation_columns(records, ["mode", "calibration", "birth_distance", "guardrails"])


@register("repeated_holdout", f"{eval_sql(seeds=[42, 43, 44, 45, 46], share=0.2)}, runs AS {runs_sql('vigilancia')} {evaluation_columns_sql()}")
def repeated_holdout(spark, sf_dir):
    base = prepare(pairs(spark, sf_dir), SETTINGS, birth_distance=False)
    return evaluation_columns(E.repeated_holdout(base, SETTINGS, "k", "vigilancia"))


@register("aligned_scores", f"""{SCORED_SQL} SELECT k, ROUND((2.0E0 * p + q) / 3.0E0, 6) AS vote, CASE WHEN p >= 0.7 AND q >= 0.7 THEN 1 ELSE 0 END AS unanimous FROM scored""")
def aligned_scores(spark, sf_dir):
    """Scores of two models from tables of their own, met by key, and what they decide together."""
    rows = scored(spark, sf_dir)
    both = join_scores(rows.select("k"), {"a": rows.select("k", "p"), "b": rows.select("k", F.col("q").alias("p"))}, "k")
    return both.select("k", F.round(soft_vote(both, ["a", "b"], [2.0, 1.0]), 6).alias("vote"), unanimity(["a", "b"])[0].alias("unanimous"))


@register("run_spread", f"""{SCORED_SQL}, r AS (SELECT passo, situence, AVG(p) AS m FROM scored GROUP BY passo, situence)
SELECT passo, ROUND(AVG(m), 6) AS m_mean, ROUND(STDDEV_SAMP(m), 6) AS m_std, COUNT(*) AS n_runs FROM r GROUP BY passo""")
def run_spread(spark, sf_dir):
    runs = scored(spark, sf_dir).groupBy("passo", "situence").agg(F.avg("p").alias("m"))
    return round_all(M.summarize_runs(runs, ["passo"], ["m"]), ["m_mean", "m_std"])


@register("upsert_runs", f"""{SCORED_SQL}, old AS (SELECT passo AS model, COUNT(*) AS n FROM scored GROUP BY passo),
new AS (SELECT passo AS model, CAST(SUM(target) AS BIGINT) AS positives FROM scored WHERE passo > 1 GROUP BY passo)
SELECT model, n, NULL AS positives FROM old WHERE model NOT IN (SELECT model FROM new) UNION ALL SELECT model, NULL, positives FROM new""")
def upsert_runs(spark, sf_dir):
    df = scored(spark, sf_dir)
    old = df.groupBy(F.col("passo").alias("model")).agg(F.count("*").alias("n"))
    new = df.filter("passo > 1").groupBy(F.col("passo").alias("model")).agg(F.sum("target").alias("positives"))
    return T.upsert(old, new, ["model"])


@register("append_missing_runs", f"""{SCORED_SQL}, old AS (SELECT passo AS model, COUNT(*) AS n FROM scored WHERE passo < 3 GROUP BY passo),
new AS (SELECT passo AS model, CAST(SUM(target) AS BIGINT) AS n FROM scored GROUP BY passo)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE model NOT IN (SELECT model FROM old)""")
def append_missing_runs(spark, sf_dir):
    df = scored(spark, sf_dir)
    old = df.filter("passo < 3").groupBy(F.col("passo").alias("model")).agg(F.count("*").alias("n"))
    new = df.groupBy(F.col("passo").alias("model")).agg(F.sum("target").alias("n"))
    return T.append_missing(old, new, ["model"])


@register("reconcile_tables", f"""{SCORED_SQL}, a AS (SELECT passo, AVG(p) AS p, AVG(q) AS q FROM scored WHERE passo < 3 GROUP BY passo),
b AS (SELECT passo, AVG(p) AS p, AVG(q) + CASE WHEN passo = 2 THEN 0.5E0 ELSE 0 END AS q FROM scored WHERE passo > 1 GROUP BY passo),
f AS (SELECT COALESCE(a.passo, b.passo) AS passo, a.p AS pa, b.p AS pb, a.q AS qa, b.q AS qb FROM a FULL OUTER JOIN b ON a.passo = b.passo)
SELECT passo, 'p' AS measure, CASE WHEN pa IS NULL OR pb IS NULL THEN 'INCONCLUSIVE' WHEN ABS(pa - pb) <= 0.001 THEN 'OK' ELSE 'DIVERGENCE' END AS status FROM f
UNION ALL SELECT passo, 'q', CASE WHEN qa IS NULL OR qb IS NULL THEN 'INCONCLUSIVE' WHEN ABS(qa - qb) <= 0.001 THEN 'OK' ELSE 'DIVERGENCE' END FROM f""")
def reconcile_tables(spark, sf_dir):
    df = scored(spark, sf_dir)
    means = [F.avg("p").alias("p"), F.avg("q").alias("q")]
    left = df.filter("passo < 3").groupBy("passo").agg(*means)
    right = df.filter("passo > 1").groupBy("passo").agg(*means).withColumn(
        "q", F.col("q") + F.when(F.col("passo") == 2, 0.5).otherwise(0.0))
    return T.reconcile(left, right, ["passo"], ["p", "q"]).select("passo", "measure", "status")


@register("invalid_rows", f"""{WITH_PAIRS} SELECT CAST(SUM(CASE WHEN par IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_label,
CAST(SUM(CASE WHEN nota IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_score, CAST(SUM(CASE WHEN mae_qtd IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_mother FROM pairs""")
def invalid_rows(spark, sf_dir):
    df = ready(spark, sf_dir)
    M.check_binary(df, C.TARGET, C.SCORE, "band")
    missing = {"no_label": C.LABEL, "no_score": C.SCORE, "no_mother": C.MOTHER_COUNT}
    return df.agg(*[F.sum(ref(c).isNull().cast("bigint")).alias(n) for n, c in missing.items()])
