"""Registered queries: fairness, drift, k-anonymity."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsieve.config import Monitoring
from pairsieve.functions import intervals as I
from pairsieve.functions.values import ref
from pairsieve.operators import drift as D
from pairsieve.operators import fairness as N
from pairsieve.operators import privacy as K
from pairsieve.operators.split import bootstrap_confusion
from pairsieve.plans.queries_features import WITH_PAIRS
from pairsieve.plans.queries_triage import SETTINGS
from pairsieve.plans.queries_metrics import SCORED_SQL, round_all, scored
from pairsieve.session import small_table
from pairsieve.plans.registry import register, table
from pairsieve.plans.views import FEATURES_SQL, pairs

# Pairs with a population: name quartile by score, origin, age, sex, and the customer's nation
# and region as state and region of residence.
FAIR_SQL = f"""WITH {FEATURES_SQL},
joined AS (SELECT f.*, n.n_name AS state, r.r_name AS region, CASE WHEN c.c_mktsegment = 'MACHINERY' THEN NULL
    WHEN c.c_mktsegment = 'BUILDING' THEN 'fem' ELSE 'Masc' END AS sex_source
  FROM features f JOIN customer c ON f.refrec = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
edges AS (SELECT QUANTILE_CONT(nome_qtd, 0.25) AS e1, QUANTILE_CONT(nome_qtd, 0.5) AS e2, QUANTILE_CONT(nome_qtd, 0.75) AS e3,
  MIN(nome_qtd) AS e0, MAX(nome_qtd) AS e4 FROM joined),
elist AS (SELECT LIST_SORT(LIST_DISTINCT([e0, e1, e2, e3, e4])) AS e FROM edges),
ucount AS (SELECT state, ANY_VALUE(region) AS region, COUNT(*) AS n FROM joined GROUP BY state),
uplan AS (SELECT state, n, CASE WHEN n < {{least}} THEN CONCAT('REGIAO_', region) ELSE state END AS dest FROM ucount),
udest AS (SELECT state, CASE WHEN dest LIKE 'REGIAO_%' AND SUM(n) OVER (PARTITION BY dest) < {{least}} THEN 'MISSING' ELSE dest END AS uf FROM uplan),
frame AS (SELECT k, target AS y_true, CASE WHEN nota >= 8 THEN 1 ELSE 0 END AS y_pred,
  CONCAT('Q', CAST(GREATEST(1, LEN(LIST_FILTER(e, lambda x: x < nome_qtd))) AS VARCHAR)) AS nome_qtd_quartis,
  CASE WHEN situence IN (3, 4) THEN 'tb_origem' ELSE 'controle' END AS bandeira,
  COALESCE(CASE WHEN age >= 0 AND age < 18 THEN '0-17' WHEN age >= 18 AND age < 40 THEN '18-39' WHEN age >= 40 AND age < 60 THEN '40-59'
    WHEN age >= 60 AND age < 80 THEN '60-79' WHEN age >= 80 AND age < 130 THEN '80+' END, 'MISSING') AS faixa_idade,
  COALESCE(CASE LEFT(UPPER(sex_source), 1) WHEN 'F' THEN 'F' WHEN 'M' THEN 'M' END, 'MISSING') AS sexo, uf,
  CASE WHEN wide <= 6 THEN '0-6' WHEN wide <= 11 THEN '6-11' WHEN wide <= 25 THEN '11-25' ELSE '>25' END AS score_band
  FROM (SELECT j.*, u.uf, elist.e, DATE_DIFF('day', r_dtnasc, r_dtobito) / 365.25E0 AS age, nota * 2 AS wide
        FROM joined j JOIN udest u ON j.state = u.state, elist) t)"""
LEAST = 600


def fair_sql(least: int = LEAST) -> str:
    return FAIR_SQL.replace("{least}", str(least))


def population(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    customer = table(spark, sf_dir, "customer")
    rows = pairs(spark, sf_dir).join(customer, F.col("REFREC") == F.col("c_custkey"))
    rows = rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    segment = F.col("c_mktsegment")
    return rows.withColumns({
        "sex_source": F.when(segment == "MACHINERY", F.lit(None)).when(segment == "BUILDING", "fem").otherwise("Masc"),
        "age": F.datediff("R_DTOBITO", "R_DTNASC") / 365.25, "wide": ref("nota final") * 2,
    })


def frame(spark, sf_dir, least: int = LEAST):
    rows = population(spark, sf_dir)
    return N.fairness_frame(
        rows, "k", F.col("PAR").isin(1, 2), ref("nota final") >= 8, F.col("wide"), "NOME qtd frag iguais",
        F.col("C_SITUENCE"), F.col("age"), (F.col("sex_source"), F.lit(None).cast("string")),
        F.col("n_name"), F.col("r_name"), least,
    )


FRAME_COLUMNS = ["k", "y_true", "y_pred", "nome_qtd_quartis", "bandeira", "faixa_idade", "sexo", "uf", "score_band"]


@register("fairness_frame", f"{fair_sql()} SELECT {', '.join(FRAME_COLUMNS)} FROM frame")
def fairness_frame(spark, sf_dir):
    return frame(spark, sf_dir).select(*FRAME_COLUMNS)


_DIMS = ["nome_qtd_quartis", "bandeira", "faixa_idade", "sexo", "uf"]
_COUNTS = " UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, {d} AS "group", COUNT(*) AS n_total, SUM(y_true) AS n_true, SUM(y_pred) AS n_pred_pos,
  SUM(y_true * y_pred) AS tp, SUM(y_true * (1 - y_pred)) AS fn, SUM((1 - y_true) * y_pred) AS fp FROM frame
  WHERE {d} <> 'MISSING' GROUP BY {d} HAVING COUNT(*) >= 30""" for d in _DIMS)
_Z = "1.959963984540054E0"
_LOW = f"GREATEST(0.0E0, (({{p}}) + {_Z}*{_Z} / (2 * {{n}}) - {_Z} * SQRT((({{p}}) * (1 - ({{p}})) + {_Z}*{_Z} / (4 * {{n}})) / {{n}})) / (1 + {_Z}*{_Z} / {{n}}))"
_HIGH = f"LEAST(1.0E0, (({{p}}) + {_Z}*{_Z} / (2 * {{n}}) + {_Z} * SQRT((({{p}}) * (1 - ({{p}})) + {_Z}*{_Z} / (4 * {{n}})) / {{n}})) / (1 + {_Z}*{_Z} / {{n}}))"
METRIC_SQL = f"""{fair_sql()}, counts AS ({_COUNTS}),
rates AS (SELECT dimension, "group", n_total, 'tpr' AS metric, tp AS num, tp + fn AS den FROM counts UNION ALL
  SELECT dimension, "group", n_total, 'ppv', tp, tp + fp FROM counts)"""


@register("group_metrics", f"""{METRIC_SQL} SELECT dimension, "group", metric, n_total, CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den,
  CASE WHEN den > 0 THEN ROUND(CAST(num AS DOUBLE) / den, 6) END AS rate,
  CASE WHEN den > 0 THEN ROUND({_LOW.format(p='CAST(num AS DOUBLE) / den', n='den')}, 6) END AS wilson_low,
  CASE WHEN den > 0 THEN ROUND({_HIGH.format(p='CAST(num AS DOUBLE) / den', n='den')}, 6) END AS wilson_high FROM rates""")
def group_metrics(spark, sf_dir):
    out = N.group_metrics(N.group_counts(frame(spark, sf_dir)))
    return round_all(out.select("dimension", "group", "metric", "n_total", "num", "den", "rate", "wilson_low", "wilson_high"),
                     ["rate", "wilson_low", "wilson_high"])


PAIR_SQL = f"""{METRIC_SQL.replace(" AS (", " AS MATERIALIZED (")}, pairs2 AS MATERIALIZED (SELECT a.dimension, a.metric, a."group" AS group_a, b."group" AS group_b,
  CAST(a.num AS DOUBLE) AS a, CAST(a.den - a.num AS DOUBLE) AS b, CAST(b.num AS DOUBLE) AS c, CAST(b.den - b.num AS DOUBLE) AS d
  FROM rates a JOIN rates b ON a.dimension = b.dimension AND a.metric = b.metric AND a."group" < b."group"),
odds AS MATERIALIZED (SELECT *, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5E0 ELSE 0 END AS h,
  (a + b > 0 AND c + d > 0) AS usable,
  LEAST((a + b) * (a + c), (a + b) * (b + d), (c + d) * (a + c), (c + d) * (b + d)) / (a + b + c + d) AS expected,
  (a + b) * (c + d) * (a + c) * (b + d) AS product, (a + b + c + d) * (a * d - b * c) * (a * d - b * c) AS top FROM pairs2)"""


@register("pairwise_tests", f"""{PAIR_SQL} SELECT dimension, metric, group_a, group_b,
  CASE WHEN NOT usable THEN 'skipped' WHEN expected < 5 OR product <= 0 THEN 'fisher' ELSE 'chi2' END AS test,
  CASE WHEN usable AND expected >= 5 AND product > 0 THEN ROUND(top / product, 4) END AS test_statistic,
  CASE WHEN usable THEN ROUND((a + h) * (d + h) / ((b + h) * (c + h)), 5) END AS odds_ratio,
  CASE WHEN usable THEN ROUND(EXP(LN((a + h) * (d + h) / ((b + h) * (c + h))) - {_Z} * SQRT(1 / (a + h) + 1 / (b + h) + 1 / (c + h) + 1 / (d + h))), 5) END AS or_ci_low,
  CASE WHEN usable THEN ROUND(a / (a + b) - c / (c + d), 6) END AS rate_diff,
  CASE WHEN usable THEN ROUND({_LOW.format(p='a / (a + b)', n='(a + b)')} - {_HIGH.format(p='c / (c + d)', n='(c + d)')}, 6) END AS rate_diff_ci_low
FROM odds""")
def pairwise_tests(spark, sf_dir):
    out = N.pairwise_tests(N.group_counts(frame(spark, sf_dir))).select(
        "dimension", "metric", "group_a", "group_b", "test", F.round("test_statistic", 4).alias("test_statistic"),
        F.round("odds_ratio", 5).alias("odds_ratio"), F.round("or_ci_low", 5).alias("or_ci_low"),
        "rate_diff", "rate_diff_ci_low")
    return round_all(out, ["rate_diff", "rate_diff_ci_low"])


@register("adjusted_tests")
def adjusted_tests(spark, sf_dir):
    """p-values of all pairwise tests with their false-discovery adjustment."""
    return N.pairwise_tests(N.group_counts(frame(spark, sf_dir))).select(
        "dimension", "metric", "group_a", "group_b", "test", "p_value_raw", "p_value_fdr", "reject_fdr")


@register("false_discovery_adjustment", f"""{SCORED_SQL}, t AS (SELECT passo * 10 + situence AS id, AVG(q) * AVG(p) AS p FROM scored
  WHERE situence IS NOT NULL GROUP BY passo, situence), r AS (SELECT id, p, ROW_NUMBER() OVER (ORDER BY p, id) AS rn, COUNT(*) OVER () AS m FROM t)
SELECT id, ROUND(p, 6) AS p, ROUND(LEAST(1.0E0, MIN(p * m / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS adjusted FROM r""")
def false_discovery_adjustment(spark, sf_dir):
    tests = scored(spark, sf_dir).filter("situence is not null").groupBy("passo", "situence").agg(
        (F.avg("q") * F.avg("p")).alias("p")).select((F.col("passo") * 10 + F.col("situence")).alias("id"), "p")
    return round_all(N.benjamini_hochberg(tests, "p", "adjusted", ["id"]), ["p", "adjusted"])


@register("band_stability", f"""{fair_sql()}, b AS (SELECT UNNEST(['0-6', '6-11', '11-25', '>25']) AS score_band),
c AS (SELECT b.score_band, COUNT(k) AS n_rows, COALESCE(SUM(y_true * y_pred), 0) AS tp, COALESCE(SUM((1 - y_true) * y_pred), 0) AS fp,
  COALESCE(SUM(y_true * (1 - y_pred)), 0) AS fn, COALESCE(SUM((1 - y_true) * (1 - y_pred)), 0) AS tn
  FROM b LEFT JOIN frame f ON b.score_band = f.score_band GROUP BY b.score_band)
SELECT score_band, n_rows, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
  CASE WHEN tp + fn > 0 THEN ROUND(CAST(tp AS DOUBLE) / (tp + fn), 6) END AS tpr, CASE WHEN tp + fp > 0 THEN ROUND(CAST(tp AS DOUBLE) / (tp + fp), 6) END AS ppv FROM c""")
def band_stability(spark, sf_dir):
    out = N.band_stability(frame(spark, sf_dir)).select("score_band", "n_rows", "tp", "fp", "fn", "tn", "tpr", "ppv")
    return round_all(out, ["tpr", "ppv"])


@register("small_group_notes", f"""{fair_sql()}, moved AS (SELECT state AS original_uf, n AS rows, region, 'aggregated_to_region' AS action FROM ucount WHERE n < {LEAST}),
gone AS (SELECT CONCAT('REGIAO_', region) AS original_uf, CAST(SUM(rows) AS BIGINT) AS rows, region, 'collapsed_to_missing_due_small_region' AS action
  FROM moved GROUP BY region HAVING SUM(rows) < {LEAST})
SELECT * FROM moved UNION ALL SELECT * FROM gone""")
def small_group_notes(spark, sf_dir):
    return N.collapse_notes(population(spark, sf_dir), "n_name", F.col("r_name"), LEAST)


@register("wilson_rates", f"""{SCORED_SQL}, c AS (SELECT passo, SUM(target) AS s, COUNT(*) AS n FROM scored GROUP BY passo)
SELECT passo, ROUND({_LOW.format(p='CAST(s AS DOUBLE) / n', n='n')}, 6) AS low, ROUND({_HIGH.format(p='CAST(s AS DOUBLE) / n', n='n')}, 6) AS high FROM c""")
def wilson_rates(spark, sf_dir):
    counts = scored(spark, sf_dir).groupBy("passo").agg(F.sum("target").alias("s"), F.count("*").alias("n"))
    low, high = I.wilson(F.col("s"), F.col("n"))
    return counts.select("passo", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register("reviewer_kappa", f"""{SCORED_SQL}, c AS (SELECT k % 3 AS a, (k + CASE WHEN q < 0.3 THEN 1 ELSE 0 END) % 3 AS b FROM scored),
n AS (SELECT COUNT(*) AS n, SUM(CASE WHEN a = b THEN 1 ELSE 0 END) AS agree FROM c),
e AS (SELECT SUM(CAST(x.n AS DOUBLE) * y.n) AS e FROM (SELECT a, COUNT(*) AS n FROM c GROUP BY a) x JOIN (SELECT b, COUNT(*) AS n FROM c GROUP BY b) y ON a = b)
SELECT n, ROUND(CAST(agree AS DOUBLE) / n, 6) AS observed, ROUND(e / n / n, 6) AS expected,
  ROUND((CAST(agree AS DOUBLE) / n - e / n / n) / (1 - e / n / n), 6) AS kappa FROM n, e""")
def reviewer_kappa(spark, sf_dir):
    rows = scored(spark, sf_dir).select((F.col("k") % 3).alias("a"), ((F.col("k") + F.when(F.col("q") < 0.3, 1).otherwise(0)) % 3).alias("b"))
    return round_all(N.kappa(rows, "a", "b"), ["observed", "expected", "kappa"])


@register("bootstrap_fbeta", f"""{SCORED_SQL}, c AS (SELECT passo, target AS y, COUNT(*) AS n, SUM(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS h FROM scored GROUP BY 1, 2),
d AS (SELECT *, CAST(h AS DOUBLE) / n AS p, 9.0E0 * (SQRT(n * (CAST(h AS DOUBLE) / n) * (1 - CAST(h AS DOUBLE) / n)) + 1) AS reach FROM c),
w AS (SELECT *, CASE WHEN h > 0 AND h < n THEN CAST(GREATEST(0, FLOOR(n * p - reach)) AS BIGINT) ELSE CAST(h AS BIGINT) END AS low,
  CASE WHEN h > 0 AND h < n THEN CAST(LEAST(n, CEIL(n * p + reach)) AS BIGINT) ELSE CAST(h AS BIGINT) END AS high FROM d),
k AS (SELECT *, UNNEST(RANGE(low, high + 1)) AS k FROM w),
l AS (SELECT *, SUM(CASE WHEN k = low THEN 0.0E0 ELSE LN(CAST(n - k + 1 AS DOUBLE) / k) + LN(p / (1 - p)) END) OVER (PARTITION BY passo, y ORDER BY k) AS lg FROM k),
e AS (SELECT *, EXP(lg - MAX(lg) OVER (PARTITION BY passo, y)) AS v FROM l),
t AS (SELECT *, SUM(v) OVER (PARTITION BY passo, y ORDER BY k) / SUM(v) OVER (PARTITION BY passo, y) AS cdf FROM e),
u AS (SELECT passo, y, n, high, low, r, CAST(CAST('0x' || SUBSTR(MD5(CONCAT('0|', COALESCE(CAST(passo AS VARCHAR), ''), '|', CAST(y AS VARCHAR), '|', CAST(r AS VARCHAR))), 1, 7) AS BIGINT) AS DOUBLE) / 268435456.0E0 AS u
  FROM (SELECT *, UNNEST(RANGE(1, 1001)) AS r FROM w) x),
m AS (SELECT u.y, u.r, u.n, LEAST(u.low + (SELECT COUNT(*) FROM t WHERE t.passo IS NOT DISTINCT FROM u.passo AND t.y = u.y AND t.cdf <= u.u), u.high) AS drawn FROM u),
f AS (SELECT r, SUM(CASE WHEN y = 1 THEN drawn ELSE 0 END) AS tp, SUM(CASE WHEN y = 0 THEN drawn ELSE 0 END) AS fp, SUM(CASE WHEN y = 1 THEN n - drawn ELSE 0 END) AS fn FROM m GROUP BY r),
b AS (SELECT CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5.0E0 * tp / (5 * tp + 4 * fn + fp) ELSE 0 END AS f FROM f)
SELECT COUNT(*) AS n, ROUND(QUANTILE_CONT(f, 0.025), 6) AS low, ROUND(QUANTILE_CONT(f, 0.5), 6) AS middle, ROUND(QUANTILE_CONT(f, 0.975), 6) AS high FROM b""")
def bootstrap_fbeta(spark, sf_dir):
    """Percentile interval of F2 over 1,000 resamples, stratified by step and label."""
    from pairsieve.operators.histograms import exact_quantiles
    from pairsieve.operators.metrics import add_rates

    rows = scored(spark, sf_dir).select("passo", "target", (F.col("p") >= 0.5).cast("int").alias("hit"))
    counts = add_rates(bootstrap_confusion(rows, "target", "hit", ["passo"]), beta=2.0)
    return round_all(exact_quantiles(counts, "fbeta", {"low": 0.025, "middle": 0.5, "high": 0.975}), ["low", "middle", "high"])


# Drift: events before and from the sixteenth, values per event type.
DRIFT_SQL = """WITH base AS (SELECT event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00'),
curr AS (SELECT event_type, value * 1.05E0 + 1 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00')"""


def drift_sides(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    base = events.filter(F.col("ts") < cut).select("event_type", "value")
    current = events.filter(F.col("ts") >= cut).select("event_type", (F.col("value") * 1.05 + 1).alias("value"))
    return base, current


_KS = """h AS (SELECT {g} value, SUM(b) AS b, SUM(c) AS c FROM (SELECT event_type, value, 1 AS b, 0 AS c FROM base UNION ALL SELECT event_type, value, 0, 1 FROM curr) u GROUP BY {g} value),
w AS (SELECT {g} CAST(SUM(b) OVER (PARTITION BY {p} ORDER BY value) AS DOUBLE) / SUM(b) OVER (PARTITION BY {p}) AS fb,
  CAST(SUM(c) OVER (PARTITION BY {p} ORDER BY value) AS DOUBLE) / SUM(c) OVER (PARTITION BY {p}) AS fc FROM h)"""


@register("ks_drift", f"""{DRIFT_SQL}, {_KS.format(g='event_type,', p='event_type')}
SELECT event_type, ROUND(MAX(ABS(fb - fc)), 6) AS ks FROM w GROUP BY event_type""")
def ks_drift(spark, sf_dir):
    return round_all(D.ks(*drift_sides(spark, sf_dir), "value", ["event_type"]), ["ks"])


_PTS = ", ".join(f"QUANTILE_CONT(value, {i / 10})" for i in range(11))
PSI_SQL = f"""{DRIFT_SQL}, e AS (SELECT event_type, LIST_SORT(LIST_DISTINCT([{_PTS}])) AS e FROM base GROUP BY event_type),
s AS (SELECT event_type, 'e' AS side, value FROM base UNION ALL SELECT event_type, 'a', value FROM curr),
b AS (SELECT s.event_type, side, LEN(e) AS edges, CASE WHEN value >= e[1] AND value <= e[-1] THEN
  LEAST(LEN(LIST_FILTER(e, lambda x: x <= value)), LEN(e) - 1) ELSE 0 END AS bin FROM s JOIN e ON s.event_type = e.event_type),
n AS (SELECT event_type, SUM(CASE WHEN side = 'e' THEN 1 ELSE 0 END) AS ne, SUM(CASE WHEN side = 'a' THEN 1 ELSE 0 END) AS na, MAX(edges) AS edges FROM b GROUP BY event_type),
bins AS (SELECT event_type, ne, na, UNNEST(RANGE(1, edges)) AS bin FROM n),
c AS (SELECT bins.event_type, bins.bin, (SUM(CASE WHEN side = 'e' THEN 1 ELSE 0 END) + 0.000001E0) / ANY_VALUE(ne) AS fe,
  (SUM(CASE WHEN side = 'a' THEN 1 ELSE 0 END) + 0.000001E0) / ANY_VALUE(na) AS fa
  FROM bins LEFT JOIN b ON b.event_type = bins.event_type AND b.bin = bins.bin GROUP BY bins.event_type, bins.bin)
SELECT event_type, ROUND(SUM((fa - fe) * LN(fa / fe)), 6) AS psi FROM c GROUP BY event_type"""


@register("psi_drift", PSI_SQL)
def psi_drift(spark, sf_dir):
    return round_all(D.psi(*drift_sides(spark, sf_dir), "value", ["event_type"]), ["psi"])


MONITOR = Monitoring(True, {"ks": {"threshold_warn": 0.02, "threshold_critical": 0.2},
                            "psi": {"threshold_warn": 0.01, "threshold_critical": 0.25}}, ("event_type",), ("value", "absent"))


def drift_rows_sql(slices: bool) -> str:
    """Both statistics with their status, for all events or per event type."""
    sides = DRIFT_SQL if slices else DRIFT_SQL.replace("SELECT event_type,", "SELECT 'all' AS event_type,")
    values = {
        "ks": f"{sides}, {_KS.format(g='event_type,', p='event_type')} SELECT event_type, MAX(ABS(fb - fc)) AS v FROM w GROUP BY event_type",
        "psi": PSI_SQL.replace(DRIFT_SQL, sides).replace("ROUND(SUM((fa - fe) * LN(fa / fe)), 6) AS psi", "SUM((fa - fe) * LN(fa / fe)) AS v"),
    }
    limit = lambda metric, name: MONITOR.metrics[metric][f"threshold_{name}"]
    return " UNION ALL ".join(
        f"""SELECT '{metric}' AS metric, v AS value, CASE WHEN v >= {limit(metric, 'critical')} THEN 'critical' WHEN v >= {limit(metric, 'warn')} THEN 'warning' ELSE 'ok' END AS status,
  'value' AS feature, '{'event_type' if slices else 'global'}' AS slice_name, event_type AS slice_value FROM ({sql}) {metric}""" for metric, sql in values.items())


@register("drift_report", f"SELECT metric, feature, slice_name, slice_value, ROUND(value, 6) AS value, status FROM ({drift_rows_sql(False)} UNION ALL {drift_rows_sql(True)}) d")
def drift_report(spark, sf_dir):
    return round_all(D.check_drift(*drift_sides(spark, sf_dir), MONITOR, ["event_type"]), ["value"])


@register("drift_alerts", f"""SELECT feature, metric, CONCAT('Drift alert: ', UPPER(metric), ' for value is ', PRINTF('%.3f', value), ' (', status, ')') AS alert
FROM ({drift_rows_sql(False)} UNION ALL {drift_rows_sql(True)}) d WHERE status IN ('warning', 'critical')""")
def drift_alerts(spark, sf_dir):
    return D.alerts(D.check_drift(*drift_sides(spark, sf_dir), MONITOR, ["event_type"]))


@register("drift_actions", f"""WITH c AS (SELECT COALESCE(MAX(CASE WHEN status = 'critical' THEN 1 ELSE 0 END), 0) AS hit FROM ({drift_rows_sql(False)}) d)
SELECT 'vigilancia' AS mode, CASE WHEN hit = 1 THEN 0.90E0 ELSE 0.85E0 END AS min_auto_match, CASE WHEN hit = 1 THEN 0.10E0 ELSE 0.15E0 END AS max_auto_nonmatch,
  hit = 1 AS frozen FROM c""")
def drift_actions(spark, sf_dir):
    """What the next window's thresholds are after the drift found in the events."""
    metrics = D.check_drift(*drift_sides(spark, sf_dir), MONITOR)
    monitor = Monitoring(True, MONITOR.metrics, (), MONITOR.fields, ("tighten_auto_thresholds", "freeze_calibration"))
    mode, frozen = D.after_drift(SETTINGS.mode("vigilancia"), monitor, D.critical(metrics))
    return small_table(spark, [("vigilancia", round(mode.min_auto_match, 6), round(mode.max_auto_nonmatch, 6), frozen)],
                       "mode string, min_auto_match double, max_auto_nonmatch double, frozen boolean")


VALUES, QS = K.FAMILIES, [2, 3, 4]
_SUMS = {
    "nome_total": "nome_prim + nome_ult + nome_qtd + nome_parec",
    "mae_total": "mae_prim + mae_ult + COALESCE(mae_qtd, 0.0E0)",
    "dtnasc_total": "dt_iguais + dt_ap1 + dt_inv_dia + dt_inv_mes + dt_inv_ano",
    "local_total": "uf_igual + mun_igual + mun_prox",
    "endereco_total": "via_igual + via_prox + num_igual + compl_prox + texto_prox + tokens_jacc", "nota_final": "nota",
}


def _bin_sql(value: str, q: int) -> str:
    rank = f"(ROW_NUMBER() OVER (ORDER BY {value}, k) - 1)"
    cap = f"LEAST({q}, (SELECT COUNT(DISTINCT {value}) FROM fam))"
    return f"CONCAT('Q', CAST(GREATEST(1, CAST(CEIL(CAST({rank} * {cap} AS DOUBLE) / (COUNT(*) OVER () - 1)) AS INT)) AS VARCHAR)) AS {value}_q{q}"


BIN_SQL = f"""{WITH_PAIRS}, fam AS (SELECT k, passo, {', '.join(f'{e} AS {n}' for n, e in _SUMS.items())} FROM pairs),
bins AS (SELECT k, passo, {', '.join(_bin_sql(v, q) for v in VALUES for q in QS)} FROM fam)"""


@register("quantile_bins", f"{BIN_SQL} SELECT k, nome_total_q2, nome_total_q3, nome_total_q4 FROM bins")
def quantile_bins(spark, sf_dir):
    fam = K.families(pairs(spark, sf_dir), ["k"])
    return K.rank_bins(fam, ["nome_total"], "k", QS).select("k", *[f"nome_total_q{q}" for q in QS])


def cells(spark, sf_dir):
    fam = K.families(pairs(spark, sf_dir).withColumnRenamed("PASSO", "passo"), ["k", "passo"])
    return K.finest_cells(fam, "k", "passo", VALUES, QS)


_Q4 = [f"{v}_q4" for v in VALUES]


@register("family_group_statistics", f"""{BIN_SQL}, g AS (SELECT COUNT(*) AS n FROM bins GROUP BY passo, {', '.join(_Q4)})
SELECT COUNT(*) AS groups, MIN(n) AS k_min, CAST(SUM(CASE WHEN n < 5 THEN 1 ELSE 0 END) AS BIGINT) AS groups_lt5 FROM g""")
def family_group_statistics(spark, sf_dir):
    return K.group_statistics(cells(spark, sf_dir), ["passo", *_Q4], "n")


@register("smallest_groups", f"""{BIN_SQL} SELECT passo, {', '.join(_Q4)}, COUNT(*) AS n FROM bins GROUP BY ALL
ORDER BY n, passo, {', '.join(_Q4)} LIMIT 20""")
def smallest_groups(spark, sf_dir):
    return K.smallest_groups(cells(spark, sf_dir), ["passo", *_Q4], 20, "n")


_OPTIONS = {v: " UNION ALL ".join([f"SELECT '0' AS q{i}, 0 AS u{i}"] + [f"SELECT '{q}', {q}" for q in QS]) for i, v in enumerate(VALUES)}
_CELL = ", ".join(f"CASE q{i} WHEN '0' THEN '' WHEN '2' THEN {v}_q2 WHEN '3' THEN {v}_q3 ELSE {v}_q4 END" for i, v in enumerate(VALUES))


@register("schema_search", f"""{BIN_SQL}, cells AS (SELECT * EXCLUDE (k), COUNT(*) AS n FROM bins GROUP BY ALL),
cand AS (SELECT CONCAT({', '.join(f'q{i}' for i in range(6))}) AS schema, {', '.join(f'q{i}' for i in range(6))}
  FROM {', '.join(f'({o}) t{i}' for i, o in enumerate(_OPTIONS.values()))}),
g AS (SELECT schema, passo, CONCAT_WS('|', {_CELL}) AS cell, SUM(n) AS n FROM cells, cand WHERE schema <> '000000' GROUP BY ALL),
s AS (SELECT schema, COUNT(*) AS groups, CAST(MIN(n) AS BIGINT) AS k_min, CAST(SUM(CASE WHEN n < 5 THEN 1 ELSE 0 END) AS BIGINT) AS groups_lt5 FROM g GROUP BY schema)
SELECT schema, groups, k_min, groups_lt5, CAST(LENGTH(REPLACE(schema, '0', '')) AS INT) AS columns,
  CAST(LIST_SUM(LIST_TRANSFORM(STRING_SPLIT(schema, ''), lambda c: CAST(c AS INT))) AS INT) AS bins FROM s WHERE k_min >= 5
ORDER BY groups DESC, columns DESC, bins DESC, REGEXP_REPLACE(schema, '[1-9]', '1', 'g') DESC, schema LIMIT 1""")
def schema_search(spark, sf_dir):
    return K.best_schema(cells(spark, sf_dir), "passo", VALUES, QS)


@register("generalisation_ladder")
def generalisation_ladder(spark, sf_dir):
    return K.generalisation_ladder(pairs(spark, sf_dir).withColumnRenamed("PASSO", "passo"), "k", "passo")
