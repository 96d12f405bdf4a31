"""Registered queries: parsing, feature projections, scans' expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsieve import columns as C
from pairsieve.functions import values as V
from pairsieve.functions.values import ref
from pairsieve.operators import features as X
from pairsieve.operators.dossier import config_label, pair_id
from pairsieve.plans.registry import register, table
from pairsieve.plans.views import FEATURES_SQL, PAIRS_SQL, dates_as_text, pairs

WITH_PAIRS = f"WITH pairs AS ({PAIRS_SQL})"


def rounded(df, names, digits=6):
    """Round the listed doubles for output."""
    return df.withColumns({n: F.round(ref(n), digits) for n in names})


RAW_SQL = f"""{WITH_PAIRS},
raw AS (SELECT k, REPLACE(CAST(k % 997 AS VARCHAR(20)), '7', ',') AS amount,
  CASE WHEN k % 10 = 0 THEN '00000000' WHEN k % 10 = 1 THEN 'x' WHEN k % 10 = 2 THEN '1990/02/30'
       WHEN k % 10 = 3 THEN '9800101' WHEN k % 10 = 4 THEN NULL
       ELSE CONCAT(CAST(1940 + k % 70 AS VARCHAR(4)), '-', LPAD(CAST(1 + k % 12 AS VARCHAR(2)), 2, '0'), '-',
                   LPAD(CAST(1 + k % 28 AS VARCHAR(2)), 2, '0')) END AS ymd,
  CASE WHEN k % 9 = 0 THEN '1012020' WHEN k % 9 = 1 THEN '32012020' WHEN k % 9 = 2 THEN ''
       ELSE CONCAT(LPAD(CAST(1 + k % 28 AS VARCHAR(2)), 2, '0'), '/', LPAD(CAST(1 + k % 12 AS VARCHAR(2)), 2, '0'),
                   '/', CAST(1990 + k % 30 AS VARCHAR(4))) END AS dmy
FROM pairs)"""


def raw_rows(spark, sf_dir):
    text = f"{RAW_SQL} SELECT * FROM raw".replace("FROM orders", "FROM {orders}").replace(
        "VARCHAR(20)", "STRING").replace("VARCHAR(4)", "STRING").replace("VARCHAR(2)", "STRING")
    return spark.sql(text, orders=table(spark, sf_dir, "orders"))


_SAFE_DATE = """CASE WHEN {d} IS NOT NULL AND LENGTH({d}) > 0 AND {e} <> '00000000'
  THEN TRY_CAST(CONCAT({y}, '-', {m}, '-', {a}) AS DATE) END"""


def _date_sql(column: str, ymd: bool) -> str:
    digits = f"REGEXP_REPLACE({column}, '[^0-9]', '', 'g')"
    eight = f"SUBSTR(CASE WHEN LENGTH({digits}) < 8 THEN LPAD({digits}, 8, '0') ELSE {digits} END, 1, 8)"
    spots = [(1, 4), (5, 2), (7, 2)] if ymd else [(5, 4), (3, 2), (1, 2)]
    y, m, a = (f"SUBSTR({eight}, {at}, {n})" for at, n in spots)
    return _SAFE_DATE.format(d=digits, e=eight, y=y, m=m, a=a)


@register("lenient_parsing", f"""{RAW_SQL}
SELECT k, ROUND(TRY_CAST(REPLACE(amount, ',', '.') AS DOUBLE), 6) AS amount,
  {_date_sql('ymd', True)} AS ymd, {_date_sql('dmy', False)} AS dmy FROM raw""")
def lenient_parsing(spark, sf_dir):
    raw = raw_rows(spark, sf_dir)
    return raw.select(
        "k", F.round(V.decimal_comma(F.col("amount")), 6).alias("amount"),
        V.compact_date(raw, "ymd", "ymd").alias("ymd"), V.compact_date(raw, "dmy", "dmy").alias("dmy"),
    )


@register("strict_date_variants", f"""{WITH_PAIRS}
SELECT k, r_dtnasc AS by_number, CASE WHEN k % 3 = 0 THEN r_dtnasc END AS strict_eight,
  r_dtobito AS before_dot FROM pairs""")
def strict_date_variants(spark, sf_dir):
    raw = dates_as_text(pairs(spark, sf_dir))
    number = F.concat(F.col("R_DTNASC"), F.lit(",0"))
    eight = F.when(F.col("k") % 3 == 0, F.col("R_DTNASC")).otherwise(F.substring("R_DTNASC", 2, 7))
    dotted = F.concat(F.col("R_DTOBITO"), F.lit(".0"))
    return raw.select(
        "k", V.date_by_number(number, "ymd").alias("by_number"),
        V.date_strict_eight(eight).alias("strict_eight"), V.date_before_dot(dotted).alias("before_dot"),
    )


SCORE_FEATURES = ["nome_score_total", "mae_score_total", "dtnasc_score_total", "endereco_score_total"]


@register("pair_features", f"""WITH {FEATURES_SQL}
SELECT k, target, diff_ano, dtnasc_all_zero, mae_missing, endereco_zero, municipio_score,
  CASE WHEN nome_prim >= 1 THEN 1.0E0 ELSE 0.0E0 END + CASE WHEN dt_iguais >= 1 THEN 1.0E0 ELSE 0.0E0 END
  + CASE WHEN mun_igual >= 1 THEN 1.0E0 ELSE 0.0E0 END AS score_regras,
  {', '.join(f'ROUND({n}, 6) AS {n}' for n in SCORE_FEATURES)} FROM features""")
def pair_feature_rows(spark, sf_dir):
    wide = X.pair_features(pairs(spark, sf_dir), birth_distance=False)
    out = wide.select("k", F.col("TARGET").alias("target"), "diff_ano", "dtnasc_all_zero", "mae_missing",
                      "endereco_zero", "municipio_score", "score_regras", *SCORE_FEATURES)
    return rounded(out, SCORE_FEATURES)


@register("birth_distance_features", f"""{WITH_PAIRS}, d AS (
SELECT k, ABS(DATE_DIFF('day', r_dtnasc, c_dtnasc)) AS days, nome_qtd >= 0.95E0 AND nome_prim >= 1 AND nome_ult >= 1 AS perfect,
  COALESCE(CAST(EXTRACT(YEAR FROM r_dtnasc) = EXTRACT(YEAR FROM c_dtnasc) AS INT), 0) AS y,
  COALESCE(CAST(EXTRACT(MONTH FROM r_dtnasc) = EXTRACT(MONTH FROM c_dtnasc) AS INT), 0) AS m,
  COALESCE(CAST(EXTRACT(DAY FROM r_dtnasc) = EXTRACT(DAY FROM c_dtnasc) AS INT), 0) AS d FROM pairs)
SELECT k, CASE WHEN days IS NOT NULL THEN ROUND(LEAST(days / 365.25E0, 20.0E0), 6) END AS macd_nasc_diff_capped,
  y AS macd_nasc_year_match, m AS macd_nasc_month_match, d AS macd_nasc_day_match,
  ROUND((y + m + d) / 3.0E0, 6) AS macd_nasc_partial_overlap,
  COALESCE(CAST(days <= 30 AS INT), 0) AS macd_nasc_close, COALESCE(CAST(days <= 7 AS INT), 0) AS macd_nasc_very_close,
  COALESCE(CAST(perfect AND days / 365.25E0 >= 5 AS INT), 0) AS macd_nome_perf_x_date_far,
  CASE WHEN perfect THEN ROUND(LEAST(COALESCE(days / 365.25E0, 0.0E0), 20.0E0), 6) ELSE 0.0E0 END AS macd_nome_perf_x_year_diff
FROM d""")
def birth_distance_rows(spark, sf_dir):
    wide = X.pair_features(pairs(spark, sf_dir))
    real = [X.BIRTH_DISTANCE[i] for i in (0, 4, 8)]
    return rounded(wide.select("k", *X.BIRTH_DISTANCE), real)


ENGINEERED = {
    "nome_total": "nome_prim + nome_ult + nome_qtd + nome_parec",
    "mae_total": "mae_prim + mae_ult + m", "dtnasc_total": "dt_iguais + dt_ap1 * 0.8E0 + dt_inv_dia * 0.5E0",
    "endereco_total": "via_igual + via_prox * 0.7E0 + texto_prox", "local_total": "mun_igual + mun_prox * 0.5E0",
    "score_recall": "nome_qtd * 3 + nome_prim * 2 + dt_iguais * 2.5E0 + dt_ap1 * 2 + m * 1.5E0 + mun_igual + via_igual * 0.5E0",
    "nome_x_dtnasc": "nome_qtd * (dt_iguais + dt_ap1)", "nome_x_mae": "nome_qtd * m",
    "nome_x_local": "nome_qtd * mun_igual",
    "dtnasc_x_local": "(dt_iguais + dt_ap1 * 0.8E0 + dt_inv_dia * 0.5E0) * (mun_igual + mun_prox * 0.5E0)",
    "nome_x_endereco": "(nome_prim + nome_ult + nome_qtd + nome_parec) * (via_igual + via_prox * 0.7E0 + texto_prox)",
    "nome_bom": "CAST(nome_qtd >= 0.7E0 AS INT)", "nome_prim_ok": "CAST(nome_prim >= 0.8E0 AS INT)",
    "dtnasc_ok": "CAST(dt_iguais = 1 OR dt_ap1 = 1 AS INT)",
    "dtnasc_parcial": "CAST(dt_inv_dia = 1 OR dt_inv_mes = 1 AS INT)", "mae_presente": "CAST(m > 0.3E0 AS INT)",
    "local_ok": "CAST(mun_igual >= 0.8E0 AS INT)",
    "evidencias_positivas": "CAST(nome_qtd >= 0.7E0 AS INT) + CAST(nome_prim >= 0.8E0 AS INT)"
    " + CAST(dt_iguais = 1 OR dt_ap1 = 1 AS INT) + CAST(dt_inv_dia = 1 OR dt_inv_mes = 1 AS INT)"
    " + CAST(m > 0.3E0 AS INT) + CAST(mun_igual >= 0.8E0 AS INT)",
    "min_score_nome": "LEAST(nome_prim, nome_ult, nome_qtd)", "max_score_dtnasc": "GREATEST(dt_iguais, dt_ap1)",
    "ratio_nome_mae": "(nome_prim + nome_ult + nome_qtd + nome_parec) / (mae_prim + mae_ult + m + 0.1E0)",
    "ratio_nome_nota": "(nome_prim + nome_ult + nome_qtd + nome_parec) / (nota + 0.1E0)",
    "obito_sinan": "COALESCE(CAST(situence IN (3, 4) AS INT), 0)", "obito_tb": "COALESCE(CAST(situence = 3 AS INT), 0)",
    "diff_ano_nasc": "COALESCE(CAST(ABS(EXTRACT(YEAR FROM r_dtnasc) - EXTRACT(YEAR FROM c_dtnasc)) AS DOUBLE), 99.0E0)",
    "diff_ano_ok": "COALESCE(CAST(ABS(EXTRACT(YEAR FROM r_dtnasc) - EXTRACT(YEAR FROM c_dtnasc)) <= 5 AS INT), 0)",
    "nome_squared": "nome_qtd * nome_qtd", "dtnasc_squared": "dt_iguais * dt_iguais", "nota_squared": "nota * nota",
}
REAL = {"nome_total", "mae_total", "dtnasc_total", "endereco_total", "local_total", "score_recall",
        "nome_x_dtnasc", "nome_x_mae", "nome_x_local", "dtnasc_x_local", "nome_x_endereco",
        "min_score_nome", "max_score_dtnasc", "ratio_nome_mae", "ratio_nome_nota", "nome_squared",
        "dtnasc_squared", "nota_squared"}


@register("model_features", f"""{WITH_PAIRS}, p AS (SELECT pairs.*, COALESCE(mae_qtd, 0.0E0) AS m FROM pairs)
SELECT k, CASE WHEN par IN (1, 2) THEN 1 ELSE 0 END AS y, ROUND(m, 6) AS mae_qtd, ROUND(nota, 6) AS nota,
{', '.join((f'ROUND({e}, 6)' if n in REAL else e) + f' AS {n}' for n, e in ENGINEERED.items())} FROM p""")
def model_feature_rows(spark, sf_dir):
    wide = X.model_features(pairs(spark, sf_dir), ["k"])
    out = wide.select("k", "y", ref(C.MOTHER_COUNT).alias("mae_qtd"), ref(C.SCORE).alias("nota"), *X.ENGINEERED)
    return rounded(out, ["mae_qtd", "nota", *[n for n in X.ENGINEERED if n in REAL]])


@register("first_study_features", f"""{WITH_PAIRS}, p AS (SELECT pairs.*, COALESCE(mae_qtd, 0.0E0) AS m FROM pairs)
SELECT k, ROUND(nome_prim + nome_ult + nome_qtd, 6) AS nome_score_total, ROUND(mae_prim + mae_ult + m, 6) AS mae_score_total,
  ROUND(dt_iguais + dt_ap1 + dt_inv_dia + dt_inv_mes, 6) AS dtnasc_score_total,
  ROUND(via_igual + via_prox + texto_prox, 6) AS endereco_score_total, ROUND(nome_qtd * dt_iguais, 6) AS nome_x_dtnasc,
  ROUND(nome_qtd * m, 6) AS nome_x_mae, ROUND(nome_qtd * (via_igual + via_prox + texto_prox), 6) AS nome_x_endereco,
  CAST(nome_qtd >= 0.95E0 AS INT) AS nome_perfeito, CAST(dt_iguais = 1 AS INT) AS dtnasc_perfeito,
  CAST(m > 0 AS INT) AS mae_presente, CAST(via_igual > 0 AS INT) AS endereco_match,
  COALESCE(CAST(situence IN (3, 4) AS INT), 0) AS obito_sinan FROM p""")
def first_study_rows(spark, sf_dir):
    out = X.first_study_features(pairs(spark, sf_dir), ["k"])
    return rounded(out, ["nome_score_total", "mae_score_total", "dtnasc_score_total", "endereco_score_total",
                         "nome_x_dtnasc", "nome_x_mae", "nome_x_endereco"])


@register("precision_features", f"""{WITH_PAIRS}, p AS (SELECT pairs.*, COALESCE(mae_qtd, 0.0E0) AS m,
  COALESCE(CAST(ABS(EXTRACT(YEAR FROM r_dtnasc) - EXTRACT(YEAR FROM c_dtnasc)) AS DOUBLE), 99.0E0) AS gap FROM pairs),
f AS (SELECT k, nome_prim * 0.3E0 + nome_ult * 0.3E0 + nome_qtd * 0.4E0 AS nome_total,
  mae_prim * 0.25E0 + mae_ult * 0.25E0 + m * 0.5E0 AS mae_total, CAST(nome_qtd >= 0.95E0 AS INT) AS nome_perfeito,
  CAST(nome_qtd >= 0.85E0 AS INT) AS nome_excelente, CAST(dt_iguais = 1 AS INT) AS dtnasc_exato,
  CAST(dt_iguais = 1 OR dt_ap1 = 1 AS INT) AS dtnasc_quase, CAST(m >= 0.6E0 AS INT) AS mae_forte,
  CAST(mun_igual = 1 AS INT) AS local_exato, CAST(via_igual = 1 AS INT) AS endereco_match,
  LEAST(nome_qtd, dt_iguais) AS min_nome_dtnasc, gap, nota FROM p)
SELECT k, ROUND(nome_total, 6) AS nome_total, ROUND(mae_total, 6) AS mae_total, nome_excelente, dtnasc_quase,
  ROUND(nome_perfeito * 3 + dtnasc_exato * 3 + mae_forte * 2 + local_exato * 1.5E0 + endereco_match, 6) AS score_precisao,
  nome_perfeito + dtnasc_exato + mae_forte + local_exato + endereco_match AS criterios_fortes,
  ROUND(LEAST(nome_total, mae_total), 6) AS min_nome_mae, ROUND(min_nome_dtnasc, 6) AS min_nome_dtnasc,
  nome_perfeito * mae_forte AS nome_e_mae, dtnasc_exato * local_exato AS dtnasc_e_local,
  nome_perfeito * dtnasc_exato * mae_forte AS trifecta, CAST(gap <= 2 AS INT) AS ano_consistente,
  ROUND(nota * nota * nota, 6) AS nota_cubed FROM f""")
def precision_rows(spark, sf_dir):
    out = X.precision_features(pairs(spark, sf_dir), ["k"]).select(
        "k", "nome_total", "mae_total", "nome_excelente", "dtnasc_quase", "score_precisao",
        "criterios_fortes", "min_nome_mae", "min_nome_dtnasc", "nome_e_mae", "dtnasc_e_local", "trifecta",
        "ano_consistente", "nota_cubed")
    return rounded(out, ["nome_total", "mae_total", "score_precisao", "min_nome_mae", "min_nome_dtnasc", "nota_cubed"])


@register("band_study_features", f"""{WITH_PAIRS}, s AS (SELECT k,
  nome_prim + nome_ult + nome_qtd + nome_raros + nome_comuns + nome_parec + nome_abrev AS nome_score_total,
  mae_prim + mae_ult + COALESCE(mae_qtd, 0.0E0) + mae_raros + mae_comuns + mae_parec + mae_abrev AS mae_score_total,
  dt_iguais + dt_ap1 + dt_inv_dia + dt_inv_mes + dt_inv_ano AS dtnasc_score_total,
  via_igual + via_prox + num_igual + compl_prox + texto_prox + tokens_jacc AS endereco_score_total FROM pairs)
SELECT k, ROUND(nome_score_total, 6) AS nome_score_total, ROUND(mae_score_total, 6) AS mae_score_total,
  ROUND(dtnasc_score_total, 6) AS dtnasc_score_total, ROUND(endereco_score_total, 6) AS endereco_score_total,
  CAST(nome_score_total / MAX(nome_score_total) OVER () >= 0.95E0 AS INT) AS nome_perfeito,
  CAST(dtnasc_score_total / MAX(dtnasc_score_total) OVER () >= 1 AS INT) AS dtnasc_perfeito,
  CAST(endereco_score_total > 0 AS INT) AS endereco_match FROM s""")
def band_study_rows(spark, sf_dir):
    out = X.band_study_features(pairs(spark, sf_dir), ["k"]).select(
        "k", *SCORE_FEATURES, "nome_perfeito", "dtnasc_perfeito", "endereco_match")
    return rounded(out, SCORE_FEATURES)


@register("rule_score", f"WITH {FEATURES_SQL} SELECT k, rules FROM features")
def rule_score_rows(spark, sf_dir):
    df = pairs(spark, sf_dir)
    return df.select("k", X.rule_score(df).alias("rules"))


CLINICAL = """people AS (SELECT p.*, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN ' f ' WHEN k % 3 = 1 THEN 'Masc'
  ELSE 'x' END AS r_sexo, CASE WHEN k % 2 = 0 THEN 'Fem' ELSE 'M' END AS c_sexo,
  CONCAT(' centro ', CAST(k % 5 AS VARCHAR(3))) AS r_baires FROM pairs p)"""


def people(spark, sf_dir):
    """Pairs with sex and district as the registries write them."""
    k = F.col("k")
    return pairs(spark, sf_dir).withColumns({
        "R_SEXO": F.when(k % 7 == 0, F.lit(None)).when(k % 3 == 0, " f ").when(k % 3 == 1, "Masc").otherwise("x"),
        "C_SEXO": F.when(k % 2 == 0, "Fem").otherwise("M"),
        "R_BAIRES": F.concat(F.lit(" centro "), (k % 5).cast("string")),
        "C_DTNOTI": F.date_format(F.date_sub("R_DTOBITO", 1) , "ddMMyyyy"),
    })


@register("clinical_projection", f"""{WITH_PAIRS}, {CLINICAL}, c AS (SELECT k,
  DATE_DIFF('day', r_dtnasc, r_dtobito) / 365.25E0 AS age, UPPER(TRIM(r_sexo)) AS sexo, UPPER(TRIM(r_baires)) AS bairro,
  CASE LEFT(UPPER(TRIM(COALESCE(r_sexo, c_sexo))), 1) WHEN 'F' THEN 'F' WHEN 'M' THEN 'M' END AS sex_code FROM people)
SELECT k, ROUND(age, 6) AS age, sexo, bairro, sex_code, 1 AS dias_noti_obito,
  CASE WHEN age >= 0 AND age < 18 THEN '0-17' WHEN age >= 18 AND age < 40 THEN '18-39' WHEN age >= 40 AND age < 60
    THEN '40-59' WHEN age >= 60 AND age < 80 THEN '60-79' WHEN age >= 80 AND age < 130 THEN '80+' END AS age_band FROM c""")
def clinical_rows(spark, sf_dir):
    rows = X.clinical(people(spark, sf_dir))
    return rows.select(
        "k", F.round("idade_obito", 6).alias("age"), "sexo", "bairro",
        X.sex_code(F.col("R_SEXO"), F.col("C_SEXO")).alias("sex_code"), "dias_noti_obito",
        X.age_band(F.col("idade_obito")).alias("age_band"),
    )


@register("outcome_counts", f"""{WITH_PAIRS} SELECT CASE situence WHEN 1 THEN 'Cura' WHEN 2 THEN 'Abandono'
  WHEN 3 THEN 'Óbito TB' WHEN 4 THEN 'Óbito outras' WHEN 5 THEN 'Transferência' WHEN 6 THEN 'Mudança diag'
  WHEN 7 THEN 'TBDR' END AS outcome, COUNT(*) AS n FROM pairs GROUP BY 1""")
def outcome_counts(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy(X.outcome_label(F.col("C_SITUENCE")).alias("outcome")).agg(
        F.count("*").alias("n"))


@register("pair_identifiers", f"""{WITH_PAIRS} SELECT k,
  SUBSTR(SHA256(CONCAT(CAST(comprec AS VARCHAR), '|', CAST(refrec AS VARCHAR), '|', CAST(passo AS VARCHAR))), 1, 16)
  AS pair_id FROM pairs""")
def pair_identifiers(spark, sf_dir):
    df = pairs(spark, sf_dir)
    return df.select("k", pair_id(df).alias("pair_id"))


@register("config_labels", f"""{WITH_PAIRS} SELECT DISTINCT CONCAT('vigilancia | split=row | cal=',
  CASE WHEN k % 2 = 0 THEN 'platt' ELSE 'stub' END, ' | macd=', CASE WHEN k % 3 = 0 THEN 'on' ELSE 'off' END) AS label FROM pairs""")
def config_labels(spark, sf_dir):
    k = F.col("k")
    label = config_label(F.lit("vigilancia"), F.lit("row"), F.when(k % 2 == 0, "platt").otherwise("stub"), k % 3 == 0)
    return pairs(spark, sf_dir).select(label.alias("label")).distinct()


@register("header_resolution", f"""{WITH_PAIRS} SELECT COUNT(*) AS n_rows, CAST(SUM(comprec) AS BIGINT) AS left_sum,
  ROUND(SUM(nota), 2) AS score_sum FROM pairs""")
def header_resolution(spark, sf_dir):
    from pairsieve.sources.scans import add_tidy_aliases, canonical_columns

    typed = pairs(spark, sf_dir).withColumnsRenamed({"COMPREC": "COMPREC,C,12,0", "nota final": "nota  final"})
    named = add_tidy_aliases(canonical_columns(typed, C.PREFIXED))
    return named.agg(F.count("*").alias("n_rows"), F.sum("COMPREC").alias("left_sum"),
                     F.round(F.sum("nota_final"), 2).alias("score_sum"))
