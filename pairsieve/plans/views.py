"""Deterministic views over the driver's tables, in SQL both engines read alike.

``PAIRS_SQL`` gives every order the shape of a candidate pair.  The later texts extend it by
features, bands, guardrails and triage; they serve as independent SQL counterparts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairsieve import columns as C
from pairsieve.plans.registry import table

_STEP = "CASE WHEN {test} THEN 1.0E0 ELSE 0.0E0 END AS {name}"
_FRACTION = "CAST((k * {m}) % {n} AS DOUBLE) / {d} AS {name}"

_EXTRA = [
    _FRACTION.format(m=13, n=5, d=4, name="nome_raros"),
    _FRACTION.format(m=11, n=7, d=6, name="nome_comuns"),
    _FRACTION.format(m=5, n=9, d=8, name="nome_parec"),
    _FRACTION.format(m=3, n=4, d=4, name="nome_abrev"),
    _STEP.format(test="k % 5 <> 0 AND k % 6 <> 0", name="mae_prim"),
    _STEP.format(test="k % 7 <> 0 AND k % 6 <> 0", name="mae_ult"),
    _FRACTION.format(m=19, n=6, d=5, name="mae_raros"),
    _FRACTION.format(m=23, n=5, d=4, name="mae_comuns"),
    _FRACTION.format(m=29, n=9, d=8, name="mae_parec"),
    _FRACTION.format(m=7, n=4, d=4, name="mae_abrev"),
    _STEP.format(test="k % 10 = 2", name="dt_inv_dia"),
    _STEP.format(test="k % 20 = 3", name="dt_inv_mes"),
    _STEP.format(test="k % 20 = 4", name="dt_inv_ano"),
    _STEP.format(test="k % 2 = 0 OR k % 5 = 0", name="uf_igual"),
    _STEP.format(test="k % 4 = 1", name="mun_prox"),
    "CASE WHEN k % 7 = 0 THEN 1.0E0 WHEN k % 7 = 3 THEN 0.5E0 ELSE 0.0E0 END AS via_prox",
    _STEP.format(test="k % 21 = 0", name="num_igual"),
    _STEP.format(test="k % 35 = 0", name="compl_prox"),
    "CASE WHEN k % 7 = 0 THEN CAST((k * 3) % 11 AS DOUBLE) / 10 ELSE 0.0E0 END AS texto_prox",
    "CASE WHEN k % 7 = 0 THEN CAST((k * 5) % 9 AS DOUBLE) / 8 ELSE 0.0E0 END AS tokens_jacc",
    "CASE WHEN k % 23 = 0 THEN NULL ELSE CAST(k % 7 + 1 AS INT) END AS situence",
]

PAIRS_SQL = (
    """
SELECT k, k % 4001 AS comprec, cust AS refrec, k % 3 + 1 AS passo, nota,
  CASE WHEN nota >= 9 THEN 1 WHEN nota >= 7 AND k % 5 = 0 THEN 2
       WHEN nota >= 5 AND k % 97 = 0 THEN 1 ELSE 0 END AS par,
  CASE WHEN nota >= 8 THEN 1.0E0 ELSE CAST((k * 31) % 21 AS DOUBLE) / 20 END AS nome_qtd,
  CASE WHEN nota >= 8 OR k % 3 <> 0 THEN 1.0E0 ELSE 0.0E0 END AS nome_prim,
  CASE WHEN nota >= 8 OR k % 4 <> 0 THEN 1.0E0 ELSE 0.0E0 END AS nome_ult,
  CASE WHEN k % 6 = 0 THEN NULL ELSE CAST((k * 17) % 11 AS DOUBLE) / 10 END AS mae_qtd,
  CASE WHEN nota >= 10 OR k % 9 = 0 THEN 1.0E0 ELSE 0.0E0 END AS dt_iguais,
  CASE WHEN k % 10 = 1 THEN 1.0E0 ELSE 0.0E0 END AS dt_ap1,
  CASE WHEN k % 2 = 0 THEN 1.0E0 ELSE 0.0E0 END AS mun_igual,
  CASE WHEN k % 7 = 0 THEN 1.0E0 ELSE 0.0E0 END AS via_igual,
  birth AS r_dtnasc,
  CASE WHEN k % 13 = 0 THEN NULL
       WHEN k % 8 = 0 THEN birth + CAST((k % 9) * 365 AS INT) ELSE birth END AS c_dtnasc,
  odate AS r_dtobito, odate + CAST((k % 500) - 100 AS INT) AS c_dtdiag,
  """
    + ",\n  ".join(_EXTRA)
    + """
FROM (SELECT o_orderkey AS k, o_custkey AS cust,
             CAST((o_orderkey * 7919) % 1201 AS DOUBLE) / 100 AS nota,
             DATE '1940-01-01' + CAST((o_orderkey * 37) % 20000 AS INT) AS birth,
             CAST(o_orderdate AS DATE) AS odate
      FROM orders) t"""
)

NAMES = {
    "comprec": C.LEFT, "refrec": C.RIGHT, "passo": C.STEP, "nota": C.SCORE, "par": C.LABEL,
    "nome_prim": C.NAME_FIRST, "nome_ult": C.NAME_LAST, "nome_qtd": C.NAME_COUNT,
    "nome_raros": C.NAME_SCORES[3], "nome_comuns": C.NAME_SCORES[4],
    "nome_parec": C.NAME_SCORES[5], "nome_abrev": C.NAME_SCORES[6],
    "mae_prim": C.MOTHER_FIRST, "mae_ult": C.MOTHER_LAST, "mae_qtd": C.MOTHER_COUNT,
    "mae_raros": C.MOTHER_SCORES[3], "mae_comuns": C.MOTHER_SCORES[4],
    "mae_parec": C.MOTHER_SCORES[5], "mae_abrev": C.MOTHER_SCORES[6],
    "dt_iguais": C.BIRTH_EQUAL, "dt_ap1": C.BIRTH_ONE_DIGIT, "dt_inv_dia": C.BIRTH_DAY_SWAP,
    "dt_inv_mes": C.BIRTH_MONTH_SWAP, "dt_inv_ano": C.BIRTH_YEAR_SWAP,
    "uf_igual": C.TOWN_STATE, "mun_igual": C.TOWN_EQUAL, "mun_prox": C.TOWN_NEAR,
    "via_igual": C.STREET_EQUAL, "via_prox": C.STREET_NEAR, "num_igual": C.ADDRESS_SCORES[2],
    "compl_prox": C.ADDRESS_SCORES[3], "texto_prox": C.STREET_TEXT,
    "tokens_jacc": C.ADDRESS_SCORES[5], "situence": C.OUTCOME,
    "r_dtnasc": "R_DTNASC", "c_dtnasc": "C_DTNASC", "r_dtobito": "R_DTOBITO",
    "c_dtdiag": "C_DTDIAG",
}
SHORT = {v: k for k, v in NAMES.items()}


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate-pair view under the comparator's column names; ``k`` is the row key."""
    view = spark.sql(PAIRS_SQL.replace("FROM orders", "FROM {orders}"),
                     orders=table(spark, sf_dir, "orders"))
    return view.withColumnsRenamed(NAMES)


def short(df: DataFrame) -> DataFrame:
    """Back to the short names, for output next to SQL."""
    return df.withColumnsRenamed({n: SHORT[n] for n in df.columns if n in SHORT})


FEATURES_SQL = f"""
pairs AS ({PAIRS_SQL}),
features AS (
SELECT p.*,
  CASE WHEN par IN (1, 2) THEN 1 ELSE 0 END AS target,
  CAST(ABS(EXTRACT(YEAR FROM r_dtnasc) - EXTRACT(YEAR FROM c_dtnasc)) AS DOUBLE) AS diff_ano,
  (dt_iguais = 0 AND dt_ap1 = 0 AND dt_inv_dia = 0 AND dt_inv_mes = 0 AND dt_inv_ano = 0) AS dtnasc_all_zero,
  LEAST(GREATEST(0.5E0 * nome_qtd + 0.25E0 * nome_prim + 0.25E0 * nome_ult, 0.0E0), 1.0E0) AS nome_score_total,
  LEAST(GREATEST(0.5E0 * COALESCE(mae_qtd, 0.0E0) + 0.25E0 * mae_prim + 0.25E0 * mae_ult, 0.0E0), 1.0E0) AS mae_score_total,
  CASE WHEN COALESCE(mae_qtd, 0.0E0) = 0 AND mae_prim = 0 AND mae_ult = 0 THEN 1 ELSE 0 END AS mae_missing,
  (dt_iguais + dt_ap1 + dt_inv_dia + dt_inv_mes + dt_inv_ano) / 5 AS dtnasc_score_total,
  (via_igual + via_prox + num_igual + compl_prox + texto_prox + tokens_jacc) / 6 AS endereco_score_total,
  CASE WHEN via_igual = 0 AND via_prox = 0 AND num_igual = 0 AND compl_prox = 0 AND texto_prox = 0 AND tokens_jacc = 0
       THEN 1 ELSE 0 END AS endereco_zero,
  mun_igual AS municipio_score,
  CASE WHEN nome_qtd >= 0.95E0 THEN 3.0E0 WHEN nome_qtd >= 0.85E0 THEN 2.0E0 ELSE 0.0E0 END
  + CASE WHEN dt_iguais = 1 THEN 3.0E0 WHEN dt_ap1 = 1 THEN 1.5E0 ELSE 0.0E0 END
  + CASE WHEN mae_qtd >= 0.7E0 THEN 2.0E0 WHEN mae_qtd >= 0.5E0 THEN 1.0E0 ELSE 0.0E0 END
  + CASE WHEN mun_igual = 1 THEN 1.5E0 ELSE 0.0E0 END
  + CASE WHEN via_igual = 1 THEN 1.0E0 ELSE 0.0E0 END
  + CASE WHEN nota >= 9 THEN 2.0E0 WHEN nota >= 8 THEN 1.0E0 ELSE 0.0E0 END AS rules
FROM pairs p)"""

BAND_SQL = """CASE WHEN nota >= 0 AND nota < 5 THEN 'low' WHEN nota >= 5 AND nota < 6 THEN 'grey_low'
  WHEN nota >= 6 AND nota < 7 THEN 'grey_mid' WHEN nota >= 7 AND nota < 8 THEN 'grey_high'
  WHEN nota >= 8 AND nota < 9 THEN 'near_high' WHEN nota >= 9 AND nota <= 999 THEN 'high' END"""

GUARD_SQL = f"""{FEATURES_SQL},
guarded AS (
SELECT f.*, {BAND_SQL} AS band,
  LEAST(GREATEST(nota / 10, 0.000001E0), 0.999999E0) AS p_cal,
  CASE WHEN r_dtobito < c_dtdiag - CAST(180 AS INT) THEN 'temporal_filter'
       WHEN nota < 3 THEN 'nota_final_low'
       WHEN nota >= 7 AND dtnasc_all_zero AND diff_ano > 5 AND endereco_zero = 1 THEN 'homonimia_risk'
       WHEN nota >= 10 AND nome_qtd >= 0.95E0 AND nome_prim >= 1 AND nome_ult >= 1 AND dt_iguais >= 1
            AND mun_igual >= 1 THEN 'nota_final_high' END AS guardrail_reason
FROM features f),
labelled AS (
SELECT g.*, CASE guardrail_reason WHEN 'temporal_filter' THEN 'ALWAYS_NONMATCH'
  WHEN 'nota_final_low' THEN 'ALWAYS_NONMATCH' WHEN 'homonimia_risk' THEN 'FORCE_REVIEW'
  WHEN 'nota_final_high' THEN 'ALWAYS_MATCH' END AS guardrail,
  CASE band WHEN 'low' THEN 0.10E0 WHEN 'grey_low' THEN 0.08E0 WHEN 'grey_mid' THEN 0.06E0
            WHEN 'grey_high' THEN 0.04E0 WHEN 'near_high' THEN 0.02E0 ELSE 0.01E0 END AS e_fp,
  CASE band WHEN 'low' THEN 0.15E0 WHEN 'grey_low' THEN 0.12E0 WHEN 'grey_mid' THEN 0.10E0
            WHEN 'grey_high' THEN 0.08E0 WHEN 'near_high' THEN 0.06E0 ELSE 0.03E0 END AS e_fn
FROM guarded g)"""


def triage_sql(
    source: str = "labelled", cfp: float = 10.0, cfn: float = 50.0, crev: float = 0.25,
    auto_match: float = 0.85, auto_non: float = 0.15, budget: int = 500, by: str = "",
) -> str:
    """CTEs ``scored, tiered, picked, decided`` over a table with p_cal, band, rates, guardrail."""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
scored AS (
SELECT s.*, (1.0E0 - p_cal) * {cfp!r}E0 AS loss_match, p_cal * {cfn!r}E0 AS loss_non,
  {crev!r}E0 + (1.0E0 - p_cal) * e_fp * {cfp!r}E0 + p_cal * e_fn * {cfn!r}E0 AS loss_llm
FROM {source} s),
chosen AS (
SELECT s.*, CASE WHEN loss_match <= loss_non THEN 'MATCH' ELSE 'NONMATCH' END AS base_choice,
  LEAST(loss_match, loss_non) AS base_loss, LEAST(loss_match, loss_non) - loss_llm AS evr FROM scored s),
tiered AS (
SELECT c.*,
  (evr > 0 OR COALESCE(guardrail = 'FORCE_REVIEW', FALSE)
    OR (base_choice = 'MATCH' AND p_cal < {auto_match!r}E0)
    OR (base_choice = 'NONMATCH' AND p_cal > {auto_non!r}E0)) AS review_requested,
  CASE WHEN guardrail IN ('ALWAYS_MATCH', 'ALWAYS_NONMATCH') THEN NULL
       WHEN guardrail = 'FORCE_REVIEW' THEN 1
       WHEN (base_choice = 'MATCH' AND p_cal < {auto_match!r}E0)
         OR (base_choice = 'NONMATCH' AND p_cal > {auto_non!r}E0) THEN 2
       WHEN evr > 0 THEN 3 END AS tier
FROM chosen c),
picked AS (
SELECT t.*, CASE WHEN tier IS NOT NULL THEN
  ROW_NUMBER() OVER ({part}ORDER BY tier NULLS LAST, evr DESC, k) END AS review_rank FROM tiered t),
decided AS (
SELECT p.*, CASE WHEN review_rank <= {budget} THEN 'LLM_REVIEW'
  WHEN guardrail = 'ALWAYS_MATCH' THEN 'MATCH' WHEN guardrail = 'ALWAYS_NONMATCH' THEN 'NONMATCH'
  ELSE base_choice END AS action FROM picked p)"""


# The reviewers' raw answers: three agents' decisions from arithmetic on the key, wrapped in
# thinking blocks, prose, fences and broken text.
REVIEWED = "k % 11 = 0"
_DECISIONS = {"A": "k % 3", "B": "(k + k % 5) % 3", "C": "(k * 7) % 3"}


def answers_sql(source: str = "pairs") -> str:
    """``pair, agent, raw`` with one raw answer per agent."""
    parts = []
    for agent, pick in _DECISIONS.items():
        choice = (f"CASE {pick} WHEN 0 THEN 'MATCH' WHEN 1 THEN 'nonmatch ' ELSE "
                  f"CASE WHEN k % 4 = 0 THEN 'maybe' ELSE 'UNSURE' END END")
        conf = f"CAST((k * 3 + {len(agent)} + {ord(agent)}) % 13 AS VARCHAR(20))"
        code = ("CASE k % 3 WHEN 0 THEN '\"NAME_STRONG\",\"BOGUS\"' WHEN 1 THEN "
                "'\"DOB_EXACT\",\"MODEL_HIGH_P\"' ELSE '' END")
        body = (f"CONCAT('{{\"decision\": \"', {choice}, '\", \"confidence\": 0.', {conf}, "
                f"', \"reason_codes\": [', {code}, '], \"quality_flags\": "
                f"{{\"insufficient_evidence\": ', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, '}}}}')")
        fence = "CAST(CHR(96) || CHR(96) || CHR(96) AS VARCHAR(3))"
        parts.append(
            f"SELECT k AS pair, '{agent}' AS agent, nota, target, CASE k % 5 "
            f"WHEN 0 THEN {body} "
            f"WHEN 1 THEN CONCAT('<think>so {{maybe}}</think> ', {body}) "
            f"WHEN 2 THEN CONCAT('Answer: ', {fence}, 'json ', {body}, ' ', {fence}) "
            f"WHEN 3 THEN CONCAT({body}, ' end of answer') "
            f"ELSE CASE WHEN k % 2 = 0 THEN 'no answer at all' ELSE CONCAT('ok ', {body}) END END AS raw "
            f"FROM {source}"
        )
    return " UNION ALL ".join(parts)


def dates_as_text(df: DataFrame) -> DataFrame:
    """The pair view with dates as the export writes them."""
    forms = {"R_DTNASC": "yyyyMMdd", "C_DTNASC": "yyyyMMdd", "C_DTDIAG": "yyyyMMdd",
             "R_DTOBITO": "ddMMyyyy"}
    return df.withColumns({n: F.date_format(n, f) for n, f in forms.items()})
