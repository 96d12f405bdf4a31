"""Deterministic guardrails, first rule wins.

Each rule is SQL text over the columns at hand; a NULL condition counts as not met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairsieve import columns as C
from pairsieve.config import GuardrailLimits
from pairsieve.functions.values import all_zero_sql, indicator_sql, number_sql, quoted

MATCH, NONMATCH, REVIEW = "ALWAYS_MATCH", "ALWAYS_NONMATCH", "FORCE_REVIEW"
BIRTH_FALLBACK = [*C.BIRTH_PARTS, C.BIRTH_EQUAL]
# What full agreement asks of the sub-scores.
FULL_AGREEMENT = [(C.NAME_COUNT, 0.95), (C.NAME_FIRST, 1.0), (C.NAME_LAST, 1.0),
                  (C.BIRTH_EQUAL, 1.0), (C.TOWN_EQUAL, 1.0)]


def _score(df: DataFrame) -> str:
    return f"coalesce({number_sql(df, C.SCORE)}, {number_sql(df, 'nota_final')})"


def died_before_diagnosis(df: DataFrame, days: int) -> str:
    death, diagnosis = "R_DTOBITO_dt", "C_DTDIAG_dt"
    if death not in df.columns or diagnosis not in df.columns:
        return "false"
    return f"CAST({death} AS DATE) < date_sub(CAST({diagnosis} AS DATE), {int(days)})"


def namesake_risk(df: DataFrame, limits: GuardrailLimits) -> str:
    """A good score although no birth-date or address score agrees and the years lie apart."""
    def empty(flag: str, scores: list[str]) -> str:
        return indicator_sql(df, flag) if flag in df.columns else all_zero_sql(df, scores)

    return (
        f"{_score(df)} >= {limits.namesake_score!r}D "
        f"AND ({empty('dtnasc_all_zero', BIRTH_FALLBACK)}) "
        f"AND {number_sql(df, 'diff_ano')} > {limits.namesake_years!r}D "
        f"AND ({empty('endereco_zero', C.ADDRESS_SCORES)})"
    )


def full_agreement(df: DataFrame) -> str:
    return " AND ".join(f"{number_sql(df, n)} >= {least!r}D" for n, least in FULL_AGREEMENT)


def rules(df: DataFrame, limits: GuardrailLimits) -> list[tuple[str, str, str]]:
    """(condition, decision, reason) in order of precedence."""
    score = _score(df)
    return [
        (died_before_diagnosis(df, limits.temporal_days), NONMATCH, "temporal_filter"),
        (f"{score} < {limits.always_nonmatch!r}D", NONMATCH, "nota_final_low"),
        (namesake_risk(df, limits), REVIEW, "homonimia_risk"),
        (f"{score} >= {limits.always_match!r}D AND {full_agreement(df)}", MATCH, "nota_final_high"),
    ]


def risk_rules(df: DataFrame) -> list[tuple[str, str, str]]:
    """Optional extra rules: grey band without a mother's name, low name with low birth date."""
    grey = "band IN ('grey_low', 'grey_mid', 'grey_high')"
    low = (f"{number_sql(df, 'nome_score_total')} < 0.25D "
           f"AND {number_sql(df, 'dtnasc_score_total')} < 0.25D")
    return [
        (f"{grey} AND {indicator_sql(df, 'mae_missing')}", REVIEW, "grey_mother_missing"),
        (low, NONMATCH, "low_name_and_low_dob"),
    ]


def apply_guardrails(
    df: DataFrame, limits: GuardrailLimits = GuardrailLimits(), with_risk_rules: bool = False
) -> DataFrame:
    """Add ``guardrail`` and ``guardrail_reason``; both NULL when no rule fires.

    The reason decides the action, so only the reason carries the conditions.
    """
    chain = rules(df, limits) + (risk_rules(df) if with_risk_rules else [])
    reason = " ".join(f"WHEN {condition} THEN '{why}'" for condition, _, why in chain)
    action = " ".join(f"WHEN '{why}' THEN '{act}'" for _, act, why in chain)
    kept = [quoted(n) for n in df.columns if n not in ("guardrail", "guardrail_reason")]
    return df.selectExpr(*kept, f"CASE {reason} END AS guardrail_reason").selectExpr(
        *kept, f"CASE guardrail_reason {action} END AS guardrail", "guardrail_reason"
    )
