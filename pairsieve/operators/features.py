"""Feature projections over the comparator's sub-scores: one ``select`` each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairsieve import columns as C
from pairsieve.functions.values import (
    all_zero_sql, compact_date, compact_date_sql, flag, number, number_sql, quoted, ref, target,
    total,
)

# Names of the birth-distance features.
BIRTH_DISTANCE = [
    "macd_nasc_diff_capped", "macd_nasc_year_match", "macd_nasc_month_match",
    "macd_nasc_day_match", "macd_nasc_partial_overlap", "macd_nasc_close",
    "macd_nasc_very_close", "macd_nome_perf_x_date_far", "macd_nome_perf_x_year_diff",
]
# Names of the engineered features of the model table, in their order.
ENGINEERED = [
    "nome_total", "mae_total", "dtnasc_total", "endereco_total", "local_total", "score_recall",
    "nome_x_dtnasc", "nome_x_mae", "nome_x_local", "dtnasc_x_local", "nome_x_endereco",
    "nome_bom", "nome_prim_ok", "dtnasc_ok", "dtnasc_parcial", "mae_presente", "local_ok",
    "evidencias_positivas", "min_score_nome", "max_score_dtnasc", "ratio_nome_mae",
    "ratio_nome_nota", "obito_sinan", "obito_tb", "diff_ano_nasc", "diff_ano_ok",
    "nome_squared", "dtnasc_squared", "nota_squared",
]
MODEL_FEATURES = C.ALL_SCORES + ENGINEERED


def _weighted_name(df: DataFrame, count: str, first: str, last: str) -> str:
    c, f, l = (number_sql(df, n, 0.0) for n in (count, first, last))
    return f"least(greatest(0.5D * {c} + 0.25D * {f} + 0.25D * {l}, 0D), 1D)"


def _mean_score(df: DataFrame, names: list[str]) -> str:
    parts = " + ".join(number_sql(df, n, 0.0) for n in names)
    return f"least(greatest(({parts}) / {len(names)}, 0D), 1D)"


DATES = {
    "R_DTOBITO_dt": ("R_DTOBITO", "dmy"), "C_DTDIAG_dt": ("C_DTDIAG", "ymd"),
    "R_DTNASC_dt": ("R_DTNASC", "ymd"), "C_DTNASC_dt": ("C_DTNASC", "ymd"),
}
BORN = ("R_DTNASC_dt", "C_DTNASC_dt")


def pair_features(df: DataFrame, birth_distance: bool = True) -> DataFrame:
    """Totals, flags and dates the triage needs; required columns are checked first."""
    lost = [n for n in (C.LEFT, C.RIGHT, C.STEP, C.LABEL) if n not in df.columns]
    if lost:
        raise KeyError(f"missing required columns: {lost}")
    dates = {
        name: compact_date_sql(df, source, order)
        for name, (source, order) in DATES.items()
        if source in df.columns or name in BORN
    }
    rules = [n for n in (C.NAME_FIRST, C.BIRTH_EQUAL, C.TOWN_EQUAL) if n in df.columns]
    fired = [f"CASE WHEN {number_sql(df, n, 0.0)} >= 1 THEN 1D ELSE 0D END" for n in rules]
    mother = [C.MOTHER_COUNT, C.MOTHER_FIRST, C.MOTHER_LAST, C.MOTHER_BOTH]
    first = {
        C.TARGET: f"CASE WHEN {number_sql(df, C.LABEL)} IN (1, 2) THEN 1 ELSE 0 END",
        "dtnasc_all_zero": all_zero_sql(df, C.BIRTH_SCORES),
        "nome_score_total": _weighted_name(df, C.NAME_COUNT, C.NAME_FIRST, C.NAME_LAST),
        "mae_score_total": _weighted_name(df, C.MOTHER_COUNT, C.MOTHER_FIRST, C.MOTHER_LAST),
        "mae_missing": f"CAST({all_zero_sql(df, mother)} AS INT)",
        "dtnasc_score_total": _mean_score(df, C.BIRTH_SCORES),
        "endereco_score_total": _mean_score(df, C.ADDRESS_SCORES),
        "endereco_zero": f"CAST({all_zero_sql(df, C.ADDRESS_SCORES)} AS INT)",
        "municipio_score": f"least(greatest({number_sql(df, C.TOWN_EQUAL, 0.0)}, 0D), 1D)",
        "score_regras": " + ".join(fired) or "0D",
    }
    second = {"diff_ano": "CAST(abs(year(R_DTNASC_dt) - year(C_DTNASC_dt)) AS DOUBLE)"}
    if birth_distance:
        second |= _birth_distance(df)
    new = {*dates, *first, *second}
    kept = [quoted(n) for n in df.columns if n not in new]
    out = df.selectExpr(*kept, *[f"{sql} AS {quoted(n)}" for n, sql in {**dates, **first}.items()])
    score = C.SCORE if C.SCORE in df.columns else "nota_final"
    front = [C.LEFT, C.RIGHT, C.STEP, C.LABEL, C.TARGET, score, "diff_ano", "dtnasc_all_zero",
             "nome_score_total", "mae_score_total", "dtnasc_score_total", "endereco_score_total",
             "municipio_score"]
    every = [*out.columns, *second]
    order = [n for n in front if n in every] + [n for n in every if n not in front]
    return out.selectExpr(
        *[f"{second[n]} AS {quoted(n)}" if n in second else quoted(n) for n in order]
    )


def _birth_distance(df: DataFrame) -> dict[str, str]:
    """Nine measures of how far the two birth dates lie apart."""
    days = "abs(datediff(C_DTNASC_dt, R_DTNASC_dt))"
    years = f"({days} / 365.25D)"
    capped = f"CASE WHEN {days} IS NOT NULL THEN least({years}, 20D) END"
    same = [
        f"CAST(coalesce({part}(R_DTNASC_dt) = {part}(C_DTNASC_dt), false) AS INT)"
        for part in ("year", "month", "day")
    ]
    perfect = (
        f"({number_sql(df, C.NAME_COUNT, 0.0)} >= 0.95D AND {number_sql(df, C.NAME_FIRST, 0.0)} >= 1 "
        f"AND {number_sql(df, C.NAME_LAST, 0.0)} >= 1)"
    )
    values = [
        capped, *same, f"CAST({' + '.join(same)} AS DOUBLE) / 3D",
        f"CAST(coalesce({days} <= 30, false) AS INT)", f"CAST(coalesce({days} <= 7, false) AS INT)",
        f"CAST(coalesce({perfect} AND {years} >= 5, false) AS INT)",
        f"CAST({perfect} AS DOUBLE) * coalesce({capped}, 0D)",
    ]
    return dict(zip(BIRTH_DISTANCE, values))


def _birth_year(df: DataFrame, name: str) -> Column:
    """First four characters as a number; dates and date text alike."""
    return F.substring(ref(name).cast("string"), 1, 4).try_cast("double")


def _year_gap(df: DataFrame) -> Column:
    if "R_DTNASC" not in df.columns or "C_DTNASC" not in df.columns:
        return F.lit(99.0)
    gap = F.abs(_birth_year(df, "R_DTNASC") - _birth_year(df, "C_DTNASC"))
    return F.coalesce(gap, F.lit(99.0))


def _outcome(df: DataFrame, codes: tuple[float, ...]) -> Column:
    return flag(number(df, C.OUTCOME).isin(*codes)) if C.OUTCOME in df.columns else F.lit(0)


def model_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 58 features: 29 sub-scores with missing as 0, and 29 engineered ones."""
    base = df.select(
        *[ref(k) for k in keep or []],
        *[number(df, n, 0.0).alias(n) for n in C.ALL_SCORES],
        target(df, C.LABEL).alias("y"),
        _outcome(df, (3.0, 4.0)).alias("obito_sinan"),
        _outcome(df, (3.0,)).alias("obito_tb"),
        _year_gap(df).alias("diff_ano_nasc"),
    )
    v = {n: ref(n) for n in C.ALL_SCORES}
    name, mother, birth, town = v[C.NAME_COUNT], v[C.MOTHER_COUNT], v[C.BIRTH_EQUAL], v[C.TOWN_EQUAL]
    near = v[C.BIRTH_ONE_DIGIT]
    sums = {
        "nome_total": v[C.NAME_FIRST] + v[C.NAME_LAST] + name + v[C.NAME_SIMILAR],
        "mae_total": v[C.MOTHER_FIRST] + v[C.MOTHER_LAST] + mother,
        "dtnasc_total": birth + near * 0.8 + v[C.BIRTH_DAY_SWAP] * 0.5,
        "endereco_total": v[C.STREET_EQUAL] + v[C.STREET_NEAR] * 0.7 + v[C.STREET_TEXT],
        "local_total": town + v[C.TOWN_NEAR] * 0.5,
        "score_recall": name * 3.0 + v[C.NAME_FIRST] * 2.0 + birth * 2.5 + near * 2.0
        + mother * 1.5 + town + v[C.STREET_EQUAL] * 0.5,
    }
    flags = {
        "nome_bom": name >= 0.7,
        "nome_prim_ok": v[C.NAME_FIRST] >= 0.8,
        "dtnasc_ok": (birth == 1) | (near == 1),
        "dtnasc_parcial": (v[C.BIRTH_DAY_SWAP] == 1) | (v[C.BIRTH_MONTH_SWAP] == 1),
        "mae_presente": mother > 0.3,
        "local_ok": town >= 0.8,
    }
    wide = base.withColumns({**sums, **{n: flag(c) for n, c in flags.items()}})
    s = {n: F.col(n) for n in sums}
    wide = wide.withColumns({
        "nome_x_dtnasc": name * (birth + near),
        "nome_x_mae": name * mother,
        "nome_x_local": name * town,
        "dtnasc_x_local": s["dtnasc_total"] * s["local_total"],
        "nome_x_endereco": s["nome_total"] * s["endereco_total"],
        "evidencias_positivas": total([F.col(n) for n in flags]),
        "min_score_nome": F.least(v[C.NAME_FIRST], v[C.NAME_LAST], name),
        "max_score_dtnasc": F.greatest(birth, near),
        "ratio_nome_mae": s["nome_total"] / (s["mae_total"] + 0.1),
        "ratio_nome_nota": s["nome_total"] / (v[C.SCORE] + 0.1),
        "diff_ano_ok": flag(F.col("diff_ano_nasc") <= 5),
        "nome_squared": name * name,
        "dtnasc_squared": birth * birth,
        "nota_squared": v[C.SCORE] * v[C.SCORE],
    })
    return wide.select(*[ref(k) for k in keep or []], *[ref(n) for n in MODEL_FEATURES], "y")


def first_study_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The twelve features of the first comparison study."""
    n = lambda name: number(df, name, 0.0)
    street = n(C.STREET_EQUAL) + n(C.STREET_NEAR) + n(C.STREET_TEXT)
    return df.select(
        *[ref(k) for k in keep or []],
        (n(C.NAME_FIRST) + n(C.NAME_LAST) + n(C.NAME_COUNT)).alias("nome_score_total"),
        (n(C.MOTHER_FIRST) + n(C.MOTHER_LAST) + n(C.MOTHER_COUNT)).alias("mae_score_total"),
        (n(C.BIRTH_EQUAL) + n(C.BIRTH_ONE_DIGIT) + n(C.BIRTH_DAY_SWAP) + n(C.BIRTH_MONTH_SWAP))
        .alias("dtnasc_score_total"),
        street.alias("endereco_score_total"),
        (n(C.NAME_COUNT) * n(C.BIRTH_EQUAL)).alias("nome_x_dtnasc"),
        (n(C.NAME_COUNT) * n(C.MOTHER_COUNT)).alias("nome_x_mae"),
        (n(C.NAME_COUNT) * street).alias("nome_x_endereco"),
        flag(n(C.NAME_COUNT) >= 0.95).alias("nome_perfeito"),
        flag(n(C.BIRTH_EQUAL) == 1).alias("dtnasc_perfeito"),
        flag(n(C.MOTHER_COUNT) > 0).alias("mae_presente"),
        flag(n(C.STREET_EQUAL) > 0).alias("endereco_match"),
        _outcome(df, (3.0, 4.0)).alias("obito_sinan"),
    )


def precision_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Strict agreement features of the precision study."""
    n = lambda name: number(df, name, 0.0)
    name, birth, mother = n(C.NAME_COUNT), n(C.BIRTH_EQUAL), n(C.MOTHER_COUNT)
    out = df.select(
        *[ref(k) for k in keep or []],
        (n(C.NAME_FIRST) * 0.3 + n(C.NAME_LAST) * 0.3 + name * 0.4).alias("nome_total"),
        (n(C.MOTHER_FIRST) * 0.25 + n(C.MOTHER_LAST) * 0.25 + mother * 0.5).alias("mae_total"),
        flag(name >= 0.95).alias("nome_perfeito"),
        flag(name >= 0.85).alias("nome_excelente"),
        flag(birth == 1).alias("dtnasc_exato"),
        flag((birth == 1) | (n(C.BIRTH_ONE_DIGIT) == 1)).alias("dtnasc_quase"),
        flag(mother >= 0.6).alias("mae_forte"),
        flag(n(C.TOWN_EQUAL) == 1).alias("local_exato"),
        flag(n(C.STREET_EQUAL) == 1).alias("endereco_match"),
        F.least(name, birth).alias("min_nome_dtnasc"),
        _outcome(df, (3.0, 4.0)).alias("obito_sinan"),
        _year_gap(df).alias("diff_ano"),
        (n(C.SCORE) * n(C.SCORE)).alias("nota_squared"),
        (n(C.SCORE) * n(C.SCORE) * n(C.SCORE)).alias("nota_cubed"),
    )
    c = F.col
    return out.withColumns({
        "score_precisao": c("nome_perfeito") * 3.0 + c("dtnasc_exato") * 3.0 + c("mae_forte") * 2.0
        + c("local_exato") * 1.5 + c("endereco_match") * 1.0,
        "criterios_fortes": c("nome_perfeito") + c("dtnasc_exato") + c("mae_forte")
        + c("local_exato") + c("endereco_match"),
        "min_nome_mae": F.least("nome_total", "mae_total"),
        "nome_e_dtnasc": c("nome_perfeito") * c("dtnasc_exato"),
        "nome_e_mae": c("nome_perfeito") * c("mae_forte"),
        "dtnasc_e_local": c("dtnasc_exato") * c("local_exato"),
        "trifecta": c("nome_perfeito") * c("dtnasc_exato") * c("mae_forte"),
        "ano_consistente": flag(c("diff_ano") <= 2),
    })


def band_study_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Sums over columns found by prefix; "perfect" is measured against the global maximum.

    The two maxima come from one small aggregate read as a scalar subquery.
    """
    def group(prefix: str) -> Column:
        names = [n for n in df.columns if n.startswith(prefix)]
        if prefix == "NOME":
            names = [n for n in names if "MAE" not in n and n != "NOME"]
        if prefix == "DTNASC":
            names = [n for n in names if not n.startswith("DTNASC2")]
        return total([number(df, n, 0.0) for n in names]) if names else F.lit(0.0)

    sums = df.select(
        *[ref(k) for k in keep or []],
        group("NOME").alias("nome_score_total"),
        group("NOMEMAE").alias("mae_score_total"),
        group("DTNASC").alias("dtnasc_score_total"),
        group("ENDERECO").alias("endereco_score_total"),
        _outcome(df, (3.0, 4.0)).alias("obito_sinan"),
    )
    top = sums.agg(
        F.max("nome_score_total").alias("name"), F.max("dtnasc_score_total").alias("birth")
    ).select(F.struct("name", "birth")).scalar()

    def share(value: str, best: Column) -> Column:
        return F.col(value) / F.when(best > 0, best).otherwise(1.0)

    return sums.withColumns({
        "nome_x_dtnasc": F.col("nome_score_total") * F.col("dtnasc_score_total"),
        "nome_x_mae": F.col("nome_score_total") * F.col("mae_score_total"),
        "nome_x_endereco": F.col("nome_score_total") * F.col("endereco_score_total"),
        "nome_perfeito": flag(share("nome_score_total", top["name"]) >= 0.95),
        "dtnasc_perfeito": flag(share("dtnasc_score_total", top["birth"]) >= 1.0),
        "mae_presente": flag(F.col("mae_score_total") > 0),
        "endereco_match": flag(F.col("endereco_score_total") > 0),
    })


def rule_score(df: DataFrame) -> Column:
    """High-confidence rules, 0 to 12.5."""
    n = lambda name: number(df, name, 0.0)
    ladders = [
        [(n(C.NAME_COUNT) >= 0.95, 3.0), (n(C.NAME_COUNT) >= 0.85, 2.0)],
        [(n(C.BIRTH_EQUAL) == 1, 3.0), (n(C.BIRTH_ONE_DIGIT) == 1, 1.5)],
        [(n(C.MOTHER_COUNT) >= 0.7, 2.0), (n(C.MOTHER_COUNT) >= 0.5, 1.0)],
        [(n(C.TOWN_EQUAL) == 1, 1.5)],
        [(n(C.STREET_EQUAL) == 1, 1.0)],
        [(n(C.SCORE) >= 9, 2.0), (n(C.SCORE) >= 8, 1.0)],
    ]
    parts = []
    for steps in ladders:
        chain = F.when(*steps[0])
        for condition, points in steps[1:]:
            chain = chain.when(condition, points)
        parts.append(chain.otherwise(0.0))
    return total(parts)


def clinical(df: DataFrame) -> DataFrame:
    """Age at death, sex, district and days from notification to death."""
    born, died = compact_date(df, "R_DTNASC", "ymd"), compact_date(df, "R_DTOBITO", "dmy")
    noted = compact_date(df, "C_DTNOTI", "dmy")

    def upper(name: str) -> Column:
        return F.upper(F.trim(ref(name).cast("string"))) if name in df.columns else F.lit("?")

    return df.withColumns({
        "idade_obito": F.datediff(died, born) / 365.25,
        "sexo": upper("R_SEXO"),
        "bairro": upper("R_BAIRES"),
        "dias_noti_obito": F.datediff(died, noted),
    })


def sex_code(*sources: Column) -> Column:
    """First letter F or M of the first non-missing source."""
    letter = F.substring(F.upper(F.trim(F.coalesce(*sources).cast("string"))), 1, 1)
    return F.when(letter.isin("F", "M"), letter)


def age_band(age: Column) -> Column:
    """Left-closed bands 0, 18, 40, 60, 80, 130; an age outside is NULL."""
    return (
        F.when((age >= 0) & (age < 18), "0-17")
        .when((age >= 18) & (age < 40), "18-39")
        .when((age >= 40) & (age < 60), "40-59")
        .when((age >= 60) & (age < 80), "60-79")
        .when((age >= 80) & (age < 130), "80+")
    )


def wide_score_band(score: Column) -> Column:
    return (
        F.when(score <= 6, "0-6").when(score <= 11, "6-11").when(score <= 25, "11-25")
        .when(score > 25, ">25").otherwise("MISSING")
    )


# Outcome codes of the disease registry.
OUTCOMES = {1: "Cura", 2: "Abandono", 3: "Óbito TB", 4: "Óbito outras", 5: "Transferência",
            6: "Mudança diag", 7: "TBDR"}


def outcome_label(code: Column) -> Column:
    pairs = [F.lit(x) for item in OUTCOMES.items() for x in item]
    whole = code.cast("int")
    return F.coalesce(F.try_element_at(F.create_map(*pairs), whole), whole.cast("string"))
