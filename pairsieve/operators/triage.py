"""Expected-loss triage under a review budget."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from pairsieve.config import ErrorRate, Mode, Settings
from pairsieve.functions.values import quoted, ref, true_or_false
from pairsieve.operators.guardrails import MATCH, NONMATCH, REVIEW
from pairsieve.operators.ranking import first_k, rank_by_value
from pairsieve.session import small_table


def with_error_rates(df: DataFrame, rates: Mapping[str, ErrorRate]) -> DataFrame:
    """Attach the band's ``e_fp`` and ``e_fn``; an unknown band raises.

    The rate table has one row per configured band, which bounds the broadcast.
    """
    rows = [(name, float(r.e_fp), float(r.e_fn)) for name, r in rates.items()]
    table = small_table(df.sparkSession, rows, "_band string, _fp double, _fn double")
    lost = "raise_error(concat('no review error rates for band ', coalesce(band, 'NULL')))"
    kept = [quoted(n) for n in df.columns if n not in ("e_fp", "e_fn")]
    joined = df.join(F.broadcast(table), F.expr("band = _band"), "left")
    return joined.selectExpr(
        *kept,
        *[f"coalesce({a}, CAST({lost} AS DOUBLE)) AS {b}" for a, b in (("_fp", "e_fp"), ("_fn", "e_fn"))],
    )


def loss_sql(mode: Mode, p: str = "p_cal", costs: tuple[str, str] | None = None) -> dict[str, str]:
    """Expected loss of each decision, given the band's error rates.

    ``costs`` names columns that hold the two error costs instead of the mode's.
    """
    fixed = (f"{float(mode.false_positive)!r}D", f"{float(mode.false_negative)!r}D")
    fp, fn = costs or fixed
    return {
        "match": f"(1D - {p}) * {fp}",
        "nonmatch": f"{p} * {fn}",
        "review": f"{float(mode.review)!r}D + (1D - {p}) * e_fp * {fp} + {p} * e_fn * {fn}",
    }


def score_decisions(
    df: DataFrame, mode: Mode, rates: Mapping[str, ErrorRate], costs: tuple[str, str] | None = None
) -> DataFrame:
    """Add base choice, losses, value of review, the request flag and the selection tier.

    Tier 1 is a forced review, 2 a broken automatic limit, 3 a positive value of review;
    rows fixed by a guardrail and rows that ask for nothing have no tier.
    """
    new = ["base_choice", "base_loss", "loss_llm", "evr", "review_requested", "tier", "action"]
    kept = [quoted(n) for n in df.columns if n not in new]
    guard = "guardrail" if "guardrail" in df.columns else "CAST(NULL AS STRING)"
    loss = loss_sql(mode, costs=costs)
    limits = []
    if mode.min_auto_match is not None:
        limits.append(f"(base_choice = 'MATCH' AND p_cal < {mode.min_auto_match!r}D)")
    if mode.max_auto_nonmatch is not None:
        limits.append(f"(base_choice = 'NONMATCH' AND p_cal > {mode.max_auto_nonmatch!r}D)")
    capped = " OR ".join(limits) or "false"
    forced = f"coalesce({guard} = '{REVIEW}', false)"
    return (
        with_error_rates(df, rates)
        .selectExpr(*kept, f"{loss['match']} AS _lm", f"{loss['nonmatch']} AS _ln",
                    f"{loss['review']} AS loss_llm")
        .selectExpr(
            *kept, "loss_llm", "CASE WHEN _lm <= _ln THEN 'MATCH' ELSE 'NONMATCH' END AS base_choice",
            "least(_lm, _ln) AS base_loss", "least(_lm, _ln) - loss_llm AS evr",
        )
        .selectExpr(
            *kept, "base_choice", "base_loss", "loss_llm", "evr",
            f"{forced} OR {capped} OR evr > 0 AS review_requested",
            f"CASE WHEN {guard} IN ('{MATCH}', '{NONMATCH}') THEN NULL WHEN {forced} THEN 1 "
            f"WHEN {capped} THEN 2 WHEN evr > 0 THEN 3 END AS tier",
            f"CASE {guard} WHEN '{MATCH}' THEN 'MATCH' WHEN '{NONMATCH}' THEN 'NONMATCH' "
            "ELSE base_choice END AS action",
        )
    )


def review_order(key: str) -> Column:
    """Tier, then highest value of review, then the row key: unique and reproducible."""
    return F.struct(F.col("tier"), (-F.col("evr")).alias("cost"), ref(key).alias("key"))


def triage(
    df: DataFrame, settings: Settings, mode: str, key: str, used: int = 0,
    budget: int | None = None,
) -> DataFrame:
    """Decide every pair; at most ``budget - used`` rows become ``LLM_REVIEW``.

    Needs ``p_cal``, ``band``, an optional ``guardrail`` and a unique ``key``.  One pass scores
    the rows, a top-k finds the last selected row, and its order value is compared in place.
    """
    limit = settings.budget(mode) if budget is None else budget
    scored = score_decisions(df, settings.mode(mode), settings.band_errors())
    chosen = first_k(
        scored, F.col("tier").isNotNull(), review_order(key), max(0, limit - used), "_chosen"
    )
    return chosen.withColumn(
        "action", F.when(F.col("_chosen"), "LLM_REVIEW").otherwise(F.col("action"))
    ).drop("_chosen")


def selection_rank(scored: DataFrame, key: str, groups: list[str] | None = None) -> DataFrame:
    """Position of each row in the review order, NULL for rows without a tier.

    Several budgets can then be tested on one ranking.  ``key`` is numeric; equal values of
    review may be shared by any share of the rows without one task holding them all.
    """
    waiting = scored.filter(F.col("tier").isNotNull()).withColumn("_cost", -F.col("evr"))
    ranked = rank_by_value(waiting, groups or [], "_cost", key, "review_rank", leading=["tier"])
    rest = scored.filter(F.col("tier").isNull()).withColumn(
        "review_rank", F.lit(None).cast("bigint")
    )
    return ranked.drop("_cost").unionByName(rest)


def action_counts(decided: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows and requests per action (and further columns)."""
    return decided.groupBy(*[ref(c) for c in by or []], "action").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.col("review_requested").cast("bigint")).alias("review_requested"),
    )


def consistent_per_left(
    df: DataFrame, key: str, left: str = "COMPREC", probability: str = "p_cal",
    margin: float = 0.03,
) -> DataFrame:
    """Per left record: the best pair, or a review of the top two when they are close.

    A left record with a third of all pairs must not sit in one task, so the top two are kept
    by mergeable aggregates instead of a window over the group.  Pairs without a left record
    compete with nothing and are kept.
    """
    order = F.struct(ref(probability).alias("p"), (-ref(key)).alias("k"))
    nameless = df.filter(ref(left).isNull()).withColumn("consistency", F.lit("KEEP"))
    df = df.filter(ref(left).isNotNull())
    tops = df.groupBy(ref(left)).agg(F.max(order).alias("_first"))
    flagged = df.join(tops, left)
    second = flagged.filter(order < F.col("_first")).groupBy(ref(left)).agg(
        F.max(order).alias("_second")
    )
    joined = flagged.join(second, left, "left")
    close = true_or_false(F.col("_first.p") - F.col("_second.p") < margin)
    top, runner = order == F.col("_first"), true_or_false(order == F.col("_second"))
    status = F.when(close & (top | runner), "REVIEW").when(top, "KEEP").otherwise("DROP")
    return joined.withColumn("consistency", status).drop("_first", "_second").unionByName(nameless)
