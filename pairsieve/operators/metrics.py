"""Confusion counts, rates, sweeps, grids, fronts and run summaries.

Sweeps over many thresholds or configurations never repeat the rows: scores are first reduced
to the number of thresholds they reach, which leaves a table of at most (thresholds + 1) rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairsieve.config import ErrorRate
from pairsieve.functions import rates as R
from pairsieve.functions.values import flag, quoted, ref
from pairsieve.operators.ranking import value_bin
from pairsieve.operators.triage import with_error_rates

COUNTS = ("tp", "fp", "fn", "tn")


def count_columns(label: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates ``tp, fp, fn, tn`` of a binary label and prediction."""
    one = F.lit(1).cast("bigint") if weight is None else weight
    zero = F.lit(0).cast("bigint") if weight is None else F.lit(0.0)
    yes, hit = label == 1, predicted == 1
    cells = {"tp": yes & hit, "fp": ~yes & hit, "fn": yes & ~hit, "tn": ~yes & ~hit}
    return [F.coalesce(F.sum(F.when(c, one).otherwise(zero)), zero).alias(n) for n, c in cells.items()]


def confusion(
    df: DataFrame, label: str, predicted: str, groups: list[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Confusion counts in one aggregation, optionally per group and weighted."""
    cells = count_columns(ref(label), ref(predicted), ref(weight) if weight else None)
    return df.groupBy(*[ref(g) for g in groups or []]).agg(*cells)


def add_rates(counts: DataFrame, beta: float | Column | None = None, prefix: str = "") -> DataFrame:
    """Add precision, recall, F1 (and F-beta) to prefixed confusion counts."""
    tp, fp, fn = (F.col(prefix + c) for c in ("tp", "fp", "fn"))
    out = {
        f"{prefix}precision": R.precision(tp, fp),
        f"{prefix}recall": R.recall(tp, fn),
        f"{prefix}f1": R.f_beta(tp, fp, fn),
    }
    if beta is not None:
        out[f"{prefix}fbeta"] = R.f_beta(tp, fp, fn, beta)
    return counts.withColumns(out)


def add_error_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, false-positive and false-negative rate; NULL for an empty denominator."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    return counts.withColumns({
        "accuracy": R.ratio(tp + tn, tp + fp + fn + tn, None),
        "fpr": R.ratio(fp, fp + tn, None),
        "fnr": R.ratio(fn, fn + tp, None),
    })


def check_binary(df: DataFrame, label: str, score: str | None = None, band: str | None = None) -> None:
    """Raise when labels are not 0/1, or scores or bands are missing; one aggregation."""
    value = ref(label).cast("double")
    checks = {"bad_label": F.coalesce(~value.isin(0.0, 1.0), F.lit(True))}
    if score:
        checks["bad_score"] = ref(score).isNull()
    if band:
        checks["bad_band"] = ref(band).isNull()
    found = df.agg(*[F.sum(c.cast("bigint")).alias(n) for n, c in checks.items()]).first()
    wrong = {n: found[n] for n in checks if found[n]}
    if wrong:
        raise ValueError(f"invalid rows: {wrong}")


def steps_reached(score: str, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds a column reaches (``score >= t``).

    A balanced tree of comparisons: about log2 of the thresholds per row, all in generated code.
    """
    name, steps = quoted(score), [float(t) for t in thresholds]

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN {name} >= {steps[middle]!r}D THEN {tree(middle + 1, high)} ELSE {tree(low, middle)} END"

    return F.expr(f"CASE WHEN {name} IS NULL THEN 0 ELSE {tree(0, len(steps))} END")


def grid_values(start: int, stop: int, scale: int) -> list[float]:
    """``start/scale … stop/scale`` made from whole numbers, so no step error piles up."""
    return [i / scale for i in range(start, stop + 1)]


def threshold_sweep(
    df: DataFrame, score: str, label: str, thresholds: Sequence[float],
    groups: list[str] | None = None,
) -> DataFrame:
    """Confusion counts and rates at every threshold; thresholds nobody reaches are left out."""
    groups = groups or []
    ordered = sorted(float(t) for t in thresholds)
    by = [ref(g) for g in groups]
    cells = df.groupBy(*by, steps_reached(score, ordered).alias("_s")).agg(
        F.count("*").alias("_n"), F.sum(ref(label).cast("bigint")).alias("_p")
    )
    spread = cells.select(
        *by, "_n", "_p", F.posexplode(F.array(*[F.lit(t) for t in ordered])).alias("_i", "threshold"), "_s"
    )
    hit = F.col("_i") < F.col("_s")
    counts = spread.groupBy(*by, "threshold").agg(
        F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("_n") - F.col("_p")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("_p")).otherwise(0)).alias("fn"),
        F.sum(F.when(~hit, F.col("_n") - F.col("_p")).otherwise(0)).alias("tn"),
    )
    return add_rates(counts.filter(F.col("tp") + F.col("fp") > 0))


def best_threshold(sweep: DataFrame, objective: str = "f1") -> DataFrame:
    """The first best row: by F1, by recall with precision > 0.01, or precision with recall > 0.3."""
    limits = {
        "f1": F.lit(True),
        "recall": F.col("precision") > 0.01,
        "precision": F.col("recall") > 0.3,
    }
    return sweep.filter(limits[objective]).orderBy(F.desc(objective), F.asc("threshold")).limit(1)


def rule_grid(
    df: DataFrame, score: str, rule: str, label: str, score_steps: Sequence[float],
    rule_steps: Sequence[float],
) -> DataFrame:
    """AND-combination of a probability and a rule threshold over a whole grid.

    Rows shrink to (steps reached, steps reached) counts, so the grid is evaluated on at most
    a few hundred cells.
    """
    s_steps, r_steps = sorted(map(float, score_steps)), sorted(map(float, rule_steps))
    cells = df.groupBy(
        steps_reached(score, s_steps).alias("_s"), steps_reached(rule, r_steps).alias("_r")
    ).agg(F.count("*").alias("_n"), F.sum(ref(label).cast("bigint")).alias("_p"))
    spread = cells.select(
        "_n", "_p", "_s", "_r",
        F.posexplode(F.array(*[F.lit(t) for t in s_steps])).alias("_i", "ml_threshold"),
    ).select("*", F.posexplode(F.array(*[F.lit(t) for t in r_steps])).alias("_j", "rules_threshold"))
    hit = (F.col("_i") < F.col("_s")) & (F.col("_j") < F.col("_r"))
    counts = spread.groupBy("ml_threshold", "rules_threshold").agg(
        F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("_n") - F.col("_p")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("_p")).otherwise(0)).alias("fn"),
        F.sum(F.when(~hit, F.col("_n") - F.col("_p")).otherwise(0)).alias("tn"),
    )
    return add_rates(counts.filter(F.col("tp") + F.col("fp") > 0))


def pareto_front(
    points: DataFrame, precision: str = "precision", recall: str = "recall"
) -> DataFrame:
    """Points no other point beats on both measures; equal points all stay.

    Best precision per recall first; then the best precision at any greater recall, carried
    over bins of recall and inside each bin, so no window spans all points.
    """
    per_recall = points.groupBy(ref(recall).alias("_r")).agg(F.max(ref(precision)).alias("_p"))
    per_recall = value_bin(per_recall, "_r", "_b")
    bins = per_recall.groupBy("_b").agg(F.max("_p").alias("_m"))
    over_bins = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select("_b", F.max("_m").over(over_bins).alias("_outer"))
    inside = W.partitionBy("_b").orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, -1)
    beyond = F.greatest(F.max("_p").over(inside), F.col("_outer"))
    best = per_recall.join(bins, "_b").withColumn("_beyond", beyond).filter(
        F.col("_beyond").isNull() | (F.col("_beyond") < F.col("_p"))
    )
    keep = (ref(recall) == F.col("_r")) & (ref(precision) == F.col("_p"))
    return points.join(best.select("_r", "_p"), keep, "left_semi")


def profile_label(precision: Column, recall: Column, f1: Column) -> Column:
    """The published names of the operating profiles."""
    return (
        F.when(recall >= 0.98, "Máx. revocação")
        .when(precision >= 0.97, "Máx. precisão")
        .when(f1 >= 0.94, "Equilíbrio ótimo")
        .otherwise("Intermediário")
    )


def front_summary(front: DataFrame, top: int = 8, tie: str | None = None) -> DataFrame:
    """Front points that differ at three decimals, from the greatest recall, with a profile."""
    named = front.withColumns({
        "p3": F.round("precision", 3), "r3": F.round("recall", 3),
        "profile": profile_label(F.col("precision"), F.col("recall"), F.col("f1")),
    })
    row = F.struct(*[ref(c) for c in named.columns])
    order = [F.col("recall"), F.col("precision")] + ([-ref(tie)] if tie else [])
    picked = named.groupBy(F.col("p3").alias("_p"), F.col("r3").alias("_r")).agg(
        F.max_by(row, F.struct(*order)).alias("_row")
    )
    return picked.select("_row.*").orderBy(F.desc("recall"), F.desc("precision")).limit(top)


def operating_region(
    points: DataFrame, least_precision: float = 0.95, least_recall: float = 0.80, top: int = 10,
    tie: Sequence[str] = (),
) -> DataFrame:
    inside = (F.col("precision") >= least_precision) & (F.col("recall") >= least_recall)
    return points.filter(inside).orderBy(F.desc("f1"), *[F.asc(t) for t in tie]).limit(top)


def select_model(models: DataFrame, metric: str = "precision", name: str = "model") -> DataFrame:
    """The best model with precision >= 0.5 and recall >= 0.2, else simply the best."""
    fit = flag((F.col("precision") >= 0.5) & (F.col("recall") >= 0.2))
    return (
        models.filter(F.col("recall") > 0)
        .orderBy(F.desc(fit), F.desc(metric), F.asc(name))
        .limit(1)
    )


def review_outcome_counts(
    decided: DataFrame, label: str, error_rates: Mapping[str, ErrorRate],
    groups: list[str] | None = None, weight: str | None = None,
) -> DataFrame:
    """Automatic, oracle and expected confusion counts of triaged pairs in one aggregation.

    Expected: a reviewed positive counts ``1 - e_fn`` as found and ``e_fn`` as missed, a
    reviewed negative ``e_fp`` as a false alarm and ``1 - e_fp`` as dismissed.  ``weight`` is
    the row count of an already compacted table.
    """
    rows = with_error_rates(decided, error_rates)
    w = quoted(weight) if weight else "1"
    y, n = f"{quoted(label)} = 1", f"{quoted(label)} <> 1"

    def number_of(condition: str, name: str) -> Column:
        return F.expr(f"CAST(sum(CASE WHEN {condition} THEN {w} ELSE 0 END) AS BIGINT)").alias(name)

    def certain(condition: str, name: str) -> Column:
        return F.expr(f"sum(CASE WHEN {condition} THEN CAST({w} AS DOUBLE) ELSE 0D END)").alias(name)

    def expected(act: str, side: str, share: str, name: str) -> Column:
        return F.expr(
            f"sum(CASE WHEN action = '{act}' AND {side} THEN CAST({w} AS DOUBLE) "
            f"WHEN action = 'LLM_REVIEW' AND {side} THEN {w} * ({share}) ELSE 0D END)"
        ).alias(name)

    match, non, review = (f"action = '{a}'" for a in ("MATCH", "NONMATCH", "LLM_REVIEW"))
    return rows.groupBy(*[ref(g) for g in groups or []]).agg(
        number_of("true", "n_test"), number_of(y, "pos_test"),
        number_of("review_requested", "review_requested"), number_of(review, "review_selected"),
        certain(f"{match} AND {y}", "auto_tp"), certain(f"{match} AND {n}", "auto_fp"),
        certain(f"{non} AND {y}", "auto_fn"), certain(f"{non} AND {n}", "auto_tn"),
        certain(f"({match} OR {review}) AND {y}", "oracle_tp"),
        certain(f"{match} AND {n}", "oracle_fp"), certain(f"{non} AND {y}", "oracle_fn"),
        certain(f"({non} OR {review}) AND {n}", "oracle_tn"),
        expected("MATCH", y, "1D - e_fn", "exp_tp"), expected("MATCH", n, "e_fp", "exp_fp"),
        expected("NONMATCH", y, "e_fn", "exp_fn"), expected("NONMATCH", n, "1D - e_fp", "exp_tn"),
    )


def summarize_runs(
    runs: DataFrame, groups: list[str], metrics: list[str], population: bool = False
) -> DataFrame:
    """Mean and deviation per metric and the number of runs; one run has no sample deviation."""
    lost = [c for c in [*groups, *metrics] if c not in runs.columns]
    if lost:
        raise KeyError(f"missing columns: {lost}")
    spread = F.stddev_pop if population else F.stddev_samp
    cells = []
    for m in metrics:
        cells += [F.avg(ref(m)).alias(f"{m}_mean"), spread(ref(m)).alias(f"{m}_std")]
    return runs.groupBy(*[ref(g) for g in groups]).agg(*cells, F.count("*").alias("n_runs"))


def rank_models(summary: DataFrame, metrics: list[str], name: str = "model") -> DataFrame:
    """Rank by several metrics in order of importance; the table has one row per model."""
    order = [F.desc(m) for m in metrics] + [F.asc(name)]
    return summary.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def best_per_category(results: DataFrame, category: str, metric: str, tie: str) -> DataFrame:
    """The best row of each category by a mergeable aggregate, not a window over the category."""
    best = results.groupBy(ref(category)).agg(F.max(ref(metric)).alias("_m"))
    tied = results.join(best, category).filter(ref(metric) == F.col("_m")).drop("_m")
    row = F.struct(*[ref(c) for c in results.columns])
    return tied.groupBy(ref(category).alias("_c")).agg(F.min_by(row, ref(tie)).alias("_r")).select("_r.*")


def best_by(results: DataFrame, metric: str, tie: str) -> DataFrame:
    return results.orderBy(F.desc(metric), F.asc(tie)).limit(1)
