"""Distribution drift between a baseline and a current table: PSI and KS per field and slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairsieve.config import Mode, Monitoring
from pairsieve.functions.values import number_sql, ref
from pairsieve.operators.histograms import exact_quantiles, histogram, running_totals, with_totals


def long_form(df: DataFrame, fields: list[str], slices: list[str] | None = None) -> DataFrame:
    """``feature, slice..., value`` for the fields present, missing values dropped."""
    cells = ", ".join(f"struct('{f}' AS feature, {number_sql(df, f)} AS value)" for f in fields)
    rows = df.select(*[ref(s) for s in slices or []], F.expr(f"inline(array({cells}))"))
    return rows.filter(F.col("value").isNotNull())


def _status(value: Column, warn: float, critical: float) -> Column:
    return F.when(value >= critical, "critical").when(value >= warn, "warning").otherwise("ok")


def psi(
    baseline: DataFrame, current: DataFrame, value: str = "value", groups: list[str] | None = None,
    buckets: int = 10,
) -> DataFrame:
    """Population stability index over the baseline's quantile bins.

    Edges are exact quantiles, equal ones merged; the last bin is closed; values outside the
    edges are dropped although the full length divides.  Fewer than two edges, or an empty
    side, give 0.  Values shrink to counts per distinct value before they meet the edges.
    """
    groups = groups or []
    points = {f"e{i}": i / buckets for i in range(buckets + 1)}
    edges = exact_quantiles(baseline, value, points, groups).select(
        *[ref(g) for g in groups], F.array_sort(F.array_distinct(F.array(*points))).alias("edges")
    )

    def side(df: DataFrame, name: str) -> DataFrame:
        return histogram(df, value, groups).withColumn("side", F.lit(name))

    counts = side(baseline, "e").unionByName(side(current, "a"))
    if groups:
        rows = counts.join(edges, _same(counts, edges, groups), "left").select(counts["*"], "edges")
        rows = rows.withColumn("edges", F.coalesce("edges", F.array().cast("array<double>")))
    else:
        rows = counts.withColumn("edges", edges.select("edges").scalar())
    v, e = F.col("value"), F.col("edges")
    inside = (F.size(e) > 1) & (v >= F.element_at(e, 1)) & (v <= F.element_at(e, -1))
    below = F.size(F.filter(e, lambda x: x <= v))
    rows = rows.withColumn("bin", F.when(inside, F.least(below, F.size(e) - 1)).otherwise(F.lit(0)))
    per_bin = rows.groupBy(*[ref(g) for g in groups], "bin").agg(
        F.max(F.size("edges")).alias("n_edges"),
        *[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(s) for s in ("e", "a")],
    )
    collected = per_bin.groupBy(*[ref(g) for g in groups]).agg(
        F.max("n_edges").alias("n_edges"),
        F.sum("e").alias("n_e"), F.sum("a").alias("n_a"),
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("e", "a")))).alias("bins"),
    )

    def term(i: Column) -> Column:
        cell = F.try_element_at(F.col("bins"), i)
        count = lambda s: F.coalesce(cell[s], F.lit(0)).cast("double") + 1e-6
        share_e, share_a = count("e") / F.col("n_e"), count("a") / F.col("n_a")
        return (share_a - share_e) * F.log(share_a / share_e)

    bins = F.sequence(F.lit(1), F.greatest(F.col("n_edges") - 1, F.lit(1)))
    total = F.aggregate(F.transform(bins, term), F.lit(0.0), lambda acc, x: acc + x)
    usable = (F.col("n_edges") > 1) & (F.col("n_e") > 0) & (F.col("n_a") > 0)
    return collected.select(*[ref(g) for g in groups], F.when(usable, total).otherwise(0.0).alias("psi"))


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of the named columns with NULL equal to NULL."""
    condition = F.lit(True)
    for n in names:
        condition = condition & left[n].eqNullSafe(right[n])
    return condition


def ks(
    baseline: DataFrame, current: DataFrame, value: str = "value", groups: list[str] | None = None
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic; 0 when a side is empty."""
    groups = groups or []
    sides = baseline.select(*[ref(g) for g in groups], ref(value), F.lit(1).alias("_b")).unionByName(
        current.select(*[ref(g) for g in groups], ref(value), F.lit(0).alias("_b"))
    )
    hist = histogram(sides, value, groups, {"b": F.sum("_b"), "c": F.sum(1 - F.col("_b"))})
    totals = with_totals(running_totals(hist, groups, ["b", "c"], False), groups, ["b", "c"])
    gap = F.abs(
        F.try_divide(F.col("b_to").cast("double"), F.col("b_all"))
        - F.try_divide(F.col("c_to").cast("double"), F.col("c_all"))
    )
    return totals.groupBy(*[ref(g) for g in groups]).agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))


def check_drift(
    baseline: DataFrame, current: DataFrame, monitoring: Monitoring, slices: list[str] | None = None
) -> DataFrame:
    """Both statistics per monitored field with a status, for all rows and per slice value.

    Fields absent from either table are skipped.  ``slices`` names columns of both tables.
    """
    fields = [f for f in monitoring.fields if f in baseline.columns and f in current.columns]
    views = [("global", None), *[(s, s) for s in slices or []]]
    parts = []
    for name, column in views:
        on = [] if column is None else [column]
        b, c = long_form(baseline, fields, on), long_form(current, fields, on)
        groups = ["feature", *on]
        label = F.lit("all") if column is None else ref(column).cast("string")
        for metric, frame in (("ks", ks(b, c, "value", groups)), ("psi", psi(b, c, "value", groups))):
            limits = monitoring.metrics.get(metric, {})
            value = F.col(metric)
            status = _status(value, limits.get("threshold_warn", 0.1), limits.get("threshold_critical", 0.2))
            parts.append(frame.select(
                F.lit(metric).alias("metric"), value.alias("value"), status.alias("status"), "feature",
                F.lit(name).alias("slice_name"), label.alias("slice_value"),
            ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def alerts(metrics: DataFrame) -> DataFrame:
    """One line of text per warning or critical value."""
    text = F.format_string(
        "Drift alert: %s for %s is %.3f (%s)", F.upper("metric"), F.col("feature"), F.col("value"), F.col("status")
    )
    return metrics.filter(F.col("status").isin("warning", "critical")).select("feature", "metric", text.alias("alert"))


def critical(metrics: DataFrame) -> bool:
    return not metrics.filter("status = 'critical'").limit(1).isEmpty()


def after_drift(mode: Mode, monitoring: Monitoring, is_critical: bool, tighten: float = 0.05,
                more_budget: float = 1.5) -> tuple[Mode, bool]:
    """The mode for the next window and whether its calibration stays frozen."""
    from dataclasses import replace

    if not is_critical:
        return mode, False
    actions = set(monitoring.actions)
    if "tighten_auto_thresholds" in actions:
        raised = None if mode.min_auto_match is None else min(1.0, mode.min_auto_match + tighten)
        lowered = None if mode.max_auto_nonmatch is None else max(0.0, mode.max_auto_nonmatch - tighten)
        mode = replace(mode, min_auto_match=raised, max_auto_nonmatch=lowered)
    if "increase_llm_budget_if_possible" in actions:
        mode = replace(mode, budget=int(mode.budget * more_budget))
    return mode, "freeze_calibration" in actions
