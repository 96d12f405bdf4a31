"""Score histograms and what follows from them: curves, areas, exact quantiles, KS.

Rows are reduced to one line per distinct value before anything is ordered.  Running totals
then take two levels: a short table of value bins, and the distinct values inside each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairsieve.functions.values import ref
from pairsieve.operators.ranking import _null_safe_join, bin_offsets, value_bin


def histogram(
    df: DataFrame, value: str, groups: list[str] | None = None,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Counts per distinct non-missing value: ``value, n`` and any extra sums."""
    groups = groups or []
    extra = [c.alias(name) for name, c in (sums or {}).items()]
    return (
        df.filter(ref(value).isNotNull() & ~F.isnan(ref(value).cast("double")))
        .groupBy(*[ref(g) for g in groups], ref(value).cast("double").alias("value"))
        .agg(F.count("*").alias("n"), *extra)
    )


def running_totals(
    hist: DataFrame, groups: list[str], measures: list[str], descending: bool
) -> DataFrame:
    """Add ``<measure>_to``, the total up to and including each value in the chosen order."""
    binned = value_bin(hist, "value")
    bins = bin_offsets(binned, groups, {m: F.sum(m) for m in measures}, descending)
    bins = bins.drop(*measures)
    order = F.desc("value") if descending else F.asc("value")
    inside = (
        W.partitionBy(*[ref(g) for g in groups], "_vb")
        .orderBy(order)
        .rowsBetween(W.unboundedPreceding, 0)
    )
    joined = _null_safe_join(binned, bins, [*groups, "_vb"])
    for m in measures:
        joined = joined.withColumn(f"{m}_to", F.sum(m).over(inside) + F.col(f"{m}_before"))
    return joined.drop("_vb", *[f"{m}_before" for m in measures])


def _totals(hist: DataFrame, groups: list[str], measures: list[str]) -> DataFrame:
    aggregates = [F.sum(m).alias(f"{m}_all") for m in measures]
    return hist.groupBy(*[ref(g) for g in groups]).agg(*aggregates)


def with_totals(hist: DataFrame, groups: list[str], measures: list[str]) -> DataFrame:
    """Attach the group totals ``<measure>_all``; a scalar subquery when there is no group."""
    totals = _totals(hist, groups, measures)
    if groups:
        return _null_safe_join(hist, totals, groups)
    names = [f"{m}_all" for m in measures]
    one = totals.select(F.struct(*names)).scalar()
    return hist.withColumns({n: one[n] for n in names})


def curve(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """ROC and precision-recall points, one per distinct score, from the highest down."""
    groups = groups or []
    positives = F.sum(ref(label).cast("bigint"))
    hist = histogram(df, score, groups, {"pos": positives})
    points = with_totals(running_totals(hist, groups, ["n", "pos"], True), groups, ["n", "pos"])
    tp, fp = F.col("pos_to"), F.col("n_to") - F.col("pos_to")
    negatives = F.col("n_all") - F.col("pos_all")
    return points.select(
        *[ref(g) for g in groups],
        F.col("value").alias("threshold"),
        F.col("n"),
        F.col("pos"),
        tp.alias("tp"),
        fp.alias("fp"),
        (F.col("pos_all") - tp).alias("fn"),
        (negatives - fp).alias("tn"),
        F.try_divide(tp.cast("double"), F.col("n_to").cast("double")).alias("precision"),
        F.try_divide(tp.cast("double"), F.col("pos_all").cast("double")).alias("recall"),
        F.try_divide(fp.cast("double"), negatives.cast("double")).alias("fpr"),
    )


def ranking_quality(
    df: DataFrame, score: str, label: str, groups: list[str] | None = None
) -> DataFrame:
    """ROC AUC (ties averaged) and step-wise average precision, NULL for a single class."""
    groups = groups or []
    points = curve(df, score, label, groups)
    neg = (F.col("n") - F.col("pos")).cast("double")
    above = F.col("tp") - F.col("pos") / 2.0
    sums = points.groupBy(*[ref(g) for g in groups]).agg(
        F.sum(neg * above).alias("area"),
        F.sum(neg).alias("negatives"),
        F.sum("pos").cast("double").alias("positives"),
        F.sum(F.col("pos") * F.col("precision")).alias("steps"),
    )
    both = (F.col("negatives") > 0) & (F.col("positives") > 0)
    return sums.select(
        *[ref(g) for g in groups],
        F.when(both, F.try_divide("area", F.col("negatives") * F.col("positives"))).alias("roc_auc"),
        F.when(both, F.try_divide("steps", "positives")).alias("average_precision"),
    )


def exact_quantiles(
    df: DataFrame, value: str, points: dict[str, float], groups: list[str] | None = None
) -> DataFrame:
    """Linearly interpolated quantiles, one column per name, plus the count ``n``.

    Equal to a sort-based percentile without holding the distinct values in one aggregation
    buffer.
    """
    groups = groups or []
    hist = with_totals(
        running_totals(histogram(df, value, groups), groups, ["n"], False), groups, ["n"]
    )
    first, last = F.col("n_to") - F.col("n"), F.col("n_to") - 1
    picks = []
    for i, q in enumerate(points.values()):
        position = F.lit(float(q)) * (F.col("n_all") - 1)
        for side, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.max(F.when((first <= at) & (at <= last), F.col("value"))).alias(f"_{side}{i}"))
    found = hist.groupBy(*[ref(g) for g in groups]).agg(F.max("n_all").alias("n"), *picks)
    outputs = []
    for i, (name, q) in enumerate(points.items()):
        position = F.lit(float(q)) * (F.col("n") - 1)
        part = position - F.floor(position)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        outputs.append((low + (high - low) * part).alias(name))
    return found.select(*[ref(g) for g in groups], "n", *outputs)


def average_ranks(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """Descending rank of every distinct value, ties sharing their mean rank."""
    groups = groups or []
    hist = running_totals(histogram(df, value, groups), groups, ["n"], True)
    mean_rank = F.col("n_to") - (F.col("n") - 1) / 2.0
    return hist.select(*[ref(g) for g in groups], "value", "n", mean_rank.alias("rank"))


def cumulative_distribution(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """Share of rows at or below each distinct value."""
    groups = groups or []
    hist = with_totals(
        running_totals(histogram(df, value, groups), groups, ["n"], False), groups, ["n"]
    )
    return hist.select(
        *[ref(g) for g in groups], "value", "n",
        (F.col("n_to").cast("double") / F.col("n_all")).alias("cdf"),
    )
