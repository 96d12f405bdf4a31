"""Population and configuration studies over scored pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairsieve.functions import rates as R
from pairsieve.functions.values import ref
from pairsieve.operators.histograms import exact_quantiles
from pairsieve.operators.metrics import add_rates, confusion

# The eight score ranges of the band report, the last one open.
REPORT_RANGES = [(0, 3), (3, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, None)]


def range_label(score: Column, ranges: Sequence[tuple] = REPORT_RANGES) -> Column:
    chain = None
    for low, high in ranges:
        inside = score >= low if high is None else (score >= low) & (score < high)
        name = f"{low}+" if high is None else f"{low}-{high}"
        chain = F.when(inside, name) if chain is None else chain.when(inside, name)
    return chain


def compact(df: DataFrame, label: str, inputs: list[str]) -> DataFrame:
    """One row per distinct combination of label and decision inputs, with its count.

    Decision inputs are flags and small step counts, so the result does not grow with the data
    and every configuration can be tried on it.
    """
    return df.groupBy(ref(label).alias("y"), *[ref(c) for c in inputs]).agg(F.count("*").alias("n"))


def configuration_study(
    cells: DataFrame, configurations: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Confusion counts and rates of many rules at once.

    ``cells`` has ``y``, ``n`` and the decision inputs; ``configurations`` maps a name to
    (category, SQL condition).  All conditions are evaluated in one pass over the cells.
    """
    structs = [
        F.struct(F.lit(name).alias("config"), F.lit(category).alias("category"),
                 F.coalesce(F.expr(condition), F.lit(False)).alias("hit"))
        for name, (category, condition) in configurations.items()
    ]
    long = cells.select("y", "n", F.explode(F.array(*structs)).alias("c")).select(
        "y", "n", "c.config", "c.category", F.col("c.hit").cast("int").alias("pred")
    )
    return add_rates(confusion(long, "y", "pred", ["config", "category"], "n").withColumns(
        {c: F.col(c).cast("bigint") for c in ("tp", "fp", "fn", "tn")}
    ))


def impact_table(cells: DataFrame, methods: Mapping[str, str]) -> DataFrame:
    """Detected, missed and reviewed per method, in percent, and reviews per detection.

    ``cost_per_death`` is NULL where nothing was detected.
    """
    study = configuration_study(cells, {m: ("", c) for m, c in methods.items()}).drop("category")
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    true = F.col("tp") + F.col("fn")
    review = F.col("tp") + F.col("fp")

    def rounded(value: Column, digits: int) -> Column:
        return F.round(value, digits)

    return study.select(
        F.col("config").alias("method"), "tp", "fp", "fn", "tn",
        F.col("tp").alias("detected"), F.col("fn").alias("missed"), review.alias("to_review"),
        rounded(F.col("precision"), 4).alias("precision"),
        rounded(F.col("recall"), 4).alias("recall"),
        rounded(F.col("f1"), 4).alias("f1"),
        rounded(R.ratio(F.col("tp") * 100, total), 4).alias("rate_detected_pct"),
        rounded(R.ratio(true * 100, total), 4).alias("rate_true_pct"),
        rounded(R.ratio(F.col("tp") * 100, true), 1).alias("pct_of_true_found"),
        rounded(R.ratio(review, F.col("tp"), None), 2).alias("cost_per_death"),
    )


def band_report(
    df: DataFrame, score: str, label: str, models: Mapping[str, str],
    ranges: Sequence[tuple] = REPORT_RANGES,
) -> DataFrame:
    """Counts and rates per score range and model; one aggregation for all models."""
    preds = [F.struct(F.lit(m).alias("model"), F.expr(c).cast("int").alias("pred")) for m, c in models.items()]
    long = df.select(
        range_label(ref(score), ranges).alias("band"), ref(label).alias("y"),
        F.explode(F.array(*preds)).alias("m"),
    ).filter(F.col("band").isNotNull()).select("band", "y", "m.model", "m.pred")
    counts = add_rates(confusion(long, "y", "pred", ["band", "model"]))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    pairs = F.col("tp") + F.col("fn")
    return counts.select(
        "band", "model", n.alias("n"), pairs.alias("pairs"),
        R.ratio(pairs * 100, n).alias("pct_pairs"), "tp", "fp", "fn", "tn",
        "precision", "recall", "f1",
    )


def grey_zone(df: DataFrame, score: str, low: float = 5.0, high: float = 8.0) -> DataFrame:
    return df.filter((ref(score) >= low) & (ref(score) < high))


def missed_pairs(
    df: DataFrame, probability: str, threshold: float, rule: str | None = None,
    least_rule: float | None = None, label: str = "PAR",
) -> DataFrame:
    """Pairs labelled 0 whose probability (and rule score) is high."""
    found = df.filter((ref(label) == 0) & (ref(probability) >= threshold))
    return found if rule is None else found.filter(ref(rule) >= least_rule)


def recovered_profile(
    df: DataFrame, found_by_a: Column, found_by_b: Column, label: str, age: str, sex: str,
    score: str,
) -> DataFrame:
    """Recovered (A but not B) against already found (both): age, sex, score, bands."""
    group = F.when(~found_by_b, "recovered").otherwise("found")
    rows = df.filter((ref(label) == 1) & found_by_a).withColumn("group", group)
    bands = {"band_5_6": (5, 6), "band_6_7": (6, 7), "band_7_8": (7, 8)}
    facts = rows.groupBy("group").agg(
        F.count("*").alias("n"),
        F.avg(ref(age)).alias("age_mean"), F.avg(ref(score)).alias("score_mean"),
        F.sum((ref(sex) == "F").cast("bigint")).alias("n_female"),
        F.sum((ref(sex) == "M").cast("bigint")).alias("n_male"),
        *[F.sum(((ref(score) >= a) & (ref(score) < b)).cast("bigint")).alias(n)
          for n, (a, b) in bands.items()],
    )
    for n in bands:
        facts = facts.withColumn(f"{n}_pct", F.col(n) * 100.0 / F.col("n"))
    ages = exact_quantiles(rows, age, {"age_median": 0.5}, ["group"]).drop("n")
    scores = exact_quantiles(rows, score, {"score_median": 0.5}, ["group"]).drop("n")
    return facts.join(ages, "group", "left").join(scores, "group", "left")


def mean_comparison(
    df: DataFrame, features: list[str], candidate: Column, true_pair: Column
) -> DataFrame:
    """Mean of each feature for candidates and true pairs, and the difference in percent."""
    picks = []
    for i, f in enumerate(features):
        picks += [F.avg(F.when(true_pair, ref(f))).alias(f"t{i}"),
                  F.avg(F.when(candidate, ref(f))).alias(f"c{i}")]
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"t{i}").alias("mean_true"),
                 F.col(f"c{i}").alias("mean_candidate"))
        for i, f in enumerate(features)
    ])
    long = df.agg(*picks).select(F.inline(rows))
    t, c = F.col("mean_true"), F.col("mean_candidate")
    return long.withColumn("diff_pct", F.when(t != 0, (c - t) / t * 100).otherwise(0.0))


def impact_estimate(df: DataFrame, candidate: Column, true_pair: Column, precision: Column | float) -> DataFrame:
    """Expected new pairs among the candidates and the gain over today's pairs."""
    p = precision if isinstance(precision, Column) else F.lit(float(precision))
    counts = df.agg(
        F.sum(true_pair.cast("bigint")).alias("pairs"),
        F.sum(candidate.cast("bigint")).alias("candidates"),
    )
    new = F.floor(F.col("candidates") * p).cast("bigint")
    return counts.select("pairs", "candidates", new.alias("expected_new")).withColumn(
        "gain_pct", R.ratio(F.col("expected_new") * 100, F.col("pairs"))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(ref(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), ref(column))


def funnel(df: DataFrame, stages: Mapping[str, Column], label: str) -> DataFrame:
    """Pairs left after each stage, their positives, prevalence and the step's reduction.

    The stages are few, so the window runs over that handful of rows.
    """
    picks, rows = [], []
    for i, (name, keep) in enumerate(stages.items()):
        picks += [F.sum(keep.cast("bigint")).alias(f"n{i}"),
                  F.sum((keep & (ref(label) == 1)).cast("bigint")).alias(f"p{i}")]
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"),
                             F.col(f"n{i}").alias("pairs"), F.col(f"p{i}").alias("positives")))
    long = df.agg(*picks).select(F.inline(F.array(*rows)))
    before = F.lag("pairs").over(W.orderBy("position"))
    return long.withColumns({
        "prevalence_pct": R.ratio(F.col("positives") * 100, F.col("pairs")),
        "reduction_pct": F.when(before > 0, (before - F.col("pairs")) * 100.0 / before),
    })


def importance_pivot(importances: DataFrame, bands: list[str], top: int = 12) -> DataFrame:
    """Feature by band, keeping the features with the greatest mean importance."""
    best = importances.groupBy("feature").agg(F.avg("importance").alias("mean_importance")).orderBy(
        F.desc("mean_importance"), "feature"
    ).limit(top)
    wide = importances.join(best.select("feature"), "feature", "left_semi")
    return wide.groupBy("feature").pivot("band", bands).agg(F.avg("importance"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones with the same key; columns may differ."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def append_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append only rows whose key is not there yet."""
    return old.unionByName(
        new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True
    )


def union_runs(*runs: DataFrame) -> DataFrame:
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run, allowMissingColumns=True)
    return out


def reconcile(
    left: DataFrame, right: DataFrame, keys: list[str], measures: list[str],
    atol: float = 1e-3, rtol: float = 0.0,
) -> DataFrame:
    """Compare two tables by key and measure: OK, DIVERGENCE, or INCONCLUSIVE when one is absent."""
    def renamed(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, *[ref(m).cast("double").alias(f"{side}{i}") for i, m in enumerate(measures)])

    both = renamed(left, "a").join(renamed(right, "b"), keys, "full_outer")
    rows = F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"a{i}").alias("left"), F.col(f"b{i}").alias("right"))
        for i, m in enumerate(measures)
    ])
    long = both.select(*keys, F.inline(rows))
    near = F.abs(F.col("left") - F.col("right")) <= atol + rtol * F.abs("right")
    status = (
        F.when(F.col("left").isNull() | F.col("right").isNull(), "INCONCLUSIVE")
        .when(near, "OK").otherwise("DIVERGENCE")
    )
    return long.withColumn("status", status)
