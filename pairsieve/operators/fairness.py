"""Subgroup fairness: slices, group rates, pairwise tests, band stability.

Rows are counted once per (dimension, group); everything after that works on those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairsieve.functions import intervals as I
from pairsieve.functions.rates import ratio
from pairsieve.functions.values import flag, ref
from pairsieve.operators.features import age_band, sex_code, wide_score_band
from pairsieve.operators.histograms import exact_quantiles

DIMENSIONS = ["nome_qtd_quartis", "bandeira", "faixa_idade", "sexo", "uf"]
METRICS = ["tpr", "ppv"]
WIDE_BANDS = ["0-6", "6-11", "11-25", ">25"]

# Two-digit state codes per region of the national geography.
REGIONS = {
    "NORTE": [11, 12, 13, 14, 15, 16, 17],
    "NORDESTE": [21, 22, 23, 24, 25, 26, 27, 28, 29],
    "SUDESTE": [31, 32, 33, 35],
    "SUL": [41, 42, 43],
    "CENTRO_OESTE": [50, 51, 52, 53],
}
# The hypotheses as reports name them.
NULL_HYPOTHESIS = {
    "tpr": "P(y_hat=1 | y=1, g=a) = P(y_hat=1 | y=1, g=b)",
    "ppv": "P(y=1 | y_hat=1, g=a) = P(y=1 | y_hat=1, g=b)",
}
ALTERNATIVE = {
    "tpr": "TPR differs between groups in the same comparison",
    "ppv": "PPV differs between groups in the same comparison",
}


def region_of_state(code: Column) -> Column:
    chain = None
    for region, codes in REGIONS.items():
        inside = code.cast("int").isin(*[int(c) for c in codes])
        chain = F.when(inside, region) if chain is None else chain.when(inside, region)
    return chain.otherwise("OUTRA_REGION")


def quartile_labels(df: DataFrame, value: str, out: str, quarters: int = 4) -> DataFrame:
    """Right-closed value quantiles, equal edges merged; labels Q1.. by edge order."""
    points = {f"e{i}": i / quarters for i in range(quarters + 1)}
    edges = exact_quantiles(df, value, points).select(
        F.array_sort(F.array_distinct(F.array(*points))).alias("edges")
    ).scalar()
    v = ref(value).cast("double")
    rows = df.withColumn("_edges", edges)
    e = F.col("_edges")
    position = F.greatest(F.size(F.filter(e, lambda x: x < v)), F.lit(1))
    inside = v.isNotNull() & (F.size(e) > 1)
    return rows.withColumn(out, F.when(inside, F.concat(F.lit("Q"), position.cast("string")))).drop("_edges")


def collapse_small_groups(
    df: DataFrame, group: str, region: Column, least: int = 30, out: str = "uf"
) -> DataFrame:
    """Groups with fewer rows become their region; regions still too small become MISSING.

    Both counts are over the short list of groups, and the mapping joins back by group.
    """
    counts = df.groupBy(ref(group).alias("_g")).agg(F.count("*").alias("_n"), F.first(region).alias("_r"))
    small = F.col("_n") < least
    plan = counts.withColumn(
        "_to", F.when(F.col("_g").isNull(), "MISSING").when(small, F.concat(F.lit("REGIAO_"), "_r"))
        .otherwise(F.col("_g").cast("string"))
    )
    total = F.sum("_n").over(W.partitionBy("_to"))
    regional = F.col("_to").startswith("REGIAO_")
    plan = plan.withColumn("_to", F.when(regional & (total < least), "MISSING").otherwise(F.col("_to")))
    plan = plan.select("_g", F.col("_to").alias(out))
    return df.join(plan, ref(group).eqNullSafe(F.col("_g"))).drop("_g")


def collapse_notes(df: DataFrame, group: str, region: Column, least: int = 30) -> DataFrame:
    """What the collapse did: which groups moved to a region, which regions to MISSING."""
    counts = df.filter(ref(group).isNotNull()).groupBy(ref(group).cast("string").alias("original_uf")).agg(
        F.count("*").alias("rows"), F.first(region).alias("region")
    )
    moved = counts.filter(F.col("rows") < least).withColumn("action", F.lit("aggregated_to_region"))
    small = moved.groupBy("region").agg(F.sum("rows").alias("rows")).filter(F.col("rows") < least)
    gone = small.select(
        F.concat(F.lit("REGIAO_"), "region").alias("original_uf"), "rows", "region",
        F.lit("collapsed_to_missing_due_small_region").alias("action"),
    )
    return moved.unionByName(gone)


def fairness_frame(
    df: DataFrame, key: str, label: Column, predicted: Column, score: Column, name_score: str,
    outcome: Column, age: Column, sex: tuple[Column, Column], state: Column, region: Column,
    least: int = 30,
) -> DataFrame:
    """One row per pair with label, prediction and the seven slicing columns."""
    base = df.withColumns({
        "_y": flag(label), "_p": flag(predicted), "_score": score.cast("double"), "_age": age_band(age),
        "_sex": sex_code(*sex), "_state": state, "_region": region,
        "_origin": F.when(F.coalesce(outcome.isin(3, 4), F.lit(False)), "tb_origem").otherwise("controle"),
    })
    base = quartile_labels(base, name_score, "_quarter")
    base = collapse_small_groups(base, "_state", F.col("_region"), least)
    missing = lambda c: F.coalesce(F.col(c), F.lit("MISSING"))
    return base.select(
        ref(key), F.col("_y").alias("y_true"), F.col("_p").alias("y_pred"),
        missing("_quarter").alias("nome_qtd_quartis"), F.col("_origin").alias("bandeira"),
        missing("_age").alias("faixa_idade"), missing("_sex").alias("sexo"), missing("uf").alias("uf"),
        wide_score_band(F.col("_score")).alias("score_band"), F.col("_score").alias("score_source"),
    )


def group_counts(frame: DataFrame, dimensions: list[str] | None = None, least: int = 30) -> DataFrame:
    """Confusion counts per (dimension, group) of the eligible groups.

    Rows are first counted per combination of all slicing columns and only those counts are
    turned to long form.
    """
    dimensions = dimensions or DIMENSIONS
    cells = frame.groupBy(*dimensions, "y_true", "y_pred").agg(F.count("*").alias("_n"))
    pairs = F.array(*[
        F.struct(F.lit(d).alias("dimension"), ref(d).cast("string").alias("group")) for d in dimensions
    ])
    long = cells.select("y_true", "y_pred", "_n", F.inline(pairs))
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1

    def n_of(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(0))

    counts = long.filter(F.col("group").isNotNull() & (F.col("group") != "MISSING")).groupBy(
        "dimension", "group"
    ).agg(
        F.sum("_n").alias("n_total"), n_of(y).alias("n_true"), n_of(p).alias("n_pred_pos"),
        n_of(y & p).alias("tp"), n_of(y & ~p).alias("fn"), n_of(~y & p).alias("fp"),
    )
    return counts.filter(F.col("n_total") >= least)


def _by_metric(counts: DataFrame) -> DataFrame:
    both = F.array(
        F.struct(F.lit("tpr").alias("metric"), (F.col("tp") + F.col("fn")).alias("den")),
        F.struct(F.lit("ppv").alias("metric"), (F.col("tp") + F.col("fp")).alias("den")),
    )
    return counts.select("*", F.inline(both)).withColumn("num", F.col("tp"))


def group_metrics(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """TPR and PPV per group with Wilson bounds."""
    long = _by_metric(counts)
    low, high = I.wilson(F.col("num"), F.col("den"), alpha)
    return long.withColumns({
        "rate": ratio(F.col("num"), F.col("den"), None), "wilson_low": low, "wilson_high": high,
    })


def pairwise_tests(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """All pairs of groups of a dimension: chi-square, or Fisher for small expected cells.

    The self join is on (dimension, metric) of the aggregated groups.  The p-values are
    adjusted over every test that could be done.
    """
    long = _by_metric(counts).select("dimension", "metric", "group", "n_total", "num", "den")

    def side(letter: str, n: str) -> DataFrame:
        return long.select(
            "dimension", "metric", F.col("group").alias(f"group_{letter}"),
            F.col("n_total").alias(f"n_group_{letter}"), F.col("num").alias(f"num_{letter}"),
            F.col("den").alias(n),
        )

    pairs = side("a", "n1").join(side("b", "n2"), ["dimension", "metric"]).filter(
        F.col("group_a") < F.col("group_b")
    )
    a, c = F.col("num_a"), F.col("num_b")
    b, d = F.col("n1") - a, F.col("n2") - c
    statistic, expected = I.chi_square(a, b, c, d)
    usable = (F.col("n1") > 0) & (F.col("n2") > 0)
    exact = F.coalesce(expected < 5.0, F.lit(True)) | statistic.isNull()
    rate_a, rate_b = ratio(a, F.col("n1"), None), ratio(c, F.col("n2"), None)
    odds = I.odds_ratio(a, b, c, d, alpha)
    diff = I.rate_difference(rate_a, F.col("n1"), rate_b, F.col("n2"), alpha)

    def only(value: Column) -> Column:
        return F.when(usable, value)

    tested = pairs.withColumns({
        "test": F.when(~usable, "skipped").when(exact, "fisher").otherwise("chi2"),
        "test_reason": F.when(~usable, "invalid_denominator_zero").when(exact, "expected_cell_below_5")
        .otherwise("expected_cells>=5"),
        "null_hypothesis": F.when(F.col("metric") == "tpr", NULL_HYPOTHESIS["tpr"]).otherwise(NULL_HYPOTHESIS["ppv"]),
        "alternative": F.when(F.col("metric") == "tpr", ALTERNATIVE["tpr"]).otherwise(ALTERNATIVE["ppv"]),
        "n_cell_min": F.least(a, b, c, d),
        "test_statistic": F.when(usable & ~exact, statistic),
        "odds_ratio": only(odds[0]), "or_ci_low": only(odds[1]), "or_ci_high": only(odds[2]),
        "rate_a": only(rate_a), "rate_b": only(rate_b), "rate_diff": only(diff[0]),
        "rate_diff_ci_low": only(diff[1]), "rate_diff_ci_high": only(diff[2]),
    })
    fisher = F.col("test") == "fisher"
    cells = [F.when(fisher, x) for x in (a, b, c, d)]
    tested = tested.withColumn(
        "p_value_raw",
        F.coalesce(I.chi_square_p(F.col("test_statistic")), I.fisher_p(*[x.cast("double") for x in cells])),
    )
    return benjamini_hochberg(tested, "p_value_raw", "p_value_fdr", ["dimension", "metric", "group_a", "group_b"]
                              ).withColumn("reject_fdr", F.coalesce(F.col("p_value_fdr") <= alpha, F.lit(False)))


def benjamini_hochberg(tests: DataFrame, p: str, out: str, tie: list[str]) -> DataFrame:
    """Adjusted p-values over all tests; missing ones stay missing.

    The window spans the table of tests, one row per pair of groups.
    """
    p_value = F.nanvl(ref(p), F.lit(None).cast("double"))
    known = tests.withColumn("_p", p_value)
    order = [F.asc_nulls_last("_p"), *[F.asc(t) for t in tie]]
    rank = F.row_number().over(W.orderBy(*order))
    m = F.count("_p").over(W.partitionBy(F.lit(0)))
    stepped = known.withColumn("_q", F.when(F.col("_p").isNotNull(), F.col("_p") * m / rank))
    down = W.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    adjusted = F.least(F.lit(1.0), F.min("_q").over(down))
    return stepped.withColumn(out, F.when(F.col("_p").isNotNull(), adjusted)).drop("_p", "_q")


def band_stability(frame: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Counts and rates of every wide score band, zero rows for empty ones."""
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1

    def n_of(condition: Column) -> Column:
        return F.sum(condition.cast("bigint"))

    counts = frame.groupBy("score_band").agg(
        F.count("*").alias("n_rows"), n_of(y).alias("n_true"), n_of(p).alias("n_pred_pos"),
        n_of(y & p).alias("tp"), n_of(~y & p).alias("fp"), n_of(y & ~p).alias("fn"), n_of(~y & ~p).alias("tn"),
    )
    bands = frame.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in WIDE_BANDS])).alias("score_band"))
    full = bands.join(counts, "score_band", "left").fillna(0)
    tpr_den, ppv_den = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    tpr, ppv = I.wilson(F.col("tp"), tpr_den, alpha), I.wilson(F.col("tp"), ppv_den, alpha)
    return full.withColumns({
        "tpr": ratio(F.col("tp"), tpr_den, None), "tpr_ci_low": tpr[0], "tpr_ci_high": tpr[1],
        "ppv": ratio(F.col("tp"), ppv_den, None), "ppv_ci_low": ppv[0], "ppv_ci_high": ppv[1],
    })


def kappa(df: DataFrame, first: str, second: str) -> DataFrame:
    """Agreement of two reviewers beyond chance, over any set of answers."""
    cells = df.groupBy(ref(first).alias("a"), ref(second).alias("b")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    row, column = F.sum("n").over(W.partitionBy("a")), F.sum("n").over(W.partitionBy("b"))
    # Each margin product is counted once, through the diagonal; answers of one reviewer only add none.
    margins = cells.withColumns({"_t": total, "_a": row, "_b": column})
    left = margins.groupBy("a", "_t").agg(F.first("_a").alias("na"))
    right = margins.groupBy("b").agg(F.first("_b").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(
        F.sum(F.col("na").cast("double") * F.col("nb") / F.col("_t") / F.col("_t")).alias("pe")
    ).scalar()
    agree = margins.agg(
        F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"),
        F.sum("n").alias("n"),
    )
    po = F.col("agree") / F.col("n")
    return agree.select("n", po.alias("observed"), chance.alias("expected")).withColumn(
        "kappa", F.try_divide(F.col("observed") - F.col("expected"), 1.0 - F.col("expected"))
    )
