"""k-anonymity: quantile bins, group statistics and the search for the finest safe schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairsieve import columns as C
from pairsieve.functions.values import number, ref, total
from pairsieve.operators.histograms import histogram, running_totals, with_totals
from pairsieve.operators.ranking import value_bin, value_edges
from pairsieve.session import materialise

#: Distinct values of a column whose bins are sent to all tasks; with more of them they meet the rows by a shuffle.
MOST_SENT = 100_000

FAMILIES = ["nome_total", "mae_total", "dtnasc_total", "local_total", "endereco_total", "nota_final"]


def families(df: DataFrame, keep: list[str]) -> DataFrame:
    """Sums of the sub-scores per domain, and the score."""
    n = lambda names: total([number(df, x, 0.0) for x in names])
    return df.select(
        *[ref(k) for k in keep],
        n([C.NAME_FIRST, C.NAME_LAST, C.NAME_COUNT, C.NAME_SIMILAR]).alias("nome_total"),
        n([C.MOTHER_FIRST, C.MOTHER_LAST, C.MOTHER_COUNT]).alias("mae_total"),
        n(C.BIRTH_SCORES).alias("dtnasc_total"), n(C.TOWN_SCORES).alias("local_total"),
        n(C.ADDRESS_SCORES).alias("endereco_total"), number(df, C.SCORE, 0.0).alias("nota_final"),
    )


def _bin(rank: Column, q: Column, n: Column) -> Column:
    """Bin of a 1-based rank cut at equal quantiles of 1..n."""
    return F.greatest(F.lit(1), F.ceil((rank - 1) * q / F.greatest(n - 1, F.lit(1)))).cast("int")


def _last_ranks(low: Column, high: Column, size: Column, cap: Column, first: Column) -> Column:
    """Ranks inside a value, 1-based, of the last row of every bin it leaves."""
    return F.transform(
        F.sequence(low, high - 1),
        lambda j: (F.floor(j * (size - 1) / cap) + 2 - first).cast("bigint"),
    )


def bin_facts(df: DataFrame, values: list[str], key: str, counts: list[int]) -> DataFrame:
    """Per column and distinct value: the bin of its first row and the keys where bins change.

    A column's rank bins are decided by its value counts alone, except for the few values that
    straddle a cut (at most one per cut).  For those, rows are counted per stretch of keys, and only
    the stretches that hold a cut are ranked, to find the last key before each cut.
    """
    cells = ", ".join(f"struct('{v}' AS col, coalesce(CAST({v} AS DOUBLE), 0D) AS v)" for v in values)
    edges = materialise(value_edges(df, key))  # two jobs read the stretches
    long = value_bin(df, key, "_kb", edges).select(ref(key), "_kb", F.expr(f"inline(array({cells}))"))
    hist = running_totals(histogram(long, "v", ["col"]), ["col"], ["n"], False)
    hist = with_totals(hist.withColumn("one", F.lit(1)), ["col"], ["n", "one"])
    last, first, size = F.col("n_to"), F.col("n_to") - F.col("n") + 1, F.col("n_all")
    picked = []
    for q in counts:
        cap = F.least(F.lit(q), F.col("one_all").cast("int"))
        low, high = _bin(first, cap, size), _bin(last, cap, size)
        cuts = F.when(low < high, _last_ranks(low, high, size, cap, first)).otherwise(
            F.array().cast("array<bigint>"))
        picked += [low.alias(f"a{q}"), cuts.alias(f"cut{q}")]
    facts = materialise(hist.select("col", "value", *picked))
    wanted = None
    for q in counts:
        part = facts.select("col", "value", F.lit(q).alias("q"), F.explode(f"cut{q}").alias("_rank"))
        wanted = part if wanted is None else wanted.unionByName(part)
    # at most one value per cut straddles it; which stretch of keys holds a cut is told by counts alone
    straddling = F.broadcast(wanted.select("col", F.col("value").alias("v")).distinct())
    rows = long.join(straddling, ["col", "v"])
    stretches = rows.groupBy("col", F.col("v").alias("value"), "_kb").agg(F.count("*").alias("_n"))
    before = W.partitionBy("col", "value").orderBy("_kb").rowsBetween(W.unboundedPreceding, -1)
    stretches = stretches.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    holds = (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_n"))
    wanted = materialise(stretches.join(F.broadcast(wanted), ["col", "value"]).filter(holds).select(
        "col", "value", "q", "_kb", (F.col("_rank") - F.col("_before")).alias("_at")))
    near = rows.withColumnRenamed("v", "value").join(F.broadcast(wanted.select("col", "value", "_kb").distinct()), ["col", "value", "_kb"])
    ranked = near.withColumn("_at", F.row_number().over(W.partitionBy("col", "value", "_kb").orderBy(ref(key))))
    keys = ranked.join(F.broadcast(wanted), ["col", "value", "_kb", "_at"]).groupBy("col", "value").agg(*[
        F.collect_list(F.when(F.col("q") == q, ref(key))).alias(f"k{q}") for q in counts
    ])
    return materialise(facts.join(keys, ["col", "value"], "left").select(
        "col", "value", *[f"a{q}" for q in counts], *[f"k{q}" for q in counts]
    ))


def rank_bins(df: DataFrame, values: list[str], key: str, counts: list[int]) -> DataFrame:
    """First-come rank bins ``<value>_q<count>`` of every column and bin count.

    Missing is 0; the bin count is capped by the number of distinct values; ties are cut in
    key order.
    """
    facts = bin_facts(df, values, key, counts)
    sizes = {r["col"]: r["count"] for r in facts.groupBy("col").count().collect()}  # a row per column
    out = df
    for value in values:
        mine = facts.filter(F.col("col") == value).select(
            F.col("value").alias("_v"), *[F.col(f"{c}{q}").alias(f"_{c}{q}") for q in counts for c in "ak"]
        )
        # few values mean many rows each, which a shuffle would bring together in one task
        mine = F.broadcast(mine) if sizes.get(value, 0) <= MOST_SENT else mine
        out = out.join(mine, F.coalesce(ref(value).cast("double"), F.lit(0.0)) == F.col("_v"))
        labels = {
            f"{value}_q{q}": F.concat(F.lit("Q"), (
                F.col(f"_a{q}") + F.coalesce(F.size(F.filter(f"_k{q}", lambda x: x < ref(key))), F.lit(0))
            ).cast("string"))
            for q in counts
        }
        out = out.withColumns(labels).drop("_v", *[f"_{c}{q}" for q in counts for c in "ak"])
    return out


def group_statistics(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Number of groups, smallest group, groups under five."""
    size = F.sum(ref(weight)) if weight else F.count("*")
    groups = df.groupBy(*[ref(c) for c in by]).agg(size.alias("n"))
    return groups.agg(
        F.count("*").alias("groups"), F.min("n").alias("k_min"),
        F.sum((F.col("n") < 5).cast("bigint")).alias("groups_lt5"),
    )


def smallest_groups(df: DataFrame, by: list[str], top: int = 20, weight: str | None = None) -> DataFrame:
    size = F.sum(ref(weight)) if weight else F.count("*")
    groups = df.groupBy(*[ref(c) for c in by]).agg(size.alias("n"))
    return groups.orderBy("n", *[ref(c) for c in by]).limit(top)


def finest_cells(df: DataFrame, key: str, step: str, values: list[str], counts: list[int]) -> DataFrame:
    """All bin columns of all values, reduced to one row per combination with its count."""
    rows = rank_bins(df, values, key, counts)
    columns = [f"{v}_q{q}" for v in values for q in counts]
    return rows.groupBy(ref(step), *columns).agg(F.count("*").alias("n"))


def schema_search(
    cells: DataFrame, step: str, values: list[str], counts: list[int]
) -> DataFrame:
    """Group statistics of every schema: each column left out or binned in one of the ways.

    The schemas form a cube that is built one column at a time: a column's choices are spread
    over the counted cells and counted again at once, so the work follows the number of groups
    in the answer, and the rows behind the cells are never read again.
    """
    rows = cells.select(
        F.col("n"), ref(step).cast("string").alias("cell"), F.lit("").alias("schema"),
        *[ref(f"{v}_q{q}") for v in values for q in counts],
    )
    left = list(values)
    while left:
        value = left.pop(0)
        options = ", ".join(
            ["struct('0' AS q, '' AS bin)"]
            + [f"struct('{q}' AS q, coalesce({value}_q{q}, '') AS bin)" for q in counts]
        )
        others = [f"{v}_q{q}" for v in left for q in counts]
        spread = rows.selectExpr("n", "cell", "schema", *others, f"inline(array({options}))")
        rows = spread.groupBy(
            F.concat_ws("|", "cell", "bin").alias("cell"), F.concat("schema", "q").alias("schema"), *others
        ).agg(F.sum("n").alias("n"))
    return rows.filter(F.col("schema") != "0" * len(values)).groupBy("schema").agg(
        F.count("*").alias("groups"), F.min("n").alias("k_min"),
        F.sum((F.col("n") < 5).cast("bigint")).alias("groups_lt5"),
    )


def best_schema(
    cells: DataFrame, step: str, values: list[str], counts: list[int], least: int = 5
) -> DataFrame:
    """The safe schema with most groups, then most columns, then most bins.

    ``schema`` has one digit per column: its bin count, 0 when left out.
    """
    found = schema_search(cells, step, values, counts).filter(F.col("k_min") >= least)
    digits = F.transform(F.split("schema", ""), lambda d: d.cast("int"))
    digits = F.filter(digits, lambda d: d.isNotNull())
    used = F.filter(digits, lambda d: d > 0)
    named = found.withColumns({
        "columns": F.size(used), "bins": F.aggregate(digits, F.lit(0), lambda a, d: a + d),
        "_present": F.regexp_replace("schema", "[1-9]", "1"),
    })
    return named.orderBy(
        F.desc("groups"), F.desc("columns"), F.desc("bins"), F.desc("_present"), "schema"
    ).limit(1).drop("_present")


def generalisation_ladder(df: DataFrame, key: str, step: str) -> DataFrame:
    """Group statistics of two stages: all sub-scores in quartiles, then the family sums.

    The third stage, the mixed schema, is ``best_schema``.
    """
    renamed = df.select(ref(key), ref(step), *[number(df, n, 0.0).alias(f"s{i}") for i, n in enumerate(C.ALL_SCORES)])
    scores = [f"s{i}" for i in range(len(C.ALL_SCORES))]
    first = group_statistics(rank_bins(renamed, scores, key, [4]), [step, *[f"{x}_q4" for x in scores]])
    family = rank_bins(families(df, [key, step]), FAMILIES, key, [4])
    second = group_statistics(family, [step, *[f"{v}_q4" for v in FAMILIES]])
    return first.withColumns({"stage": F.lit("all scores"), "n_features": F.lit(len(scores))}).unionByName(
        second.withColumns({"stage": F.lit("family sums"), "n_features": F.lit(len(FAMILIES))})
    )
