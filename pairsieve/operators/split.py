"""Hold-outs, folds and stratified samples of exact size.

Membership follows the hashed order of the row key, so it is the same on every run and every
cluster size.  Positions come from ``rank_by_hash``: one shuffle over 4096 hash bins per
class, never a window over a whole class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairsieve.functions.values import ref
from pairsieve.operators.ranking import _null_safe_join, hash_uniform, hashed, rank_by_hash


def holdout_size(size: Column, share: float) -> Column:
    """Half-even rounded share of a class, at least 1 and at most all but one."""
    wanted = F.bround(size * F.lit(float(share)), 0).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.least(size - 1, wanted))


def _check_share(share: float) -> None:
    if not 0.0 < share < 1.0:
        raise ValueError("the test share must lie between 0 and 1")


def stratified_holdout(
    df: DataFrame, label: str, key: str, share: float = 0.3, seed: int = 42, out: str = "split",
) -> DataFrame:
    """Split ``test``/``train`` with the exact share of each class; classes need two rows."""
    _check_share(share)
    ranked = rank_by_hash(df, [label], seed, key, "_rank", "_size")
    wanted = F.when(F.col("_size") < 2, F.raise_error(F.lit("a class needs at least two rows")))
    test = F.col("_rank") <= F.coalesce(
        wanted.cast("bigint"), holdout_size(F.col("_size"), share)
    )
    return ranked.withColumn(out, F.when(test, "test").otherwise("train")).drop("_rank", "_size")


def group_holdout(
    df: DataFrame, label: str, group: str, share: float = 0.3, seed: int = 42,
    stratify: bool = True, out: str = "split",
) -> DataFrame:
    """Keep groups whole: groups are split, stratified by whether they hold any positive.

    Only the group table is ranked.  The rows then pick their side up by a join on the group;
    a group with a third of all rows is split by the adaptive skew join.
    """
    _check_share(share)
    key = F.when(ref(group).isNull(), F.raise_error(F.lit("a group is missing"))).otherwise(
        ref(group).cast("string")
    )
    groups = df.groupBy(key.alias("_g")).agg(F.max(ref(label)).alias("_y"))
    ranked = rank_by_hash(groups, ["_y"] if stratify else [], seed, "_g", "_rank", "_size")
    side = F.when(F.col("_rank") <= holdout_size(F.col("_size"), share), "test").otherwise("train")
    sides = ranked.select("_g", side.alias(out))
    return df.join(sides, ref(group).cast("string") == F.col("_g")).drop("_g")


def split_by(
    df: DataFrame, label: str, key: str, how: str = "row", share: float = 0.3, seed: int = 42,
    stratify: bool = True,
) -> DataFrame:
    how = how.strip().lower()
    if how == "row":
        return stratified_holdout(df, label, key, share, seed)
    columns = {"comprec": "COMPREC", "refrec": "REFREC"}
    if how not in columns:
        raise ValueError("split by row, comprec or refrec")
    return group_holdout(df, label, columns[how], share, seed, stratify)


def stratified_folds(
    df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42, out: str = "fold",
) -> DataFrame:
    """Fold number 0..k-1, each class spread evenly."""
    ranked = rank_by_hash(df, [label], seed, key, "_rank")
    return ranked.withColumn(out, ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def repeated_folds(
    df: DataFrame, label: str, key: str, folds: int = 5, repeats: int = 5, seed: int = 42,
) -> DataFrame:
    """One row per row and repeat, with ``repeat`` and ``fold``."""
    spread = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    seeds = F.col("repeat") + F.lit(seed)
    ranked = rank_by_hash(spread, ["repeat", label], seeds, key, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def proportional_sample(
    df: DataFrame, stratum: str, key: str, size: int, seed: int = 42
) -> DataFrame:
    """A sample of exactly ``size`` rows in proportion to the strata.

    Rounding residue goes to the largest stratum; all rows come back when there are too few.
    """
    ranked = rank_by_hash(df, [stratum], seed, key, "_rank", "_size")
    sizes = df.groupBy(ref(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    whole = W.partitionBy(F.lit(0))
    share = F.bround(F.col("_n") * F.lit(float(size)) / F.sum("_n").over(whole), 0).cast("bigint")
    plan = sizes.withColumn("_take", share).withColumn("_all", F.sum("_n").over(whole))
    largest = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("_n"), "_s")) == 1
    plan = plan.withColumn("_first", largest).withColumn(
        "_take",
        F.when(F.col("_all") <= size, F.col("_n"))
        .when(F.col("_first"), F.col("_take") + F.lit(size) - F.sum("_take").over(whole))
        .otherwise(F.col("_take")),
    )
    plan = plan.select(F.col("_s").alias(stratum), "_take")
    kept = _null_safe_join(ranked, plan, [stratum]).filter(F.col("_rank") <= F.col("_take"))
    return kept.drop("_rank", "_size", "_take")


def range_sample(
    df: DataFrame, score: str, edges: Sequence[float], size: int, key: str, seed: int = 42
) -> DataFrame:
    """An equal number of rows from each score range, ``size`` rows in all at most."""
    steps = list(zip(edges[:-1], edges[1:]))
    per = max(1, size // len(steps))
    chain = None
    for i, (low, high) in enumerate(steps):
        inside = (ref(score) >= low) & (ref(score) < high)
        chain = F.when(inside, i) if chain is None else chain.when(inside, i)
    binned = df.withColumn("_bin", chain).filter(F.col("_bin").isNotNull())
    ranked = rank_by_hash(binned, ["_bin"], seed, key, "_rank").filter(F.col("_rank") <= per)
    return ranked.orderBy("_bin", "_rank").limit(size).drop("_bin", "_rank")


def head_per_band(df: DataFrame, band: str, key: str, n: int, limit: int) -> DataFrame:
    """The first n rows of each band by hash, up to a total."""
    ranked = rank_by_hash(df, [band], "head", key, "_rank").filter(F.col("_rank") <= n)
    return ranked.orderBy(ref(band), "_rank").limit(limit).drop("_rank")


def temporal_split(df: DataFrame, date: str, last_train_year: int) -> DataFrame:
    """Earlier years train, later years test; rows without a date belong to neither."""
    year = F.year(ref(date))
    side = F.when(year <= last_train_year, "train").when(year > last_train_year, "test")
    return df.withColumn("split", side)


#: Standard deviations beyond which a draw is not looked for; less than one in 10^18 lies there.
TAIL = 9.0


def bootstrap_counts(cells: DataFrame, strata: list[str], hits: str, rows: str, replicates: int, seed: int = 0) -> DataFrame:
    """Resampled hits of every stratum in every replicate: ``*strata, replicate, rows, drawn``.

    ``cells`` has one row per stratum with its ``rows`` and how many of them are ``hits``.  Drawing
    that many rows with replacement inside a stratum makes the hits binomial, so counts are drawn,
    never rows: a hash of seed, stratum and replicate gives a number in [0, 1), and the draw is the
    first count whose cumulative probability lies above it.  Probabilities come from their ratios,
    each count over the one before, within ``TAIL`` standard deviations of the mean.  The work
    follows the replicates and the root of the rows.
    """
    by = [ref(c) for c in strata]
    n, p = ref(rows).cast("double"), ref(hits).cast("double") / ref(rows)
    reach = F.lit(TAIL) * (F.sqrt(n * p * (1 - p)) + 1)
    inner = (ref(hits) > 0) & (ref(hits) < ref(rows))
    known = cells.filter(ref(rows) > 0).select(
        *by, ref(rows).cast("bigint").alias("rows"), ref(hits).cast("bigint").alias("_hits"), p.alias("_p"),
        F.when(inner, F.greatest(F.lit(0), F.floor(n * p - reach))).otherwise(ref(hits)).cast("bigint").alias("_low"),
        F.when(inner, F.least(ref(rows), F.ceil(n * p + reach))).otherwise(ref(hits)).cast("bigint").alias("_high"))
    steps = known.withColumn("_k", F.explode(F.sequence("_low", "_high")))
    ratio = F.when(F.col("_k") == F.col("_low"), 0.0).otherwise(
        F.log((F.col("rows") - F.col("_k") + 1).cast("double") / F.col("_k")) + F.log(F.col("_p") / (1 - F.col("_p"))))
    own = W.partitionBy(*by)
    upto = own.orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    logs = steps.withColumn("_log", F.sum(ratio).over(upto))
    weights = logs.withColumn("_w", F.exp(F.col("_log") - F.max("_log").over(own)))
    table = weights.withColumn("_u", F.sum("_w").over(upto) / F.sum("_w").over(own))
    draws = known.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn(
        "_u", hash_uniform(hashed(seed, *[F.coalesce(c.cast("string"), F.lit("")) for c in by], F.col("replicate"))))
    columns = [*strata, "rows", "_low", "_high", "_u"]
    both = table.select(*[ref(c) for c in columns], F.lit(None).cast("int").alias("replicate")).unionByName(
        draws.select(*[ref(c) for c in columns], "replicate"))
    below = F.count(F.when(F.col("replicate").isNull(), 1)).over(
        own.orderBy("_u", F.col("replicate").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("drawn", F.least(F.col("_low") + below, F.col("_high"))).filter("replicate IS NOT NULL").select(
        *by, "replicate", "rows", "drawn")


def bootstrap_confusion(df: DataFrame, label: str, predicted: str, strata: list[str] | None = None, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """``replicate, tp, fp, fn, tn`` of resamples stratified by the label and ``strata``."""
    held = [ref(c).alias(f"_s{i}") for i, c in enumerate(strata or [])]
    names = [f"_s{i}" for i in range(len(held))]
    rows = df.select(*held, (ref(label) == 1).cast("int").alias("_y"), (ref(predicted) == 1).cast("int").alias("_hit"))
    cells = rows.groupBy(*names, "_y").agg(F.count("*").alias("_rows"), F.sum("_hit").alias("_hits"))
    drawn = bootstrap_counts(cells, [*names, "_y"], "_hits", "_rows", replicates, seed)
    positive, missed = F.col("_y") == 1, F.col("rows") - F.col("drawn")
    total = lambda c, value: F.coalesce(F.sum(F.when(c, value)), F.lit(0)).cast("bigint")
    return drawn.groupBy("replicate").agg(
        total(positive, F.col("drawn")).alias("tp"), total(~positive, F.col("drawn")).alias("fp"),
        total(positive, missed).alias("fn"), total(~positive, missed).alias("tn"))
