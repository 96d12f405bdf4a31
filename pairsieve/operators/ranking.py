"""Ranks, first-k selection and hashed order without a single-task window on raw rows.

The rule throughout: rows are first counted per fine bin, the counts are accumulated over the
bins (a table whose size depends on the bins, not on the rows), and only the last step orders
rows, inside one bin.  A value held by a third of all rows is split over the bins of its key,
so no task ever sees a whole hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairsieve.functions.values import ref
from pairsieve.session import materialise

KEY_BINS_PER_E = 65_536
# Value bins follow the rows, about so many each, up to the most that are worth a lookup.
ROWS_PER_BIN = 25
MOST_BINS = 10_000
# Rows with the same first digits of their hash.
ROWS_PER_HASH = 20_000
# The same where only the rows around a cut are ordered: fewer counts to shuffle.
ROWS_PER_CUT = 100_000


def value_edges(rows: DataFrame, value: str) -> DataFrame:
    """One row: the quantiles of a column that part its bins (see ``value_bin``), and the steps to search them."""
    # one literal instead of an expression per point
    points = F.split(F.lit(",".join(str(i / MOST_BINS) for i in range(1, MOST_BINS))), ",").cast("array<double>")
    facts = rows.agg(F.count("*").alias("n"), F.percentile_approx(ref(value).cast("double"), points, F.lit(8 * MOST_BINS)).alias("all"))
    nth = F.greatest(F.lit(1), F.floor(F.lit(MOST_BINS * ROWS_PER_BIN) / F.greatest(F.col("n"), F.lit(1)))).alias("nth")
    edges = F.array_sort(F.array_distinct(F.expr("filter(all, (x, i) -> (i + 1) % nth = 0)"))).alias("edges")
    steps = F.expr("transform(sequence(cast(floor(log2(greatest(coalesce(size(edges), 0), 0) + 1)) as int), 0, -1), s -> shiftleft(1, s))").alias("steps")
    return facts.select("all", nth).select(edges).select("edges", steps)


def value_bin(rows: DataFrame, value: str, out: str = "_vb", edges: DataFrame | None = None) -> DataFrame:
    """Add a monotone integer bin: how many quantiles of the column are not above the value.

    The quantiles come from the rows themselves, in one small aggregate, so every bin holds a
    like share of them whatever their scale, and infinities are values like any other.  The same
    aggregate counts the rows: twice as many rows make twice as many bins, up to ``MOST_BINS``.

    The quantiles are approximate and follow the order in which partial results arrive, so on many
    machines two jobs find different ones.  Bins that are read by more than one job need
    ``edges``: what ``value_edges`` found, written.
    """
    one = (value_edges(rows, value) if edges is None else edges).select(F.struct("steps", "edges")).scalar()

    def climb(at: Column, step: Column) -> Column:
        return F.when(F.get(F.col("_bins")["edges"], at + step - 1) <= ref(value), at + step).otherwise(at)

    return rows.withColumn("_bins", one).withColumn(
        out, F.coalesce(F.aggregate(F.col("_bins")["steps"], F.lit(0), climb), F.lit(0))).drop("_bins")


def hashed(seed: int | str | Column, *keys: Column) -> Column:
    """A reproducible random order: MD5 of the seed and the row key."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), *[k.cast("string") for k in keys]))


def hash_uniform(hash_text: Column, start: int = 1) -> Column:
    """A number in [0, 1) from seven hex digits of a hash."""
    return F.conv(F.substring(hash_text, start, 7), 16, 10).cast("double") / F.lit(float(16**7))


def rank_by_hash(
    df: DataFrame, groups: list[str], seed: int | str | Column, key: str, out: str = "rank",
    size_out: str | None = None,
) -> DataFrame:
    """Exact 1-based position of every row in the hashed order of its group.

    One shuffle on (group, first hex digits); there are as many digits as leave about
    ``ROWS_PER_HASH`` rows of the table with the same ones.  ``size_out`` adds the group's row count.
    """
    rows = df.agg(F.count("*").alias("n")).scalar()
    digits = F.least(F.lit(8), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(rows, F.lit(1)) / ROWS_PER_HASH) / 4).cast("int")))
    hashed_rows = df.withColumn("_h", hashed(seed, ref(key))).withColumn("_hb", F.substring(F.col("_h"), F.lit(1), digits))
    by = [*groups, "_hb"]
    per_bin = hashed_rows.groupBy(*[ref(c) for c in by]).agg(F.count("*").alias("_n"))
    group_window = W.partitionBy(*[ref(c) for c in groups]) if groups else W.partitionBy(F.lit(0))
    running = group_window.orderBy("_hb").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = per_bin.withColumn("_before", F.sum("_n").over(running) - F.col("_n"))
    if size_out:
        offsets = offsets.withColumn(size_out, F.sum("_n").over(group_window))
    offsets = offsets.drop("_n")
    joined = _null_safe_join(hashed_rows, offsets, by)
    inside = W.partitionBy(*[ref(c) for c in by]).orderBy("_h", ref(key))
    ranked = joined.withColumn(out, F.col("_before") + F.row_number().over(inside))
    return ranked.drop("_h", "_hb", "_before")


def hash_cuts(df: DataFrame, groups: list[str], seed: int | str | Column, key: str, take) -> DataFrame:
    """Per group its row count ``_size`` and ``_last``, the ``take(size)``-th (hash, key) of its hashed order.

    Same order as ``rank_by_hash``, without a shuffle of the rows: they are counted per first hex
    digits, and only those that share the digits of a group's last one are ordered.  ``_last`` is
    NULL where nothing is taken.
    """
    rows = df.agg(F.count("*").alias("n")).scalar()
    digits = F.least(F.lit(8), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(rows, F.lit(1)) / ROWS_PER_CUT) / 4).cast("int")))
    hashed_rows = df.select(*[ref(g) for g in groups], ref(key).alias("_k"), hashed(seed, ref(key)).alias("_h")).withColumn(
        "_hb", F.substring(F.col("_h"), F.lit(1), digits))
    per_bin = hashed_rows.groupBy(*[ref(g) for g in groups], "_hb").agg(F.count("*").alias("_n"))
    window = W.partitionBy(*[ref(g) for g in groups] or [F.lit(0)])
    bins = materialise(per_bin.withColumns({
        "_to": F.sum("_n").over(window.orderBy("_hb").rowsBetween(W.unboundedPreceding, W.currentRow)), "_size": F.sum("_n").over(window)}))
    wanted = take(F.col("_size"))
    holder = bins.filter((F.col("_to") >= wanted) & (F.col("_to") - F.col("_n") < wanted)).withColumn("_at", wanted - F.col("_to") + F.col("_n"))
    inside = _null_safe_join(hashed_rows, F.broadcast(holder.drop("_n", "_to", "_size")), [*groups, "_hb"])
    at = F.row_number().over(window.orderBy("_h", "_k"))
    last = inside.withColumn("_rn", at).filter(F.col("_rn") == F.col("_at")).select(*[ref(g) for g in groups], F.struct("_h", "_k").alias("_last"))
    nothing = bins.groupBy(*[ref(g) for g in groups]).agg(F.max("_size").alias("_size")).withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType))
    both = nothing.unionByName(last.withColumn("_size", F.lit(None).cast("long")))
    return materialise(both.groupBy(*[ref(g) for g in groups]).agg(F.max("_size").alias("_size"), F.max("_last").alias("_last")))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL, keeping the left columns."""
    renamed = right.select(
        *[ref(k).alias(f"_r_{i}") for i, k in enumerate(keys)],
        *[ref(c) for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & ref(k).eqNullSafe(F.col(f"_r_{i}"))
    return left.join(renamed, condition).drop(*[f"_r_{i}" for i in range(len(keys))])


def key_bin(key: Column) -> Column:
    """A monotone bin of a numeric row key, tens of thousands of bins per doubling."""
    size = F.floor(F.log1p(F.abs(key.cast("double"))) * KEY_BINS_PER_E).cast("bigint")
    return F.when(key < 0, -size).otherwise(size)


def rank_by_value(
    df: DataFrame, groups: list[str], value: str, key: str, out: str = "rank",
    leading: list[str] | None = None,
) -> DataFrame:
    """Exact position by (leading columns, value, numeric key), ascending, inside each group.

    Two passes over the rows: one counts them per distinct value and key bin, one joins the
    running totals of those counts back and orders the rows of a single cell.
    """
    leading = leading or []
    rows = df.withColumns({"_v": ref(value).cast("double"), "_kb": key_bin(ref(key))})
    rows = value_bin(rows, "_v")
    outer = [*groups, *leading]
    cells = rows.groupBy(*[ref(g) for g in outer], "_vb", "_v", "_kb").agg(F.count("*").alias("_n"))
    before = W.unboundedPreceding
    in_bin = W.partitionBy(*[ref(g) for g in outer], "_vb").orderBy("_v", "_kb").rowsBetween(before, -1)
    bins = cells.groupBy(*[ref(g) for g in outer], "_vb").agg(F.sum("_n").alias("_n"))
    over_bins = (
        W.partitionBy(*[ref(g) for g in groups] or [F.lit(0)])
        .orderBy(*[ref(c) for c in leading], "_vb").rowsBetween(before, -1)
    )
    bins = bins.withColumn("_bin_before", F.coalesce(F.sum("_n").over(over_bins), F.lit(0))).drop("_n")
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(in_bin), F.lit(0))).drop("_n")
    cells = _null_safe_join(cells, bins, [*outer, "_vb"]).withColumn(
        "_before", F.col("_before") + F.col("_bin_before")
    )
    joined = _null_safe_join(rows, cells.drop("_vb", "_bin_before"), [*outer, "_v", "_kb"])
    inside = W.partitionBy(*[ref(g) for g in outer], "_v", "_kb").orderBy(ref(key))
    position = F.col("_before") + F.row_number().over(inside)
    return joined.withColumn(out, position).drop("_v", "_vb", "_kb", "_before")


def bin_offsets(
    rows: DataFrame, groups: list[str], sums: dict[str, Column], descending: bool
) -> DataFrame:
    """Sums per (group, ``_vb``) with the running total of the bins before, as ``<name>_before``."""
    bins = rows.groupBy(*[ref(g) for g in groups], "_vb").agg(
        *[c.alias(n) for n, c in sums.items()]
    )
    order = F.desc("_vb") if descending else F.asc("_vb")
    window = W.partitionBy(*[ref(g) for g in groups] or [F.lit(0)]).orderBy(order)
    before = window.rowsBetween(W.unboundedPreceding, -1)
    for name in sums:
        bins = bins.withColumn(f"{name}_before", F.coalesce(F.sum(name).over(before), F.lit(0)))
    return bins


def cutoff(rows: DataFrame, order: Column, k: int) -> DataFrame:
    """One row ``(last, taken)``: the k-th smallest order value and how many rows reach it.

    ``order`` must be unique per row.  The order values alone are range-partitioned across the
    cluster and written with their partition's number; partition sizes say which partition holds
    the k-th, and only that one is sorted.  Range bounds are sampled anew by every exchange, so both
    steps have to read what was written, whether exchanges are reused or stages run again.  One
    path for every k.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = materialise(rows.select(order.alias("o")).repartitionByRange(parts, "o").withColumn("p", F.spark_partition_id()))
    sizes = keys.groupBy("p").agg(F.count("*").alias("n"))
    running = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(running), F.lit(0)))
    wanted = F.least(F.lit(k), F.col("start") + F.col("n")).alias("taken")
    holder = starts.filter(F.col("start") < k).select("p", "start", wanted).agg(
        F.max(F.struct("p", "start", "taken")).alias("h")).select("h.*")
    inside = keys.join(F.broadcast(holder), "p").withColumn(
        "at", F.col("start") + F.row_number().over(W.partitionBy("p").orderBy("o")))
    return inside.filter(F.col("at") == F.col("taken")).agg(F.max("o").alias("last"), F.coalesce(F.max("taken"), F.lit(0)).alias("taken"))


def first_k(df: DataFrame, eligible: Column, order: Column, k: int, out: str) -> DataFrame:
    """Mark the first k eligible rows of a unique order.

    Only the cut-off value travels back to the rows, as a scalar subquery: no join on the key
    and nothing to broadcast but one value.
    """
    if k <= 0:
        return df.withColumn(out, F.lit(False))
    last = cutoff(df.filter(eligible), order, k).select("last").scalar()
    return df.withColumn(out, F.coalesce(eligible & (order <= last), F.lit(False)))
