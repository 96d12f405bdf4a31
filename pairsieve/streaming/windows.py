"""Windowed triage: a review budget per window, kept in a ledger table.

The ledger has one row per (mode, window, batch) with the reviews used.  A batch that is run
again after a failure finds its own row and its own output folder and replaces both, so a
window's budget is not spent twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairsieve import columns as C
from pairsieve.config import Mode, Monitoring, Settings
from pairsieve.functions.values import ref
from pairsieve.operators.calibrate import Platt, fit_platt, with_probability
from pairsieve.operators.drift import after_drift, check_drift, critical
from pairsieve.operators.triage import score_decisions, selection_rank
from pairsieve.plans.run import prepare
from pairsieve.session import small_table

LEDGER = "mode string, window string, used bigint, batch bigint"


def week_start(date: Column) -> Column:
    return F.date_trunc("week", date).cast("date")


def look_back(df: DataFrame, date: str, end: str, days: int = 28) -> DataFrame:
    """Rows of the look-back period that ends with the given day."""
    last = F.lit(end).cast("date")
    return df.filter((ref(date) > F.date_sub(last, days)) & (ref(date) <= last))


def triage_by_window(
    ready: DataFrame, settings: Settings, mode: str, key: str, window: str, ledger: DataFrame | None = None
) -> DataFrame:
    """Triage with a budget of its own for every window value, less what the ledger has used."""
    scored = score_decisions(ready, settings.mode(mode), settings.band_errors())
    ranked = selection_rank(scored, key, [window])
    budget = F.lit(settings.budget(mode))
    if ledger is not None:
        used = ledger.filter(F.col("mode") == mode).groupBy(F.col("window").alias("_w")).agg(F.sum("used").alias("_used"))
        ranked = ranked.join(used, ref(window).cast("string") == F.col("_w"), "left")
        budget = budget - F.coalesce("_used", F.lit(0))
    chosen = F.coalesce(F.col("review_rank") <= budget, F.lit(False))
    return ranked.withColumn("action", F.when(chosen, "LLM_REVIEW").otherwise(F.col("action"))).drop("_w", "_used")


def ledger_rows(decided: DataFrame, mode: str, window: str, batch: int) -> DataFrame:
    return decided.groupBy(ref(window).cast("string").alias("window")).agg(
        F.sum((F.col("action") == "LLM_REVIEW").cast("bigint")).alias("used")
    ).select(F.lit(mode).alias("mode"), "window", "used", F.lit(batch).cast("bigint").alias("batch"))


def read_ledger(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    try:
        rows = spark.read.schema(LEDGER).parquet(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        rows = spark.createDataFrame([], LEDGER)
    return rows if before is None else rows.filter(F.col("batch") < before)


@dataclass(frozen=True)
class DriftControl:
    """Watches a stream: the rows to compare batches with, what to watch, where thresholds are kept."""

    baseline: DataFrame
    monitoring: Monitoring
    path: str
    slices: tuple[str, ...] = ()


THRESHOLDS = "mode string, min_auto_match double, max_auto_nonmatch double, budget bigint, frozen boolean, intercept double, slope double"


def current_thresholds(spark: SparkSession, path: str, name: str, mode: Mode, before: int) -> tuple[Mode, bool, Platt | None]:
    """The mode, whether its calibration is frozen, and the calibration, as of the last version before a batch.

    Without a version the configured mode holds.  Later versions are never looked at, so a batch
    that is replayed decides as it did the first time.
    """
    try:
        rows = spark.read.schema(f"{THRESHOLDS}, version bigint").parquet(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return mode, False, None  # nothing written yet
    last = rows.filter((F.col("version") < before) & (F.col("mode") == name)).orderBy(F.desc("version")).limit(1).collect()
    if not last:
        return mode, False, None
    row = last[0]
    platt = None if row["intercept"] is None else Platt(row["intercept"], row["slope"])
    return replace(mode, min_auto_match=row["min_auto_match"], max_auto_nonmatch=row["max_auto_nonmatch"], budget=row["budget"]), row["frozen"], platt


def write_thresholds(spark: SparkSession, path: str, name: str, mode: Mode, frozen: bool, model: Platt | None, version: int) -> None:
    row = (name, mode.min_auto_match, mode.max_auto_nonmatch, mode.budget, frozen, model.intercept if model else None, model.slope if model else None)
    small_table(spark, [row], THRESHOLDS).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def batch_writer(
    settings: Settings, mode: str, key: str, window: Callable[[], Column], ledger: str, output: str,
    model: Platt | None = None, control: DriftControl | None = None, refit: bool = False,
):
    """A ``foreachBatch`` function: prepare, calibrate, triage within the window's budget, write.

    With ``control`` the thresholds come from a versioned table that each batch's end extends: a
    critical drift of the batch against the baseline tightens them, raises the budget or freezes
    the calibration for the batches after it, as the monitoring's actions say.  ``refit`` fits
    the calibration on every batch until it is frozen.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now, frozen, kept = settings.mode(mode), False, None
        if control:
            now, frozen, kept = current_thresholds(spark, control.path, mode, now, number)
        used = replace(settings, modes={**settings.modes, mode: now})
        ready = prepare(batch, used).withColumn("window", window())
        fitted = kept or model
        if refit and not frozen:
            fitted = fit_platt(ready, C.SCORE, C.TARGET, settings.calibration)[()]
        ready = with_probability(ready, "platt" if fitted else "stub", settings.calibration, fitted)
        past = read_ledger(spark, ledger, before=number)
        decided = triage_by_window(ready, used, mode, key, "window", past)
        place = f"{output}/batch={number}"
        decided.write.mode("overwrite").parquet(place)
        written = spark.read.parquet(place)
        ledger_rows(written, mode, "window", number).drop("batch").write.mode("overwrite").parquet(
            f"{ledger}/batch={number}")
        if control:
            metrics = check_drift(control.baseline, written, control.monitoring, list(control.slices))
            after, freezes = after_drift(now, control.monitoring, critical(metrics))
            write_thresholds(spark, control.path, mode, after, frozen or freezes, fitted, number)

    return write


def start(stream: DataFrame, writer, checkpoint: str):
    """Run the writer over all input that is there, one micro-batch at a time."""
    return (
        stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
