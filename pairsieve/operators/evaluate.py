"""Evaluation loops: mode x seed, budget and cost sensitivity, component ablation.

All seeds of a run share one plan: the seed is a column, the splits are ranked per seed, the
logistic fits run together, and the budgets are tested on one ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairsieve import columns as C
from pairsieve.config import Settings
from pairsieve.functions.rates import f_beta, precision, recall
from pairsieve.functions.values import ref
from pairsieve.functions.values import clip
from pairsieve.operators.bands import assign_bands
from pairsieve.operators.calibrate import fit_platt, sigmoid, stub_probability
from pairsieve.operators.features import BIRTH_DISTANCE, pair_features
from pairsieve.operators.guardrails import apply_guardrails
from pairsieve.operators.metrics import review_outcome_counts, summarize_runs
from pairsieve.operators.ranking import _null_safe_join, hash_cuts, hashed, rank_by_hash
from pairsieve.operators.split import holdout_size
from pairsieve.operators.triage import score_decisions, selection_rank
from pairsieve.session import materialise, small_table

# Weight of recall per mode; any other mode has weight 1.
BETA = {"vigilancia": 2.0, "confirmacao": 0.5}

#: What a group hold-out keeps together.
GROUP_OF = {"comprec": C.LEFT, "refrec": C.RIGHT}


def mode_beta(mode: str) -> float:
    return BETA.get(mode.strip().lower(), 1.0)


def seeded_splits(
    df: DataFrame, label: str, key: str, seeds: list[int], share: float, split_by: str = "row",
    stratify: bool = True,
) -> DataFrame:
    """Every row once per seed, with ``seed`` and ``split``; row or group membership.

    As for a single split, a class of one row and a missing group are errors.
    """
    column = None if split_by == "row" else GROUP_OF[split_by]
    seed_list = F.array(*[F.lit(int(s)) for s in seeds])
    if column is None:
        rows = df.withColumn("seed", F.explode(seed_list))
        # a row per seed and class travels to the rows, which stay where they are
        cuts = hash_cuts(rows.select("seed", ref(label), ref(key)), ["seed", label], F.col("seed"), key, lambda n: holdout_size(n, share))
        met = _null_safe_join(rows, F.broadcast(cuts), ["seed", label])
        lone = F.when(F.col("_size") < 2, F.raise_error(F.lit("a class needs at least two rows")))
        test = F.coalesce(lone.cast("boolean"), F.struct(hashed(F.col("seed"), ref(key)).alias("_h"), ref(key).alias("_k")) <= F.col("_last"))
        return met.withColumn("split", F.when(test, "test").otherwise("train")).drop("_last", "_size")
    named = F.when(ref(column).isNull(), F.raise_error(F.lit("a group is missing"))).otherwise(ref(column).cast("string"))
    groups = df.groupBy(named.alias("_g")).agg(F.max(ref(label)).alias("_y"))
    groups = groups.withColumn("seed", F.explode(seed_list))
    strata = ["seed", "_y"] if stratify else ["seed"]
    ranked = rank_by_hash(groups, strata, F.col("seed"), "_g", "_rank", "_size")
    test = F.col("_rank") <= holdout_size(F.col("_size"), share)
    sides = ranked.select("_g", "seed", F.when(test, "test").otherwise("train").alias("split"))
    return df.join(sides, ref(column).cast("string") == F.col("_g")).drop("_g")


def calibrated_test_rows(
    df: DataFrame, settings: Settings, key: str, seeds: list[int], share: float, split_by: str,
    method: str = "stub", stratify: bool = True,
) -> DataFrame:
    """Test rows of every seed with ``p_cal`` fitted on that seed's training rows.

    Only what decisions and their measures read is repeated per seed.
    """
    carried = [key, C.TARGET, C.SCORE, "band", "guardrail", *GROUP_OF.values()]
    split = seeded_splits(df.select(*[ref(c) for c in dict.fromkeys(carried) if c in df.columns]), C.TARGET, key, seeds, share, split_by, stratify)
    test = split.filter("split = 'test'")
    cal = settings.calibration
    score = ref(C.SCORE)
    if method == "stub":
        return test.withColumn("p_cal", stub_probability(score, cal))
    if method != "platt":
        raise ValueError("method must be stub or platt; forests are fitted one run at a time")
    fits = fit_platt(split.filter("split = 'train'"), C.SCORE, C.TARGET, cal, ["seed"])
    rows = [(int(k[0]), m.intercept, m.slope) for k, m in fits.items()]
    models = small_table(df.sparkSession, rows, "seed int, platt_intercept double, platt_slope double")
    joined = test.join(F.broadcast(models), "seed")
    z = F.col("platt_intercept") + F.col("platt_slope") * score
    return joined.withColumn("p_cal", clip(sigmoid(z), cal.clip_min, cal.clip_max))


def run_records(
    ranked: DataFrame, settings: Settings, mode: str, groups: list[str], budgets: list[int],
) -> DataFrame:
    """One record per group and budget from rows ranked by review order.

    The rows shrink to counts per group, band, label, action and number of budgets that leave
    them out; only that small table is repeated per budget.
    """
    limits = sorted(int(b) for b in budgets)
    left_out = " + ".join(f"CAST(review_rank > {b} AS INT)" for b in limits)
    cells = ranked.groupBy(
        *groups, "band", C.TARGET, "action", "review_requested",
        F.expr(f"coalesce({left_out}, {len(limits)})").alias("_out"),
    ).agg(F.count("*").alias("_n"))
    listed = F.array(*[F.lit(b) for b in limits])
    rows = cells.select("*", F.posexplode(listed).alias("_i", "llm_max")).withColumn(
        "action", F.expr("CASE WHEN _i >= _out THEN 'LLM_REVIEW' ELSE action END")
    )
    counts = review_outcome_counts(
        rows, C.TARGET, settings.band_errors(), [*groups, "llm_max"], "_n"
    )
    return with_run_metrics(counts, mode)


def with_run_metrics(counts: DataFrame, mode: str) -> DataFrame:
    beta = mode_beta(mode)
    out = {"llm_used": F.col("review_selected"),
           "auto_coverage": (F.col("n_test") - F.col("review_selected")) / F.col("n_test"),
           "mode": F.lit(mode), "beta": F.lit(beta)}
    for prefix in ("auto_", "oracle_", "exp_"):
        tp, fp, fn = (F.col(prefix + c) for c in ("tp", "fp", "fn"))
        out[f"{prefix}precision"] = precision(tp, fp)
        out[f"{prefix}recall"] = recall(tp, fn)
        out[f"{prefix}f1"] = f_beta(tp, fp, fn)
        out[f"{prefix}fbeta"] = f_beta(tp, fp, fn, beta)
    return counts.withColumns(out)


def evaluate(
    ready: DataFrame, settings: Settings, key: str, modes: list[str] | None = None,
    seeds: list[int] | None = None, share: float | None = None, split_by: str | None = None,
    method: str = "platt", budgets: list[int] | None = None,
) -> DataFrame:
    """Split, calibrate, triage and measure for every mode and seed.

    ``ready`` holds features, band, guardrail and ``TARGET``.  The seeds travel as a column, so
    a mode costs one plan whatever the number of seeds or budgets.
    """
    ev = settings.evaluation
    seeds = list(seeds or ev.seeds)
    rows = calibrated_test_rows(
        ready, settings, key, seeds, ev.test_size if share is None else share,
        split_by or ev.split_by, method, ev.group_stratify,
    )
    records = None
    for mode in modes or list(settings.modes):
        scored = score_decisions(rows, settings.mode(mode), settings.band_errors())
        ranked = selection_rank(scored, key, ["seed"])
        limits = budgets if budgets is not None else [settings.budget(mode)]
        record = run_records(ranked, settings, mode, ["seed"], limits)
        records = record if records is None else records.unionByName(record)
    return records


def cost_sensitivity(
    rows: DataFrame, settings: Settings, key: str, mode: str, ratios: list[float],
) -> DataFrame:
    """Records per FP/FN cost ratio; the false-negative cost stays as configured.

    The ratio is a column: all ratios are scored and ranked in one plan.
    """
    fn = float(settings.mode(mode).false_negative)
    varied = rows.withColumn("fp_fn_ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    varied = varied.withColumns({"_cost_fp": F.col("fp_fn_ratio") * fn, "_cost_fn": F.lit(fn)})
    scored = score_decisions(
        varied, settings.mode(mode), settings.band_errors(), ("_cost_fp", "_cost_fn")
    )
    ranked = selection_rank(scored, key, ["seed", "fp_fn_ratio"])
    return run_records(ranked, settings, mode, ["seed", "fp_fn_ratio"], [settings.budget(mode)])


def mean_points(records: DataFrame, by: list[str]) -> DataFrame:
    """Mean quality and review use per setting, over the seeds."""
    metrics = ["exp_precision", "exp_recall", "exp_f1", "exp_fbeta", "llm_used", "review_requested"]
    return summarize_runs(records, by, metrics)


VARIANT = ["seed", "calibration", "birth_distance", "guardrails"]


def ablation(
    pairs: DataFrame, settings: Settings, key: str, modes: list[str] | None = None, seeds: list[int] | None = None,
    calibrations: tuple[str, ...] = ("stub", "platt"),
) -> DataFrame:
    """Records per calibration, with and without birth-distance features, with and without guardrails.

    Without the features the table is built without them, so nothing can read them.  What is left
    of a build is key, label, score, band and guardrail; the variants travel as columns, and each
    mode ranks and counts all of them at once.  ``forest`` as a calibration fits one forest per
    seed and build.
    """
    ev = settings.evaluation
    seeds = list(seeds or ev.seeds)
    rows = None
    for birth in (True, False):
        wide = assign_bands(pair_features(pairs, birth), settings)
        if not birth:
            wide = wide.drop(*BIRTH_DISTANCE)
        built = apply_guardrails(wide, settings.guardrails)
        for method in calibrations:
            if method == "forest":
                tests = _forest_test_rows(built, settings, key, seeds)
            else:
                tests = calibrated_test_rows(built, settings, key, seeds, ev.test_size, ev.split_by, method, ev.group_stratify)
            part = tests.select("seed", ref(key), C.TARGET, "band", "p_cal", "guardrail").withColumns(
                {"calibration": F.lit(method), "birth_distance": F.lit(birth)})
            rows = part if rows is None else rows.unionByName(part)
    both = materialise(rows).withColumn("guardrails", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(
        "guardrail", F.when(F.col("guardrails"), F.col("guardrail")))
    records = None
    for mode in modes or list(settings.modes):
        scored = score_decisions(both, settings.mode(mode), settings.band_errors())
        record = run_records(selection_rank(scored, key, VARIANT), settings, mode, VARIANT, [settings.budget(mode)])
        records = record if records is None else records.unionByName(record)
    return records


def _forest_test_rows(built: DataFrame, settings: Settings, key: str, seeds: list[int]) -> DataFrame:
    from pairsieve.operators.models import CalibratedForest

    ev = settings.evaluation
    split = seeded_splits(built, C.TARGET, key, seeds, ev.test_size, ev.split_by, ev.group_stratify)
    rows = None
    for seed in seeds:
        own = split.filter(F.col("seed") == seed)
        forest = CalibratedForest().fit(own.filter("split = 'train'").drop("seed", "split"), key)
        part = forest.score(own.filter("split = 'test'"), "p_cal")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def repeated_holdout(
    ready: DataFrame, settings: Settings, key: str, mode: str, repeats: int = 5, share: float = 0.2, method: str = "platt",
    base_seed: int = 42,
) -> DataFrame:
    """Records of ``repeats`` hold-outs of one row in five, drawn with seeds that follow the base seed.

    Each repeat draws anew, so a row may be tested more than once or never.
    """
    return evaluate(ready, settings, key, [mode], [base_seed + i for i in range(repeats)], share, "row", method)
