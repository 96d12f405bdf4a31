"""The model entries run the operators' own sizes over all features and rows; studies on small rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pairsieve.operators import models as L
from pairsieve.operators import resample as K
from pairsieve.plans import queries_models as Q
from pairsieve.plans.registry import ENTRIES

SMALL = "/root/testdata/sf0.001"


def test_all_features(spark):
    train, test = Q.training(spark, SMALL)
    assert len(Q.features(spark, SMALL)) == 58 == train.first()["features"].size
    assert train.count() + test.count() == Q.pairs(spark, SMALL).count()


def test_entries_keep_the_operators_sizes(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(L, "fold_study", lambda rows, key, builders, folds=5, **_: seen.update(rows=rows.count(), folds=folds) or 1 / 0)
    try:
        ENTRIES["fold_study"].run(spark, SMALL)
    except ZeroDivisionError:
        pass
    assert seen == {"rows": Q.pairs(spark, SMALL).count(), "folds": 5}
    monkeypatch.setattr(L, "band_importances", lambda df, *a: seen.update(bands=df.select("band").distinct().count(), jobs=a[-1]) or 1 / 0)
    try:
        ENTRIES["importance_by_band"].run(spark, SMALL)
    except ZeroDivisionError:
        pass
    assert seen["jobs"].getNumTrees() == 200 and seen["jobs"].getMaxDepth() == 10 and seen["bands"] > 3


def small_rows(spark, n=160):
    rng = np.random.default_rng(1)
    y = (np.arange(n) % 8 == 0).astype(int)
    x = rng.standard_normal((n, 3)) + y[:, None] * 2.5
    return spark.createDataFrame([(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, y))], "id long, x array<double>, y int")


def test_a_failing_strategy_is_recorded(spark):
    def fails(rows):
        raise ValueError("no neighbours here")

    chosen = {"none": L.STRATEGIES["none"], "smote tomek 0.3": L.STRATEGIES["smote tomek 0.3"], "broken": (fails, False)}
    runs = {(r.strategy, r.fold): r for r in L.imbalance_study(small_rows(spark), chosen, folds=2, trees=3, depth=3).collect()}
    assert len(runs) == 6
    for fold in (0, 1):
        assert runs["broken", fold].error == "no neighbours here" and runs["broken", fold].tp is None
        assert runs["none", fold].error is None and runs["none", fold].synthetic_rows == 0 and runs["none", fold].f1 > 0.4
        grown = runs["smote tomek 0.3", fold]
        assert grown.error is None and grown.tp + grown.fn == 10 and 0 < grown.synthetic_rows <= 11 and grown.real_rows <= 80
    with pytest.raises(ValueError):
        L.run_all({"a": lambda: fails(None)})


def vectors(rows):
    return rows.select("id", F.col("y").cast("double").alias("y"), array_to_vector("x").alias("features"), F.lit(1.0).alias("weight"))


def test_stack_and_folds_use_written_scores(spark):
    rows = vectors(small_rows(spark))
    jobs = {"forest": L.forest(3, 3), "logistic": L.logistic(weighted=True)}
    out = L.stack(rows, rows, jobs, "id", folds=2)
    assert out.count() == 160 and out.filter("(p > 0.5) = (y = 1)").count() > 130
    runs = L.fold_study(rows.withColumn("rules", F.col("id") % 9), "id", {"forest": lambda t: (lambda r, m=jobs["forest"].fit(t): L.scored(m, r))},
                        {"model": F.col("p_forest") >= 0.5, "both": (F.col("p_forest") >= 0.5) & (F.col("rules") > 4), "rules": F.col("rules") > 4}, folds=2).collect()
    assert len(runs) == 6 and all(r.tp + r.fp + r.fn + r.tn == 80 for r in runs)
    cells = {(r.model, r.fold): r for r in runs}
    assert all(cells["both", f].tp <= min(cells["model", f].tp, cells["rules", f].tp) for f in (0, 1))


def test_calibrated_forest_is_the_same_when_loaded(spark, tmp_path):
    rows = small_rows(spark).select("id", *[F.col("x")[i].alias(f"f{i}") for i in range(3)], F.col("y").alias("label"), F.lit("text").alias("note"))
    forest = L.CalibratedForest(3, 3, 2).fit(rows, "id", "label")
    assert "note" not in forest.features and "id" not in forest.features and len(forest.members) == 2
    forest.save(str(tmp_path / "forest"))
    again = L.CalibratedForest.load(spark, str(tmp_path / "forest"))
    both = forest.score(rows, "p").join(again.score(rows, "q").select("id", "q"), "id")
    assert both.count() == 160 and both.filter("p <> q OR p IS NULL OR p < 0 OR p > 1").count() == 0
    lacking = again.score(rows.drop("f1"), "p")  # an absent feature counts as missing
    assert lacking.filter("p IS NULL").count() == 0


def test_importances_are_joined_with_ranks(spark):
    from pairsieve.session import small_table

    a = small_table(spark, [("x", 0.5), ("y", 0.2), ("z", 0.3)], "feature string, importance double")
    got = {(r.model, r.feature): r["rank"] for r in L.union_importances({"a": a, "b": a.filter("feature <> 'x'")}).collect()}
    assert got == {("a", "x"): 1, ("a", "z"): 2, ("a", "y"): 3, ("b", "z"): 1, ("b", "y"): 2}


def test_weights(spark):
    rows = small_rows(spark)
    assert {(r.y, r.weight) for r in K.fixed_weight(rows, "y", 7).select("y", "weight").distinct().collect()} == {(1, 7.0), (0, 1.0)}


def test_scores_must_fit_the_rows(spark):
    rows = spark.range(6).select(F.col("id").alias("k"))
    good = rows.select("k", (F.col("k") / 10).alias("p"))
    joined = L.join_scores(rows, {"a": good, "b": good.withColumn("p", 1 - F.col("p"))}, "k").orderBy("k").collect()
    assert [(r.k, round(r.a + r.b, 9)) for r in joined] == [(i, 1.0) for i in range(6)]
    for wrong in (good.filter("k < 5"), good.unionByName(good.filter("k = 1")), good.withColumn("k", F.col("k") + 1)):
        with pytest.raises(ValueError):
            L.join_scores(rows, {"a": wrong}, "k")
