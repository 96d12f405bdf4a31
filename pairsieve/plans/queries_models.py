"""Registered queries: neighbours, resampling and classifiers."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from pairsieve import columns as C
from pairsieve.operators import models as L
from pairsieve.operators import resample as K
from pairsieve.operators import study as T
from pairsieve.operators.features import model_features, rule_score
from pairsieve.operators.histograms import ranking_quality
from pairsieve.operators.metrics import add_rates, confusion, summarize_runs
from pairsieve.operators.split import stratified_holdout
from pairsieve.config import default_settings
from pairsieve.plans.registry import register, table
from pairsieve.plans.run import decide
from pairsieve.plans.views import FEATURES_SQL, pairs
from pairsieve.session import checkpoint_folder, materialise


def features(spark, sf_dir):
    """Names of all model features."""
    return [c for c in model_features(pairs(spark, sf_dir)).columns if c != "y"]


def vectors(spark, sf_dir):
    """Embeddings with label 0 as the rare class."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == 0).cast("int").alias("y"))


@register("nearest_neighbours", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT a.id, b.id AS n_id, LIST_DISTANCE(a.x, b.x) AS d FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT id, n_id, CAST(ROW_NUMBER() OVER (PARTITION BY id ORDER BY d, n_id) AS INT) AS rank FROM d)
SELECT id, rank, n_id FROM r WHERE rank <= 3""")
def nearest_neighbours(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return K.neighbours(v, v, 3).select("id", "rank", "n_id")


def _sizes(rows):
    return rows.groupBy("y").agg(F.count("*").alias("n"))


@register("smote_sizes", """SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, CASE WHEN label = 0 THEN
 (SELECT GREATEST(COUNT(*) FILTER (WHERE label = 0), CAST(ROUND_EVEN(COUNT(*) FILTER (WHERE label <> 0) * 0.5, 0) AS BIGINT)) FROM embeddings) ELSE COUNT(*) END AS n FROM embeddings GROUP BY (label = 0)""")
def smote_sizes(spark, sf_dir):
    return _sizes(K.smote(vectors(spark, sf_dir), 0.5))


@register("borderline_smote_rows")
def borderline_rows(spark, sf_dir):
    return K.borderline_smote(vectors(spark, sf_dir)).groupBy("y", "synthetic").agg(F.count("*").alias("n"))


@register("adasyn_rows")
def adasyn_rows(spark, sf_dir):
    return K.adasyn(vectors(spark, sf_dir)).groupBy("y", "synthetic").agg(F.count("*").alias("n"))


@register("tomek_links", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings),
r AS (SELECT a.id, a.y, b.id AS n_id, b.y AS n_y, ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY LIST_DISTANCE(a.x, b.x), b.id) AS rn FROM v a JOIN v b ON a.id <> b.id),
o AS (SELECT * FROM r WHERE rn = 1)
SELECT id, y FROM v WHERE id NOT IN (SELECT a.id FROM o a JOIN o b ON a.n_id = b.id AND b.n_id = a.id WHERE a.y <> b.y)""")
def tomek_links(spark, sf_dir):
    return K.without_tomek_links(vectors(spark, sf_dir)).select("id", "y")


@register("class_weights", """WITH c AS (SELECT COUNT(*) AS n, SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS p FROM embeddings)
SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, COUNT(*) AS n, ROUND(ANY_VALUE(CASE WHEN label = 0 THEN c.n / (2.0E0 * p) ELSE c.n / (2.0E0 * (c.n - p)) END), 6) AS weight
FROM embeddings, c GROUP BY 1""")
def class_weights(spark, sf_dir):
    return K.balanced_weights(vectors(spark, sf_dir), "y").groupBy("y").agg(
        F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@register("knn_vote", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings),
d AS (SELECT a.id, b.y, LIST_DISTANCE(a.x, b.x) AS d, ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY LIST_DISTANCE(a.x, b.x), b.id) AS rn FROM v a JOIN v b ON a.id <> b.id)
SELECT id, ROUND(CASE WHEN SUM(CASE WHEN d = 0 THEN 1 ELSE 0 END) > 0 THEN SUM(CASE WHEN d = 0 THEN CAST(y AS DOUBLE) ELSE 0 END) / SUM(CASE WHEN d = 0 THEN 1 ELSE 0 END)
  ELSE SUM(CASE WHEN d > 0 THEN y / d ELSE 0 END) / SUM(CASE WHEN d > 0 THEN 1 / d ELSE 0 END) END, 5) AS p FROM d WHERE rn <= 5 GROUP BY id""")
def knn_vote(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return K.knn_vote(v, v, 5).select("id", F.round("p", 5).alias("p"))


def training(spark, sf_dir):
    """Hold-out train and test rows of the pair view with all features."""
    df = pairs(spark, sf_dir)
    wide = model_features(df, ["k"]).withColumn("y", F.col("y").cast("double"))
    wide = wide.join(df.select("k", rule_score(df).alias("rules")), "k")
    rows = L.assemble(wide.withColumn("band", T.range_label(F.col("`nota final`"))), features(spark, sf_dir), ["k", "y", "rules", "band"])
    split = stratified_holdout(rows.withColumn("id", F.col("k")), "y", "k")
    split = L.packed(K.balanced_weights(split, "y"), "k")
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")


def quality(df, name):
    hit = df.withColumn("hit", (F.col("p") >= 0.5).cast("int"))
    return add_rates(confusion(hit, "y", "hit")).withColumn("model", F.lit(name))


@register("model_comparison")
def model_comparison(spark, sf_dir):
    """Forest, boosting, logistic, perceptron on one hold-out."""
    train, test = training(spark, sf_dir)
    jobs = {
        "forest": L.forest(), "boosted": L.boosted(), "logistic": L.scaled(L.logistic(weighted=True)),
        "perceptron": L.perceptron(len(features(spark, sf_dir))),
    }
    models, out = L.run_all({name: (lambda j=job: L.fit(j, train)) for name, job in jobs.items()}, L.at_once(train)), None
    for name in jobs:
        part = quality(L.scored(models[name], test), name)
        out = part if out is None else out.unionByName(part)
    return out


@register("forest_ranking_quality")
def forest_ranking_quality(spark, sf_dir):
    train, test = training(spark, sf_dir)
    return ranking_quality(materialise(L.scored(L.fit(L.forest(), train), test).select("y", "p")), "p", "y")


@register("ensemble_decisions")
def ensemble_decisions(spark, sf_dir):
    """Soft vote, unanimity, majority, cascade and rule hybrids over four models."""
    train, test = training(spark, sf_dir)
    jobs = {"a": L.forest(), "b": L.boosted(), "c": L.scaled(L.logistic(weighted=True)), "d": L.perceptron(len(features(spark, sf_dir)))}
    models = L.run_all({name: (lambda j=job: L.fit(j, train)) for name, job in jobs.items()}, L.at_once(train))
    both, names = test, list(jobs)
    for name in names:
        both = L.scored(models[name], both, name)
    vote = L.soft_vote(both, names, [2.0, 1.0, 1.0, 1.0])
    picks = {
        "soft vote": (vote >= 0.15).cast("int"), "unanimity": L.unanimity(names)[0], "majority": L.majority(names, 0.5),
        "cascade": L.cascade(F.col("a"), F.col("b"))[0], "hybrid and": L.hybrid(vote, F.col("rules"), "and")[0],
        "hybrid or": L.hybrid(vote, F.col("rules"), "or")[0],
    }
    rows = both.select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), c.alias("hit")) for n, c in picks.items()])).alias("m"))
    return add_rates(confusion(rows.select("y", "m.model", "m.hit"), "y", "hit", ["model"]))


@register("stacked_model")
def stacked_model(spark, sf_dir):
    train, test = training(spark, sf_dir)
    jobs = {"forest": L.forest(), "logistic": L.logistic(weighted=True)}
    return quality(L.stack(train, test, jobs, "k"), "stack")


@register("adaptive_boosting")
def adaptive_boosting(spark, sf_dir):
    train, test = training(spark, sf_dir)
    return quality(L.AdaBoost().fit(train).score(test), "adaboost")


@register("isotonic_calibration")
def isotonic_calibration(spark, sf_dir):
    train, test = training(spark, sf_dir)
    return quality(L.isotonic_forest(train, test, L.forest(), "k"), "isotonic")


@register("feature_importance")
def feature_importance(spark, sf_dir):
    train, _ = training(spark, sf_dir)
    return L.importances(L.fit(L.forest(), train), features(spark, sf_dir), spark)


@register("permutation_importance")
def permutation_importance(spark, sf_dir):
    train, test = training(spark, sf_dir)
    names = features(spark, sf_dir)
    return L.permutation_importance(L.fit(L.forest(), train), test, "k", len(names), names)


@register("importance_by_band")
def importance_by_band(spark, sf_dir):
    df = L.packed(model_features(pairs(spark, sf_dir), ["k"]).withColumn("band", T.range_label(F.col("`nota final`"))), "k")
    long = L.band_importances(df, features(spark, sf_dir), "band", "y", L.forest())
    return T.importance_pivot(long, [f"{a}+" if b is None else f"{a}-{b}" for a, b in T.REPORT_RANGES])


def study_rows(spark, sf_dir):
    """All pairs with features, class weight, rule score and the linkage score."""
    train, test = training(spark, sf_dir)
    nota = pairs(spark, sf_dir).select("k", F.col("`nota final`").alias("nota"))
    return train.unionByName(test).join(nota, "k")


def grown_forest(ratio: float, k: int, trees: int, depth: int):
    """A forest on rows grown by SMOTE."""
    def build(train):
        rows = train.select("id", vector_to_array("features").alias("x"), F.col("y").cast("int").alias("y"))
        grown = L.packed(K.smote(rows, ratio, k).select("id", "x", F.col("y").cast("double").alias("y")), "id", "x", about=rows.count())
        model = L.fit(L.forest(trees, depth, weighted=False), grown.select("y", array_to_vector("x").alias("features")))
        grown.unpersist()
        return lambda tested: L.scored(model, tested)
    return build


def fitted(estimator):
    def build(train):
        model = L.fit(estimator, train)
        return lambda tested: L.scored(model, tested)
    return build


def configurations():
    forest, boosted, rules, score = F.col("p_forest"), F.col("p_boosted"), F.col("rules"), F.col("nota")
    return {
        "forest+smote >= 0.5": forest >= 0.5, "boosted >= 0.5": boosted >= 0.5, "rules >= 7": rules >= 7,
        "forest+smote >= 0.5 and rules >= 7": (forest >= 0.5) & (rules >= 7),
        "boosted >= 0.6 and rules >= 6": (boosted >= 0.6) & (rules >= 6),
        "forest+smote >= 0.7 or rules >= 8": (forest >= 0.7) | (rules >= 8), "score >= 8": score >= 8,
    }


_FOLD_SQL = "CAST((ROW_NUMBER() OVER (PARTITION BY {y} ORDER BY MD5(CONCAT('42|', CAST({key} AS VARCHAR))), {key}) - 1) % 5 AS INT)"


@register("fold_study", f"""WITH {FEATURES_SQL}, f AS (SELECT target, rules, nota, {_FOLD_SQL.format(y='target', key='k')} AS fold FROM features),
c AS (SELECT *, UNNEST(['forest+smote >= 0.5', 'boosted >= 0.5', 'rules >= 7', 'forest+smote >= 0.5 and rules >= 7', 'boosted >= 0.6 and rules >= 6', 'forest+smote >= 0.7 or rules >= 8', 'score >= 8']) AS model FROM f),
h AS (SELECT *, CASE model WHEN 'rules >= 7' THEN rules >= 7 WHEN 'score >= 8' THEN nota >= 8 END AS hit FROM c)
SELECT model, fold, COUNT(*) AS n, CAST(SUM(target) AS BIGINT) AS positives, CAST(SUM(CASE WHEN hit AND target = 1 THEN 1 WHEN hit IS NULL THEN NULL ELSE 0 END) AS BIGINT) AS tp,
  CAST(SUM(CASE WHEN hit AND target = 0 THEN 1 WHEN hit IS NULL THEN NULL ELSE 0 END) AS BIGINT) AS fp, TRUE AS rates_in_range FROM h GROUP BY 1, 2""")
def fold_study(spark, sf_dir):
    """Seven configurations over five folds of all rows.

    Counts of what is decided without a model are shown as they are; those of fitted models, which
    no other engine repeats, by the sizes of their folds and the range of their rates.
    """
    builders = {"forest": grown_forest(0.3, 3, 150, 12), "boosted": fitted(L.boosted())}
    runs = L.fold_study(study_rows(spark, sf_dir), "k", builders, configurations=configurations())
    exact = F.col("model").isin("rules >= 7", "score >= 8")
    inside = lambda c: F.coalesce(F.col(c), F.lit(0.0)).between(0, 1)
    return runs.select(
        "model", "fold", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), (F.col("tp") + F.col("fn")).alias("positives"),
        *[F.when(exact, F.col(c)).alias(c) for c in ("tp", "fp")], (inside("precision") & inside("recall") & inside("f1")).alias("rates_in_range"))


@register("fold_summary")
def fold_summary(spark, sf_dir):
    """The seven configurations, mean and spread of their rates over the folds."""
    builders = {"forest": grown_forest(0.3, 3, 150, 12), "boosted": fitted(L.boosted())}
    runs = L.fold_study(study_rows(spark, sf_dir), "k", builders, configurations=configurations())
    return summarize_runs(runs, ["model"], ["precision", "recall", "f1"])


_GROWN = {"none": 0.0, "class weight": 0.0, "smote 0.3": 0.3, "smote 0.5": 0.5, "smote 1.0": 1.0, "class weight + smote 0.3": 0.3}


@register("imbalance_study", f"""WITH f AS (SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, {_FOLD_SQL.format(y='(label = 0)', key='vec_id')} AS fold FROM embeddings),
s AS (SELECT UNNEST([{', '.join(f"'{n}'" for n in L.STRATEGIES)}]) AS strategy, UNNEST([{', '.join(str(_GROWN.get(n, 'NULL')) for n in L.STRATEGIES)}]) AS ratio),
n AS (SELECT g.fold, SUM(CASE WHEN f.fold <> g.fold THEN 1 ELSE 0 END) AS rows, SUM(CASE WHEN f.fold <> g.fold THEN y ELSE 0 END) AS pos,
  SUM(CASE WHEN f.fold = g.fold THEN 1 ELSE 0 END) AS tests, SUM(CASE WHEN f.fold = g.fold THEN y ELSE 0 END) AS test_pos FROM f, (SELECT DISTINCT fold FROM f) g GROUP BY g.fold)
SELECT strategy, fold, CAST(tests AS BIGINT) AS test_rows, CAST(test_pos AS BIGINT) AS test_positives, CASE WHEN strategy <> 'smote tomek 0.3' THEN CAST(rows AS BIGINT) END AS real_rows,
  CASE WHEN ratio IS NOT NULL THEN CAST(GREATEST(0, CASE WHEN ratio > 0 THEN ROUND_EVEN((rows - pos) * ratio, 0) ELSE 0 END - CASE WHEN ratio > 0 THEN pos ELSE 0 END) AS BIGINT) END AS synthetic_rows,
  TRUE AS ended FROM n, s""")
def imbalance_study(spark, sf_dir):
    """Nine strategies over five folds; the sizes that follow from the strategy alone, and that every job ended."""
    runs = L.imbalance_study(vectors(spark, sf_dir))
    return runs.select(
        "strategy", "fold", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("test_rows"), (F.col("tp") + F.col("fn")).alias("test_positives"),
        F.when(F.col("strategy") != "smote tomek 0.3", F.col("real_rows")).alias("real_rows"),
        F.when(F.col("strategy").isin(*_GROWN), F.col("synthetic_rows")).alias("synthetic_rows"), F.col("error").isNull().alias("ended"))


@register("importance_union", """SELECT model, 58 AS features, TRUE AS ranked, TRUE AS sums_to_one FROM (SELECT UNNEST(['boosted', 'forest']) AS model) t""")
def importance_union(spark, sf_dir):
    """Impurity importances of two models in one table: how many features, whole ranks, and their sum."""
    train, _ = training(spark, sf_dir)
    names = features(spark, sf_dir)
    models = L.run_all({"forest": lambda: L.fit(L.forest(), train), "boosted": lambda: L.boosted().fit(train)}, L.at_once(train))
    table_ = L.union_importances({name: L.importances(model, names, spark) for name, model in models.items()})
    return table_.groupBy("model").agg(
        F.count("*").cast("int").alias("features"), (F.sum("rank") == F.lit(58 * 59 // 2)).alias("ranked"),
        (F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"))


_METHODS = ["stub", "fit_platt", "load_platt", "fit_forest", "load_forest"]


@register("calibration_methods", f"""SELECT method, n_rows, TRUE AS in_range, TRUE AS same_when_loaded
FROM (SELECT UNNEST([{', '.join(f"'{m}'" for m in _METHODS)}]) AS method) m, (SELECT COUNT(*) AS n_rows FROM lineitem) c""")
def calibration_methods(spark, sf_dir):
    """Decisions under all five calibrations; a model that was saved gives the probabilities it gave when fitted."""
    rows, folder = pairs(spark, sf_dir), f"{checkpoint_folder(spark)}/models-{uuid.uuid4().hex}"
    parts = None
    for method in _METHODS:
        kind = method.split("_")[-1]
        done = decide(rows, default_settings(), "vigilancia", "k", method, check=False,
                      save_to=f"{folder}/{kind}" if method.startswith("fit") else None, model_path=f"{folder}/{kind}" if method.startswith("load") else None)
        part = done.pairs.select(F.lit(method).alias("method"), "k", "p_cal")
        parts = part if parts is None else parts.unionByName(part)
    return compared(materialise(parts))


def compared(kept):
    """Rows per method, and whether a loaded model's probabilities are those of the fitted one; a row meets one other at most."""
    fitted_ = kept.filter(F.col("method").startswith("fit")).select(F.regexp_replace("method", "fit", "load").alias("method"), "k", F.col("p_cal").alias("other"))
    both = kept.join(fitted_, ["method", "k"], "left")
    return both.groupBy("method").agg(
        F.count("*").alias("n_rows"), F.min(F.col("p_cal").between(0, 1)).alias("in_range"),
        F.min((F.abs(F.col("p_cal") - F.coalesce("other", "p_cal")) < 1e-12)).alias("same_when_loaded"))
