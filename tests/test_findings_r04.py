"""The findings of round 4."""

from pyspark.sql import functions as F


def test_rank_bins_with_quantiles_that_differ_between_jobs(spark, monkeypatch):
    from pairsieve.operators.privacy import rank_bins

    found = F.percentile_approx
    # on several machines approximate quantiles follow the order in which partial results arrive
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: F.transform(
        found(c, p, a), lambda x: x + F.pmod(F.unix_micros(F.current_timestamp()), F.lit(9_973)) / 100))
    rows = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    order = sorted(range(20_000), key=lambda i: (i % 7, i))
    want = {q: {k: f"Q{max(1, -(-r * q // 19_999))}" for r, k in enumerate(order)} for q in (2, 3, 4)}
    got = rank_bins(rows, ["v"], "k", [2, 3, 4]).collect()
    assert len(got) == 20_000
    assert all(r[f"v_q{q}"] == want[q][r.k] for r in got for q in (2, 3, 4))


def _blobs(spark, n=600):
    return spark.range(n).select(
        "id", F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double"), (F.col("id") / 100)).alias("x"),
        (F.col("id") % 3 == 0).cast("int").alias("y"))


def test_smote_searches_only_rows_that_get_copies(spark, monkeypatch):
    from pairsieve.operators import resample as K

    asked, real = [], K.neighbours

    def counted(queries, pool, k, *more):
        asked.append(queries.count())
        return real(queries, pool, k, *more)

    monkeypatch.setattr(K, "neighbours", counted)
    rows = _blobs(spark)
    assert K.smote(rows, 0.5, 3).count() == 600 and asked.pop() == 0  # 200 of 400 are there already
    grown = K.smote(rows, 0.525, 3)
    assert grown.filter("synthetic").count() == 10 and asked.pop() == 10
    # the same points as from a search of all rows
    minority = rows.filter("y = 1")
    all_ = K._spread(minority, real(minority, minority, 3), minority, K._even_copies(minority, 10, 200, 42), 3, 42)
    points = lambda df: sorted((r.id, tuple(r.x)) for r in df.collect())
    assert points(grown.filter("synthetic")) == points(all_)


def test_few_rows_train_in_few_partitions_and_many_rows_keep_no_nodes(spark, monkeypatch):
    from pairsieve.operators import models as L

    rows = _blobs(spark, 9_000).select("id", "y")
    assert L.packed(rows.repartition(32), "id").rdd.getNumPartitions() <= 4
    seen = []

    class Watched(L.RandomForestClassifier):
        def fit(self, df):
            seen.append(self.getCacheNodeIds())

    monkeypatch.setattr(L, "KEEP_ROWS", 8_000)
    forest = Watched(cacheNodeIds=True)
    L.fit(forest, rows), L.fit(forest, rows.limit(100))
    assert seen == [False, True] and L.at_once(rows) == L.PARALLEL
    monkeypatch.setattr(L, "ROWS_AT_ONCE", 10_000)
    assert L.at_once(rows) == 1


def test_calibrations_do_not_carry_their_forests(spark, monkeypatch):
    from pairsieve.operators import models as L

    plans, real = [], L.fit_platt

    def watched(held, *more):
        plans.append(held._jdf.queryExecution().optimizedPlan().toString())
        return real(held, *more)

    monkeypatch.setattr(L, "fit_platt", watched)
    rows = _blobs(spark).select(F.col("id").alias("k"), F.col("y").alias("target"), F.col("x")[0].alias("a"), F.col("x")[2].alias("b"))
    model = L.CalibratedForest(trees=3, depth=2, folds=2).fit(rows, "k", "target")
    assert len(plans) == 2 and not any("UDF" in p for p in plans)
    assert model.score(rows, "p").filter("p between 0 and 1").count() == 600


def test_loaded_calibrations_are_counted_once(spark):
    from pairsieve.plans.queries_models import compared

    kept = spark.createDataFrame([(m, k, 0.1 * k) for m in ("stub", "fit_platt", "load_platt") for k in (1, 2)], "method string, k long, p_cal double")
    assert {(r.method, r.n_rows, r.same_when_loaded) for r in compared(kept).collect()} == {(m, 2, True) for m in ("stub", "fit_platt", "load_platt")}
    off = compared(kept.withColumn("p_cal", F.when((F.col("method") == "load_platt") & (F.col("k") == 1), 0.9).otherwise(F.col("p_cal"))))
    assert [r.same_when_loaded for r in off.filter("method = 'load_platt'").collect()] == [False]


def test_stumps_are_counted_from_bins(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    from pairsieve.operators import models as L

    monkeypatch.setattr(L, "DecisionTreeClassifier", None)  # no tree is grown per round
    x = [((i * 37) % 101 / 10.0, float(i % 5), 1.0) for i in range(400)]
    y = [float((a > 4.0) != (b == 3.0)) for a, b, _ in x]
    rows = spark.createDataFrame([(i, list(v), w) for i, (v, w) in enumerate(zip(x, y))], "id long, x array<double>, y double").select(
        "id", array_to_vector("x").alias("features"), "y").repartition(3, "id")
    model = L.AdaBoost(rounds=8).fit(rows)
    # the same rounds by hand, over all cuts of the values the model may cut at
    weight = [1.0] * len(x)
    for stump, alpha in model.members:
        miss = [(stump.left if v[stump.feature] <= stump.cut else stump.right) != w for v, w in zip(x, y)]
        error = sum(w for w, m in zip(weight, miss) if m) / sum(weight)
        assert abs(alpha - L.np.log((1 - error) / error)) < 1e-9 and error < 0.5
        weight = [w * (1 - error) / error if m else w for w, m in zip(weight, miss)]
    assert len(model.members) == 8
    hits = model.score(rows).withColumn("right", ((F.col("p") >= 0.5).cast("double") == F.col("y")).cast("int")).agg(F.avg("right")).first()[0]
    assert hits > 0.75


def test_permutation_scores_only_changed_values(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    from pairsieve.operators import models as L
    from pairsieve.operators.histograms import ranking_quality
    from pairsieve.operators.ranking import rank_by_hash

    rows = spark.range(300).select(F.col("id").alias("k"), ((F.col("id") * 7) % 10 < 4).cast("double").alias("y"), array_to_vector(F.array(
        ((F.col("id") * 7) % 10).cast("double"), (F.col("id") % 3).cast("double"), F.lit(1.0))).alias("features"))
    model, sent, real = L.forest(4, 3, weighted=False).fit(rows), [], L.scored

    def watched(m, df, *more):
        sent.append(df.count())
        return real(m, df, *more)

    monkeypatch.setattr(L, "scored", watched)
    names = ["a", "b", "constant"]
    got = {r.feature: r.importance for r in L.permutation_importance(model, rows, "k", 3, names).collect()}
    ranked = sorted(rank_by_hash(rows, [], 7, "k", "i").collect(), key=lambda r: r.i)
    x, y = [[float(v) for v in r.features] for r in ranked], [r.y for r in ranked]
    assert sum(sent) == 300 + sum(a != b for j in range(3) for a, b in zip([v[j] for v in x], [v[j] for v in x[1:] + x[:1]]))
    quality = lambda vectors: ranking_quality(real(model, spark.createDataFrame(list(zip(vectors, y)), "x array<double>, y double").select(
        array_to_vector("x").alias("features"), "y")), "p", "y").first()["average_precision"]
    base = quality(x)
    for j, name in enumerate(names):
        moved = [[*v[:j], x[(i + 1) % 300][j], *v[j + 1:]] for i, v in enumerate(x)]
        assert abs(got[name] - (base - quality(moved))) < 1e-9
