"""The findings of round 3."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pairsieve.operators import models as L


def _rows(spark, n):
    return spark.range(n).select(
        F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("double").alias("y"),
        array_to_vector(F.array((F.col("id") % 3).cast("double"), (F.col("id") % 7).cast("double"))).alias("features"))


def test_training_partitions_follow_the_rows(spark):
    for n, parts in ((0, 1), (400, 1), (2_000, 4)):
        rows = L.packed(_rows(spark, n).repartition(64), "k")
        assert rows.count() == n and rows.rdd.getNumPartitions() <= parts
    assert L.packed(_rows(spark, 20_000).repartition(64), "k").rdd.getNumPartitions() == L.PARTS


def test_trees_do_not_depend_on_the_partitions_given(spark):
    said = {L.forest(5, 3, weighted=False).fit(L.packed(_rows(spark, 3_000).repartition(p), "k")).toDebugString.split("\n", 1)[1]
            for p in (2, 50)}
    assert len(said) == 1


def test_bins_shuffle_no_rows(spark):
    from pairsieve.operators.privacy import rank_bins

    rows = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"), F.lit("x" * 20).alias("note"))
    sent = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables whose size is estimated too large
    try:
        binned = rank_bins(rows, ["v"], "k", [2, 4])
        assert "SortMergeJoin" not in binned._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
    want, order = {}, sorted(range(40_000), key=lambda i: (i % 7, i))
    for q in (2, 4):
        want[q] = {k: f"Q{max(1, -(-r * q // 39_999))}" for r, k in enumerate(order)}
    assert all(r.v_q2 == want[2][r.k] and r.v_q4 == want[4][r.k] for r in binned.select("k", "v_q2", "v_q4").collect())


def test_sentences_are_read_once(spark, monkeypatch):
    from pairsieve.operators import text as X

    cited = spark.createDataFrame([(1, 0, "a"), (1, 0, "a"), (1, 1, "a")], "doc_id int, sentence_no int, bib_key string")
    sentences = spark.createDataFrame([(1, 0, "health records linkage"), (1, 1, "nothing else")], "doc_id int, number int, text string")
    abstracts = spark.createDataFrame([("a", "linkage of health")], "bib_key string, abstract string")
    out = X.keyword_scores(cited, sentences, abstracts)
    assert "regexp_extract_all(lower(text" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.sentence_no, round(r.overlap, 6), r.citations) for r in out.collect()) == [(0, round(2 / 3, 6), 2), (1, 0.0, 1)]


def test_forests_keep_their_rows_nodes(spark):
    rows = L.packed(_rows(spark, 2_000), "k")
    kept = L.forest(5, 4, weighted=False)
    assert kept.getCacheNodeIds()
    plain = L.forest(5, 4, weighted=False, cacheNodeIds=False)
    assert len({e.fit(rows).toDebugString.split("\n", 1)[1] for e in (kept, plain)}) == 1


def test_seeded_splits_shuffle_no_rows(spark):
    from pairsieve.operators.evaluate import seeded_splits
    from pairsieve.operators.ranking import rank_by_hash
    from pairsieve.operators.split import holdout_size

    rows = spark.range(3_000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 10 < 8, 0).alias("y"))
    split = seeded_splits(rows, "y", "k", [3, 4], 0.3)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
    ranked = rank_by_hash(rows.withColumn("seed", F.explode(F.array(F.lit(3), F.lit(4)))), ["seed", "y"], F.col("seed"), "k", "r", "n")
    want = {(r.seed, r.k) for r in ranked.filter(F.col("r") <= holdout_size(F.col("n"), 0.3)).collect()}
    assert {(r.seed, r.k) for r in split.filter("split = 'test'").collect()} == want and split.count() == 6_000
