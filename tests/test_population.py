import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairsieve.functions import intervals as I
from pairsieve.functions.similarity import indel_ratio, plain_text, title_similarity
from pairsieve.operators import drift as D
from pairsieve.operators import fairness as N
from pairsieve.operators import privacy as P
from pairsieve.operators import resample as R


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "value double")


def psi_by_hand(a, b):
    edges = np.unique(np.percentile(a, np.linspace(0, 100, 11)))
    fa, fb = ((np.histogram(x, edges)[0] + 1e-6) / len(x) for x in (a, b))
    return ((fb - fa) * np.log(fb / fa)).sum()


def test_psi_and_ks(spark):
    rng = np.random.default_rng(0)
    a, b = np.round(rng.normal(size=400), 2), np.round(rng.normal(0.4, 1.2, size=300), 2)
    assert D.psi(frame(spark, a), frame(spark, b)).first()["psi"] == pytest.approx(psi_by_hand(a, b))
    assert D.psi(frame(spark, a), frame(spark, a)).first()["psi"] == pytest.approx(0.0)
    every = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in every)
    assert D.ks(frame(spark, a), frame(spark, b)).first()["ks"] == pytest.approx(want)
    assert D.psi(frame(spark, [1.0] * 5), frame(spark, [1.0, 2.0])).first()["psi"] == 0.0


def test_two_by_two(spark):
    df = spark.createDataFrame([(8, 2, 1, 5), (50, 50, 30, 70)], "a int, b int, c int, d int")
    cells = [F.col(c) for c in "abcd"]
    stat, least = I.chi_square(*cells)
    got = df.select(I.fisher_p(*[c.cast("double") for c in cells]).alias("f"), I.chi_square_p(stat).alias("p"),
                    stat.alias("s"), least.alias("e")).collect()
    assert got[0]["f"] == pytest.approx(0.0349650350, abs=1e-8)
    assert got[1]["s"] == pytest.approx(8.3333333333) and got[1]["p"] == pytest.approx(0.0038924171, abs=1e-8)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, None, 0.03, 0.2]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = [r["q"] for r in N.benjamini_hochberg(df, "p", "q", ["i"]).orderBy("i").collect()]
    assert got[2] is None and np.allclose([got[0], got[1], got[3], got[4]], [0.04, 0.16 / 3, 0.16 / 3, 0.2])


def test_rank_bins_match_equal_cuts(spark):
    rng = np.random.default_rng(4)
    v = rng.choice([0.0, 0.5, 1.0], size=101, p=[0.6, 0.3, 0.1])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "k long, v double")
    got = P.rank_bins(df, ["v"], "k", [2]).orderBy("k").toPandas()["v_q2"].tolist()
    want = pd.qcut(pd.Series(v).rank(method="first"), 2, labels=["Q1", "Q2"]).astype(str).tolist()
    assert got == want


def test_schema_search_by_hand(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 7), float(i % 3)) for i in range(200)], "k long, s int, a double, b double")
    cells = P.finest_cells(df, "k", "s", ["a", "b"], [2, 3])
    best = P.best_schema(cells, "s", ["a", "b"], [2, 3]).first()
    binned = P.rank_bins(df, ["a", "b"], "k", [2, 3]).toPandas()
    found = []
    for qa in (0, 2, 3):
        for qb in (0, 2, 3):
            by = ["s"] + [f"{c}_q{q}" for c, q in (("a", qa), ("b", qb)) if q]
            sizes = binned.groupby(by).size()
            if (qa or qb) and sizes.min() >= 5:
                found.append((len(sizes), len(by) - 1, qa + qb))
    assert (best["groups"], best["columns"], best["bins"]) == max(found)


@pytest.mark.parametrize("block", [20_000, 17])
def test_neighbours(spark, block):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, [float(c) for c in row], int(i % 4 == 0)) for i, row in enumerate(x)], "id long, x array<double>, y int")
    got = R.neighbours(df, df, 4, block).orderBy("id", "rank").toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert (got["n_id"].to_numpy().reshape(60, 4) == want).all()
    grown = R.smote(df, 1.0, 3)
    assert grown.filter("y = 1").count() == grown.filter("y = 0").count()


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "abxd", "the record linkage method", "record linkage method the"),
                                ("a", "b", "probabilistic linkage", "probabilistic linkage in public health")], "a string, b string, s string, t string")
    got = df.select(indel_ratio(F.col("a"), F.col("b")).alias("r"), title_similarity(F.col("s"), F.col("t")).alias("t"),
                    plain_text(F.lit("\\emph{Ação}~de  {Saúde}")).alias("p")).collect()
    assert got[0]["r"] == 75.0 and got[0]["t"] == 100.0 and got[1]["r"] == 0.0 and got[1]["t"] == 100.0
    assert got[0]["p"] == "acao de saude"


def test_bootstrap_draws_are_binomial(spark):
    import math

    from pairsieve.operators.split import bootstrap_confusion, bootstrap_counts

    cells = spark.createDataFrame([("a", 40, 10), ("b", 100_000, 70_000), ("c", 7, 0), ("d", 9, 9), (None, 1, 1), ("e", 0, 0)], "s string, n long, h long")
    got = bootstrap_counts(cells, ["s"], "h", "n", 4000).groupBy("s").agg(
        F.count("*").alias("r"), F.avg("drawn").alias("m"), F.stddev("drawn").alias("sd"), F.min("drawn").alias("lo"), F.max("drawn").alias("hi"))
    found = {r.s: r for r in got.collect()}
    assert set(found) == {"a", "b", "c", "d", None} and all(r.r == 4000 for r in found.values())
    for name, n, p in (("a", 40, 0.25), ("b", 100_000, 0.7)):
        sd = math.sqrt(n * p * (1 - p))
        assert abs(found[name].m - n * p) < 5 * sd / math.sqrt(4000) and abs(found[name].sd / sd - 1) < 0.06
    assert (found["c"].lo, found["c"].hi, found["d"].lo, found[None].hi) == (0, 0, 9, 1)
    rows = spark.range(5000).select((F.col("id") % 5 == 0).cast("int").alias("y"), (F.col("id") % 3 == 0).cast("int").alias("hit"), (F.col("id") % 2).alias("s"))
    sums = bootstrap_confusion(rows, "y", "hit", ["s"], 50).select((F.col("tp") + F.col("fn")).alias("p"), (F.col("fp") + F.col("tn")).alias("q"))
    assert {tuple(r) for r in sums.collect()} == {(1000, 4000)}  # strata keep their size


def test_pivots_skip_most_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((25, 6)) * 40
    points = np.concatenate([centres[i % 25] + rng.standard_normal((1, 6)) for i in range(2500)])
    points[1000:1400] = points[0]  # equal rows that no ball can tell apart
    df = spark.createDataFrame([(i, [float(v) for v in x], int(i % 4 == 0)) for i, x in enumerate(points)], "id long, x array<double>, y int")
    pool = df.select(F.col("id").alias("p_id"), F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    placed, blocks = R.pivot_blocks(pool, 50)
    assert placed.groupBy("block").count().agg(F.max("count")).first()[0] <= 150 and placed.count() == 2500
    asked = df.select(F.col("id").alias("q_id"), F.col("x").alias("q_x"), F.array().cast("array<int>").alias("seen"), F.lit(5.0).alias("reach"))
    looked = R.visits(asked, blocks, 3, known=True).count()
    assert looked < 0.25 * 2500 * len(blocks.rows)
    got = {(r.id, r["rank"]): r.n_id for r in R.neighbours(df.filter("id % 7 = 0"), df, 3, 50).collect()}
    for i in range(0, 2500, 7):
        gap = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        gap[i] = np.inf
        assert [got[i, r] for r in (1, 2, 3)] == np.lexsort((np.arange(2500), gap))[:3].tolist()
    plan = R.neighbours(df, df, 3, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert R.neighbours(df, df.filter("id < 2"), 3, 50).groupBy("id").count().filter("count < 2").select("id").orderBy("id").collect()[0].id == 0
    assert R.neighbours(df, df.filter("id < 0"), 3).count() == 0 and R.neighbours(df.filter("id < 0"), df, 3).count() == 0
