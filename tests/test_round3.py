"""Cases of the third round of findings."""

from pyspark.sql import functions as F


def test_means_that_end_in_a_half(spark):
    from pairsieve.plans.queries_metrics import ranked_models

    rates = [0.814989, 0.067141, 0.167142, 0.795062, 0.619812, 0.044867, 0.315902, 0.817969]  # 0.4553605; 0.45536049999999995 in doubles
    runs = spark.createDataFrame([("a", r, r, r) for r in rates] + [("b", 0.5, 0.5, 0.5)], "model string, f1 double, precision double, recall double")
    got = {r.model: (r.f1_mean, r["rank"], r.n_runs) for r in ranked_models(runs.coalesce(1)).collect()}
    assert got == {"a": (0.455361, 2, 8), "b": (0.5, 1, 1)}


def test_screened_neighbours_are_the_exact_ones():
    import numpy as np

    from pairsieve.operators import resample as R

    rng = np.random.default_rng(5)
    spread = rng.normal(size=(700, 9))
    spread[100:160] = spread[40]  # equal rows: ties by id
    tight = 1e6 + rng.normal(size=(700, 9)) * 1e-6  # all within the screen's rounding
    lost = spread.copy()
    lost[3, 2], lost[5, 1] = np.nan, np.inf
    for pool in (spread, tight, spread * 1e200, spread * 0, lost):
        ids, k, asked = np.arange(700) * 3, 4, np.arange(0, 700, 7)
        with np.errstate(all="ignore"):
            query, row, gap = R.nearest_rows(ids[asked], pool[asked], np.full(len(asked), np.inf), ids, R.Screen(pool, k))
            exact = R.distances(pool[asked], pool)
        exact[np.arange(len(asked)), asked] = np.inf
        want = [(q, r, exact[q, r]) for q in range(len(asked)) for r in np.argsort(exact[q], kind="stable")[:k] if np.isfinite(exact[q, r])]
        assert list(zip(query, row, gap)) == want
    query, row, gap = R.nearest_rows(ids[asked], spread[asked], np.full(len(asked), 2.0), ids, R.Screen(spread, k))
    assert len(gap) and gap.max() <= 2.0
    found, _ = R.Screen(spread, k).candidates(spread[asked], np.full(len(asked), np.inf), asked)
    assert len(found) < 100 * len(asked)


def test_titles_and_names_are_normalised_once(spark):
    from pairsieve.functions.similarity import plain_text, title_similarity
    from pairsieve.operators.biblio import author_match

    rows = spark.createDataFrame([("A b", "b C", ["Silva, Ana"], ["Silvo Ana"]), ("x", None, [], None), ("x", "y", ["Others"], ["B C"]), ("x", "y", ["Lee, B"], ["Ray C"])],
                                 "a string, b string, authors array<string>, m_authors array<string>").withColumn("bib_key", F.lit("k"))
    similar = rows.select(title_similarity(plain_text(F.col("a")), plain_text(F.col("b"))).alias("s"))
    assert similar._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 2
    assert [round(r.s, 4) for r in similar.collect()] == [66.6667, 0.0, 0.0, 0.0]
    matched = author_match(rows)
    assert "Join" not in matched._jdf.queryExecution().optimizedPlan().toString()
    assert [r.author_match for r in matched.collect()] == [False, True, True, False]
