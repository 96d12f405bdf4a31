"""Cases that used to give wrong answers or to be cut."""

import math

import pytest
from pyspark.sql import functions as F

from pairsieve.functions.similarity import plain_text
from pairsieve.operators.biblio import match_metadata
from pairsieve.operators.drift import ks, psi
from pairsieve.operators.evaluate import seeded_splits
from pairsieve.operators.histograms import exact_quantiles, running_totals, histogram
from pairsieve.operators.ranking import cutoff, rank_by_value, value_bin
from pairsieve.operators.review import consensus, extract_json
from pairsieve.operators.triage import consistent_per_left


@pytest.mark.parametrize("raw,expected", [
    ('The "decision" is hard. {note} {"decision": "MATCH", "confidence": 0.9} }', '{"decision": "MATCH", "confidence": 0.9}'),
    ('{"decision": "MATCH"}', '{"decision": "MATCH"}'),
    ('<think>{"decision": 1}</think>x {"a": {"b": 1}, "decision": "UNSURE"} tail', '{"a": {"b": 1}, "decision": "UNSURE"}'),
    ('{broken ```json\n{"decision": "NONMATCH"}\n``` }', '{"decision": "NONMATCH"}'),
    ('{x} {"p": 1, "decision": "MATCH", "q": {"r": 2}} {y}', '{"p": 1, "decision": "MATCH", "q": {"r": 2}}'),
    ("no braces", None), ("{not json}", None), ('"decision" alone', None), (None, None),
])
def test_extract_json(spark, raw, expected):
    assert extract_json(spark.createDataFrame([(raw,)], "raw string")).first()["json"] == expected


def test_consensus_takes_the_last_answer(spark):
    rows = [(1, "A", "MATCH", 0.9, 1), (1, "A", "NONMATCH", 0.6, 2), (1, "B", "NONMATCH", 0.7, 1)]
    parsed = spark.createDataFrame(rows, "pair_id long, agent string, decision string, confidence double, attempt int").withColumns({
        "reason_codes": F.array(F.lit("NAME_WEAK")),
        "evidence_summary": F.expr("struct(array('x') AS supports_match, array('y') AS supports_nonmatch, array('z') AS tie_breakers)"),
        "quality_flags": F.expr("struct(false AS pii_leak_detected, false AS insufficient_evidence, false AS inconsistent_input)")})
    got = consensus(parsed).first()
    assert got["decision"] == "NONMATCH" and got["confidence"] == 0.7


def test_missing_groups_and_lone_classes_are_errors(spark):
    rows = spark.createDataFrame([(i, i % 2, None if i == 3 else f"g{i}") for i in range(20)], "k long, TARGET int, COMPREC string")
    with pytest.raises(Exception, match="a group is missing"):
        seeded_splits(rows, "TARGET", "k", [1], 0.3, "comprec").count()
    lone = spark.createDataFrame([(i, int(i == 0)) for i in range(9)], "k long, TARGET int")
    with pytest.raises(Exception, match="two rows"):
        seeded_splits(lone, "TARGET", "k", [1], 0.3).collect()


def test_pairs_without_left_record_stay(spark):
    rows = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.5), (3, None, 0.4), (4, None, 0.8)], "k long, COMPREC string, p_cal double")
    got = {r.k: r.consistency for r in consistent_per_left(rows, "k").collect()}
    assert got == {1: "KEEP", 2: "DROP", 3: "KEEP", 4: "KEEP"}


def test_drift_of_a_new_slice(spark):
    base = spark.createDataFrame([("a", float(i)) for i in range(50)], "g string, value double")
    now = spark.createDataFrame([("a", float(i)) for i in range(50)] + [("b", 1.0), (None, 2.0)], "g string, value double")
    assert {r.g: r.psi for r in psi(base, now, groups=["g"]).collect()} == {"a": pytest.approx(0, abs=1e-9), "b": 0.0, None: 0.0}
    assert {r.g for r in ks(base, now, groups=["g"]).collect()} == {"a", "b", None}


def test_infinite_and_nan_values(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, math.nan), (4, math.inf), (5, -math.inf), (6, None)], "k long, v double")
    got = exact_quantiles(rows.filter("k <= 3"), "v", {"m": 0.5}).first()
    assert got.m == 1.5 and got.n == 2
    totals = {r.value: r.n_to for r in running_totals(histogram(rows, "v"), [], ["n"], False).collect()}
    assert totals == {-math.inf: 1, 1.0: 2, 2.0: 3, math.inf: 4}


def test_bins_do_not_depend_on_the_scale(spark):
    for low, step in ((1_700_000_000.0, 1.0), (0.998, 1e-7)):
        rows = spark.range(20_000).select("id", (F.lit(low) + F.col("id") * step).alias("v"))
        sizes = [r["count"] for r in value_bin(rows, "v").groupBy("_vb").count().collect()]
        assert len(sizes) > 500 and max(sizes) < 200
    ranked = rank_by_value(spark.range(3000).select("id", (F.lit(1.7e9) + F.pmod("id", F.lit(7))).alias("v")), [], "v", "id")
    assert [r["rank"] for r in ranked.orderBy("v", "id").collect()] == list(range(1, 3001))


@pytest.mark.parametrize("k", [1, 7, 499, 500, 9000])
def test_cutoff(spark, k):
    rows = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(5)).alias("a"), "id").repartition(5)
    order = sorted((r.a, r.id) for r in rows.collect())
    got = cutoff(rows, F.struct("a", "id"), k).first()
    assert tuple(got["last"]) == order[min(k, 500) - 1] and got["taken"] == min(k, 500)
    nothing = cutoff(rows.filter("id < 0"), F.struct("a", "id"), k).first()
    assert nothing["last"] is None and nothing["taken"] == 0


def test_accents_of_the_whole_plane(spark):
    assert spark.range(1).select(plain_text(F.lit("Čapek, Şahin, Erdős, Łódź, Ångström, Nguyễn"))).first()[0] == "capek, sahin, erdos, łodz, angstrom, nguyen"


def test_search_order_and_followed_identifier(spark):
    entries = spark.createDataFrame([("k1", "deep title of a work", ""), ("k2", "another title here", "")], "bib_key string, title string, doi string")
    metadata = spark.createDataFrame([
        (None, "Deep Title of a Work", ["A B"], 2001, "J", 5, "k1", "crossref", 1),
        ("10.1/x", "Deep title of a work", ["C D"], 2002, "K", 6, "k1", "openalex", 1),
        ("10.1/X", "Registered title", ["E F"], 2003, "L", 7, None, "crossref", 0),
        (None, "Another title here", ["G H"], 2004, "M", 8, "k2", "crossref", 1),
    ], "m_doi string, m_title string, m_authors array<string>, m_year int, m_journal string, citation_count int, bib_key string, source string, rank int")
    got = {r.bib_key: r.m_title for r in match_metadata(entries, metadata).collect()}
    assert got["k1"] in ("Registered title", "Deep title of a work") and got["k2"] == "Another title here"


def test_cutoff_without_exchange_reuse(spark):
    from pairsieve.operators.ranking import cutoff, first_k

    rows = spark.range(100_000).withColumn("o", F.struct(F.xxhash64("id").alias("h"), "id"))
    values = sorted((r.o.h, r.o.id) for r in rows.collect())
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        for k in (1, 60_000, 100_000, 200_000):
            found = cutoff(rows.repartition(7), F.col("o"), k).first()
            assert tuple(found["last"]) == values[min(k, 100_000) - 1] and found["taken"] == min(k, 100_000)
        marked = first_k(rows, F.col("id") % 2 == 0, F.col("o"), 700, "taken").filter("taken").select("id").collect()
        assert {r.id for r in marked} == {i for _, i in [v for v in values if v[1] % 2 == 0][:700]}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_bins_follow_the_rows(spark, monkeypatch):
    from pairsieve.operators import ranking

    rows = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 40_000) / 100.0).alias("v"))
    counts = []
    for per in (40_000, 4_000, 100):
        monkeypatch.setattr(ranking, "ROWS_PER_BIN", per)
        bins = value_bin(rows, "v").groupBy("_vb").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_vb").collect()
        assert all(a.hi < b.lo for a, b in zip(bins, bins[1:])) and sum(b.n for b in bins) == 40_000
        counts.append(len(bins))
        ranked = ranking.rank_by_hash(rows, [], 1, "id", "r").agg(F.count_distinct("r").alias("d"), F.max("r").alias("m")).first()
        assert (ranked.d, ranked.m) == (40_000, 40_000)
    assert counts[0] <= 2 < counts[1] < 20 and counts[2] > 200
    assert value_bin(rows.filter("id < 0"), "v").count() == 0


def test_similar_names_against_all_pairs(spark):
    import random

    from pairsieve.operators.biblio import journal_lookup, similar_names
    from pairsieve.functions.similarity import indel_ratio

    rng = random.Random(11)
    words = ["journal", "of", "health", "saude", "publica", "bmj", "ab", "a", "lancet", "q", "epidemiologia", "clinical"]
    known = sorted({" ".join(sorted(rng.choice(words) for _ in range(rng.randint(1, 4)))) for _ in range(60)})
    asked = set(known[:20])
    while len(asked) < 160:
        text = list(rng.choice(known))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text) + 1)
            text[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "e", "o"])
        if text:
            asked.add("".join(text))
    left = spark.createDataFrame([(t,) for t in sorted(asked)], "text string")
    right = spark.createDataFrame([(t,) for t in known], "known string")
    every = left.crossJoin(right).withColumn("r", indel_ratio(F.col("text"), F.col("known"))).filter("r >= 80")
    want = {(r.text, r.known) for r in every.collect()}
    assert {(r.text, r.known) for r in similar_names(left, right).collect()} == want and len(want) > 100
    names = spark.createDataFrame([("The {Lancet}",), ("lancet the",), ("The Lanzet",), (None,), ("",), ("nothing alike",)], "journal string")
    found = {r.journal: (r.known_journal, r.quartile) for r in journal_lookup(names, [("the lancet", "Q1"), ("bmj", "Q2")]).collect()}
    assert found == {"The {Lancet}": ("the lancet", "Q1"), "lancet the": ("the lancet", "Q1"), "The Lanzet": ("the lancet", "Q1"), None: (None, None),
                     "": (None, None), "nothing alike": (None, None)}
