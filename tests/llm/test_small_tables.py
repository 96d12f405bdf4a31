"""Small tables are not spread over empty tasks, and settled components take no further pass."""

from pyspark.sql import functions as F

from pairsieve.llm import common, components as K


def test_stars_take_no_pass(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(K, "keep", lambda df, name: kept.append(name) or common.keep(df, name))
    stars = [(1, 2), (3, 1), (7, 9), (9, 7), (5, 5)]
    got = {r.node: r.component for r in K.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7} and len(kept) == 1


def test_tables_of_few_rows_have_few_files(spark):
    rows = spark.range(300).repartition(40, "id")
    with common.scratch(spark, 300):
        kept = common.keep(rows, "few", lasting=True)
    assert kept.count() == 300 and kept.select(F.input_file_name()).distinct().count() <= common.TASKS
    with common.scratch(spark, 10**6):
        assert common.keep(rows, "many", lasting=True).select(F.input_file_name()).distinct().count() > common.TASKS
