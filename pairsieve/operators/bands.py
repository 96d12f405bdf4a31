"""Score bands: first matching range wins, lower limit closed, upper limit open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairsieve.config import Band, Settings
from pairsieve.functions.values import number, true_or_false

# The second scheme used for hand-picked samples, from the top.
SAMPLE_CUTS = [("high", 9.0), ("near_high", 7.0), ("grey_mid", 5.0), ("grey_low", 3.0)]


def band_of(score: Column, bands: tuple[Band, ...] | list[Band]) -> Column:
    """The band name, NULL when the score is missing or in no range."""
    chain = None
    for band in bands:
        inside = score.isNotNull()
        if band.low is not None:
            inside &= score >= band.low
        if band.high is not None:
            inside &= (score <= band.high) if band.closed_high else (score < band.high)
        chain = F.when(inside, band.name) if chain is None else chain.when(inside, band.name)
    return chain


def assign_bands(df: DataFrame, settings: Settings, score: str = "nota final") -> DataFrame:
    return df.withColumn("band", band_of(number(df, score), settings.bands))


def assign_bands_by_join(df: DataFrame, bands: DataFrame, score: str = "nota final") -> DataFrame:
    """The same assignment against a band table ``position, band, low, high, closed_high``.

    For band tables kept as data.  The ranges are short and bounded by configuration, so they
    are folded into one array, read as a scalar subquery, and searched per row.
    """
    listed = bands.select(
        F.sort_array(
            F.collect_list(F.struct("position", "band", "low", "high", "closed_high"))
        ).alias("all")
    ).scalar()
    value = number(df, score)

    def holds(b: Column) -> Column:
        above = b["low"].isNull() | (value >= b["low"])
        below = b["high"].isNull() | (value < b["high"]) | (b["closed_high"] & (value == b["high"]))
        return true_or_false(above & below)

    found = F.try_element_at(F.filter(F.col("_bands"), holds), F.lit(1))["band"]
    return df.withColumn("_bands", listed).withColumn("band", found).drop("_bands")


def sample_band(score: Column) -> Column:
    """The 9/7/5/3 scheme; everything below is ``low``."""
    chain = F.when(score >= SAMPLE_CUTS[0][1], SAMPLE_CUTS[0][0])
    for name, low in SAMPLE_CUTS[1:]:
        chain = chain.when(score >= low, name)
    return F.when(score.isNotNull(), chain.otherwise("low"))
