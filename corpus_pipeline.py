"""A training-data pipeline over ``documents``: five corpus operators, each stage written and reread.

Each stage takes (session, documents, folder of the tables) and returns what it keeps, with the
columns of its input; the last returns the packed sequences.  Rows are told apart by their place,
never by id, so null and repeated ids are safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairsieve.llm.common import documents, keep
from pairsieve.llm.exact import exact_dedup
from pairsieve.llm.jaccard import one_per_component
from pairsieve.llm.langid import NO_FIT_BITS, UNKNOWN, language_id
from pairsieve.llm.mixing import mix_sources
from pairsieve.llm.packing import best_fit_packing


def _unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col("carried").getField(c).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null, without letters, or that no model can compress.

    The models learn from the labelled documents outside the held-out fold.  A document stays if
    its best language needs fewer bits per byte than the byte itself.
    """
    found = language_id(docs, carry=tuple(docs.columns))
    return _unpacked(found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") < NO_FIT_BITS)), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return _unpacked(exact_dedup(docs, carry=tuple(docs.columns)).filter("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity the one with the least id stays."""
    return one_per_component(docs)


def mix_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents as the mix takes them.

    Whole takes become whole copies.  The one document per source in which the budget ends is cut
    behind the words taken, and its ``n_chars`` with it; documents not taken go.
    """
    found = mix_sources(docs, carry=tuple(docs.columns)).filter("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size"))
    rest = F.col("taken") - whole * F.col("size")
    copies = found.select("carried", F.explode(F.sequence(F.lit(1), (whole + F.when(rest > 0, 1).otherwise(0)).cast("int"))).alias("copy"),
                          whole.alias("whole"), rest.cast("int").alias("rest"))
    # the text up to the end of its rest-th word
    text = F.col("carried.text")
    words = F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1), F.lit(1), F.col("rest"))
    cut = F.when(F.col("copy") > F.col("whole"), F.array_join(words, "")).otherwise(text)
    columns = []
    for name in docs.columns:
        value = F.col("carried").getField(name)
        if name == "text":
            value = cut
        elif name == "n_chars":
            value = F.when(F.col("copy") > F.col("whole"), F.length(cut).cast(docs.schema[name].dataType)).otherwise(value)
        columns.append(value.alias(name))
    return copies.select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix in certified sequences."""
    return best_fit_packing(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mix_sources", mix_by_weight),
    ("best_fit_packing", pack),
]

#: Trained models and hashed orders have no SQL counterpart; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
