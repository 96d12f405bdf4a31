"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key; the documents are range-sorted by (source, key) across the
cluster, prefix sums of their sizes are computed chunk by chunk, and each source is cut where its
running total reaches its budget.  A budget above the source's size repeats the source: whole
epochs first, then the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pairsieve.functions.values import ref
from pairsieve.llm.common import join_facts, keep, prefix_sums, text_of, word_count

#: Weights of the sources in their order, repeating, and the most often a source may be repeated.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources in ``sizes`` (``source``, ``source_size``), as column ``target``.

    All sizes together are shared by weight; a target stops at ``max_epochs`` times its source's
    size and the rest is shared again among the others until none is above.  The ranking sees one
    row per source, never a document.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = keep(
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("most", F.col("source_size") * max_epochs), "sources",
    )
    budget = ranked.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0  # of one unit of weight; grows as sources reach their most
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(share)
        capped, open_weight, opened = ranked.agg(
            F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(~full),
        ).first()
        if not opened:
            break
        new = (budget - (capped or 0)) / open_weight
        if new <= share:
            break
        share = new
    return ranked.withColumn(
        "target", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(share)))
    ).drop("most", "weight")


def mix_sources(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 42,
    carry: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``.

    Sizes are words; null text has none.  ``taken`` counts the words that the mix takes of the
    document, repeats included: its size for every whole epoch, plus, for documents before the
    cut, its size once more, plus the words up to the budget for the one document in which the
    cut falls.  A source's ``taken`` therefore adds up to the whole words of its target.  The null
    source is a source of its own, the last.  Rows that agree in every given column are
    interchangeable, so reruns agree.  ``carry`` brings columns along in the struct ``carried``.
    """
    columns = [
        ref(doc_id).alias("id"), ref(source).cast("string").alias("source"), word_count(text_of(text)).alias("size"),
        F.xxhash64(F.lit(seed), ref(doc_id)).alias("key"), F.xxhash64(text_of(text)).alias("tie"),
    ]
    if carry:
        columns.append(F.struct(*[ref(c) for c in carry]).alias("carried"))
    sized = keep(docs.select(*columns), "sized")
    total = sized.count()
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    facts = (
        targets(sources, weights, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0))
        .withColumn("cut", F.floor("target") - F.col("epochs") * F.col("source_size"))
        .select(named.alias("source_key"), "source_size", "source_rows", "target", "epochs", "cut")
    )
    before = prefix_sums(sized, ["source"], ["key", "id", "tie"], "size", "before")
    joined = join_facts(before.withColumn("source_key", named), facts, ["source_key"], "source_rows", total)
    again = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - F.col("before")))
    out = [
        F.col("id").alias("doc_id"), "size", F.col("source_size").cast("long"), "target",
        (F.col("epochs") * F.col("size") + again).cast("long").alias("taken"),
    ]
    return joined.select(*out, *(["carried"] if carry else []))
