"""What the corpus operators share: shared-folder tables, skew-safe joins, distributed prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pairsieve.functions.values import ref
from pairsieve.session import checkpoint_folder

#: A key is hot when it holds more than one row in this many, so fewer keys than this are hot.
HOT_SHARE = 1000
#: The words of a text: runs of anything but ASCII white space (a fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"


_scratch: list[tuple[list[str], int | None]] = []
#: Rows of the main table per task of what is kept for it, and the tasks of a small one.
TASK_ROWS, TASKS = 2_000, 12


def keep(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there and lost executors cost nothing.

    Inside ``scratch`` the table goes when the block ends, unless it is ``lasting``.
    """
    path = shared_path(df.sparkSession, name)
    if _scratch:
        paths, rows = _scratch[-1]
        if not lasting:
            paths.append(path)
        if rows is not None:
            df = df.coalesce(max(TASKS, -(-rows // TASK_ROWS)))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Tables kept in this block are removed at its end; nothing may read them after that.

    With the ``rows`` of the table they come from, their last step has a task per ``TASK_ROWS`` of them
    at most: a small table is not spread over hundreds of empty tasks and files.
    """
    _scratch.append(([], rows))
    try:
        yield
    finally:
        for name in _scratch.pop()[0]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(ref(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def in_fold(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id written as text leaves ``part``; a null id counts as empty text."""
    return F.crc32(F.coalesce(ref(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of rows with one fact row per key, where any key may hold a large share of the rows.

    ``weight`` is the key's row count.  Keys above one row in ``HOT_SHARE`` are fewer than that
    by arithmetic and are broadcast; all others meet by shuffle.
    """
    is_hot = F.col(weight) * HOT_SHARE > total
    hot = F.broadcast(facts.filter(is_hot))
    cold = facts.filter(~is_hot)
    near = rows.join(hot, keys)
    far = rows.join(F.broadcast(facts.filter(is_hot).select(*keys)), keys, "left_anti").join(cold, keys)
    return near.unionByName(far)


def prefix_sums(
    df: DataFrame, groups: list[str], order: list[str], value: str, out: str, chunk_rows: int = 250_000,
) -> DataFrame:
    """``out``: the sum of ``value`` over the rows before this one in its group, by ``order``.

    The rows are range-sorted by (groups, order) across the cluster and written with their chunk
    number; chunk totals are accumulated on their own (one row per chunk and group), and only the
    rows of one chunk are ever ordered together.  ``order`` should tell all rows apart; rows that
    tie stay whole, in any order, and a tied run is bounded only by its own length.
    """
    spark = df.sparkSession
    rows = df.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // chunk_rows))
    sorted_rows = keep(
        df.repartitionByRange(parts, *[ref(c) for c in [*groups, *order]])
        .withColumn("_chunk", F.spark_partition_id()), "sorted",
    )
    by = [f"_g{i}" for i in range(len(groups))]
    named = sorted_rows.withColumns({b: F.to_json(F.struct(ref(g))) for b, g in zip(by, groups)}) if groups else sorted_rows
    totals = named.groupBy("_chunk", *by).agg(F.sum(value).alias("_total"))
    # Without groups this window sees one row per chunk, however many rows there are.
    over = W.partitionBy(*(by or [F.lit(0)])).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_chunk", *by, F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_before"))
    inside = (
        W.partitionBy("_chunk", *by).orderBy(*[ref(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    )
    local = named.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        local.join(offsets, ["_chunk", *by])
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_chunk", "_before", "_local", *by)
    )


#: Bits of a filter that holds rows back before a shuffle.
FILTER_BITS = 1 << 26


def _filter_bits(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame, Column]:
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    bits = (
        keys.select(slot.alias("_slot")).groupBy(F.expr("_slot div 64").alias("_place"))
        .agg(F.bit_or(bit).alias("_bits"))
    )
    marked = rows.withColumn("_slot", slot).withColumn("_place", F.expr("_slot div 64"))
    return marked, F.broadcast(bits), bit.bitwiseAND(F.col("_bits")) != 0


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``keys``, and a few others: a cheap filter in front of a join.

    The filter is a bit map of the keys' hashes in ``FILTER_BITS`` / 64 rows at most, so it can be
    broadcast however many keys there are; when it fills up it only lets more rows pass.
    """
    marked, bits, hit = _filter_bits(rows, keys, key)
    return marked.join(bits, "_place").filter(hit).drop("_slot", "_place", "_bits")


def not_in_filter(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The other rows of ``maybe_in``: certainly not in ``keys``."""
    marked, bits, hit = _filter_bits(rows, keys, key)
    return marked.join(bits, "_place", "left").filter(~F.coalesce(hit, F.lit(False))).drop("_slot", "_place", "_bits")
