"""Exact deduplication by an extendible-hash index on shared files, in DataFrame operations only.

Every row becomes an index entry: a 64-bit hash of its text, the text's SHA-256, and its id.
Entries of equal texts are summed up before any shuffle, so a group of copies of any size is one
slot.  The directory starts as one bucket and doubles: a bucket with more slots than a page holds
splits by its next hash bit, buckets that fit keep their smaller depth.  The slots are written by
bucket, each owner task holding a range of hashes.  Texts whose hash has more than one slot are
chained: bytes are compared by grouping on (hash, text), so equal hashes of different texts stay
apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from pairsieve.functions.values import ref
from pairsieve.llm.common import join_facts, keep, text_of

#: Slots a bucket may hold before it splits, and the deepest directory (65,536 entries, so it
#: can be broadcast).  A bucket that is still overfull there chains pages: nothing is dropped.
PAGE_SLOTS = 100_000
MAX_DEPTH = 16


def directory(slots: DataFrame, count: int, page_slots: int, max_depth: int) -> tuple[DataFrame, int]:
    """Directory entries (``prefix``, ``local_depth``, ``bucket``) and the global depth."""
    depth = min(max_depth, max(1, math.ceil(math.log2(max(count, 1) / page_slots)) + 3 if count else 1))
    filled = slots.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("prefix")).agg(F.count("*").alias("n"))
    levels = filled.select("prefix", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")).withColumn(
        "page", F.expr(f"shiftright(prefix, {depth} - level)")
    )
    pages = levels.groupBy("level", "page").agg(F.sum("n").alias("held"))
    fits = (F.col("held") <= page_slots) | (F.col("level") == depth)
    local = (
        levels.join(pages, ["level", "page"]).groupBy("prefix")
        .agg(F.min(F.when(fits, F.col("level"))).alias("local_depth"))
    )
    bucket = F.expr(f"shiftleft(shiftright(prefix, {depth} - local_depth), {depth} - local_depth)")
    return local.withColumn("bucket", bucket), depth


def exact_dedup(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = (), hash_bits: int = 64,
    page_slots: int = PAGE_SLOTS, max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null text counts as empty.  Of equal texts the row with the largest id stays; of rows that
    share that id too, exactly one is marked kept.  A null id is smaller than any other; a group
    of null ids only has a null ``keep_id`` and one kept row.  ``carry`` names columns to bring
    along, as the struct ``carried``, so no name can clash.  An empty table gives no rows.
    """
    body = text_of(text)
    key = F.xxhash64(body)
    if hash_bits < 64:
        key = F.shiftleft(F.shiftrightunsigned(key, 64 - hash_bits), 64 - hash_bits)
    columns = [
        F.monotonically_increasing_id().alias("row"), ref(doc_id).alias("id"), key.alias("key"),
        F.unhex(F.sha2(body, 256)).alias("sha"),
    ]
    if carry:
        columns.append(F.struct(*[ref(c) for c in carry]).alias("carried"))
    entries = keep(docs.select(*columns), "entries")
    total = entries.count()

    order = F.coalesce(F.col("id").cast("long"), F.lit(-(2**63)))
    slots = keep(
        entries.groupBy("key", "sha").agg(
            F.count("*").alias("group_size"), F.max("id").alias("keep_id"), F.max_by("row", order).alias("keep_row"),
        ), "slots",
    )
    _compare_bytes(docs.select(key.alias("key"), body.alias("text")))

    entries_of, depth = directory(slots, slots.count(), page_slots, max_depth)
    index = keep(
        slots.withColumn("prefix", F.shiftrightunsigned("key", 64 - depth))
        .join(F.broadcast(entries_of.select("prefix", "bucket")), "prefix")
        .repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "index",
    )
    facts = index.select("key", "sha", "group_size", "keep_id", "keep_row")
    found = join_facts(entries, facts, ["key", "sha"], "group_size", total)
    out = [
        F.col("id").alias("doc_id"), F.col("keep_id"), F.col("group_size").cast("long"),
        (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    ]
    return found.select(*out, *(["carried"] if carry else []))


def _compare_bytes(texts: DataFrame) -> None:
    """Chain texts of one hash by their bytes and make sure that no slot holds two of them.

    Equal texts are merged by every task before the shuffle.  Two texts with one hash *and* one
    SHA-256 would share a slot; that is an error, never a silent merge.
    """
    chains = texts.groupBy("key", "text").agg(F.count("*").alias("rows"))
    slots = chains.groupBy("key", F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("texts"))
    if not slots.filter("texts > 1").isEmpty():
        raise ValueError("two different texts share their hash and their SHA-256")
