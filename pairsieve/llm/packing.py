"""Best-fit packing of documents into sequences, certified by lower bounds.

Pieces are dealt by hash to groups; each group packs best-fit decreasing and certifies its number
of sequences with dual-feasible-function lower bounds.  As long as all groups together use more
sequences than the bound over all lengths, the groups give the documents of their unfilled
sequences away: these meet in new, fewer groups and are packed again, and a group keeps the new
packing only if it needs fewer sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairsieve.functions.values import ref
from pairsieve.llm.common import keep
from pairsieve.llm.tokens import crc_of, encoder

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces packed together; free tokens from which on a sequence counts as unfilled; exchanges.
GROUP_PIECES = 65_536
UNFILLED = 64
ROUNDS = 6
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text with its end id; null text is empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).batch
        for batch in batches:
            ids, begins = encode(batch.column(1))
            names, rows = batch.column(0).to_pylist(), []
            for i, name in enumerate(names):
                own = np.append(ids[begins[i]:begins[i + 1]], np.uint32(end_id))
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start:start + capacity]
                    rows.append((name, piece, start, len(part), crc_of(part)))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(ref(doc_id).cast("long").alias("doc_id"), ref(text).cast("string").alias("text")).mapInArrow(
        cut, PIECES)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """A number of sequences that no packing can go below.

    The best of two families of dual feasible functions: the threshold family (lengths above
    capacity - e fill a sequence, lengths below e count nothing) for every e, and the rounding
    family u(k).
    """
    held = np.zeros(capacity + 1, np.int64)
    np.add.at(held, lengths, counts)
    size = np.arange(capacity + 1)
    many, load = np.cumsum(held), np.cumsum(held * size)
    e = np.arange(0, capacity // 2 + 1)
    large = many[capacity] - many[capacity - e]
    middle = load[capacity - e] - np.where(e > 0, load[np.maximum(e - 1, 0)], 0)
    best = int((-(-(large * capacity + middle) // capacity)).max())
    for k in range(1, 32):
        scaled = (k + 1) * size
        # u(k) in units of 1 / (k * capacity): lengths on a step keep their share, others round down
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, int(-(-int((value * held).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every length: longest first, into the fullest that fits.

    Open sequences wait in one stack per free space; a bit mask over the free spaces finds the
    smallest that is large enough.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, opened = 0, 0
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = stacks[space].pop()
            if not stacks[space]:
                spaces ^= 1 << space
        else:
            space, number, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = number, capacity - space
        if space > length:
            stacks[space - length].append(number)
            spaces |= 1 << (space - length)
    return bins, offsets


def _repack(first: bool, number: int, capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, np.ones(len(lengths), np.int64), capacity)
        before = None if first else group["sequence_id"].nunique()
        if first or bins.max() + 1 < before:
            identity = (np.int64(number) << 56) | (group["dealt"].to_numpy() << 24) | bins
            group = group.assign(sequence_id=identity, offset=offsets)
        filled = group.groupby("sequence_id")["length"].transform("sum").to_numpy()
        used = group["sequence_id"].nunique()
        return group.assign(unfilled=capacity - filled >= UNFILLED, certified=used == bound)

    return pack


def pack(pieces_of: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with ``sequence_id``, ``offset`` and ``certified``.

    ``certified``: the group that placed the piece needs as few sequences as its bound.  Equal
    lengths and repeated rows are placed one by one; no pieces give no rows.
    """
    rows = keep(pieces_of.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = rows.groupBy("length").count().collect()  # at most one row per possible length
    bound = lower_bound(np.array([r[0] for r in counts], np.int64), np.array([r[1] for r in counts], np.int64), capacity)
    left, used, done = sum(r[1] for r in counts), None, []
    schema = f"{PIECES}, row long, dealt long, sequence_id long, offset long, unfilled boolean, certified boolean"
    for number in range(ROUNDS + 1):
        groups = max(1, -(-left // group_pieces))
        # later on whole sequences move, so that a group can compare before and after
        key = F.xxhash64("row") if number == 0 else F.xxhash64("sequence_id", F.lit(number))
        dealt = rows.withColumn("dealt", F.pmod(key, F.lit(groups)))
        packed = keep(dealt.groupBy("dealt").applyInPandas(_repack(number == 0, number, capacity), schema), "packed")
        sums = packed.groupBy("sequence_id").agg(F.max("unfilled").alias("open"), F.count("*").alias("n")).agg(
            F.count("*"), F.coalesce(F.sum(F.col("open").cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.when(F.col("open"), F.col("n"))), F.lit(0)),
        ).first()
        now = sums[0] if used is None else used - before_round + sums[0]
        gained = used is None or now < used
        used = now
        if used <= bound or not gained or sums[1] < 2 or number == ROUNDS:
            done.append(packed)
            break
        done.append(packed.filter("NOT unfilled"))
        before_round, left = sums[1], sums[2]
        rows = packed.filter("unfilled").drop("dealt", "unfilled", "certified")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def best_fit_packing(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID,
    vocabulary: str = VOCABULARY, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Tokenise, cut what is longer than a sequence, and pack; see ``pieces`` and ``pack``."""
    return pack(pieces(docs, text, doc_id, capacity, end_id, vocabulary), capacity, group_pieces)
