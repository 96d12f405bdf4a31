"""Token ids on disk as Re-Pair grammars, one per shard, with random access.

Documents are range-sorted by id; a task turns each stretch of about ``SHARD_TOKENS`` ids into one
grammar: frequent pairs of neighbouring symbols are replaced by nonterminals, the most frequent
first, over and over until no pair is frequent.  A shard's row holds, as little-endian blocks, the
rules, the expansion length of every rule, the symbols that are left, and where each document
begins among them.  No rule spans two documents, so a document or a single position is decoded
without the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pairsieve.functions.values import ref
from pairsieve.llm.common import shared_path, text_of
from pairsieve.llm.tokens import crc_of, encoder

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Ids per grammar, the count that makes a pair frequent, the factor within which counts are
#: taken as equal, and the first nonterminal.
SHARD_TOKENS = 1 << 19
FREQUENT = 4
CLASS = 4
FIRST_RULE = 1 << 17
#: Pairs are counted by slot before they are sorted: odd factors, and the bits that leave as many slots.
_FIRST_FACTOR, _SECOND_FACTOR, _SLOT_SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(14)
_SLOTS = 1 << 18
#: Stands for a null document id in a shard.
NO_ID = -(2**63)
SHARDS = ("part int, shard int, part_start long, n_tokens long, doc_ids binary, doc_tokens binary, doc_symbols binary, "
          "rules binary, rule_lengths binary, symbols binary")


@dataclass
class Grammar:
    """Symbols, the pair of each rule (rule k is symbol ``FIRST_RULE + k``), expansion lengths."""

    symbols: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    _table: np.ndarray | None = None
    _begins: np.ndarray | None = None

    def expand(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids under symbols ``begin`` to ``end``, copied from the rules' expansions."""
        if self._table is None:
            self._table = self._unfold(np.arange(FIRST_RULE, FIRST_RULE + len(self.rules), dtype=np.uint32))
            self._begins = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        symbols = self.symbols[begin:end].astype(np.int64)
        rule = symbols >= FIRST_RULE
        sizes = np.ones(len(symbols), np.int64)
        sizes[rule] = self.lengths[symbols[rule] - FIRST_RULE]
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        out[ends[~rule] - 1] = symbols[~rule]
        sizes, places = sizes[rule], (ends - sizes)[rule]
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(places, sizes) + inner] = self._table[np.repeat(self._begins[symbols[rule] - FIRST_RULE], sizes) + inner]
        return out

    def _unfold(self, out: np.ndarray) -> np.ndarray:
        """Nonterminals give way to their pairs until none is left."""
        while len(out) and out.max() >= FIRST_RULE:
            pair = out >= FIRST_RULE
            places = np.cumsum(1 + pair) - (1 + pair)
            wide = np.empty(len(out) + int(pair.sum()), np.uint32)
            wide[places[~pair]] = out[~pair]
            halves = self.rules[out[pair] - FIRST_RULE]
            wide[places[pair]], wide[places[pair] + 1] = halves[:, 0], halves[:, 1]
            out = wide
        return out

    def token_at(self, position: int, begin: int = 0) -> int:
        """One id, counted from symbol ``begin``, by walking down expansion lengths."""
        symbol = begin
        while position >= (size := self._length(int(self.symbols[symbol]))):
            position, symbol = position - size, symbol + 1
        at = int(self.symbols[symbol])
        while at >= FIRST_RULE:
            left, right = map(int, self.rules[at - FIRST_RULE])
            size = self._length(left)
            at, position = (left, position) if position < size else (right, position - size)
        return at

    def _length(self, symbol: int) -> int:
        return int(self.lengths[symbol - FIRST_RULE]) if symbol >= FIRST_RULE else 1


def compress(ids: np.ndarray, begins: np.ndarray, frequent: int = FREQUENT) -> tuple[Grammar, np.ndarray]:
    """Re-Pair of the ids; ``begins``: where documents start.  Also where they start in the symbols.

    Each pass takes the pairs within a factor ``CLASS`` of the most frequent one together, replaces
    them from left to right without overlap, and counts anew.
    """
    symbols, places = ids.astype(np.uint32), np.unique(begins).astype(np.int64)
    places = places[places < len(symbols)]
    room = np.empty((2, len(symbols)), np.uint32)
    rules, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    while len(symbols) > 1:
        # equal pairs share a slot: only pairs in slots of so many rows can be so frequent
        slots, more = room[:, :len(symbols) - 1]
        np.multiply(symbols[:-1], _FIRST_FACTOR, out=slots)
        np.multiply(symbols[1:], _SECOND_FACTOR, out=more)
        np.right_shift(np.add(slots, more, out=slots), _SLOT_SHIFT, out=slots)
        across = places[places > 0] - 1  # pairs of two documents
        held = np.bincount(slots, minlength=_SLOTS)
        np.subtract.at(held, slots[across], 1)
        least = max(frequent, int(held.max()) // (2 * CLASS))
        while True:
            hit = (held >= least).take(slots)
            hit[across] = False
            at = np.flatnonzero(hit)
            codes = (symbols[at].astype(np.uint64) << np.uint64(32)) | symbols[at + 1]
            found = np.sort(codes)
            edge = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1], [True]])) if len(found) else np.zeros(1, np.int64)
            counts = np.diff(edge)
            most = int(counts.max(initial=0))
            if least == frequent or most // CLASS >= least:
                break
            least = max(frequent, min(most // CLASS, least // CLASS))
        if most < frequent:
            break
        chosen = found[edge[:-1]][counts >= max(frequent, most // CLASS)]
        # a slot names its last chosen pair; what meets another pair there is looked up
        own = (((chosen >> np.uint64(32)).astype(np.uint32) * _FIRST_FACTOR + chosen.astype(np.uint32) * _SECOND_FACTOR) >> _SLOT_SHIFT)
        named = np.full(_SLOTS, -1, np.int32)
        named[own] = np.arange(len(chosen))
        spot = named.take(slots[at])
        near = np.flatnonzero(spot >= 0)
        at, codes, spot = at[near], codes[near], spot[near]
        real = chosen.take(spot) == codes
        if len(other := np.flatnonzero(~real)):
            spot[other] = np.minimum(np.searchsorted(chosen, codes[other]), len(chosen) - 1)
            real[other] = chosen[spot[other]] == codes[other]
        at, spot = at[real], spot[real]
        # in a run of neighbouring hits every other one is replaced
        run = np.cumsum(np.diff(at, prepend=-2) != 1) - 1
        fresh = np.flatnonzero(np.diff(run, prepend=-1))
        odd = (np.arange(len(at)) - fresh[run]) % 2 == 1
        at, spot = at[~odd], spot[~odd]
        seen = np.zeros(len(chosen), bool)
        seen[spot] = True
        used, which = np.flatnonzero(seen), (np.cumsum(seen) - 1)[spot]
        pairs = np.stack([chosen[used] >> np.uint64(32), chosen[used] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        size = np.where(pairs >= FIRST_RULE, lengths[np.maximum(pairs.astype(np.int64) - FIRST_RULE, 0)] if len(lengths) else 1, 1)
        symbols[at] = FIRST_RULE + len(rules) + which
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, places = symbols[stay], places - np.searchsorted(at + 1, places)
        rules, lengths = np.concatenate([rules, pairs]), np.concatenate([lengths, size.sum(1).astype(np.uint32)])
    return Grammar(symbols, rules, lengths), places


def write_grammars(
    docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID,
    vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode every whole text, append the end id, and write shards in ascending id order.

    Null text is empty, so its document is the end id alone.  Null ids come first; rows with one
    id are ordered by a hash of their text.  An empty table writes no shard.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary).batch, TaskContext.get().partitionId()
        shard, done, pending, held, names, sizes = 0, 0, 0, [], [], []

        def flush():
            nonlocal shard, done, pending, held, names, sizes
            tokens = np.array(sizes, np.int64)
            grammar, symbols = compress(np.concatenate(held), np.cumsum(tokens) - tokens)
            blocks = [np.array([NO_ID if n is None else n for n in names], "<i8"), tokens.astype("<i8"), symbols.astype("<i8"),
                      grammar.rules.astype("<u4"), grammar.lengths.astype("<u4"), grammar.symbols.astype("<u4")]
            values = [part, shard, done, int(tokens.sum()), *[b.tobytes() for b in blocks]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
            columns = [c.split()[0] for c in SHARDS.split(", ")]
            shard, done, pending, held, names, sizes = shard + 1, done + int(tokens.sum()), 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], columns)

        for batch in batches:
            ids, begins = encode(batch.column(1))
            for i, name in enumerate(batch.column(0).to_pylist()):
                held.append(np.append(ids[begins[i]:begins[i + 1]], np.uint32(end_id)))
                names.append(name)
                sizes.append(len(held[-1]))
                pending += sizes[-1]
                if pending >= shard_tokens:
                    yield flush()
        if names:
            yield flush()

    tie = F.xxhash64(text_of(text))
    ordered = (
        docs.select(ref(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"), tie.alias("tie"))
        .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    )
    ordered.mapInArrow(shards, SHARDS).write.option("compression", "zstd").parquet(path)


def read_grammars(spark: SparkSession, path: str) -> DataFrame:
    """Decode the shards: per document ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before it: those of earlier parts (one row per
    writing task is summed up and broadcast), of the part's earlier shards, and of the shard's
    earlier documents.
    """
    files = spark.read.schema(SHARDS).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    over = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grammar = Grammar(np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2),
                                  np.frombuffer(row["rule_lengths"], "<u4"))
                names, sizes = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_tokens"], "<i8")
                ids = grammar.expand()
                begins = np.cumsum(sizes) - sizes
                crcs = [crc_of(ids[b:b + n]) for b, n in zip(begins, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, mask=names == NO_ID), pa.array(begins + row["part_start"] + row["before"]), pa.array(sizes),
                     pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    columns = ["before", "part_start", "doc_ids", "doc_tokens", "rules", "rule_lengths", "symbols"]
    return files.join(F.broadcast(offsets), "part").select(*columns).mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def grammar_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the documents' grammars to the shared folder and read them back."""
    path = shared_path(docs.sparkSession, "grammars")
    write_grammars(docs, path, **options)
    return read_grammars(docs.sparkSession, path)
