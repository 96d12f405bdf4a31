"""Language identification by partial matching (PPM) on bytes.

Every language has a context tree of byte statistics up to three bytes deep, frozen after
training.  A byte costs the bits of its probability in the deepest context that has seen it; each
context that has not pays an escape (its number of distinct successors over its total plus that
number).  Since the cost of a byte is a function of the byte and the three before it, the costs of
all four-byte strings seen in training are laid out once per worker and texts are scored by array
look-ups; any other four-byte string is walked down the trees the first time a batch needs it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from pairsieve.functions.values import ref
from pairsieve.llm.arrow import portions
from pairsieve.llm.common import in_fold

DEPTH = 3
#: The training sample: about this many documents per language, drawn by a hash of the row.
SAMPLE_DOCS = 3000
UNKNOWN = "und"
#: Bits per byte from which on no language is believed: as many as without any model.
NO_FIT_BITS = 8.0
STEP = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class ContextTrees:
    """Per language and context length the sorted (context, byte) keys and their statistics."""

    languages: list[str]
    tables: list[list[tuple[np.ndarray, ...]]] = field(default_factory=list)

    @classmethod
    def from_counts(cls, languages: list[str], language: np.ndarray, gram: np.ndarray, count: np.ndarray) -> "ContextTrees":
        trees = cls(languages)
        for i in range(len(languages)):
            own, n = gram[language == i].astype(np.int64), count[language == i].astype(np.float64)
            levels = []
            for depth in range(DEPTH, -1, -1):
                keys, at = np.unique(own & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
                seen = np.bincount(at, n, len(keys))
                contexts, where, kinds = np.unique(keys >> 8, return_inverse=True, return_counts=True)
                levels.append((keys, seen, contexts, np.bincount(where, seen, len(contexts)), kinds.astype(np.float64)))
            trees.tables.append(levels)
        return trees

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Exact code lengths of the last byte of each four-byte string, one column per language."""
        grams = grams.astype(np.int64)
        out = np.zeros((len(grams), len(self.languages)))
        for i, levels in enumerate(self.tables):
            open_ = np.arange(len(grams))
            for depth, (keys, seen, contexts, totals, kinds) in zip(range(DEPTH, -1, -1), levels):
                if not len(open_) or not len(keys):
                    break
                key = grams[open_] & ((1 << 8 * (depth + 1)) - 1)
                k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                c = np.minimum(np.searchsorted(contexts, key >> 8), len(contexts) - 1)
                known, met = contexts[c] == key >> 8, keys[k] == key
                whole = totals[c] + kinds[c]
                out[open_[met], i] -= np.log2(seen[k[met]] / whole[met])
                escape = known & ~met
                out[open_[escape], i] -= np.log2(kinds[c[escape]] / whole[escape])
                open_ = open_[~met]
            out[open_, i] += 8.0
        return out


class Scorer:
    """Code lengths of whole texts; laid out once per worker."""

    def __init__(self, trees: ContextTrees):
        self.trees = trees
        grams = np.unique(np.concatenate([t[0][0] for t in trees.tables] or [np.zeros(0, np.int64)]))
        self.costs = trees.bits(grams).astype(np.float32)
        self.high, self.low = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        highs, lows = np.unique(grams >> 16), np.unique(grams & 0xFFFF)
        self.high[highs], self.low[lows] = np.arange(1, len(highs) + 1), np.arange(1, len(lows) + 1)
        self.width = len(lows) + 1
        self.place = np.full((len(highs) + 1) * self.width, -1, np.int32)
        self.place[self.high[grams >> 16] * self.width + self.low[grams & 0xFFFF]] = np.arange(len(grams))

    def _costs(self, grams: np.ndarray) -> np.ndarray:
        at = self.place[self.high[grams >> 16] * self.width + self.low[grams & 0xFFFF]]
        costs = self.costs[at] if len(self.costs) else np.zeros((len(grams), len(self.trees.languages)), np.float32)
        strange = np.flatnonzero(at < 0)
        if len(strange):
            rare, back = np.unique(grams[strange], return_inverse=True)
            costs[strange] = self.trees.bits(rare)[back]
        return costs

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of every text under every language, and its bytes."""
        data, begins = bytes_of(texts)
        sizes = np.diff(begins)
        out = np.zeros((len(sizes), len(self.trees.languages)))
        # three empty bytes before each text, so that no context reaches into another one
        padded = np.zeros(len(data) + DEPTH * len(sizes) + DEPTH, np.uint32)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        padded[np.arange(len(data)) + DEPTH * (owner + 1)] = data
        for first in range(0, len(data), STEP):
            mine = owner[first:first + STEP]
            at = np.arange(first, first + len(mine)) + DEPTH * (mine + 1)
            grams = padded[at - 3] << 24 | padded[at - 2] << 16 | padded[at - 1] << 8 | padded[at]
            cuts = np.flatnonzero(np.diff(mine, prepend=-1))
            out[mine[cuts]] += np.add.reduceat(self._costs(grams), cuts, axis=0, dtype=np.float64)
        return out, sizes


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another and where each begins (one more entry)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def train(docs: DataFrame, text: str, doc_id: str, lang: str, sample_docs: int = SAMPLE_DOCS) -> ContextTrees:
    """Context trees from labelled documents; text and language are all that is learned from.

    The sample is bounded: of each language about ``sample_docs`` documents, by a hash of the row.
    What reaches the driver is the four-byte counts of that sample.
    """
    label = ref(lang).cast("string")
    labelled = docs.select(label.alias("lang"), ref(text).cast("string").alias("text"), ref(doc_id).alias("id")).filter(
        "lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    languages = sorted(sizes)
    if not languages:
        return ContextTrees([])
    limit = F.coalesce(*[F.when(F.col("lang") == name, min(1_000_000, 1_000_000 * sample_docs // n + 1)) for name, n in sizes.items()])
    number = F.coalesce(*[F.when(F.col("lang") == name, i) for i, name in enumerate(languages)])
    sample = labelled.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < limit).select(number.alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            data, begins = bytes_of(batch.column(1))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(begins))
            padded = np.zeros(len(data) + DEPTH * batch.num_rows, np.int64)
            at = np.arange(len(data)) + DEPTH * (owner + 1)
            padded[at] = data
            codes = batch.column(0).to_numpy()[owner].astype(np.int64) << 32
            codes |= padded[at - 3] << 24 | padded[at - 2] << 16 | padded[at - 1] << 8 | padded[at]
            keys, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["code", "n"])

    counts = sample.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes, n = (counts.column(i).to_numpy() for i in (0, 1))
    return ContextTrees.from_counts(languages, codes >> 32, codes & 0xFFFFFFFF, n)


_scorers: dict[int, Scorer] = {}


def identify(
    docs: DataFrame, trees: ContextTrees, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: ``doc_id``, ``lang_pred``, ``score``, ``bits_per_byte``, and ``carried`` if asked for.

    The language with the shortest code wins, the first by name in a tie; ``score`` is its share of
    probability among the languages.  Null text, text without letters, and any text when nothing
    was learned are ``und`` with score 0; without bytes ``bits_per_byte`` is null.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(trees)  # bounded by the sample
    struct = T.StructType([f for name in carry for f in docs.schema.fields if f.name == name])
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType()),
        *([T.StructField("carried", struct)] if carry else []),
    ])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if id(known) not in _scorers:
            _scorers.clear()
            _scorers[id(known)] = Scorer(known)
        scorer = _scorers[id(known)]
        names = np.array([*known.languages, UNKNOWN], object)
        for batch in portions(batches, 1):
            texts = batch.column(1)
            bits, sizes = scorer.totals(texts)
            letters = np.array([bool(t) and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            if known.languages:
                best = bits.argmin(1)
                lead = bits - bits[np.arange(len(best)), best][:, None]
                share = 1 / np.exp2(-lead).sum(1)
                rate = bits[np.arange(len(best)), best] / np.maximum(sizes, 1)
            else:
                best, share, rate = np.zeros(len(sizes), int), np.zeros(len(sizes)), np.full(len(sizes), NO_FIT_BITS)
                letters[:] = False
            best, share = np.where(letters, best, len(names) - 1), np.where(letters, share, 0.0)
            columns = [batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(share), pa.array(rate, mask=sizes == 0)]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], schema.fieldNames())

    given = [ref(doc_id).alias("doc_id"), ref(text).cast("string").alias("text")]
    if carry:
        given.append(F.struct(*[ref(c) for c in carry]).alias("carried"))
    return docs.select(*given).mapInArrow(score, schema)


def language_id(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", carry: tuple[str, ...] = (),
    held_out_part: int = 1, parts: int = 3, sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """Learn from the documents outside the held-out fold, then predict all of them.

    ``held_out``: the id's crc32 leaves ``held_out_part``.  A null id counts as empty text there.
    """
    held = in_fold(doc_id, parts, held_out_part)
    trees = train(docs.filter(~held), text, doc_id, lang, sample_docs)
    found = identify(docs, trees, text, doc_id, carry)
    return found.withColumn("held_out", in_fold("doc_id", parts, held_out_part))
