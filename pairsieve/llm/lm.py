"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

The predicted vector of a place is the sum of its context words' vectors, each weighted per
position; a word's score is its inner product with the word's output vector plus a bias.  Training
tells true words from noise words drawn from the unigram distribution, so it never sums over the
vocabulary; scoring does, with one matrix product per block of tokens, so probabilities are
normalised.  Every task trains on its own documents from the same start and the parameters are
averaged by a distributed aggregation, once per round.

The model's vocabulary follows the counts: every word seen ``LEAST_COUNT`` times has its own input
and output vector, up to ``MODEL_WORDS`` words, which bounds a task's model to some 40 MB.  All
other words share up to ``RARE`` hashed symbols, each with vectors of its own; such a word has its
symbol's probability times its smoothed share of the symbol's counts.  Symbols lie in classes of
``CLASS`` in order of frequency, classes in groups of ``GROUP``.  A probability is that of the group
times that of the class within it times that of the symbol within the class, so normalising costs
three short matrix products.  Exact counts of all words are kept in a
table: those of the most frequent ones travel to the tasks, the others meet their occurrences by a
shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairsieve.functions.values import ref
from pairsieve.llm.arrow import portions
from pairsieve.llm.common import in_fold, keep
from pairsieve.llm.tokens import split_words

#: The end of a document among the words; no word is empty.
END = ""
#: Words with vectors of their own: those seen so often, and at most so many.
LEAST_COUNT = 4
MODEL_WORDS = 1 << 17
#: Hashed symbols for all other words, symbols per class, and classes per group.
RARE = 4096
CLASS = 96
GROUP = 38
#: Words whose counts are sent to every task: at most so many.
HEAD_WORDS = 1 << 19
CONTEXT = 4
SIZE = 16
NOISE = 32
BATCH = 2048
#: Steps taken on every portion of the texts at least: a small one is gone over more than once.
LEAST_STEPS = 100
ROUNDS = 2
RATE = 0.05
#: Where the sums of squared slopes begin.
SQUARE = 1e-7
BLOCK = 512
#: Tokens that are sorted by class together when they are scored.
SORTED = 1 << 18


def _log_softmax(guess: np.ndarray, table: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log probability of row ``own`` among the rows of a table, for each predicted vector."""
    out, weights = np.empty(len(own)), np.ascontiguousarray(table.T)
    ones = np.ones(len(table), np.float32)
    for first in range(0, len(own), BLOCK):
        part = slice(first, first + BLOCK)
        scores = guess[part] @ weights
        mine, top = scores[np.arange(len(scores)), own[part]].astype(np.float64), 0.0
        with np.errstate(over="ignore"):
            whole = np.exp(scores, out=scores) @ ones
        if not (np.isfinite(whole) & (whole > 0)).all():  # beyond what single precision can hold
            scores = guess[part] @ weights
            top = scores.max(1)
            whole = np.exp(scores - top[:, None]) @ ones
        out[part] = mine - top - np.log(whole.astype(np.float64))
    return out


@dataclass
class Model:
    """Input vectors (symbols, the start), output vectors of symbols, classes and groups, position weights.

    The last number of a predicted vector is always one, so the last of an output vector is a bias.
    """

    inputs: np.ndarray
    outputs: np.ndarray
    classes: np.ndarray
    groups: np.ndarray
    weights: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, seed: int = 7) -> "Model":
        rng, n = np.random.default_rng(seed), len(share)
        draw = lambda last: np.column_stack([rng.normal(0, 0.1, (len(last), SIZE)), last]).astype(np.float32)
        return cls(draw(np.full(n + 1, 1 / CONTEXT)), *[draw(np.log(shares_of(share, size))) for size in LEVELS],
                   np.ones((CONTEXT, SIZE + 1), np.float32))

    def tables(self) -> list[np.ndarray]:
        return [self.inputs, self.outputs, self.classes, self.groups, self.weights]

    def copy(self) -> "Model":
        return Model(*[t.copy() for t in self.tables()])

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        return self.inputs.take(contexts.reshape(-1), axis=0).reshape(len(contexts), -1) @ self.mixing()

    def mixing(self) -> np.ndarray:
        """The position weights as a matrix from the context's vectors, side by side, to their sum."""
        return (np.eye(SIZE + 1, dtype=np.float32) * self.weights[:, None, :]).reshape(-1, SIZE + 1)

    def log_probabilities(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log of the normalised probability of each symbol after its context."""
        order = np.argsort((words // CLASS).astype(np.uint16), kind="stable")
        contexts, words = contexts.take(order, axis=0), words[order]
        guess = np.empty((len(words), SIZE + 1), np.float32)
        for first in range(0, len(words), 1 << 14):
            guess[first:first + (1 << 14)] = self.predicted(contexts[first:first + (1 << 14)])
        sums = _log_softmax(guess, self.groups, words // (CLASS * GROUP))
        for table, size, unit in ((self.classes, CLASS * GROUP, CLASS), (self.outputs, CLASS, 1)):
            cuts = np.flatnonzero(np.diff(words // size, prepend=-1))
            for begin, end in zip(cuts, [*cuts[1:], len(words)]):
                first = int(words[begin]) // size * size // unit
                sums[begin:end] += _log_softmax(guess[begin:end], table[first:first + size // unit], words[begin:end] // unit - first)
        out = np.empty(len(words))
        out[order] = sums
        return out


#: Symbols that one row of each output table stands for.
LEVELS = (1, CLASS, CLASS * GROUP)


def shares_of(share: np.ndarray, size: int) -> np.ndarray:
    """Shares of stretches of ``size`` symbols."""
    return np.add.reduceat(share, np.arange(0, len(share), size))


class Trainer:
    """Noise-contrastive estimation of symbols, classes and groups, with per-parameter step sizes."""

    def __init__(self, model: Model, share: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        shares = [shares_of(share, size) for size in LEVELS]
        self.log_noise = [np.log(s * NOISE).astype(np.float32) for s in shares]
        self.cumulative = [np.cumsum(s) for s in shares]
        self.squares = [np.full(t.shape, SQUARE, np.float32) for t in model.tables()]
        #: How often each row of each table was part of a step.
        self.times = [np.zeros(len(t), np.int64) for t in model.tables()]
        self.place = np.zeros(len(model.inputs), np.int64)
        self.room = np.empty((BATCH, len(LEVELS) * NOISE), np.float32)

    def step(self, contexts: np.ndarray, words: np.ndarray) -> None:
        m = self.m
        given = m.inputs.take(contexts.reshape(-1), axis=0).reshape(len(words), -1)
        mixing = m.mixing()
        guess = given @ mixing
        # noise of all levels at once; the one at the end of a guess takes in the noise's own log
        noises = [np.minimum(np.searchsorted(c, self.rng.random(NOISE)), len(c) - 1) for c in self.cumulative]
        tables = (m.outputs, m.classes, m.groups)
        others = np.concatenate([table[noise] for table, noise in zip(tables, noises)])
        shifted = others.copy()
        shifted[:, SIZE] -= np.concatenate([log[noise] for log, noise in zip(self.log_noise, noises)])
        if len(self.room) < len(words):
            self.room = np.empty((len(words), len(others)), np.float32)
        down = np.matmul(guess, -shifted.T, out=self.room[:len(words)])
        np.exp(np.minimum(down, 30, out=down), out=down)
        np.divide(1, np.add(down, 1, out=down), out=down)
        to_guess, to_others, updates = -(down @ others), -(down.T @ guess), []
        for k, (table, noise, size) in enumerate(zip(tables, noises, LEVELS)):
            mine = words // size
            own = table.take(mine, axis=0)
            true = np.einsum("bd,bd->b", guess, own) - self.log_noise[k][mine]
            up = (1 / (1 + np.exp(np.clip(true, -30, 30))))[:, None]
            to_guess += up * own
            updates.append((k + 1, np.concatenate([mine, noise]), np.concatenate([up * guess, to_others[k * NOISE:(k + 1) * NOISE]])))
        to_guess[:, SIZE] = 0  # the one stays
        updates.append((0, contexts.reshape(-1), (to_guess @ mixing.T).reshape(-1, SIZE + 1)))
        updates.append((4, np.arange(CONTEXT), np.einsum("bcd,bd->cd", given.reshape(-1, CONTEXT, SIZE + 1), to_guess)))
        for k, index, values in updates:
            self._move(k, index, values, len(words))

    def _move(self, k: int, index: np.ndarray, values: np.ndarray, size: int) -> None:
        """One step along the slopes added up by row, over ``size``; other rows are not touched."""
        # one place of each row stands for it, so nothing is sorted
        places = np.arange(len(index))
        self.place[index] = places
        rows = index[self.place[index] == places]
        self.place[rows] = places[:len(rows)]
        at, width = self.place[index], values.shape[1]
        cells = np.arange(len(rows) * width).reshape(-1, width).take(at, axis=0)
        slope = np.bincount(cells.reshape(-1), values.reshape(-1), len(rows) * width)
        slope = (slope / size).astype(np.float32).reshape(-1, width)
        table, squares = self.m.tables()[k], self.squares[k]
        square = squares.take(rows, axis=0) + slope * slope
        moved = table.take(rows, axis=0) + np.float32(RATE) * slope / np.sqrt(square)
        whole_rows(squares)[rows] = whole_rows(square)
        whole_rows(table)[rows] = whole_rows(moved)
        self.times[k][rows] += np.bincount(at, minlength=len(rows))


def whole_rows(table: np.ndarray) -> np.ndarray:
    """The rows of a table as single items, which are put in place several times faster."""
    return table.view(np.dtype((np.void, table.strides[0]))).reshape(-1)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def token_index(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as places among them, and words per text."""
    words, per_text = split_words(lowered(texts))
    index, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary
    empty = pc.equal(names, "").to_numpy(zero_copy_only=False)
    if empty.any():
        real = ~empty[index]
        owner = np.repeat(np.arange(len(per_text)), per_text)
        per_text, index = np.bincount(owner[real], minlength=len(per_text)), index[real]
    return names, index, per_text


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """``word``, ``n`` over all given documents, the end counted once per document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 0):
            names, index, per_text = token_index(batch.column(0))
            n = np.bincount(index, minlength=len(names)).astype(np.int64)
            used = np.flatnonzero(n)
            words = pa.concat_arrays([names.take(pa.array(used)).cast(pa.string()), pa.array([END])])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n[used], len(per_text)))], ["word", "n"])

    local = docs.select(ref(text).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return keep(local.groupBy("word").agg(F.sum("n").alias("n")), "words")


def head_of(counts: DataFrame, most: int) -> tuple[list[str], np.ndarray]:
    """The most frequent words, at most ``most``, down to a count that splits no tie.

    The cut is found on a histogram of logarithmic count bins, so nothing is sorted.
    """
    bin_of = F.floor(F.log2("n") * 64)
    bins = sorted(((r["bin"], r["words"]) for r in counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("words")).collect()), reverse=True)
    taken, cut = 0, None
    for number, words in bins:
        if taken + words > most:
            break
        taken, cut = taken + words, number
    if cut is None:
        return [], np.zeros(0, np.int64)
    rows = counts.filter(bin_of >= cut).toArrow()
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], n[order]


def rare_symbols(words: pa.Array, rare: int) -> np.ndarray:
    """The hashed symbol of each word, as ``rare_mass`` counts them."""
    return np.fromiter(map(zlib.crc32, words.cast(pa.large_binary()).to_pylist()), np.int64, len(words)) % rare


def rare_mass(counts: DataFrame, head: list[str], n: np.ndarray, rare: int) -> np.ndarray:
    """Smoothed count of each hashed symbol: all words without those of the model, and one unseen."""
    mass = np.full(rare, 0.5)
    at = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(rare))
    for row in counts.groupBy(at.alias("at")).agg((F.sum("n") + 0.5 * F.count("*")).alias("mass")).collect():
        mass[row["at"]] += row["mass"]
    return mass - np.bincount(rare_symbols(pa.array(head, pa.string()), rare), n + 0.5, rare)


class Sequences:
    """Model symbols of a batch of texts with their contexts; words beyond the model's are hashed."""

    def __init__(self, texts: pa.Array, head: pa.Array, model_words: int, rare: int):
        names, index, per_text = token_index(texts)
        self.names = names
        # the end is looked up with the words, since each look-up lays out the whole head
        sought = pa.concat_arrays([names.cast(pa.string()), pa.array([END])])
        found = pc.fill_null(pc.index_in(sought, head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        found, end = found[:-1], int(found[-1]) if found[-1] >= 0 else None
        docs = len(per_text)
        self.per_text = per_text + 1
        self.owner = np.repeat(np.arange(docs), self.per_text)
        last = np.cumsum(self.per_text) - 1
        self.is_end = np.zeros(len(self.owner), bool)
        self.is_end[last] = True
        self.word = np.full(len(self.owner), -1, np.int64)  # place among the distinct words
        self.word[~self.is_end] = index
        self.head = np.full(len(self.owner), -1 if end is None else end, np.int64)
        self.head[~self.is_end] = found[index]
        own = (found >= 0) & (found < model_words)
        symbol_of = found.copy()
        symbol_of[~own] = model_words + rare_symbols(names.filter(pa.array(~own)), rare)
        end_symbol = end if end is not None and end < model_words else model_words + rare_symbols(pa.array([END]), rare)[0]
        self.symbol = np.full(len(self.owner), end_symbol, np.int64)
        self.symbol[~self.is_end] = symbol_of[index]
        padded = np.full(len(self.owner) + CONTEXT * docs, model_words + rare, np.int64)
        self.at = np.arange(len(self.owner)) + CONTEXT * (self.owner + 1)
        padded[self.at] = self.symbol
        self.padded = padded

    def contexts(self, part: np.ndarray | slice) -> np.ndarray:
        at = self.at[part]
        return np.stack([self.padded[at - k] for k in range(1, CONTEXT + 1)], 1)


def train(docs: DataFrame, text: str, head: list[str], share: np.ndarray, rounds: int = ROUNDS) -> Model:
    """One pass over the documents, a slice of them per round, from the average of the last round.

    ``head``: the model's words; the other symbols of ``share`` are hashed ones.  Tasks send the
    moves of the rows they touched; a row's moves are averaged over the times it was touched.
    """
    spark, known, rare = docs.sparkSession, len(head), len(share) - len(head)
    model = Model.start(share)
    for number in range(rounds):
        sent = spark.sparkContext.broadcast((model, pa.array(head, pa.string()), share))  # bounded by MODEL_WORDS

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, (start, words, shares) = None, sent.value
            for batch in portions(batches, 0):
                own = own or Trainer(start.copy(), shares, TaskContext.get().partitionId())
                tokens = Sequences(batch.column(0), words, known, rare)
                steps = -(-len(tokens.owner) // BATCH)
                for _ in range(max(1, LEAST_STEPS // max(steps, 1))):
                    order = own.rng.permutation(len(tokens.owner))
                    for first in range(0, len(order), BATCH):
                        part = order[first:first + BATCH]
                        own.step(tokens.contexts(part), tokens.symbol[part])
            if own is not None:
                offset = 0
                for new, old, times in zip(own.m.tables(), start.tables(), own.times):
                    rows = np.flatnonzero(times)
                    moves = (new[rows] - old[rows]) * times[rows, None].astype(np.float32)
                    values = pa.ListArray.from_arrays(
                        pa.array(np.arange(0, moves.size + 1, SIZE + 1, dtype=np.int32)), pa.array(moves.reshape(-1)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows + offset), pa.array(times[rows]), values], ["row", "weight", "values"])
                    offset += len(times)

        mine = docs.filter(F.pmod(F.xxhash64(ref(text)), F.lit(rounds)) == number).select(ref(text).cast("string").alias("text"))
        learned = mine.mapInArrow(learn, "row long, weight long, values array<float>").groupBy("row").agg(
            F.sum("weight").alias("weight"), *[F.sum(F.get("values", F.lit(k))).alias(f"v{k}") for k in range(SIZE + 1)])
        table = learned.select("row", *[(F.col(f"v{k}") / F.col("weight")).alias(f"v{k}") for k in range(SIZE + 1)]).toArrow()
        if table.num_rows:
            rows = np.concatenate(model.tables())
            rows[table.column("row").to_numpy()] += np.stack([table.column(f"v{k}").to_numpy() for k in range(SIZE + 1)], 1).astype(np.float32)
            model = Model(*np.split(rows, np.cumsum([len(t) for t in model.tables()])[:-1]))
        sent.unpersist()
    return model


def score_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", held_out_part: int = 1, parts: int = 5,
    model_words: int = MODEL_WORDS, head_words: int = HEAD_WORDS, rounds: int = ROUNDS,
) -> DataFrame:
    """Scores of all whole texts by a model that learned from those outside the held-out fold.

    Columns: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score``.  Null text is empty: its only token is the end.  A null id counts as empty text in
    the fold.  With nothing to learn from every token has the same probability.
    """
    spark = docs.sparkSession
    held = in_fold(doc_id, parts, held_out_part)
    learning = docs.filter(~held)
    counts = count_words(learning, text)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head, n = head_of(counts, head_words)
    model_words = min(model_words, int((n >= LEAST_COUNT).sum()))
    mass = total + 0.5 * (distinct + 1)
    rare = min(RARE, max(1, distinct - model_words))
    others = rare_mass(counts, head[:model_words], n[:model_words], rare)
    share = np.append(n[:model_words] + 0.5, others)
    share /= share.sum()
    model = train(learning, text, head[:model_words], share, rounds) if total else Model.start(share)
    log_others = np.log10(others)
    sent = spark.sparkContext.broadcast((pa.array(head, pa.string()), n, model))  # bounded by head_words

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n_of, own = sent.value
        for batch in portions(batches, 1):
            tokens = Sequences(batch.column(1), words, model_words, rare)
            docs_in, owner = batch.num_rows, tokens.owner
            guess = np.concatenate([
                own.log_probabilities(tokens.contexts(slice(f, f + SORTED)), tokens.symbol[f:f + SORTED])
                for f in range(0, len(owner), SORTED)]) / np.log(10)
            counted = tokens.head >= 0
            c = np.where(counted, n_of[np.maximum(tokens.head, 0)] if len(n_of) else 0, 0)
            log_c = np.where(counted, np.log10(c + 0.5), 0.0)
            hashed = tokens.symbol >= model_words
            log_shared = log_others[np.maximum(tokens.symbol - model_words, 0)]
            per = lambda v: np.bincount(owner, v, docs_in)
            # words beyond the head: counted per document here, looked up in the counts later
            away = np.flatnonzero(~counted & ~tokens.is_end)
            pairs, times = np.unique(owner[away] * (len(tokens.names) + 1) + tokens.word[away], return_counts=True)
            at = np.bincount(pairs // (len(tokens.names) + 1), minlength=docs_in)
            names = tokens.names.take(pa.array(pairs % (len(tokens.names) + 1))).cast(pa.string())
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(at)]).astype(np.int32)),
                pa.StructArray.from_arrays([names, pa.array(times.astype(np.int64))], ["word", "times"]))
            unseen_end = per((tokens.is_end & ~counted) * 1.0) * np.log10(0.5)  # only when nothing was learned
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(tokens.per_text.astype(np.int64)), pa.array(per(counted * 1.0).astype(np.int64)),
                pa.array(per(log_c) + unseen_end), pa.array(per(guess) + per(hashed * (log_c - log_shared)) + unseen_end), lists,
            ], ["doc_id", "n_tokens", "known_head", "log_c", "log_p", "rest"])

    schema = ("doc_id long, n_tokens long, known_head long, log_c double, log_p double, "
              "rest array<struct<word string, times bigint>>")
    given = docs.select(ref(doc_id).cast("long").alias("doc_id"), ref(text).cast("string").alias("text"))
    scored = keep(given.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    c = F.coalesce(F.col("n"), F.lit(0))
    found = rest.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("rest_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rest_known"))
    rest_log = F.coalesce(F.col("rest_log"), F.lit(0.0))
    return scored.drop("rest").join(found, "row", "left").select(
        "doc_id", in_fold("doc_id", parts, held_out_part).alias("held_out"), "n_tokens",
        (F.col("known_head") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log_c") + rest_log - F.col("n_tokens") * F.lit(float(np.log10(mass)))).alias("base_score"),
        (F.col("log_p") + rest_log).alias("score"),
    )
