"""Removal of long repeated byte strings, decided on suffix arrays built by linear grouping.

*Candidates.*  Every window of ``LENGTH`` bytes owns the place of its least gram hash (the last
one in a tie); equal windows own it at the same offset.  From each owned place a grid of offsets,
``STEP`` bytes apart, is laid over the windows that own it; the bytes that all windows of a grid
cell share are the cell's core, the bytes they cover together its hull.  A window can only repeat
if its cell's core does.  Cores are counted by hash, summed up in every task before the shuffle, so
neither a frequent passage nor a large group of copies ever meets in one task.

*Settled cells.*  A hull that occurs twice makes all its windows repeat.

*The rest* are cells at the ends of repeated passages: the core repeats, the hull does not.  Cells
of one core differ in at most ``STEP`` bytes on either side.  Written as left bytes, one symbol
for the core, and right bytes, each window of the cell is a suffix's first ``STEP`` + 1 symbols, so
a window repeats exactly if its suffix agrees with a neighbour in the suffix array that far.

*The suffix array* is built by Lyndon grouping: suffixes start in groups by first symbol; groups are
processed from the largest down; each suffix of a group finds its previous smaller suffix by
following pointers, and suffixes found that way move into new groups just above their own.  The
final groups are ordered by Lyndon prefix, and one pass over the array emits the order within each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairsieve.functions.values import ref
from pairsieve.llm.common import keep, maybe_in, text_of
from pairsieve.llm.jaccard import mixed
from pairsieve.llm.langid import bytes_of

LENGTH = 400
GRAM = 32
STEP = 32
#: Cells sorted together, and cells of one core above which they are counted window by window.
CELLS = 4096
MANY_CELLS = 50_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(6).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of a list of numbers by Lyndon grouping; a shorter suffix precedes its extensions."""
    n = len(symbols)
    # groups in a doubly linked list by order; 0 is the empty suffix's
    starts = {s: g + 1 for g, s in enumerate(sorted(set(symbols)))}
    group = [starts[s] for s in symbols] + [0]
    members: list[list[int]] = [[] for _ in range(len(starts) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    above, below = [g + 1 for g in range(len(members))], [g - 1 for g in range(len(members))]
    above[-1] = -1
    smaller = [-2] * (n + 1)  # previous smaller suffix; -2: not yet known
    current = len(members) - 1
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        own.sort()
        members[current] = own
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and smaller[p] != -2:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            moves: dict[tuple[int, int], int] = {}
            order = sorted(times, key=times.__getitem__, reverse=True) if max(times.values()) > 1 else times
            for p in order:
                old, count = group[p], times[p]
                new = moves.get((old, count))
                if new is None:
                    new = moves[old, count] = len(members)
                    members.append([])
                    high = above[old]
                    above.append(high)
                    below.append(old)
                    above[old] = new
                    if high >= 0:
                        below[high] = new
                group[p] = new
                members[new].append(p)
        current = below[current]
    place, at, free = 0, 0, [0] * len(members)
    while at >= 0:
        free[at] = place
        place += len(members[at])
        at = above[at]
    out = [-1] * (n + 1)
    out[0] = n
    placed = [False] * (n + 1)
    placed[n] = True
    for k in range(n + 1):
        s = out[k] - 1
        while s >= 0 and not placed[s]:
            placed[s] = True
            out[free[group[s]]] = s
            free[group[s]] += 1
            s = smaller[s]
    return out[1:]


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


class Hashes:
    """Polynomial hashes modulo 2**64 of any stretch of a text, the same wherever it stands."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[data] * _powers(_BASE, len(data) + 1)[:-1], out=self.sums[1:])
        self.back = _powers(_INVERSE, len(data) + 1)

    def of(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[begin + size] - self.sums[begin]) * self.back[begin])

    def all_of(self, size: int) -> np.ndarray:
        count = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:count]) * self.back[:count])


class Cells:
    """Grid cells of a text: owned place, first window offset, and the windows in the text."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        windows = self.size - LENGTH + 1
        if windows <= 0:
            self.first = self.last = self.begin = np.zeros(0, np.int64)
            return
        self.hashes = Hashes(data)
        owner = _least_places(self.hashes.all_of(GRAM), LENGTH - GRAM + 1)
        # window s has the offset owner - s; cells cut the offsets at multiples of STEP
        starts = np.arange(windows)
        cell = (owner - starts) // STEP
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(cell) != 0)]))
        self.first = cut  # first window of each cell that is in the text and owns the place
        self.last = np.append(cut[1:], windows) - 1
        self.begin = owner[cut] - cell[cut] * STEP - STEP + 1  # of the first window the cell may have

    def core(self) -> np.ndarray:
        """Hashes of what all windows of a cell share: from its last start to its first end."""
        return self.hashes.of(self.begin + STEP - 1, LENGTH - STEP + 1).view(np.int64)

    def hull(self) -> np.ndarray:
        """Hashes of what the cell's windows cover, and of which windows these are."""
        spread = (self.first - self.begin) * STEP + self.last - self.begin
        own = self.hashes.of(self.first, self.last + LENGTH - self.first)
        return mixed(own ^ mixed(spread.astype(np.uint64) + np.uint64(1))).view(np.int64)


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the last least value in every run of ``width`` values, by their upper 43 bits."""
    out, piece = np.empty(len(values) - width + 1, np.int64), 1 << 20
    for base in range(0, len(out), piece):
        part = values[base:base + piece + width - 1]
        packed = (part >> np.uint64(21) << np.uint64(21)) | (np.uint64(2 * piece - 1) - np.arange(len(part), dtype=np.uint64))
        # doubling: least of runs of length 2**k, then two overlapping runs cover the width
        length = 1
        while length * 2 <= width:
            packed = np.minimum(packed[:-length], packed[length:])
            length *= 2
        least = np.minimum(packed[:len(part) - width + 1], packed[width - length:])
        out[base:base + piece] = base + (2 * piece - 1) - (least & np.uint64(2 * piece - 1)).astype(np.int64)
    return out


def _key(text: str, doc_id: str) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(ref(doc_id).cast("string"), F.lit("")), F.lit(":"), text_of(text))))


def _texts_of(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    data, begins = bytes_of(batch.column(column))
    for i in range(batch.num_rows):
        yield data[begins[i]:begins[i + 1]]


def _core_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text the cores and hulls of its cells."""
    for batch in batches:
        cores, hulls, sizes = [], [], []
        for data in _texts_of(batch, 1):
            cells = Cells(data)
            if len(cells.first):
                cores.append(cells.core())
                hulls.append(cells.hull())
            sizes.append(len(cells.first))
        ends = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
        join = lambda parts: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), join(cores), join(hulls)], ["key", "cores", "hulls"])


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For open cells: core, left and right bytes, and where the cell is."""
    for batch in batches:
        keys, cores, places, lefts, rights, lows, highs = [], [], [], [], [], [], []
        opened = batch.column(2).to_pylist()
        for i, data in enumerate(_texts_of(batch, 1)):
            cells, raw = Cells(data), data.tobytes()
            core = cells.core()
            for c in opened[i]:
                first, last, begin = int(cells.first[c]), int(cells.last[c]), int(cells.begin[c])
                keys.append(batch.column(0)[i].as_py())
                cores.append(int(core[c]))
                places.append(c)
                lefts.append(raw[first:begin + STEP - 1])
                rights.append(raw[begin + LENGTH:last + LENGTH])
                lows.append(first - begin)
                highs.append(last - begin)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cores, pa.int64()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), pa.array(lows, pa.int32()),
             pa.array(highs, pa.int32()), pa.array(keys, pa.binary()), pa.array(places, pa.int32())],
            ["core", "left", "right", "low", "high", "key", "cell"])


def repeated_windows(cores: list[int], lefts: list[bytes], rights: list[bytes], lows: list[int], highs: list[int]) -> list[int]:
    """Per cell a bit mask of its windows (by start, from the cell's first) that another cell has too.

    A window that starts j bytes into the cell is left[j:], the core, and the first j of the right
    bytes: ``STEP`` symbols of a suffix.  Missing bytes at a text's end are symbols of their own.
    """
    names = {c: 256 + k for k, c in enumerate(dict.fromkeys(cores))}
    lone = 256 + len(names)
    symbols, origin = [], []
    for i, core in enumerate(cores):
        missing = STEP - 1 - len(lefts[i])
        left = [lone + k for k in range(missing)] + list(lefts[i])
        lone += missing
        right = list(rights[i])
        gap = STEP - 1 - len(right)
        right += [lone + k for k in range(gap + 1)]  # and one that ends the cell
        lone += gap + 1
        symbols += [*left, names[core], *right]
        origin += [(i, j) for j in range(STEP)] + [(i, -1)] * STEP
    order = np.array(suffix_array(symbols))
    flat = np.array(symbols)
    starts = np.array([j for _, j in origin])
    order = order[starts[order] >= 0]
    rows = flat[order[:, None] + np.arange(STEP)]
    equal = (rows[1:] == rows[:-1]).all(1)
    twice = np.zeros(len(order), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    masks = [0] * len(cores)
    for at in order[twice].tolist():
        i, j = origin[at]
        if lows[i] <= j <= highs[i]:
            masks[i] |= 1 << j
    return masks


def _sorted_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over the cells of a partition, some cores at a time, each core whole."""
    def decided(rows):
        cores, lefts, rights, lows, highs, keys, cells = zip(*rows)
        masks = repeated_windows(cores, lefts, rights, lows, highs)
        found = [(k, c, m) for k, c, m in zip(keys, cells, masks) if m]
        ks, cs, ms = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(cs, pa.int32()), pa.array(ms, pa.int64())], ["key", "cell", "mask"])

    waiting: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if len(waiting) >= CELLS and row[0] != waiting[-1][0]:
                yield decided(waiting)
                waiting = []
            waiting.append(row)
    if waiting:
        yield decided(waiting)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For cells of a very frequent core: the bytes of each window beside the core."""
    for batch in batches:
        cores, windows, bits, keys, cells = [], [], [], [], []
        for core, left, right, low, high, key, cell in zip(*[c.to_pylist() for c in batch.columns]):
            for j in range(low, high + 1):
                cores.append(core)
                windows.append(bytes([j]) + left[j - low:] + right[:j])
                bits.append(1 << j)
                keys.append(key)
                cells.append(cell)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cores, pa.int64()), pa.array(windows, pa.binary()), pa.array(bits, pa.int64()), pa.array(keys, pa.binary()),
             pa.array(cells, pa.int32())], ["core", "window", "bit", "key", "cell"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes, removed bytes, removed runs and the digest of what is kept."""
    for batch in batches:
        keys, out = batch.column(0).to_pylist(), []
        for i, (data, settled, edges) in enumerate(zip(_texts_of(batch, 1), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            cells = Cells(data)
            change = np.zeros(len(data) + 1, np.int64)
            for c in settled or []:
                change[cells.first[c]] += 1
                change[cells.last[c] + LENGTH] -= 1
            for e in edges or []:
                for j in range(STEP):
                    if e["mask"] >> j & 1:
                        start = int(cells.begin[e["cell"]]) + j
                        change[start] += 1
                        change[start + LENGTH] -= 1
            gone = np.cumsum(change[:-1]) > 0
            runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            out.append((int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        removed, spans, digests = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
            ["key", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too, in this
    text or another one.  Null text counts as empty; rows that agree in id and text count as two
    places.  Texts shorter than ``LENGTH`` keep all.
    """
    given = docs.select(_key(text, doc_id).alias("key"), text_of(text).alias("text"))
    rows = given.mapInArrow(_core_rows, "key binary, cores array<long>, hulls array<long>").select(
        "key", F.posexplode(F.arrays_zip("cores", "hulls")).alias("cell", "c")).select(
        "key", "cell", F.col("c.cores").alias("core"), F.col("c.hulls").alias("hull"))
    repeated = keep(rows.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1"), "cores")
    hits = keep(maybe_in(rows, repeated, "core").join(repeated, "core").drop("n"), "hits")
    hulls = keep(hits.groupBy("core", "hull").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "cell")).alias("rep")), "hulls")
    settled = hits.join(hulls.filter("n > 1").select("core", "hull"), ["core", "hull"]).select("key", "cell").distinct()
    # one cell of every hull where some hull of the core stands alone
    mixed_cores = hulls.groupBy("core").agg(F.min("n").alias("least")).filter("least = 1").select("core")
    compared = keep(hulls.join(mixed_cores, "core").select("rep.key", "rep.cell", "n"), "compared")
    open_ = compared.groupBy("key").agg(F.collect_list("cell").alias("cells"))
    settled_of = keep(settled.groupBy("key").agg(F.collect_list("cell").alias("settled")), "settled")
    marked = settled_of.select("key").unionByName(open_.select("key"))
    keys = marked.select("key").distinct()
    texts = keep(maybe_in(given, keys, "key").groupBy("key", "text").agg(F.lit(1).alias("one")).drop("one").join(keys, "key", "left_semi"), "texts")
    edges = keep(
        texts.join(open_, "key").select("key", "text", "cells").mapInArrow(
            _edge_rows, "core long, left binary, right binary, low int, high int, key binary, cell int"), "edges")
    many = edges.groupBy("core").agg(F.count("*").alias("n")).filter(F.col("n") > MANY_CELLS)
    few = edges.join(many, "core", "left_anti").repartition("core").sortWithinPartitions("core")
    by_suffix = few.mapInArrow(_sorted_cells, "key binary, cell int, mask long")
    windows = edges.join(many.select("core"), "core", "left_semi").mapInArrow(
        _window_rows, "core long, window binary, bit long, key binary, cell int")
    twice = windows.groupBy("core", "window").agg(F.count("*").alias("n")).filter("n > 1").select("core", "window")
    by_count = windows.join(twice, ["core", "window"]).groupBy("key", "cell").agg(F.bit_or("bit").alias("mask"))
    masks = keep(by_suffix.unionByName(by_count), "masks")

    partly = masks.groupBy("key").agg(F.collect_list(F.struct("cell", "mask")).alias("edges"))
    changed = keep(
        texts.join(settled_of, "key", "left").join(partly, "key", "left").filter("settled IS NOT NULL OR edges IS NOT NULL")
        .select("key", "text", "settled", "edges")
        .mapInArrow(_cut, "key binary, n_removed long, n_spans long, kept_sha256 string"), "changed")
    all_rows = docs.select(
        ref(doc_id).alias("doc_id"), _key(text, doc_id).alias("key"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"),
        F.sha2(text_of(text), 256).alias("whole"))
    return all_rows.join(changed, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
