"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right into the shortest phrases not met before (LZ78).  The set of
phrases is what a compressor would have learned from the text; minimum hashes of that set are the
fingerprint, and the share of equal places of two fingerprints estimates how much of their
dictionaries two texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, functions as F

from pairsieve.functions.values import ref
from pairsieve.llm.common import text_of

PLACES = 64
#: Odd multipliers and offsets of the hash family, from a fixed seed.
_rng = np.random.default_rng(20)
MULTIPLY = _rng.integers(0, 2**63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _rng.integers(0, 2**63, PLACES, np.uint64)
EDITED_SHARE = 4
OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


class Parse:
    """An LZ78 parse that can be continued: phrases in order and the open phrase at the end."""

    def __init__(self, phrases: dict[str, None] | None = None, tail: str = ""):
        self.phrases, self.tail = phrases if phrases is not None else {}, tail

    def feed(self, text: str) -> "Parse":
        seen, phrase = self.phrases, self.tail
        for letter in text:
            phrase += letter
            if phrase not in seen:
                seen[phrase] = None
                phrase = ""
        self.tail = phrase
        return self

    def copy(self) -> "Parse":
        return Parse(self.phrases.copy(), self.tail)


def least_hashes(phrases: list[str]) -> np.ndarray:
    """Per place the least 32-bit hash of the phrases; the largest number when there are none."""
    least = np.full(PLACES, 0xFFFFFFFF, np.uint64)
    for first in range(0, len(phrases), 8192):
        hashes = hash_array(np.array(phrases[first:first + 8192], object), categorize=False)
        places = (hashes[None, :] * MULTIPLY[:, None] + OFFSET[:, None]) >> np.uint64(32)
        least = np.minimum(least, places.min(1))
    return least


def shown(least: np.ndarray) -> str:
    return least.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal places of two fingerprints; two texts without phrases are alike."""
    return float((np.frombuffer(bytes.fromhex(a), ">u2") == np.frombuffer(bytes.fromhex(b), ">u2")).mean())


def fingerprint(text: str) -> str:
    return shown(least_hashes(list(Parse().feed(text).phrases)))


def _rank(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are not above the value, by bisection in the plan."""
    if not bounds:
        return F.lit(0)
    edges, steps = F.array(*[F.lit(b).cast("long") for b in bounds]), [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: F.when((at + s <= len(bounds)) & (F.get(edges, at + s - 1) <= value), at + s).otherwise(at))


def in_order_with_next(docs: DataFrame, text: str, doc_id: str, parts: int) -> DataFrame:
    """Documents dealt to ``part`` by ascending id, each part followed by the next one's first.

    Bounds are quantiles of the ids, hence ids that occur, so the document after a part's last is
    the one that starts the next part; it is sent to both.  Null ids come first, by text hash.
    """
    value = F.coalesce(ref(doc_id).cast("long"), F.xxhash64(text_of(text)))
    given = docs.select(
        ref(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"), value.alias("v"),
        ref(doc_id).isNotNull().alias("named"), F.xxhash64(text_of(text)).alias("tie"))
    keys = docs.select(ref(doc_id).isNotNull().alias("named"), value.alias("v"))
    fractions = F.array(*[F.lit(i / parts) for i in range(1, max(parts, 2))])
    near = {r["named"]: sorted({int(b) for b in r["at"]}) for r in keys.groupBy("named").agg(
        F.percentile_approx("v", fractions, F.lit(10_000)).alias("at")).collect()}
    # quantiles are rounded beyond 53 bits; the least id of each stretch is one that occurs
    stretch = F.when(F.col("named"), _rank(near.get(True, []), F.col("v"))).otherwise(_rank(near.get(False, []), F.col("v")))
    least = keys.groupBy("named", stretch.alias("stretch")).agg(F.min("v").alias("v")).collect()
    nameless, named = (sorted(r["v"] for r in least if r["named"] == kind) for kind in (False, True))
    last = len(nameless) + len(named) - 1
    part = F.when(F.col("named"), F.lit(len(nameless)) + _rank(named, F.col("v"))).otherwise(_rank(nameless, F.col("v"))) - 1
    edges = F.array(*[F.lit(b).cast("long") for b in [*nameless, *named]]) if last >= 0 else F.array(F.lit(0).cast("long"))
    before = F.when(F.col("part") > 0, F.col("part") - 1).otherwise(F.lit(last))
    places = F.when(
        F.get(edges, F.col("part")) == F.col("v"),
        F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("after")), F.struct(before.alias("part"), F.lit(True).alias("after"))),
    ).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("after"))))
    dealt = given.withColumn("part", part.cast("int")).withColumn("place", F.explode(places))
    return (
        dealt.select("place.part", "place.after", "named", "v", "tie", "doc_id", "text")
        .repartition("part").sortWithinPartitions("part", "after", "named", "v", "tie")
        .select("part", "after", "doc_id", "text")
    )


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has the last quarter of the code points (rounded down) replaced by the first
    as many of the next document, by ascending id; the first document follows the last.  Null
    text counts as empty.  Rows with one id follow each other by a hash of their text.
    """
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = None, []
        for batch in batches:
            for part, after, name, body in zip(*[c.to_pylist() for c in batch.columns]):
                if after and (waiting is None or waiting[0] != part):
                    continue  # a further row with the next part's first id
                cut = len(body) - len(body) // EDITED_SHARE
                head = Parse().feed(body[:cut])
                own = head.copy().feed(body[cut:])
                known = least_hashes(list(head.phrases))
                mark = np.minimum(known, least_hashes(list(own.phrases)[len(head.phrases):]))
                if waiting is not None and waiting[0] == part:
                    rows.append(_finish(waiting, body, shown(mark)))
                waiting = None if after else (part, name, body, cut, head, known, shown(mark))
            if rows:
                yield _batch(rows)
                rows = []

    return in_order_with_next(docs, text, doc_id, parts).mapInArrow(scan, OUT)


def _finish(row: tuple, following: str, next_mark: str) -> tuple:
    _, name, body, cut, head, known, mark = row
    new = following[:len(body) - cut]
    count = len(head.phrases)
    edited = shown(np.minimum(known, least_hashes(list(head.feed(new).phrases)[count:])))
    digest = hashlib.sha256((body[:cut] + new).encode()).hexdigest()
    return name, len(body), digest, mark, edited, likeness(mark, edited), likeness(mark, next_mark)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
