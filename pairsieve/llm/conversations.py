"""Repair of conversation structure: cheapest edits that make the roles alternate.

Facts about every row (a digest of role and text, its role's initial, whether it is blank or
truncated) are taken in expressions; texts stay where they are.  Equal rows are summed up before
they are shuffled.  The facts are sorted by conversation and turn over all tasks, and every task
searches the lattices of the conversations it holds.  What begins or ends a task's stretch, and any
conversation of more than ``STRETCH`` rows, is searched in stretches, each from every state to every
state, and put together afterwards: a conversation with a third of all rows is searched by many
tasks.  Last, the repaired text is digested row by row in a stream in which a conversation's edits
come before its rows.  A digest of one text has to be taken in order, so this is the one step that
a single huge conversation cannot spread; it holds one batch of rows and the edits.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairsieve.functions.values import ref
from pairsieve.llm.arrow import portions
from pairsieve.llm.common import join_facts, keep
from pairsieve.llm.lattice import AFTER, FORCED, chain, row_code, transfers, whole

#: Rows of a conversation that are searched at once.
STRETCH = 256
#: Rows of facts per task of the sort.
TASK_ROWS = 200_000
# Fixed values of the contract: kinds of damage, pairs of roles that may follow each other.
DAMAGES = 20
LEGAL = ("su", "ua", "au")
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text``, ``copies`` after damage; nulls of role and text are one space.

    crc32 of ``conv:turn`` (a null there is one space) modulo 20 decides: 0 drops the row (no
    copies), 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    word = lambda c: F.coalesce(ref(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(word(conv), F.lit(":"), word(turn)).cast("binary")) % DAMAGES
    held = rows.select(ref(conv).alias("conv"), ref(turn).cast("long").alias("turn"), word(role).alias("role"), word(text).alias("text"),
                       fate.alias("fate"))
    return held.select(
        "conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _same() -> Column:
    """Digest of conversation, role and text; equal for rows that repeat each other."""
    tag = F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat(F.octet_length(tag), F.lit(":"), tag, F.octet_length("role"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


def row_facts(rows: DataFrame) -> DataFrame:
    """Facts of the damaged rows, equal rows of one turn summed up, and whether their like came before."""
    bare = F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    facts = rows.select(
        "conv", "turn", _same().alias("same"), F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
        ((bare != "") & ~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), "copies")
    groups = keep(facts.groupBy("conv", "turn", "same").agg(
        F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in ("initial", "blank", "cut")]), "facts")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = groups.groupBy("same").agg(F.min(F.when(F.col("copies") > 0, order)).alias("first"), F.count("*").alias("turns"))
    return join_facts(groups, firsts, ["same"], "turns", groups.count()).withColumn(
        "again", F.coalesce(order != F.col("first"), F.lit(False))).drop("first", "turns")


STATS = ("blank", "duplicate", "truncated", "illegal", "turns")


class _Part:
    """What is known of a stretch of one conversation's rows, in order."""

    def __init__(self):
        self.codes, self.first, self.last, self.low, self.high = [], "", "", None, None
        self.stats = dict.fromkeys(STATS, 0)

    def add(self, initial: str, fault: str, turn: int | None) -> None:
        if self.codes:
            self.stats["illegal"] += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        if fault:
            self.stats[fault] += 1
        if turn is not None and turn != self.high:
            self.stats["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.codes.append(row_code(initial, fault in ("blank", "duplicate"), fault == "truncated"))

    def facts(self, entire: bool) -> str:
        codes = "".join(self.codes)
        found = {"answer": whole(codes)} if entire else {"part": transfers(codes)}
        return json.dumps({"first": self.first, "last": self.last, "low": self.low, "high": self.high, "rows": len(codes), **self.stats, **found})


def _searched(stretch: int, schema: pa.Schema):
    """Facts and answers of the conversations in a task's rows (``conv``, ``place``, ``part``, ``facts``)."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, part = None, None, _Part()
        entire, start, number, out = False, 0, 0, []

        def close(ends_here: bool) -> None:
            if last is not None:
                out.append((conv, start, number, part.facts(entire and ends_here)))

        for batch in batches:
            for name, place, turn, initial, blank, cut, again, copies in zip(*(c.to_pylist() for c in batch.columns)):
                torn = last is None or place != last + 1  # rows before this one are elsewhere
                if torn or name != conv:
                    close(not torn)
                    conv, part, entire, start, number = name, _Part(), not torn, place, 0
                last = place
                for k in range(copies):
                    if len(part.codes) >= stretch:
                        entire = False
                        close(False)
                        part, start, number = _Part(), place, number + 1
                    fault = "blank" if blank else "duplicate" if again or k else "truncated" if cut else ""
                    part.add(initial, fault, turn)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out.clear()
        close(False)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return search


def merged(parts: list[dict]) -> dict:
    """One conversation's figures from its stretches, in order."""
    parts = [p for p in parts if p["rows"]]
    total = {name: sum(p[name] for p in parts) for name in STATS}
    turns, low, high = total.pop("turns"), None, None
    total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
    for p in parts:
        if p["low"] is not None:
            turns -= p["low"] == high
            low, high = p["low"] if low is None else low, p["high"]
    if not parts:
        cost, audit = 0, ""
    else:
        cost, audit = parts[0]["answer"] if "answer" in parts[0] else chain([p["part"] for p in parts])
    return {"gaps": 0 if low is None else high - low + 1 - turns, **total, "cost": cost, "audit": audit}


class _Repair:
    """Applies a conversation's edits to its rows, one by one, and digests what comes out."""

    def __init__(self, figures: dict):
        self.figures, self.state, self.at, self.hash, self.begun = figures, 0, 0, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.begun else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.begun = True

    def _force(self, text: str) -> None:
        role = FORCED[self.state]
        self._put(NAMES[role], text)
        self.state = AFTER[role]

    def _insert(self) -> None:
        audit = self.figures["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            self._force("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        letter = self.figures["audit"][self.at]
        self.at += 1
        if letter == "R":
            self._force(text)
        elif letter == "K":
            self._put(role, text)
            self.state = AFTER[role[0]]

    def result(self) -> dict:
        self._insert()
        return {**self.figures, "repaired_sha256": self.hash.hexdigest()}


def _repaired(schema: pa.Schema):
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, parts, repairing, begun = None, [], None, False
        for batch in portions(batches, 3):
            out = []
            for name, kind, role, text, copies, facts in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0 and (not begun or name != conv):
                    if begun:
                        out.append({"conv_id": conv, **(repairing or _Repair(merged(parts))).result()})
                    conv, parts, repairing, begun = name, [], None, True
                if kind == 0:
                    parts.append(json.loads(facts))
                    continue
                if repairing is None:
                    repairing, parts = _Repair(merged(parts)), []
                for _ in range(copies):
                    repairing.row(role, text)
            yield pa.RecordBatch.from_pylist(out, schema)
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, **(repairing or _Repair(merged(parts))).result()}], schema)

    return repair


def repair_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    stretch: int = STRETCH, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """One row per conversation of ``rows`` (before damage): its faults, its cheapest repair and its digest.

    Rows follow their turn, nulls first; rows of one turn follow a digest of role and text, so the
    result does not depend on how they were stored.  A null conversation id is a conversation of its
    own, null role or text is one space.  Equal rows are rows each, and all but the first count as
    duplicates.  A conversation that loses all rows has zeros, an empty audit and the digest of
    nothing.  An empty table gives no rows.  Other columns are not read, so names cannot clash.
    """
    spark = rows.sparkSession
    after = damaged(rows, conv, turn, role, text)
    facts = keep(row_facts(after), "marked")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-facts.count() // task_rows))
    order = ["conv", "turn", "same"]
    ordered = keep(
        facts.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ordered")
    kind = ordered.schema["conv"].dataType
    found = T.StructType([T.StructField("conv", kind), T.StructField("place", T.LongType()), T.StructField("part", T.LongType()),
                          T.StructField("facts", T.StringType())])
    searched = ordered.select("conv", "place", "turn", "initial", "blank", "cut", "again", "copies").mapInArrow(
        _searched(stretch, to_arrow_schema(found)), found)

    stream = searched.withColumn("kind", F.lit(0)).unionByName(
        after.filter("copies > 0").withColumns({"kind": F.lit(1), "same": _same()}), allowMissingColumns=True)
    result = T.StructType([
        T.StructField("conv_id", kind), *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return (
        stream.repartition("conv").sortWithinPartitions("conv", "kind", "place", "part", "turn", "same")
        .select("conv", "kind", "role", "text", "copies", "facts").mapInArrow(_repaired(to_arrow_schema(result)), result))
