"""Secret scan in DataFrame operations only: patterns, and sliding-window entropy beside them.

Positions come from cutting the text at its matches: what lies between them and the matches
themselves, added up, give every start.  Candidate strings for the entropy scan are maximal runs
of one character class; a window moves over each, its symbol counts and the sum of c log c are
updated by the symbol that enters and the one that leaves.  A window of high entropy counts unless
it holds a string of the allow-list or touches a base span; windows that overlap make one span.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pairsieve.functions.values import ref
from pairsieve.llm.common import text_of

# Fixed patterns of the base kinds, in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class CharacterClass:
    """A class of candidate strings: its alphabet, the run it forms, what a run must hold."""

    kind: str
    alphabet: str
    run: str
    holds: tuple[str, ...]
    window: int
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", "0123456789abcdef", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])",
                   ("[0-9]", "[A-Fa-f]"), 20, 3.0),
    CharacterClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
                   r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", ("[0-9]", "[a-z]", "[A-Z]"), 24, 4.0),
)
#: Strings that are known not to be secrets: samples, placeholders, and runs in order.
ALLOWED = r"(?i)example|sample|placeholder|dummy|your_|xxxx|0123456789|abcdefgh"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_ends(steps: Column) -> Column:
    """Running totals of an int array, block by block so that long arrays stay cheap."""
    def within(start: Column, block: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("ends"))
        move = lambda s, x: F.struct((s.at + x).alias("at"), F.array_append(s.ends, s.at + x).alias("ends"))
        return F.aggregate(block, state, move, lambda s: s.ends)

    def by_block(all_steps: Column) -> Column:
        count = F.ceil(F.size(all_steps) / F.lit(BLOCK)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(all_steps, b * BLOCK + 1, F.lit(BLOCK)))
        sums = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        starts = lambda bs: F.concat(F.array(F.lit(0)), within(F.lit(0), sums(bs)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(
            starts(bs), bs, lambda s, b: F.when(b.isNull(), F.array().cast("array<int>")).otherwise(within(s, b)))))

    return let(steps, lambda s: F.when(F.size(s) > 0, by_block(s)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """(start, end, value) of all matches in code points; ``keep`` sees the group's text.

    Texts without a match cost one search.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    kind = "array<struct<start:int,end:int,value:string>>"

    def places(matches: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        ends = running_ends(F.zip_with(between, matches, lambda b, m: F.length(b) + F.length(m)))
        return F.transform(
            F.arrays_zip(matches.alias("m"), ends.alias("e"), groups.alias("g")),
            lambda z: F.struct((z["e"] - F.length(z["m"])).alias("start"), z["e"].alias("end"), z["g"].alias("value")))

    spans_of = let(found, places)
    if keep is not None:
        spans_of = F.filter(spans_of, lambda s: keep(s["value"]))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans_of.cast(kind)).otherwise(F.array().cast(kind))


SPANS = "array<struct<start:int,end:int>>"


def hot_stretches(value: Column, cls: CharacterClass, allowed: Column, taken: Column) -> Column:
    """(start, end) of what windows of high entropy cover in the string.

    ``allowed`` are the places of strings known not to be secrets, ``taken`` places found already,
    both within the string: no window may hold one of the former or touch one of the latter.
    """
    size = cls.window
    log = lambda c: c * F.log2(F.greatest(c, F.lit(1)))
    text = F.lower(value) if cls.kind == "entropy_hex" else value
    count = len(cls.alphabet)

    def scan(symbols: Column) -> Column:
        leaving = F.concat(F.array_repeat(F.lit(-1), size), symbols)
        moves = F.slice(F.zip_with(symbols, leaving, lambda a, b: F.struct(a.alias("new"), b.alias("old"))), F.lit(1), F.size(symbols))
        start = F.struct(
            F.array_repeat(F.lit(0), count).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

        def move(s: Column, x: Column) -> Column:
            enter = F.get(s["counts"], x["new"])
            left = F.when(x["old"] >= 0, F.get(s["counts"], x["old"]) + F.when(x["new"] == x["old"], 1).otherwise(0))
            total = s["sum"] + log(enter + 1) - log(enter) + F.coalesce(log(left - 1) - log(left), F.lit(0.0))
            counts = F.transform(s["counts"], lambda c, k: c + F.when(k == x["new"], 1).otherwise(0) - F.when(k == x["old"], 1).otherwise(0))
            at = s["at"] + 1

            def close(t: Column) -> Column:
                high = (at >= size) & (F.lit(math.log2(size)) - t / size >= cls.bits - 1e-9)
                known = F.exists(allowed, lambda m: (m["start"] >= at - size) & (m["end"] <= at))
                found = F.exists(taken, lambda b: (b["start"] < at) & (b["end"] > at - size))
                last = F.element_at(s["found"], -1)
                goes_on = (F.size(s["found"]) > 0) & (F.get(s["found"], F.size(s["found"]) - 1)["end"] >= at - size)
                grown = F.when(goes_on, F.concat(
                    F.slice(s["found"], F.lit(1), F.greatest(F.size(s["found"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), at.alias("end"))))
                ).otherwise(F.concat(s["found"], F.array(F.struct((at - size).alias("start"), at.alias("end")))))
                return F.struct(counts.alias("counts"), t.alias("sum"), at.alias("at"),
                                F.when(high & ~known & ~found, grown).otherwise(s["found"]).cast(SPANS).alias("found"))

            return let(total, close)

        return F.aggregate(moves, start, move, lambda s: s["found"])

    return let(F.transform(F.split(text, "", -1), lambda c: F.position(c, F.lit(cls.alphabet)) - 1), scan)


def entropy_spans(text: Column, cls: CharacterClass, base: Column, allowed: str = ALLOWED) -> Column:
    """(start, end) of high-entropy stretches in the class's candidate strings, clear of the base spans."""
    def wanted(value: Column) -> Column:
        ok = F.lit(True)
        for need in cls.holds:
            ok = ok & F.regexp_like(value, F.lit(need))
        return ok

    def stretches(s: Column) -> Column:
        inside = F.transform(F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
                             lambda b: F.struct((b["start"] - s["start"]).alias("start"), (b["end"] - s["start"]).alias("end")))
        hot = let(F.struct(spans(s["value"], allowed).alias("allowed"), inside.alias("taken")),
                  lambda known: hot_stretches(s["value"], cls, known["allowed"], known["taken"]))
        return F.transform(hot, lambda h: F.struct((s["start"] + h["start"]).alias("start"), (s["start"] + h["end"]).alias("end")))

    return F.flatten(F.transform(spans(text, cls.run, wanted), stretches))


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", allowed: str = ALLOWED) -> DataFrame:
    """One row per row of ``docs``: ids, counts, the digest of the base spans, and all spans.

    Spans are kind:start:end in code points with an exclusive end, by start, then by the order of
    kinds, comma-joined.  Entropy spans never touch a base span.  Null or empty text has none, a
    null id stays null, repeated rows are scanned one by one, an empty table gives no rows, and
    other columns are not read.  A very long text is scanned whole, in one task: matches are
    placed by running totals in blocks, windows by one pass.
    """
    def ranked(of: Column, name: str, rank: int) -> Column:
        return F.transform(of, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind")))

    def found(t: Column) -> Column:
        kinds = F.struct(spans(t, ASSIGN, lambda v: F.length(v) >= ASSIGN_VALUE, 2).alias("assign"), spans(t, ACCESS).alias("access"), spans(t, HEX).alias("hex"))
        return let(kinds, lambda k: let(
            F.array_sort(F.concat(*[ranked(k[name], name, i) for i, name in enumerate(("assign", "access", "hex"))])),
            lambda base: F.struct(
                *[F.size(k[name]).cast("long").alias(f"n_{name}") for name in ("assign", "access", "hex")], base.alias("base"),
                F.concat(*[ranked(entropy_spans(t, c, base, allowed), c.kind, 3 + i) for i, c in enumerate(CLASSES)]).alias("added"))))

    frame = docs.select(ref(doc_id).alias("doc_id"), let(text_of(text), found).alias("found"))
    joined = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return frame.select(
        "doc_id", "found.n_assign", "found.n_access", "found.n_hex", F.sha2(joined(F.col("found.base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("found.base", "found.added"))).alias("spans"))
