"""N-gram Jaccard join of all documents by prefix trees.

*Candidates.*  All sets follow one global order of their shingles.  Shingles whose hash falls into
the counted region and that few documents hold come first, by document frequency.  Most sets have
enough of them.  The others, small ones and those that mostly consist of passages seen elsewhere,
go on with their other shingles by how many of these sets hold them, so what is common comes last.
Two sets above the threshold share a shingle among their first ones (the prefix filter); most
documents have none in common with others and drop out.

*Leaders.*  Every candidate is first compared with one leader, the least document of the prefix
shingle groups it shares most often.  Large groups of near copies become one component here, at
one comparison each.

*The rest.*  Prefix shingles whose documents already are in one component are settled.  Documents of
different components that meet on an unsettled one are paired where few do; since everything beyond
the shorter prefix cannot make up for it, a pair must share a certain number of prefix shingles, and
most pairs fall there.  Where many meet, every shingle is a group of its own.  The first shingle
that two near sets share lies in the even shorter index prefix of the smaller one, so the group's
index sets are met by its other sets of like size only, in cells bounded by rows and shingles.
There only sets of different components are compared, and a link joins two of them.

*Comparison.*  A task stores the sets of its group in a path-compressed trie, most frequent
shingles first, so that near copies share their paths.  A query set walks down once: overlaps
counted on a shared path serve all sets below it, and a subtree is cut as soon as the shingles that
remain cannot bring any of its sets to the threshold.  The result at a leaf is the exact Jaccard
comparison of the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, functions as F

from pairsieve.functions.values import ref
from pairsieve.llm.arrow import portions
from pairsieve.llm.common import HOT_SHARE, join_facts, keep, maybe_in, not_in_filter, scratch, text_of
from pairsieve.llm.components import components
from pairsieve.llm.lm import token_index

WORDS = 5
PERCENT = 80
#: Share of the hash space whose shingles are counted; a prefix needs about a fifth of a set.
REGION = 0.3
#: Sets of so many shingles hand out all of them at once.
SMALL = 128
#: Members compared with one copy of their leader, and sets per side of a cell.
GROUP = 512
CELL = 1024
#: Shingles per side of a place, on average, whatever the number of sets.
CELL_SHINGLES = 1 << 18
#: Bytes of text that are shingled at once.
TEXT_BYTES = 1 << 20
#: Documents on one prefix shingle up to which they are paired, and up to which it comes first.
FEW = 64
_FACTORS = np.random.default_rng(8).integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its word shingles.

    Fewer words than a shingle count as one shingle; no words give an empty set.
    """
    names, index, per_text = token_index(texts)
    hashes = hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(names) else np.zeros(0, np.uint64)
    words = hashes[index]
    count = max(len(words) - width + 1, 0)
    rolled = np.zeros(count, np.uint64)
    for k in range(width):
        rolled += words[k:k + count] * _FACTORS[k]
    rolled = mixed(rolled).view(np.int64)
    out, begin = [], 0
    for n in per_text.tolist():
        if n >= width:
            out.append(np.unique(rolled[begin:begin + n - width + 1]))
        elif n:
            short = (words[begin:begin + n] * _FACTORS[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mixed(np.array([short], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        begin += n
    return out


class Trie:
    """Sets of ranks in a path-compressed prefix tree."""

    class Node:
        __slots__ = ("path", "kids", "ends", "low", "high", "side")

        def __init__(self, path: np.ndarray, low: int, high: int, side: int | None):
            self.path, self.kids, self.ends, self.low, self.high, self.side = path, {}, [], low, high, side

    def __init__(self):
        self.root = Trie.Node(np.zeros(0, np.int64), 1 << 60, 0, None)

    def add(self, ranks: np.ndarray, name: int, side: int) -> None:
        """Store a set; ``side`` tells its component.  A node keeps the side of all below it, or None."""
        size, node, rest = len(ranks), self.root, ranks
        node.side = side if not node.high or node.side == side else None
        node.low, node.high = min(node.low, size), max(node.high, size)
        while len(rest):
            kid = node.kids.get(first := int(rest[0]))
            if kid is None:
                kid = node.kids[first] = Trie.Node(rest, size, size, side)
                kid.ends.append(name)
                return
            common = min(len(rest), len(kid.path))
            apart = np.flatnonzero(rest[:common] != kid.path[:common])
            same = int(apart[0]) if len(apart) else common
            if same < len(kid.path):
                upper = Trie.Node(kid.path[:same], kid.low, kid.high, kid.side)
                kid.path = kid.path[same:]
                upper.kids[int(kid.path[0])] = kid
                node.kids[first] = kid = upper
            kid.low, kid.high = min(kid.low, size), max(kid.high, size)
            kid.side = side if kid.side == side else None
            node, rest = kid, rest[same:]
        node.ends.append(name)

    def near(self, query: np.ndarray, held: np.ndarray, percent: int = PERCENT, settled: Callable[[int], bool] | None = None) -> list[int]:
        """Names of the sets whose Jaccard similarity with the query reaches the percentage.

        ``held``: by rank, whether the query has it.  Subtrees of one ``settled`` side are left out.
        """
        size, found, stack = len(query), [], [(self.root, 0, 0)]
        while stack:
            node, seen, depth = stack.pop()
            if settled is not None and node.side is not None and settled(node.side):
                continue
            if len(node.path):
                seen += int(np.count_nonzero(held[node.path]))
                depth += len(node.path)
                left = size - int(np.searchsorted(query, node.path[-1], "right"))
                # the least overlap that any set below needs grows with its size
                least = -(-percent * (size + node.low) // (100 + percent))
                if seen + min(left, node.high - depth) < least:
                    continue
            if node.ends and 100 * seen >= percent * (size + depth - seen):
                found += node.ends
            stack += [(kid, seen, depth) for kid in node.kids.values()]
        return found


def ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets as sorted ranks in one order of their shingles, most frequent first."""
    if not sets:
        return [], 0
    tokens, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    flat, cuts = rank[at], np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(part) for part in np.split(flat, cuts)], len(tokens)


def links_between(
    stored: list[np.ndarray], stored_sides: list[int], asking: list[np.ndarray], asking_sides: list[int], percent: int = PERCENT,
) -> list[tuple[int, int]]:
    """Links (place among the asking, place among the stored) that join the sides as their similarities do.

    Sets of one side are joined already.  A link is only given out where it joins two sides, so
    there are fewer links than sides; what a query is joined with by then is not looked at again.
    """
    if len({*stored_sides, *asking_sides}) < 2:
        return []
    ranks, width = ranked([*stored, *asking])
    trie, links, parent = Trie(), [], {}

    def root(side: int) -> int:
        while (up := parent.get(side, side)) != side:
            parent[side] = side = parent.get(up, up)
        return side

    for name, (own, side) in enumerate(zip(ranks, stored_sides)):
        trie.add(own, name, side)
    held = np.zeros(width, bool)
    for name, (own, side) in enumerate(zip(ranks[len(stored):], asking_sides)):
        held[own] = True
        mine = root(side)
        for other in trie.near(own, held, percent, lambda s: root(s) == mine):
            theirs = root(stored_sides[other])
            if theirs != mine:
                links.append((name, other))
                parent[theirs] = mine
        held[own] = False
    return links


EDGE = -(2**63) + int(REGION * 2**64)


def _shingled(docs: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """Per document its set's size and digest, and once per task and set the shingles of the
    region, or all of them if the set is small."""
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in portions(batches, 1, TEXT_BYTES):
            sizes, digests, lists = [], [], []
            for own in shingle_sets(batch.column(1), width):
                sizes.append(len(own))
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                digests.append(digest)
                if digest is None or digest in met:
                    lists.append(None)
                    continue
                met.add(digest)
                lists.append(own if len(own) <= SMALL else own[:int(np.searchsorted(own, np.int64(EDGE)))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), batch.column(2), _list_array(lists)],
                ["doc_id", "n", "digest", "key", "tokens"])

    given = docs.select(ref(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"), _text_key(text).alias("key"))
    out = given.mapInArrow(shingle, "doc_id long, n long, digest binary, key binary, tokens array<long>")
    return keep(out.withColumn("row", F.monotonically_increasing_id()), "shingled")


def _list_array(lists: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0] + [0 if x is None else len(x) for x in lists]).astype(np.int32)
    flat = np.concatenate([x for x in lists if x is not None] or [np.zeros(0, np.int64)])
    absent = np.array([*(x is None for x in lists), False])
    return pa.ListArray.from_arrays(pa.array(ends, mask=absent), pa.array(flat))


def _text_key(text: str) -> Column:
    return F.unhex(F.md5(text_of(text).cast("binary")))


def _sets_of(docs: DataFrame, text: str, keys: DataFrame, width: int, name: str) -> DataFrame:
    """``key``, ``tokens`` (the whole set) of the documents with the keys, one row per text.

    A filter holds most other texts back before the shuffle; the join after it is exact.
    """
    passed = maybe_in(docs.select(text_of(text).alias("text"), _text_key(text).alias("key")), keys, "key")
    texts = passed.groupBy("key", "text").agg(F.lit(1).alias("one")).drop("one").join(keys, "key", "left_semi")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1, TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), _list_array(shingle_sets(batch.column(1), width))], ["key", "tokens"])

    return keep(texts.select("key", "text").mapInArrow(shingle, "key binary, tokens array<long>"), name)


def _compare(sets: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) between the asking and the stored sets of each place.

    ``places``: ``key``, ``node``, ``side``, ``stored``, ``place``.  They are bounded by their
    makers, and a task works on one at a time.
    """
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["node", "stored"])
        stored, asking = group[group["stored"]], group[~group["stored"]]
        found = links_between(
            stored["tokens"].tolist(), stored["side"].tolist(), asking["tokens"].tolist(), asking["side"].tolist(), percent)
        a, b = asking["node"].to_numpy(), stored["node"].to_numpy()
        return pd.DataFrame({"a": [a[i] for i, _ in found], "b": [b[j] for _, j in found]}, dtype="int64")

    return keep(sets.join(places, "key").select("place", "node", "side", "stored", "tokens").groupBy("place").applyInPandas(
        compare, "a long, b long"), "links")


def _meet(rows: DataFrame, facts: DataFrame, weight: str, total: int) -> DataFrame:
    """Inner join on ``token`` with one row per shingle; shingles with a large share of the rows stay put.

    A shingle is hot with more than one row in ``HOT_SHARE``, so there are fewer hot ones than that.
    """
    hot = [r["token"] for r in facts.filter(F.col(weight) * HOT_SHARE > total).select("token").take(HOT_SHARE)]
    if not hot:
        return rows.join(facts, "token")
    is_hot = F.col("token").isin(hot)
    return rows.filter(is_hot).join(F.broadcast(facts.filter(is_hot)), "token").unionByName(
        rows.filter(~is_hot).join(facts.filter(~is_hot), "token"))


def _listed(rows: DataFrame, facts: DataFrame, total: int, order: Column) -> DataFrame:
    """Per row its shingles that others hold as well, in order, as ``hits``."""
    return _meet(rows, facts, "df", total).groupBy("row").agg(F.array_sort(F.collect_list(order)).alias("hits"))


def _prefixes(docs: DataFrame, shingled: DataFrame, same: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """``node``, ``n``, ``key``, ``token``, ``index``: the first shingles of every set that other sets hold too.

    ``index``: the shingle is among those of which a larger or equal near set holds one.  Shingles
    that no other set holds come first in their class; they only take up room.
    """
    nodes = keep(shingled.filter("tokens IS NOT NULL").join(same.select(F.col("node").alias("row")), "row", "left_semi").select(
        "row", "n", "key", "tokens", F.size(F.filter("tokens", lambda t: t < EDGE)).alias("counted")), "nodes")
    counted = nodes.select("row", F.explode("tokens").alias("token")).filter(F.col("token") < EDGE)
    total = nodes.agg(F.coalesce(F.sum("counted"), F.lit(0))).first()[0]
    frequent = keep(counted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "frequent")
    hits = nodes.join(_listed(counted, frequent, total, F.struct("df", "token")), "row", "left").withColumn(
        "hits", F.coalesce("hits", F.array().cast("array<struct<df:bigint,token:bigint>>")))
    # rare: shared by few; first: how many first ones are asked for; own: how many nobody else has
    rare = F.filter("hits", lambda h: h["df"] <= FEW)
    marked = keep(hits.select(
        "row", "n", "key", rare.alias("rare"), F.transform(F.filter("hits", lambda h: h["df"] > FEW), lambda h: h["token"]).alias("common"),
        F.when((F.col("n") <= SMALL) & (F.col("counted") - F.size("hits") + F.size(rare) < _first(percent)), F.filter("tokens", lambda t: t >= EDGE)).alias("late"),
        (F.col("counted") - F.size("hits")).alias("own"), _first(percent).alias("first")), "marked")
    room = F.col("first") - F.col("own")
    short = F.size("rare") < room  # the rest is taken from the other shingles
    head = marked.select("row", "n", "key", F.slice("rare", F.lit(1), F.greatest(room, F.lit(0)).cast("int")).alias("hits"), F.col("own").alias("before"))

    # other shingles of the sets that need more: common ones of the region, and all beyond it
    large = marked.filter(short & F.col("late").isNull())
    others = _sets_of(docs, text, large.select("key").distinct(), width, "late")
    late = marked.filter(short & F.col("late").isNotNull()).select("row", "common", "late").unionByName(
        large.join(others, "key").select("row", "common", F.filter("tokens", lambda t: t >= EDGE).alias("late")))
    rest = keep(late.select("row", F.concat("common", "late").alias("tokens")), "rest")
    posted = rest.select("row", F.explode("tokens").alias("token"))
    held = keep(posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "held")
    more = rest.select("row", F.size("tokens").alias("given")).join(
        _listed(posted, held, rest.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0], F.struct("df", "token")), "row")
    before = F.col("own") + F.size("rare") + F.col("given") - F.size("hits")
    tail = marked.join(more, "row").select(
        "row", "n", "key", F.slice("hits", F.lit(1), F.greatest(F.col("first") - before, F.lit(0)).cast("int")).alias("hits"), before.alias("before"))
    both = head.unionByName(tail)
    return keep(both.select(F.col("row").alias("node"), "n", "key", "before", F.posexplode("hits").alias("at", "h")).select(
        "node", "n", "key", F.col("h.token").alias("token"), (F.col("before") + F.col("at") < _first(percent, index=True)).alias("index")), "prefixes")


def _first(percent: int, index: bool = False) -> Column:
    """How many first shingles of a set hold one that it shares with any near set, or with any near
    set of its size or more (``index``)."""
    kept = f"((2 * {percent} * n + {99 + percent}) div {100 + percent})" if index else f"((n * {percent} + 99) div 100)"
    return F.expr(f"n - {kept} + 1")


def _joined(docs: DataFrame, shingled: DataFrame, same: DataFrame, text: str, width: int, percent: int, group: int, cell: int) -> DataFrame:
    """``at``, ``component`` of every set that is linked with another one."""
    prefixes = _prefixes(docs, shingled, same, text, width, percent)
    entries = prefixes.count()

    # one leader per node: the least node of its shingle groups, the one it meets most often
    leaders = keep(prefixes.groupBy("token").agg(F.min("node").alias("leader"), F.count("*").alias("members")).filter("members > 1"), "tokens")
    size_ok = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent
    met = keep(_meet(prefixes, leaders, "members", entries), "met")
    sizes = met.filter("node = leader").select("leader", F.col("n").alias("leader_n")).distinct()
    meets = met.filter("node <> leader").groupBy("node", "n", "key", "leader").agg(F.count("*").alias("times")).join(sizes, "leader").filter(size_ok)
    chosen = keep(meets.groupBy("node", "n", "key").agg(
        F.max(F.struct("times", -F.col("leader"))).alias("best")).select("node", "n", "key", (-F.col("best.col2")).alias("leader")), "leaders")
    keys_of = keep(met.select("node", "n", "key").distinct(), "keys_of")
    sets = _sets_of(docs, text, keep(keys_of.select("key").distinct(), "keys"), width, "sets")
    links = _compare(sets, _star_places(chosen, keys_of, group), percent)
    absorbed = keep(components(links), "absorbed")

    # prefix shingles that still hold documents of different components
    placed = keep(met.select("token", "node", "n", "key", "index", "members").join(absorbed, "node", "left").withColumn(
        "component", F.coalesce("component", "node")), "placed")
    open_tokens = keep(placed.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows")).filter("lo <> hi").select("token", "rows"), "open_tokens")
    open_members = keep(_meet(placed, open_tokens, "rows", entries).drop("rows"), "open")
    # few documents on a shingle: pairs, thinned by how many prefix shingles they share
    few, many = open_members.filter(F.col("members") <= FEW), open_members.filter(F.col("members") > FEW)
    left = few.select("token", F.col("node").alias("leader"), F.col("component").alias("c"), F.col("n").alias("leader_n"))
    pairs = left.join(few, "token").filter((F.col("leader") < F.col("node")) & (F.col("c") != F.col("component")) & size_ok)
    counted = pairs.groupBy("leader", "node", "leader_n", "n").agg(F.count("*").alias("shared"))
    elsewhere = keep(many.groupBy("node").agg(F.count("*").alias("more")), "elsewhere")
    needed = F.expr(f"({percent} * (n + leader_n) + {99 + percent}) div {100 + percent} - (greatest(n, leader_n) * {percent} + 99) div 100 + 1")
    likely = keep(
        counted.join(elsewhere, "node", "left")
        .join(elsewhere.select(F.col("node").alias("leader"), F.col("more").alias("leader_more")), "leader", "left")
        .filter(F.col("shared") + F.least(F.coalesce("more", F.lit(0)), F.coalesce("leader_more", F.lit(0))) >= needed)
        .select("leader", "node").join(keys_of, "node"), "likely")
    pairwise = _compare(sets, _star_places(likely, keys_of, group), percent)

    # many documents on a shingle: its index sets against the others of like size
    more = pairwise.unionByName(_compare(sets, _cells(keep(many, "many"), cell, percent), percent))
    return components(links.unionByName(more), "final").withColumnRenamed("node", "at")


def jaccard_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WORDS, percent: int = PERCENT,
    group: int = GROUP, cell: int = CELL,
) -> DataFrame:
    """One row per row of ``docs``: ``row``, ``doc_id``, ``n_shingles``, ``component``, ``component_id``.

    Documents whose shingle sets have a Jaccard similarity of at least ``percent`` are linked;
    ``component_id`` is the least id that links reach.  Documents without words are linked with
    nothing.  ``component`` tells apart components whose ids are all null.
    """
    shingled = _shingled(docs, text, doc_id, width)
    total = shingled.count()
    same = keep(shingled.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min(F.when(F.col("tokens").isNotNull(), F.col("row"))).alias("node"), F.count("*").alias("copies")), "classes")
    with scratch(docs.sparkSession, total):
        final = keep(_joined(docs, shingled, same, text, width, percent, group, cell), "final", lasting=True)

    rows = join_facts(
        shingled.filter("digest IS NOT NULL").select("row", "doc_id", "n", "key", "digest"), same, ["digest"], "copies", total)
    placed_rows = keep(rows.join(final, rows["node"] == final["at"], "left").select(
        "row", "doc_id", "n", "key", F.coalesce("component", "node").alias("component")), "placed")
    least = placed_rows.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    linked = join_facts(placed_rows, least, ["component"], "members", total)
    alone = shingled.filter("digest IS NULL").select(
        "row", "doc_id", "n", "key", F.col("row").alias("component"), F.col("doc_id").alias("component_id"))
    return linked.select("row", "doc_id", F.col("n").alias("n_shingles"), "key", "component", "component_id").unionByName(
        alone.withColumnRenamed("n", "n_shingles"))


def one_per_component(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents with one of each component left: the one with the least id.

    A null id comes after any other; rows that agree in id and text count as repeats of one row, of
    which one stays.  Only documents of components with several members are shuffled with their text.
    """
    rows = jaccard_components(docs, text, doc_id, **options).filter("n_shingles > 0")
    found = keep(rows.select("component", "doc_id", _identity(F.col("doc_id"), F.col("key")).alias("_who")), "found")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_who")
    keepers = found.groupBy("component").agg(F.count("*").alias("members"), F.min(order).alias("least")).filter("members > 1").select(
        "component", "members", F.col("least._who").alias("keeper"))
    actions = keep(join_facts(found, keepers, ["component"], "members", found.count()).select(
        "_who", (F.col("_who") == F.col("keeper")).alias("_stays")).distinct(), "actions")
    named = docs.withColumn("_who", _identity(ref(doc_id).cast("long"), _text_key(text)))
    touched, clear = maybe_in(named, actions, "_who"), not_in_filter(named, actions, "_who")
    decided = touched.join(actions, "_who", "left").filter("_stays IS NULL OR _stays")
    once = decided.filter("_stays").dropDuplicates(["_who"])
    return clear.unionByName(decided.filter("_stays IS NULL").unionByName(once).drop("_stays")).drop("_who")


def _identity(doc_id: Column, key: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.hex(key))))


def _star_places(pairs: DataFrame, keys_of: DataFrame, group: int) -> DataFrame:
    """Places where leaders ask their members (``leader``, ``node``, ``n``, ``key``), bounded in sets and shingles.

    Every member is a side of its own, so every near one is linked.
    """
    salted = keep(pairs.groupBy("leader").agg(F.count("*").alias("members"), F.sum("n").alias("held")).withColumn(
        "salts", F.greatest(F.ceil(F.col("members") / group), F.ceil(F.col("held") / CELL_SHINGLES)).cast("int")), "salted")
    spot = lambda salt: F.concat_ws(":", F.col("leader"), salt)
    members = join_facts(pairs, salted.select("leader", "members", "salts"), ["leader"], "members", pairs.count()).select(
        "key", "node", F.col("node").alias("side"), F.lit(True).alias("stored"), spot(F.pmod(F.xxhash64("node"), F.col("salts"))).alias("place"))
    leaders = salted.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(
        keys_of.select(F.col("node").alias("leader"), "key"), "leader").select(
        "key", F.col("leader").alias("node"), F.col("leader").alias("side"), F.lit(False).alias("stored"), spot(F.col("salt")).alias("place"))
    return members.unionByName(leaders)


def _cells(members: DataFrame, cell: int, percent: int) -> DataFrame:
    """Places where the index sets of one shingle meet its sets of the same or the next size.

    Sizes are steps of one threshold factor.  Within a step the sets of each role are dealt by
    hash to parts, and every part of the one role meets every part of the other; index sets are few
    wherever the shingle is common because of a passage, so the copies are few as well.
    """
    total = members.count()
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)))
    sized = members.select("token", "node", "n", "key", "component", "index", step.alias("step"))

    def parts(rows: DataFrame) -> DataFrame:
        return keep(rows.groupBy("token", "step").agg(F.count("*").alias("rows"), F.sum("n").alias("held")).select(
            "token", "step", "rows", F.greatest(F.ceil(F.col("rows") / cell), F.ceil(F.col("held") / CELL_SHINGLES)).cast("int").alias("parts")), "parts")

    index_parts, all_parts = parts(sized.filter("index")), parts(sized)

    def dealt(rows: DataFrame, own: DataFrame, other: DataFrame, stored: bool) -> DataFrame:
        mine = join_facts(rows, own, ["token", "step"], "rows", total).drop("rows").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")
        places = None
        for ahead in (0, 1):  # the asking sets are of the same step or the one above
            meets = other.select("token", (F.col("step") + (-ahead if stored else ahead)).alias("step"), F.col("parts").alias("other_parts"))
            sizes = own.select("token", "step", "rows").join(meets, ["token", "step"])
            copied = join_facts(mine, keep(sizes, "meets"), ["token", "step"], "rows", total).withColumn(
                "other", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
            low = F.col("step") if stored else F.col("step") - ahead
            pair = (F.col("part"), F.col("other")) if stored else (F.col("other"), F.col("part"))
            found = copied.select("key", "node", F.col("component").alias("side"), F.lit(stored).alias("stored"),
                                  F.concat_ws(":", "token", low, F.lit(ahead), *pair).alias("place"))
            places = found if places is None else places.unionByName(found)
        return places

    return dealt(sized.filter("index"), index_parts, all_parts, True).unionByName(dealt(sized, all_parts, index_parts, False))
