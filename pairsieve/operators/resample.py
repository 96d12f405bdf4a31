"""Exact nearest neighbours and the resampling of a rare class built on them.

Rows carry ``id`` (whole number), ``x`` (array of doubles) and ``y``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairsieve.functions.values import ref
from pairsieve.operators.ranking import hash_uniform, hashed, rank_by_hash
from pairsieve.session import materialise

BLOCK_ROWS = 20_000
#: Pivots at most, so that a worker holds no more than their vectors.
MOST_BLOCKS = 4096
#: Rings of a cell that holds more rows than a block.
RINGS = 16
#: Vectors compared at once.
STEP_ROWS = 256
#: Pairs whose exact distance is taken at once.
STEP_PAIRS = 65_536
#: Relative rounding allowed to bounds, so that no equally near row is ruled out.
SLACK = 1e-9


def with_vector(df: DataFrame, features: list[str], key: str, label: str) -> DataFrame:
    values = F.array(*[F.coalesce(ref(f).cast("double"), F.lit(0.0)) for f in features])
    return df.select(ref(key).alias("id"), values.alias("x"), ref(label).cast("int").alias("y"))


class Blocks:
    """Balls around pivots that hold the pool: where they are, how far they reach, how many rows they have."""

    def __init__(self, pivots: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray):
        self.pivots, self.cell, self.low, self.high, self.rows = pivots, cell, low, high, rows

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance from every vector to the rows of every block.

        A row at distance r from its pivot is at least ``|d - r|`` and at most ``d + r`` away from
        a vector at distance d; as its pivot is its nearest one, it is also at least half as far
        away as the vector is farther from that pivot than from its own nearest one.
        """
        to = distances(x, self.pivots)
        near, own = to[:, self.cell], to.min(axis=1, keepdims=True)
        least = np.maximum.reduce([near - self.high, self.low - near, (near - own) / 2, np.zeros_like(near)])
        return least, near + self.high


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((y - row) ** 2).sum(axis=1) for row in x])) if len(x) else np.zeros((0, len(y)))


class Screen:
    """Pool rows that can be among the k nearest, by one product of matrices in single precision.

    The product gives squared distances up to a rounding error that is bounded by the vectors'
    lengths.  The k-th least of the least values of stretches of the pool is no smaller than the
    k-th least value; whatever is within twice the error of it passes.  Vectors that are not finite
    pass without a look.
    """

    def __init__(self, pool: np.ndarray, k: int):
        self.pool, self.k = pool, k
        self.middle = pool.mean(axis=0)
        centred = pool - self.middle
        self.scale = float(np.abs(centred).max(initial=0.0)) or 1.0
        self.usable = bool(np.isfinite(self.scale))
        if self.usable:
            centred /= self.scale
            squares = (centred ** 2).sum(axis=1)
            self.rows, self.squares, self.longest = centred.astype("float32").T.copy(), squares.astype("float32"), float(np.sqrt(squares.max()))

    def candidates(self, x: np.ndarray, reach: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of queries and pool rows that may be near; ``own`` is a query's place in the pool or -1."""
        with np.errstate(over="ignore", invalid="ignore"):
            asked = (x - self.middle) / self.scale if self.usable else x
            length = np.sqrt((asked ** 2).sum(axis=1))
            if not self.usable or not (length < 1e15).all():
                return np.divmod(np.arange(len(x) * len(self.pool)), len(self.pool))
            near = asked.astype("float32") @ self.rows
            near *= -2
            near += self.squares
            known = np.flatnonzero(own >= 0)
            near[known, own[known]] = np.inf
            error = 4 * (x.shape[1] + 8) * 2.0 ** -24 * (length + self.longest) ** 2
            limit = (reach / self.scale * (1 + SLACK)) ** 2 - length ** 2
            parts = max(64, 4 * self.k)
            width = len(self.pool) // parts
            if width > 1:
                least = near[:, :parts * width].reshape(len(x), parts, width).min(axis=2)
                limit = np.minimum(limit, np.partition(least, self.k - 1, axis=1)[:, self.k - 1].astype(float) + error)
            bound = np.nextafter((limit + error).astype("float32"), np.float32(np.inf))
        return np.nonzero(near <= bound[:, None])


def nearest_rows(ids: np.ndarray, x: np.ndarray, reach: np.ndarray, pool_ids: np.ndarray, screen: Screen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, of the pool row and distance of the k nearest rows within ``reach``.

    ``pool_ids`` are in rising order; a row is not its own neighbour, ties go to the smaller id.
    """
    place = np.searchsorted(pool_ids, ids).clip(max=len(pool_ids) - 1)
    query, row = screen.candidates(x, reach, np.where(pool_ids[place] == ids, place, -1))
    gap = np.concatenate([np.zeros(0)] + [
        np.sqrt(((screen.pool[row[at:at + STEP_PAIRS]] - x[query[at:at + STEP_PAIRS]]) ** 2).sum(axis=1)) for at in range(0, len(row), STEP_PAIRS)])
    good = np.isfinite(gap) & (gap <= reach[query]) & (pool_ids[row] != ids[query])
    query, row, gap = query[good], row[good], gap[good]
    order = np.lexsort((row, gap, query))
    query, row, gap = query[order], row[order], gap[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < screen.k
    return query[best], row[best], gap[best]


def pivot_blocks(pool: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Blocks]:
    """The pool (``p_id, p_x, p_y``) with its ``block``, written once, and the table of blocks.

    Rows go to the nearest of hashed pivots, one per ``block_rows`` rows.  A cell with more rows is
    cut into rings by the distance from its pivot, and a ring with more, equal rows for instance,
    by hash.  ``MOST_BLOCKS`` bounds what is held per worker; blocks grow beyond that many.
    """
    total = pool.count()
    block_rows = max(block_rows, -(-total // MOST_BLOCKS))
    wanted = max(1, -(-total // block_rows))
    drawn = pool.orderBy(F.xxhash64("p_id"), "p_id").limit(wanted).select("p_x").collect()
    pivots = np.unique(np.array([r["p_x"] for r in drawn], float), axis=0)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), STEP_ROWS):
                part = batch.iloc[start:start + STEP_ROWS]
                to = distances(np.vstack(part["p_x"].to_numpy()), pivots)
                yield part.assign(cell=to.argmin(axis=1).astype("int32"), away=to.min(axis=1))

    placed = materialise(pool.mapInPandas(nearest, "p_id long, p_x array<double>, p_y int, cell int, away double"))
    edges = placed.groupBy("cell").agg(F.count("*").alias("_n"), F.percentile_approx(
        "away", F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)]), F.lit(1000)).alias("_edges"))
    ring = F.when(F.col("_n") > block_rows, F.size(F.filter("_edges", lambda e: e < F.col("away")))).otherwise(0)
    ringed = placed.join(F.broadcast(edges), "cell").withColumn("ring", ring).drop("_n", "_edges")  # a row per pivot
    sizes = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_parts"))
    parted = ringed.join(F.broadcast(sizes), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("p_id"), F.col("_parts")).cast("int"))
    facts = parted.groupBy("cell", "ring", "part").agg(
        F.count("*").alias("rows"), F.min("away").alias("low"), F.max("away").alias("high")).orderBy("cell", "ring", "part").toPandas()
    facts["block"] = np.arange(len(facts), dtype=np.int32)  # bounded by MOST_BLOCKS times the rings
    numbers = pool.sparkSession.createDataFrame(facts[["cell", "ring", "part", "block"]].astype("int32"), "cell int, ring int, part int, block int")
    found = parted.join(F.broadcast(numbers), ["cell", "ring", "part"]).select("p_id", "p_x", "p_y", "block")
    return found, Blocks(pivots, *(facts[c].to_numpy() for c in ("cell", "low", "high", "rows")))


def visits(queries: DataFrame, blocks: Blocks, k: int, known: bool = False) -> DataFrame:
    """``q_id, q_x, q_reach, block``: the blocks a query (``q_id, q_x``) has to look at, and how far.

    First those that surely hold k rows besides itself, nearest first.  Once these are ``known``,
    with the k-th distance found in them as ``reach`` and their numbers as ``seen``, every other
    block that can hold a nearer row, or an equally near one.
    """
    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), STEP_ROWS):
                part = batch.iloc[start:start + STEP_ROWS]
                least, most = blocks.bounds(np.vstack(part["q_x"].to_numpy()))
                if known:
                    wanted = least <= part["reach"].to_numpy()[:, None] * (1 + SLACK) + SLACK
                    for i, seen in enumerate(part["seen"]):
                        wanted[i, seen] = False
                else:
                    order = np.argsort(most, axis=1, kind="stable")
                    before = np.cumsum(blocks.rows[order], axis=1) - blocks.rows[order]
                    wanted = np.zeros(least.shape, bool)
                    np.put_along_axis(wanted, order, before < k + 1, axis=1)
                row, block = np.nonzero(wanted)
                reach = part["reach"].to_numpy()[row] if known else np.full(len(row), np.inf)
                yield pd.DataFrame({
                    "q_id": part["q_id"].to_numpy()[row], "q_x": part["q_x"].to_numpy()[row], "q_reach": reach, "block": block.astype("int32")})

    return queries.mapInPandas(choose, "q_id long, q_x array<double>, q_reach double, block int")


def _searched(asked: DataFrame, placed: DataFrame, k: int, chunk_rows: int) -> DataFrame:
    """The best k rows of each visited block for each query; many queries of a block are split."""
    chunks = asked.groupBy("block").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))  # a row per block
    left = asked.join(F.broadcast(chunks), "block").select(
        "q_id", "q_x", "q_reach", F.col("block").alias("q_block"), F.pmod(F.xxhash64("q_id"), F.col("chunks")).cast("int").alias("q_chunk"))
    right = placed.join(F.broadcast(chunks), "block").select(
        "p_id", "p_x", "p_y", F.col("block").alias("p_block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("p_chunk"))

    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"id": [], "block": [], "n_id": [], "n_y": [], "distance": []})]
        p = p.sort_values("p_id", kind="stable")
        pool_id, pool_y = p["p_id"].to_numpy(), p["p_y"].to_numpy()
        screen = Screen(np.vstack(p["p_x"].to_numpy()), k) if len(q) and len(p) else None
        for start in range(0, len(q) if screen else 0, STEP_ROWS):
            part = q.iloc[start:start + STEP_ROWS]
            ids = part["q_id"].to_numpy()
            query, row, gap = nearest_rows(ids, np.vstack(part["q_x"].to_numpy()), part["q_reach"].to_numpy(), pool_id, screen)
            parts.append(pd.DataFrame({
                "id": ids[query], "block": part["q_block"].to_numpy()[query], "n_id": pool_id[row], "n_y": pool_y[row], "distance": gap}))
        return pd.concat(parts).astype({"id": "int64", "block": "int32", "n_id": "int64", "n_y": "int32", "distance": "float64"})

    return left.groupBy("q_block", "q_chunk").cogroup(right.groupBy("p_block", "p_chunk")).applyInPandas(
        best, "id long, block int, n_id long, n_y int, distance double")


def neighbours(queries: DataFrame, pool: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The exact k nearest pool rows of every query: ``id, rank, n_id, n_y, distance``.

    The pool is cut into balls around pivots.  A query first looks at the balls that surely hold k
    rows; the k-th distance found there and the triangle inequality rule out most others.  Every
    task screens a block by a product of matrices, takes the exact distance of what can be near and
    emits its best k per query; a limited rank keeps the best of them before and after the shuffle.  A row is not its own neighbour.  Ties go to the smaller id.
    """
    # New names on both sides: a pool may be derived from the same rows as the queries.
    asked = queries.select(F.col("id").alias("q_id"), F.col("x").alias("q_x"))
    if asked.isEmpty():
        return queries.sparkSession.createDataFrame([], "id long, rank int, n_id long, n_y int, distance double")
    placed, blocks = pivot_blocks(pool.select(F.col("id").alias("p_id"), F.col("x").alias("p_x"), F.col("y").alias("p_y")), block_rows)
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "n_id"))
    if not len(blocks.rows):
        return queries.sparkSession.createDataFrame([], "id long, rank int, n_id long, n_y int, distance double")
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    chunk_rows = min(block_rows, max(STEP_ROWS, -(-queries.count() // tasks)))  # few blocks still make work for all cores
    first = materialise(_searched(visits(asked, blocks, k), placed, k, chunk_rows))
    reach = first.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("id").agg(
        F.when(F.count("*") == k, F.max("distance")).otherwise(float("inf")).alias("reach"))
    seen = visits(asked, blocks, k).groupBy("q_id").agg(F.collect_set("block").alias("seen"))  # as many as hold k rows
    open_queries = asked.join(seen, "q_id").join(reach, F.col("q_id") == F.col("id"), "left").select(
        "q_id", "q_x", "seen", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    rest = _searched(visits(open_queries, blocks, k, known=True), placed, k, chunk_rows)
    return first.unionByName(rest).withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "n_id", "n_y", "distance")


def _spread(rows: DataFrame, near: DataFrame, minority: DataFrame, copies: DataFrame, k: int, seed: int) -> DataFrame:
    """Synthetic rows on the segments from each row to hashed neighbours."""
    plan = rows.join(copies, "id").filter("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    draw = hashed(seed, F.col("id"), F.col("copy"))
    lists = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "n_id"))).alias("ns"))
    plan = plan.join(lists, "id").withColumn(
        "n_id", F.element_at("ns", (F.floor(hash_uniform(draw, 1) * F.size("ns")) + 1).cast("int"))["n_id"])
    other = minority.select(F.col("id").alias("n_id"), F.col("x").alias("n_x"))
    step = hash_uniform(draw, 9)
    moved = F.zip_with("x", "n_x", lambda a, b: a + (b - a) * F.col("_step"))
    return plan.withColumn("_step", step).join(other, "n_id").select(
        F.col("id"), moved.alias("x"), F.lit(1).alias("y"), F.lit(True).alias("synthetic"), "copy")


def _wanted(rows: DataFrame, ratio: float) -> tuple[int, int]:
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return max(0, int(round(sizes.get(0, 0) * ratio)) - sizes.get(1, 0)), sizes.get(1, 0)


def _even_copies(rows: DataFrame, n_new: int, n_rows: int, seed: int) -> DataFrame:
    base, extra = divmod(n_new, max(1, n_rows))
    ranked = rank_by_hash(rows.select("id"), [], seed, "id", "_r")
    return ranked.select("id", (F.lit(base) + (F.col("_r") <= extra).cast("int")).alias("copies"))


def _with_real(rows: DataFrame, new: DataFrame) -> DataFrame:
    return rows.select("id", "x", "y", F.lit(False).alias("synthetic")).unionByName(new.drop("copy"))


def _copied(rows: DataFrame, copies: DataFrame, n_new: int, n_rows: int) -> DataFrame:
    """The rows that get copies: nobody asks for the neighbours of the others."""
    if n_new <= 0:
        return rows.limit(0)
    return rows if n_new >= n_rows else rows.join(copies.filter("copies > 0").select("id"), "id", "left_semi")


def _grown(rows: DataFrame, ratio: float, k: int, seed: int) -> tuple[DataFrame, int]:
    """The synthetic rows with the number of their copy, and how many copies a row has at most."""
    minority = rows.filter("y = 1")
    n_new, n_rows = _wanted(rows, ratio)
    copies = _even_copies(minority, n_new, n_rows, seed)
    near = neighbours(_copied(minority, copies, n_new, n_rows), minority, k)
    return _spread(minority, near, minority, copies, k, seed), n_new // max(1, n_rows) + 1


def smote(rows: DataFrame, ratio: float = 1.0, k: int = 5, seed: int = 42) -> DataFrame:
    """Grow class 1 to ``ratio`` of class 0 with points between minority neighbours."""
    return _with_real(rows, _grown(rows, ratio, k, seed)[0])


def borderline_smote(rows: DataFrame, ratio: float = 1.0, k: int = 5, m: int = 10, seed: int = 42) -> DataFrame:
    """SMOTE from minority rows whose surroundings are mostly, but not only, majority."""
    minority = rows.filter("y = 1")
    around = neighbours(minority, rows, m).groupBy("id").agg(
        F.sum((F.col("n_y") == 0).cast("int")).alias("others"), F.count("*").alias("n"))
    danger = minority.join(materialise(around.filter("others >= n / 2 AND others < n").select("id")), "id", "left_semi")  # read several times
    n_new, _ = _wanted(rows, ratio)
    n_rows = danger.count()
    copies = _even_copies(danger, n_new, n_rows, seed)
    near = neighbours(_copied(danger, copies, n_new, n_rows), minority, k)
    return _with_real(rows, _spread(danger, near, minority, copies, k, seed))


def adasyn(rows: DataFrame, ratio: float = 1.0, k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE with copies in proportion to the majority share around each minority row."""
    minority = rows.filter("y = 1")
    n_new, _ = _wanted(rows, ratio)
    share = materialise(neighbours(minority, rows, k).groupBy("id").agg(F.avg((F.col("n_y") == 0).cast("double")).alias("r")))  # read several times
    total = share.agg(F.sum("r")).scalar()
    copies = share.select("id", F.bround(F.try_divide(F.col("r"), total) * n_new, 0).cast("int").alias("copies"))
    near = neighbours(minority.join(copies.filter("copies > 0").select("id"), "id", "left_semi"), minority, k)
    return _with_real(rows, _spread(minority, near, minority, copies, k, seed))


def without_tomek_links(rows: DataFrame) -> DataFrame:
    """Drop pairs of opposite class that are each other's nearest neighbour.

    Every such pair holds a minority row, so only those and their partners are searched.
    """
    minority = rows.filter("y = 1")
    first = materialise(neighbours(minority, rows, 1).filter("n_y = 0").select("id", "n_id"))
    partners = rows.join(first.select(F.col("n_id").alias("id")).distinct(), "id", "left_semi")
    back = neighbours(partners, rows, 1).select(F.col("id").alias("n_id"), F.col("n_id").alias("_back"))
    links = first.join(back, "n_id").filter(F.col("_back") == F.col("id"))
    gone = links.select("id").unionByName(links.select(F.col("n_id").alias("id"))).distinct()
    return rows.join(gone, "id", "left_anti")


def smote_tomek(rows: DataFrame, ratio: float = 1.0, k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE, then without Tomek links.

    Real ids are not negative; a synthetic row gets a negative id made of its source and copy, so
    equal points stay apart.
    """
    new, most = _grown(rows, ratio, k, seed)
    numbered = new.withColumn("id", -(F.col("id") * (most + 1) + F.col("copy")) - 1)
    return without_tomek_links(materialise(_with_real(rows, numbered)))  # read many times there


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``n / (2 n_class)`` per row."""
    n = df.agg(F.count("*").alias("n"), F.sum(ref(label)).alias("p")).select(F.struct("n", "p")).scalar()
    size = F.when(ref(label) == 1, n["p"]).otherwise(n["n"] - n["p"])
    return df.withColumn(out, F.try_divide(n["n"].cast("double"), 2.0 * size))


def fixed_weight(df: DataFrame, label: str, positive: float, out: str = "weight") -> DataFrame:
    return df.withColumn(out, F.when(ref(label) == 1, float(positive)).otherwise(1.0))


def knn_vote(queries: DataFrame, pool: DataFrame, k: int = 5) -> DataFrame:
    """Distance-weighted share of class 1 among the k nearest; an exact hit decides alone."""
    near = neighbours(queries, pool, k)
    zero = F.col("distance") == 0
    sums = near.groupBy("id").agg(
        F.sum(zero.cast("int")).alias("hits"), F.sum((zero & (F.col("n_y") == 1)).cast("int")).alias("yes"),
        F.sum(F.when(~zero, 1.0 / F.col("distance"))).alias("w"),
        F.sum(F.when(~zero & (F.col("n_y") == 1), 1.0 / F.col("distance")).otherwise(0.0)).alias("wy"))
    p: Column = F.when(F.col("hits") > 0, F.col("yes") / F.col("hits")).otherwise(F.col("wy") / F.col("w"))
    return sums.select("id", p.alias("p"))
