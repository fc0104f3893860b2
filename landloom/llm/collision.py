"""Approximate nearest neighbours by collision-counting hashing.

Every block of vectors is projected on ``HASHES`` random lines and sorted along each.  Around a query's own projections
windows are opened in all sorted arrays; virtual rehashing widens them level by level (radius times ``GROWTH``), ``WIDTH``
radii wide.  A vector that lies in at least ``SHARE`` of the windows of a level is verified with its exact distance.  The
search of a block ends at the first level that has the wanted number of verified vectors within its radius.

What a level verifies only grows with the level, so that level is found from the one at which the query before ended, by
growing steps and then halves.  Windows must be wide: where distances hardly differ (random directions), narrow ones tell
near from far only by many more lines.  A window is two places in a sorted array, and a vector lies in it if its own place
does, which one subtraction tells.

All rows are indexed; queries are dealt into blocks too, and each pair of blocks is one task, so that neither side is ever
held whole.  Sorting a block again for every ``QUERY_BLOCK`` queries costs little beside their counting and spares storing
and shipping its sorted arrays, which are many times its vectors.

Rows: vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no part; vectors of
different lengths are not compared; only the query's own row is left out, so repeated rows are neighbours of each other and
each row that is asked for is a query of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, table
from .vectors import matrix, usable

HASHES, WIDTH, SHARE, GROWTH = 192, 3.2, 0.865, 1.03
NEAREST, INDEX_BLOCK, QUERY_BLOCK = 10, 32_768, 8192


class Index:
    """The sorted projections of a block of vectors."""

    def __init__(self, x: np.ndarray, seed: int = 42):
        self.x, self.lines = x, np.random.default_rng((seed, x.shape[1])).standard_normal((x.shape[1], HASHES))
        projected = (x @ self.lines).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.ranked = np.take_along_axis(projected, order, 1)
        # each vector's place in every sorted array; a place less than the window's width after its begin lies in the window
        self.kind = np.uint16 if len(x) < 1 << 16 else np.uint32
        self.places = np.empty(order.shape, self.kind)
        np.put_along_axis(self.places, order, np.arange(len(x), dtype=self.kind)[None, :], 1)
        self.enough, scale = int(np.ceil(SHARE * HASHES)), np.sqrt((x * x).sum(1).mean()) or 1.0
        # radii of virtual rehashing: doubled while windows are narrow, then widened gently, at last without bound
        self.radii = scale * np.concatenate([2.0 ** np.arange(-12, -1), 0.5 * GROWTH ** np.arange(int(np.log(8) / np.log(GROWTH)) + 1), [np.inf]])

    def windows(self, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows around a query's projections begin and end in the sorted arrays: one binary search for all."""
        bounds = np.concatenate([at - radius * WIDTH / 2, at + radius * WIDTH / 2])
        line, low, high = np.tile(np.arange(HASHES), 2), np.zeros(2 * HASHES, np.int64), np.full(2 * HASHES, len(self.x))
        while (open_ := low < high).any():
            middle = (low + high) // 2
            before = open_ & (self.ranked[line, np.minimum(middle, len(self.x) - 1)] < bounds)
            low, high = np.where(before, middle + 1, low), np.where(open_ & ~before, middle, high)
        return low[:HASHES], low[HASHES:]

    def colliding(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The vectors that lie in enough of the windows."""
        counts, after, inside = np.zeros(len(self.x), np.uint16), np.empty(len(self.x), self.kind), np.empty(len(self.x), bool)
        for places, a, width in zip(self.places, begin.astype(self.kind), (end - begin).astype(self.kind), strict=True):
            np.subtract(places, a, out=after)  # places before the window wrap around
            np.less(after, width, out=inside)
            np.add(counts, inside, out=counts)
        return np.flatnonzero(counts >= self.enough)


def search(x: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, nearest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Yields (query, places in x, distances, how many were verified) with the wanted number of vectors or all there are."""
    index = Index(x)
    last = level = len(index.radii) - 1
    for q, own in zip(queries, query_rows, strict=True):
        others, at = rows != own, q @ index.lines
        wanted, seen = min(nearest, int(others.sum())), {}

        def verified(level):
            if level not in seen:
                near = index.colliding(*index.windows(at, index.radii[level]))  # noqa: B023
                near = near[others[near]]  # noqa: B023
                seen[level] = near, np.sqrt(((x[near] - q) ** 2).sum(1))  # noqa: B023
            return seen[level]

        if not wanted:
            continue
        low, high, step = -1, last, 1  # no level up to low ends the search, high does
        level = min(level, last - 1)
        while high - low > 1:
            if (verified(level)[1] <= index.radii[level]).sum() >= wanted:
                high, level = level, level - step
            else:
                low, level = level, level + step
            step *= 2
            if not low < level < high:
                level, step = (low + high) // 2, 1
        level = high
        near, distance = verified(high)
        yield own, near, distance, len(near)


def _search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    out = [(np.empty(0, np.int64),) * 3 + (np.empty(0),)]
    if len(index) and len(asked):
        nearest, names, ids = int(asked["nearest"].iloc[0]), dict(zip(asked["row"], asked["vec_id"], strict=True)), index["vec_id"].to_numpy()
        for own, near, distance, _ in search(matrix(index["e"]), index["row"].to_numpy(), matrix(asked["e"]), asked["row"].to_numpy(), nearest):
            best = np.lexsort((ids[near], distance))[:nearest]
            out.append((np.full(len(best), own), np.full(len(best), names[own]), ids[near[best]], distance[best]))
    return pd.DataFrame(dict(zip(("query", "query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def nearest(vectors: DataFrame, asked, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that the condition ``asked`` selects."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    index = materialise(rows.withColumn("dim", F.size("e")).withColumn("row", F.monotonically_increasing_id()))
    queries = index.where(asked)
    blocks, rounds = -(-index.count() // INDEX_BLOCK) or 1, -(-queries.count() // QUERY_BLOCK) or 1
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = index.select("vec_id", "row", "e", "dim", dealt(blocks).alias("block"), each(rounds).alias("round"))
    right = queries.select("vec_id", "row", "e", F.col("dim").alias("q_dim"), dealt(rounds).alias("q_round"), each(blocks).alias("q_block"), F.lit(k).alias("nearest"))
    pairs = left.groupBy("dim", "block", "round").cogroup(right.groupBy("q_dim", "q_block", "q_round"))
    found = pairs.applyInPandas(_search, "query long, query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
