"""Connected components on grids and graphs.

A mask's cells become runs (gaps and islands along the rows of tiles of bounded width) in one shuffle; from there on only runs
travel.  Runs of neighbouring rows that overlap are joined within a tile, then tiles at their borders.  Graph components
contract stars until nothing changes, with every round cut in the shared checkpoint folder.  A component's id is its
smallest member.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut

TILE = 512


def graph_components(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """edges(keys, a long, b long) -> (keys, id, component) of every id that has an edge to another; keys are graphs of their own."""
    keys = list(keys)
    now = cut(edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(20,0)"))).first())
        if state == seen or not state[0]:
            return now.select(*keys, F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(*keys, F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        seen = state
        both = now.unionByName(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
        large = both.join(least, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        now = cut(large.join(low, [*keys, "u"]).select(*keys, F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def runs_of(mask: DataFrame, tile: int = TILE, group: str = "year") -> DataFrame:
    """mask(group, r, c) -> (g, tr, tc, r, c0, c1): the longest stretches of cells along each row of each tile.

    Repeated cells count once; cells without a place are left out."""
    cells = mask.where("r is not null and c is not null").select(F.col(group).alias("g"), F.expr(f"r div {tile}").cast("int").alias("tr"), F.expr(f"c div {tile}").cast("int").alias("tc"), "r", "c")
    tiles = Window.partitionBy("g", "tr", "tc").orderBy("r", "c")  # tile * tile cells at most
    begins = ~F.coalesce((F.lag("r").over(tiles) == F.col("r")) & (F.col("c") <= F.lag("c").over(tiles) + 1), F.lit(False))
    numbered = cells.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(tiles.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("g", "tr", "tc", "run").agg(F.min("r").alias("r"), F.min("c").alias("c0"), F.max("c").alias("c1")).drop("run")


def _label(r: np.ndarray, c0: np.ndarray, c1: np.ndarray, eight: bool, cols: int) -> np.ndarray:
    """The smallest r * cols + c of each run's component among runs in order of row and column."""
    wide, reach = cols + 2, int(eight)
    below = (r + 1) * wide
    first = np.searchsorted(r * wide + c1, below + c0 - reach, side="left")
    many = np.maximum(np.searchsorted(r * wide + c0, below + c1 + reach, side="right") - first, 0)
    a = np.repeat(np.arange(len(r)), many)
    b = np.arange(len(a)) + np.repeat(first - np.cumsum(many) + many, many)
    root = np.arange(len(r))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    return (r * cols + c0)[root]


def component_runs(mask: DataFrame, rows: int, cols: int, eight: bool = True, group: str = "year", tile: int = TILE) -> DataFrame:
    """mask(group, r, c) -> (g, r, c0, c1, comp): runs of cells with the smallest r * cols + c of their component."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["r", "c0"])
        return part[["g", "r", "c0", "c1"]].assign(comp=_label(*(part[n].to_numpy(np.int64) for n in ("r", "c0", "c1")), eight, cols))

    kind = mask.schema[group].dataType.simpleString()
    local = runs_of(mask, tile, group).groupBy("g", "tr", "tc").applyInPandas(run, f"g {kind}, r int, c0 int, c1 int, comp long")
    if rows <= tile and cols <= tile:
        return local  # one tile has no border
    local = cut(local)
    side = f"(0, {tile - 1})"
    at_border = F.expr(f"CASE WHEN r % {tile} IN {side} THEN sequence(c0, c1) ELSE filter(array_distinct(array(c0, c1)), c -> c % {tile} IN {side}) END")
    border = local.select("g", "r", "comp", F.explode(at_border).alias("c"))
    # a border cell meets its neighbours in other tiles
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if eight else [(0, 1), (1, 0)]
    moved = border.select("g", F.col("comp").alias("a"), F.explode(F.array(*(F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in steps))).alias("s"))
    met = moved.select("g", "a", "s.r", "s.c").join(border.select("g", "r", "c", F.col("comp").alias("b")), ["g", "r", "c"]).where("a <> b")
    joined = graph_components(met.select("g", "a", "b"), ["g"]).withColumnRenamed("id", "comp")
    return local.join(joined, ["g", "comp"], "left").select("g", "r", "c0", "c1", F.coalesce("component", "comp").alias("comp"))


def grid_components(mask: DataFrame, rows: int, cols: int, eight: bool = True, group: str = "year", tile: int = TILE) -> DataFrame:
    """mask(group, r, c) -> (group, r, c, comp): comp is the smallest r * cols + c of the cell's component."""
    labelled = component_runs(mask, rows, cols, eight, group, tile)
    return labelled.select(F.col("g").alias(group), "r", F.explode(F.sequence("c0", "c1")).alias("c"), "comp")


def component_sizes(labelled: DataFrame, group: Sequence[str] = ("year",)) -> DataFrame:
    """Area, bounding box and truncated mean place of each component."""
    return labelled.groupBy(*group, "comp").agg(
        F.count("*").alias("area"), F.min("r").alias("row_min"), F.min("c").alias("col_min"), F.max("r").alias("row_max"), F.max("c").alias("col_max"),
        F.floor(F.avg("r")).cast("int").alias("row_mid"), F.floor(F.avg("c")).cast("int").alias("col_mid"),
    )
