"""Morphology on sparse masks (group, r, c) of a grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import grid_components
from .durable import cut


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets with dr^2 + dc^2 <= radius^2."""
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def square(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]


def _moved(mask: DataFrame, offsets: list[tuple[int, int]], rows: int, cols: int, group: str) -> DataFrame:
    steps = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets))
    moved = mask.select(group, "r", "c", F.explode(steps).alias("s")).select(group, (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    return moved.where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))


def dilate(mask: DataFrame, offsets: list[tuple[int, int]], rows: int, cols: int, group: str = "year") -> DataFrame:
    """Cells that an offset reaches from the mask; duplicates merge before the shuffle."""
    return _moved(mask, offsets, rows, cols, group).distinct()


def erode(mask: DataFrame, offsets: list[tuple[int, int]], rows: int, cols: int, group: str = "year") -> DataFrame:
    """Cells whose every offset lies in the mask; off the grid counts as empty."""
    return _moved(mask, offsets, rows, cols, group).groupBy(group, "r", "c").agg(F.count("*").alias("n")).where(F.col("n") == len(offsets)).drop("n")


def _reach(square: int, away: Column) -> Column:
    """How far along the row a disk of this squared radius goes, so far from its middle."""
    return F.floor(F.sqrt((F.lit(square) - away * away).cast("double"))).cast("int")


def dilate_disk(mask: DataFrame, radius: float, rows: int, cols: int, group: str = "year") -> DataFrame:
    """Dilation with a disk in two passes: the nearest cell of the mask along the column, then its reach along the row.

    In a column every cell goes to the nearest of the mask (at most ``radius`` away), so a cell appears once; in a row those
    cells are runs, which are merged.  Each pass shuffles at most a row for each cell of the grid."""
    square, near = math.floor(radius * radius), math.floor(radius)
    column = Window.partitionBy(group, "c").orderBy("r")
    r, before, after = F.col("r"), F.lag("r").over(column), F.lead("r").over(column)
    first = F.greatest(r - near, F.lit(0), F.coalesce(F.floor((before + r) / 2).cast("int") + 1, F.lit(0)))
    last = F.least(r + near, F.lit(rows - 1), F.coalesce(F.floor((r + after) / 2).cast("int"), F.lit(rows - 1)))
    own = mask.select(group, "r", "c").distinct().withColumns({"first": first, "last": last}).where("first <= last")
    tall = own.select(group, "c", F.col("r").alias("seed"), F.explode(F.sequence("first", "last")).alias("r"))
    h = _reach(square, F.col("r") - F.col("seed"))
    wide = tall.select(group, "r", F.greatest(F.col("c") - h, F.lit(0)).alias("c0"), F.least(F.col("c") + h, F.lit(cols - 1)).alias("c1"))
    row = Window.partitionBy(group, "r").orderBy("c0", "c1")
    end = F.max("c1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    # a run covers what no earlier run does
    new = wide.withColumn("from", F.greatest("c0", F.coalesce(end + 1, F.lit(0)))).where("from <= c1")
    return new.select(group, F.col("r").cast("int").alias("r"), F.explode(F.sequence("from", "c1")).alias("c"))


def erode_disk(mask: DataFrame, radius: float, rows: int, cols: int, group: str = "year") -> DataFrame:
    """Erosion with a disk in two passes over the mask's own cells; off the grid counts as empty.

    In a column a cell's distance to the nearest empty cell follows from its run; in a row it goes if it is too near the end
    of its run, or within reach of a cell that has an empty one above or below."""
    square, near = math.floor(radius * radius), math.floor(radius)

    def run(df: DataFrame, along: str, across: str) -> DataFrame:
        """df with ``gap``: how far the nearest empty cell is along the line."""
        line = Window.partitionBy(group, across).orderBy(along)
        island = F.col(along) - F.row_number().over(line)
        whole = Window.partitionBy(group, across, "island")
        return df.withColumn("island", island).withColumn("gap", F.least(F.col(along) - F.min(along).over(whole), F.max(along).over(whole) - F.col(along)) + 1).drop("island")

    own = run(mask.select(group, "r", "c").distinct(), "r", "c").withColumnRenamed("gap", "tall")
    h = F.when(F.col("tall") <= near, _reach(square, F.col("tall")))
    row = Window.partitionBy(group, "r").orderBy("c")
    left = F.max(F.col("c") + h).over(row.rowsBetween(Window.unboundedPreceding, 0))
    right = F.min(F.col("c") - h).over(row.rowsBetween(0, Window.unboundedFollowing))
    seen = run(own, "c", "r").withColumns({"left": left, "right": right})
    kept = (F.col("gap") > near) & (F.coalesce("left", F.lit(-1)) < F.col("c")) & (F.coalesce("right", F.lit(cols)) > F.col("c"))
    return seen.where(kept).select(group, "r", "c")


def close(mask: DataFrame, radius: int, rows: int, cols: int, group: str = "year", keep: bool = True) -> DataFrame:
    """Closing with a disk; ``keep`` puts the mask's own border cells back."""
    out = erode_disk(dilate_disk(mask, radius, rows, cols, group), radius, rows, cols, group)
    return out.unionByName(mask.select(group, "r", "c")).distinct() if keep else out


def holes(mask: DataFrame, frame: DataFrame, rows: int, cols: int, group: str = "year") -> DataFrame:
    """Background cells that no 4-connected way leads to the border from; frame(group, r, c) is the whole grid."""
    background = frame.select(group, "r", "c").join(mask.select(group, "r", "c"), [group, "r", "c"], "left_anti")
    labelled = grid_components(background, rows, cols, eight=False, group=group)
    edge = F.col("r").isin(0, rows - 1) | F.col("c").isin(0, cols - 1)
    inner = labelled.groupBy(group, "comp").agg(F.bool_or(edge).alias("open")).where(~F.col("open")).drop("open")
    return labelled.join(inner, [group, "comp"]).select(group, "r", "c")


def fill_holes(mask: DataFrame, frame: DataFrame, rows: int, cols: int, group: str = "year", largest: int | None = None) -> DataFrame:
    """The mask with its holes; with ``largest`` only with 8-connected holes of at most so many cells."""
    inner = holes(mask, frame, rows, cols, group)
    if largest is not None:
        labelled = grid_components(inner, rows, cols, eight=True, group=group)
        small = labelled.groupBy(group, "comp").agg(F.count("*").alias("n")).where(F.col("n") <= largest)
        inner = labelled.join(small, [group, "comp"]).select(group, "r", "c")
    return mask.select(group, "r", "c").unionByName(inner)


def extent_parameters(pixel_m: float, reach_m: float = 2000.0, hole_m2: float = 4e6) -> tuple[int, int]:
    """(closing radius in cells, largest filled hole in cells) of a pixel size; halves round to even."""
    return max(1, round(reach_m / (2 * pixel_m))), round(hole_m2 / (pixel_m * pixel_m))


def extent(cells: DataFrame, rows: int, cols: int, radius: int, largest: int, seeds: tuple[int, ...] = (1, 2, 3, 4), group: str = "year") -> DataFrame:
    """Built-up extent: seed classes closed with a disk, their own cells kept, and small holes filled."""
    mask = cells.where(F.col("lu").isin(*seeds)).select(group, "r", "c")
    return fill_holes(close(mask, radius, rows, cols, group), cells, rows, cols, group, largest)


def within(mask: DataFrame, distance: float, rows: int, cols: int, group: str = "year") -> DataFrame:
    """Cells at most so far (in cells, Euclidean) from the mask."""
    return dilate_disk(mask, distance, rows, cols, group)


def extent_steps(full: DataFrame, rows: int, cols: int, radius: int, largest: int, seeds: Sequence[int]) -> DataFrame:
    """Cells of each step towards the extent, by year."""
    seed = full.where(F.col("lu").isin(*seeds)).select("year", "r", "c")
    closed = cut(close(seed, radius, rows, cols))
    steps = {"seed_cells": seed, "closed_cells": closed, "hole_cells": holes(closed, full, rows, cols), "extent_cells": fill_holes(closed, full, rows, cols, largest=largest)}
    parts = None
    for name, mask in steps.items():
        own = mask.select("year", F.lit(name).alias("step"))
        parts = own if parts is None else parts.unionByName(own)
    wide = parts.groupBy("year").pivot("step", list(steps)).count()
    out = wide.select("year", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in steps))
    return out.withColumn("extent_km2", F.round(F.col("extent_cells") * F.lit(0.01), 6))
