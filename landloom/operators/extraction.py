"""From labelled grids to cities: filters, anchors, clusters, blocks and crops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import morphology as M
from .components import grid_components


def relabel(labelled: DataFrame, least: int) -> DataFrame:
    """Components of at least so many cells, numbered from 1 in the order of their ids."""
    big = labelled.groupBy("year", "comp").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    numbered = big.select("year", "comp", F.row_number().over(Window.partitionBy("year").orderBy("comp")).alias("label"))
    return labelled.join(numbered, ["year", "comp"]).select("year", "r", "c", "label")


def anchored(labelled: DataFrame, r: int, c: int, reach: int) -> DataFrame:
    """The component at an anchor, else the one with most cells in the square around it; ties go to the smaller id."""
    box = labelled.where(F.col("r").between(r - reach, r + reach) & F.col("c").between(c - reach, c + reach))
    seen = box.groupBy("year", "comp").agg(F.count("*").alias("n"), F.bool_or((F.col("r") == r) & (F.col("c") == c)).alias("here"))
    best = seen.groupBy("year").agg(F.min(F.struct((~F.col("here")).alias("away"), (-F.col("n")).alias("n"), "comp")).alias("b")).select("year", F.col("b.comp").alias("comp"))
    return labelled.join(best, ["year", "comp"]).select("year", "r", "c", "comp")


def largest(labelled: DataFrame) -> DataFrame:
    """(year, comp) of the largest component of each year, the smaller id of equals."""
    sizes = labelled.groupBy("year", "comp").agg(F.count("*").alias("n"))
    return sizes.groupBy("year").agg(F.min(F.struct((-F.col("n")).alias("n"), "comp")).alias("b")).select("year", F.col("b.comp").alias("comp"))


def without_enclaves(labelled: DataFrame, distance: float, rows: int, cols: int) -> DataFrame:
    """Components with a cell at most so far from the largest component."""
    body = labelled.join(largest(labelled), ["year", "comp"])
    near = M.within(body, distance, rows, cols)
    kept = labelled.join(near, ["year", "r", "c"], "left_semi").select("year", "comp").distinct()
    return labelled.join(kept, ["year", "comp"]).select("year", "r", "c", "comp")


def isolated(built: DataFrame, road: DataFrame, rows: int, cols: int) -> DataFrame:
    """Whether no cell of a built cell's component lies on or beside a road."""
    labelled = grid_components(built, rows, cols)
    touched = labelled.join(M.dilate_disk(road, 1, rows, cols), ["year", "r", "c"], "left_semi").select("year", "comp", F.lit(True).alias("hit")).distinct()
    return labelled.join(touched, ["year", "comp"], "left").select("year", "r", "c", F.col("hit").isNull().alias("isolated"))


def _block(size: int) -> list:
    return [F.expr(f"r div {size}").cast("int").alias("br"), F.expr(f"c div {size}").cast("int").alias("bc")]


def block_mode(cells: DataFrame, size: int) -> DataFrame:
    """The most frequent class of each block, the smallest of equals."""
    counted = cells.groupBy("year", *_block(size), "lu").agg(F.count("*").alias("n"))
    return counted.groupBy("year", "br", "bc").agg(F.min(F.struct((-F.col("n")).alias("n"), "lu")).alias("b")).select("year", "br", "bc", F.col("b.lu").alias("lu"))


def block_mean(cells: DataFrame, size: int, least: float) -> DataFrame:
    """The share of a block's cells that are inside, and whether it suffices."""
    share = F.avg(F.col("inside").cast("double"))
    return cells.groupBy("year", *_block(size)).agg(F.round(share, 6).alias("share"), (share >= least).alias("inside"))


def ever_urban(cells: DataFrame, classes: Sequence[int], years: int, steps: int, rows: int, cols: int) -> DataFrame:
    """Cells that were urban in so many years, holes filled, widened by a 3 x 3 square so many times."""
    ever = cells.where(F.col("lu").isin(*classes)).groupBy("r", "c").agg(F.count("*").alias("n")).where(F.col("n") >= years).select(F.lit(0).alias("year"), "r", "c")
    frame = cells.select(F.lit(0).alias("year"), "r", "c").distinct()
    mask = M.fill_holes(ever, frame, rows, cols)
    return M.dilate(mask, M.square(steps), rows, cols).select("r", "c")


def city_window(cells: DataFrame, classes: Sequence[int], year: int, r: int, c: int, reach: int, rows: int, cols: int) -> DataFrame:
    """All years cropped to the box of the component at an anchor in one year, other places set to 0."""
    mask = cells.where((F.col("year") == year) & F.col("lu").isin(*classes)).select("year", "r", "c")
    foot = anchored(grid_components(mask, rows, cols), r, c, reach).select("r", "c")
    box = foot.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    inside = cells.join(F.broadcast(box), F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1")))
    kept = inside.join(foot.withColumn("own", F.lit(True)), ["r", "c"], "left")
    return kept.select("year", (F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), F.when(F.col("own"), F.col("lu")).otherwise(0).alias("lu"))


def admin_groups(seed: DataFrame, buffer: int, rows: int, cols: int) -> DataFrame:
    """Groups of seed cells that a buffer joins; areas count seed cells only."""
    labelled = grid_components(M.dilate_disk(seed, buffer, rows, cols), rows, cols)
    sizes = seed.join(labelled, ["year", "r", "c"]).groupBy("year", "comp").agg(F.count("*").alias("cells"))
    return sizes.groupBy("year").agg(F.count("*").alias("groups"), F.sum("cells").alias("total_cells"), F.max("cells").alias("largest_cells"))


def clusters(cells: DataFrame, classes: Sequence[int], core: Sequence[int], least: int, rows: int, cols: int) -> DataFrame:
    """Components of at least so many cells with a core cell, numbered by year."""
    labelled = grid_components(cells.where(F.col("lu").isin(*classes)).select("year", "r", "c"), rows, cols)
    big = labelled.groupBy("year", "comp").agg(F.count("*").alias("area")).where(F.col("area") >= least)
    cored = labelled.join(cells.where(F.col("lu").isin(*core)), ["year", "r", "c"], "left_semi").select("year", "comp").distinct()
    return big.join(cored, ["year", "comp"]).select("year", F.row_number().over(Window.partitionBy("year").orderBy("comp")).alias("city_id"), "area")


def lonlat_crop(cells: DataFrame, west: float, north: float, step: float, box: tuple[float, float, float, float]) -> DataFrame:
    """Cells whose centre lies in (west, south, east, north), with Web-Mercator places."""
    lon, lat = F.lit(west) + (F.col("c") + 0.5) * F.lit(step), F.lit(north) - (F.col("r") + 0.5) * F.lit(step)
    own = cells.withColumns({"lon": lon, "lat": lat}).where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    return own.select("year", "r", "c", "lu", F.round(6378137 * F.radians("lon"), 3).alias("x"), F.round(6378137 * F.ln(F.tan(F.pi() / 4 + F.radians("lat") / 2)), 3).alias("y"))
