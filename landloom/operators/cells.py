"""Categorical grids as long tables of cells: conversions, alignment and masks.

A grid is (group columns, r, c, lu).  A cell that is absent has class 0 once it is laid on a spine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTSIDE = 255

#: Raw class to analysis class; raw classes without an entry are 0.
RAW_TO_CLASS = {0: 0, 1: 6, 2: 6, 3: 0, 4: 0, 5: 1, 6: 2, 7: 3, 8: 4, 9: 5}

#: Anchor colours (r, g, b, class); -1 is outside.
ANCHORS = (
    (240, 240, 240, 0), (238, 238, 238, 0), (255, 255, 255, 0), (240, 240, 208, -1), (245, 248, 220, -1), (245, 248, 221, -1),
    (249, 168, 37, 1), (255, 255, 45, 1), (227, 26, 28, 2), (240, 0, 0, 2), (254, 0, 0, 2), (0, 99, 128, 3), (54, 98, 123, 3),
    (109, 76, 65, 4), (187, 150, 116, 4), (186, 150, 116, 4), (97, 97, 97, 5), (183, 183, 183, 5), (56, 142, 60, 6), (0, 255, 0, 6),
    (51, 142, 192, 6), (50, 142, 191, 6),
)


def lookup(value: Column, table: Mapping[int, int], default: int = 0) -> Column:
    """A class remapped through a small table."""
    entries = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(entries, value), F.lit(default)).cast("int")


def fill_outside(lu: Column) -> Column:
    """Outside becomes vacant."""
    return F.when(lu == OUTSIDE, 0).otherwise(lu).cast("int")


def one_hot(cells: DataFrame, classes: int = 7) -> DataFrame:
    """Indicator columns c0, c1, ... of the class, clipped to the range."""
    own = F.greatest(F.lit(0), F.least(F.lit(classes - 1), F.col("lu")))
    return cells.select("*", *((own == k).cast("int").alias(f"c{k}") for k in range(classes)))


def hot_class(columns: Sequence[str]) -> Column:
    """The position of the largest indicator, the first of equals."""
    values = F.array(*columns)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def spine(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Every (r, c) of a grid."""
    at = spark.range(rows * cols)
    return at.select(F.expr(f"cast(id div {cols} as int)").alias("r"), (F.col("id") % cols).cast("int").alias("c"))


def on_spine(cells: DataFrame, rows: int, cols: int, group: Sequence[str] = ("year",), fill: int = 0) -> DataFrame:
    """Cells cropped to a grid and padded with ``fill``: one row per group and place.

    The groups (years, cities) are a small dimension next to the cells, so pairing them with the grid is the output itself."""
    frame = cells.select(*group).distinct().crossJoin(F.broadcast(spine(cells.sparkSession, rows, cols)) if rows * cols <= 1 << 16 else spine(cells.sparkSession, rows, cols))
    return frame.join(cells, [*group, "r", "c"], "left").select(*group, "r", "c", F.coalesce("lu", F.lit(fill)).cast("int").alias("lu"))


def outside_elsewhere(cells: DataFrame, year: str = "year") -> DataFrame:
    """Cells that are outside in every other year become outside in this one as well."""
    counts = cells.groupBy("r", "c").agg(F.count_if(F.col("lu") == OUTSIDE).alias("out"), F.count("*").alias("n"))
    lone = (F.col("n") > 1) & (F.col("out") - (F.col("lu") == OUTSIDE).cast("int") == F.col("n") - 1)
    return cells.join(counts, ["r", "c"]).select(year, "r", "c", F.when(lone, OUTSIDE).otherwise(F.col("lu")).cast("int").alias("lu"))


def window_scan(cells: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """Cells of a window, bounds included; the range predicates reach the scan."""
    return cells.where(F.col("r").between(row0, row1) & F.col("c").between(col0, col1))


def decimate(cells: DataFrame, rows: int, cols: int, scale: float) -> DataFrame:
    """Nearest decimation: output (i, j) reads the source cell under its centre; output size is the floor of rows / scale."""
    out_r, out_c = int(rows / scale), int(cols / scale)
    pick = lambda n_in, n_out: [int((k + 0.5) * n_in / n_out) for k in range(n_out)]
    r, c = pick(rows, out_r), pick(cols, out_c)
    near = lambda at, spots: (F.array_position(F.array(*map(F.lit, spots)), F.col(at)) - 1).cast("int")
    kept = cells.where(F.col("r").isin(r) & F.col("c").isin(c))
    return kept.withColumns({"r": near("r", r), "c": near("c", c)})


def resample(cells: DataFrame, rows: int, cols: int, row_of: Column, col_of: Column, group: Sequence[str] = ("year",)) -> DataFrame:
    """Nearest resampling on a target grid; ``row_of`` and ``col_of`` give the source place of target (r, c)."""
    frame = spine(cells.sparkSession, rows, cols).withColumns({"sr": row_of.cast("int"), "sc": col_of.cast("int")})
    groups = cells.select(*group).distinct()
    source = cells.select(*group, F.col("r").alias("sr"), F.col("c").alias("sc"), "lu")
    return groups.crossJoin(frame).join(source, [*group, "sr", "sc"], "left").select(*group, "r", "c", F.coalesce("lu", F.lit(0)).cast("int").alias("lu"))


def nearest_anchor(points: DataFrame, anchors: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Each point's class: that of the anchor with the smallest squared distance, the earlier of equals.  Anchors are few."""
    rows = anchors.orderBy("ord").collect()
    best = F.array_min(F.array(*(F.struct(sum(((F.col(d) - r[d]) * (F.col(d) - r[d]) for d in dims), F.lit(0)).alias("dist"), F.lit(r["ord"]).alias("ord"), F.lit(r["cls"]).alias("cls")) for r in rows)))
    return points.withColumn("near", best).select(*(c for c in points.columns), F.col("near.dist").alias("dist"), F.when(F.col("near.cls") < 0, OUTSIDE).otherwise(F.col("near.cls")).cast("int").alias("lu"))
