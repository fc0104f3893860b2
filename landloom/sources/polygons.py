"""Polygons over cells by scanlines: edges cross rows, sorted crossings are runs of cells, lines are cut where they cross.

Rings are rings(ring_id, pts array<struct<x, y>>), closed by themselves; cell (r, c) has the corners (c, r) and (c + 1, r + 1).
Cells and points meet in equi-joins on cells or rows of a ring; lines meet the rings of their tile, whose boxes are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def edges(rings: DataFrame) -> DataFrame:
    """ring_id, e, xa, ya, xb, yb of each side of the rings."""
    n = F.size("pts")
    after = F.concat(F.slice("pts", 2, n), F.slice("pts", 1, 1))
    own = rings.where(n > 2).select("ring_id", F.posexplode(F.arrays_zip(C("pts").alias("a"), after.alias("b"))).alias("e", "s"))
    return own.select("ring_id", "e", *(C(f"s.{p}.{v}").cast("double").alias(f"{v}{p}") for p in ("a", "b") for v in ("x", "y")))


def _x_at(y: Column) -> Column:
    return C("xa") + (C("xb") - C("xa")) * ((y - C("ya")) / (C("yb") - C("ya")))


def touched(lines: DataFrame, *keys: str) -> DataFrame:
    """lines(keys, xa, ya, xb, yb) -> (keys, r, c0, c1): the cells of each row that a line passes."""
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    rows = lines.withColumn("r", F.explode(F.sequence(F.floor(low), F.floor(high))))
    at = lambda y: F.when(C("ya") == C("yb"), None).otherwise(_x_at(y))
    one, two = at(F.greatest(low, C("r").cast("double"))), at(F.least(high, (C("r") + 1).cast("double")))
    flat = C("ya") == C("yb")
    # the ends themselves, where the line begins or ends in the row, whatever rounding makes of its quotient
    left = F.when(flat, F.least("xa", "xb")).otherwise(F.greatest(F.least(one, two), F.least("xa", "xb")))
    right = F.when(flat, F.greatest("xa", "xb")).otherwise(F.least(F.greatest(one, two), F.greatest("xa", "xb")))
    return rows.select(*keys, "r", F.floor(left).alias("c0"), F.floor(right).alias("c1"))


def merged(runs: DataFrame) -> DataFrame:
    """Runs (ring_id, r, c0, c1) of a row that overlap or meet, as one."""
    row = Window.partitionBy("ring_id", "r").orderBy("c0", "c1")
    last = F.max("c1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.sum(F.when(last.isNull() | (C("c0") > last + 1), 1).otherwise(0)).over(row)
    islands = runs.withColumn("last", last).select("ring_id", "r", "c0", "c1", begun.alias("island"))
    return islands.groupBy("ring_id", "r", "island").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("island")


def runs(rings: DataFrame, all_touched: bool = False) -> DataFrame:
    """(ring_id, r, c0, c1): the cells whose centres lie inside (even-odd); with ``all_touched`` also those that a side passes."""
    own = edges(rings)
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    # rows whose centre line the side crosses: low <= r + 0.5 < high
    span = own.where(F.ceil(high - 0.5) > F.ceil(low - 0.5)).withColumn("r", F.explode(F.sequence(F.ceil(low - 0.5), F.ceil(high - 0.5) - 1)))
    crossed = span.select("ring_id", "r", "e", _x_at(C("r") + 0.5).alias("x"))
    row = Window.partitionBy("ring_id", "r").orderBy("x", "e")
    paired = crossed.withColumn("k", F.row_number().over(row)).withColumn("x1", F.lead("x").over(row)).where("k % 2 = 1")
    inner = paired.select("ring_id", "r", F.ceil(C("x") - 0.5).alias("c0"), (F.ceil(C("x1") - 0.5) - 1).alias("c1")).where("c0 <= c1")
    return merged(inner.unionByName(touched(own, "ring_id")) if all_touched else inner)


def cells(rings: DataFrame, rows: int, cols: int, all_touched: bool = False) -> DataFrame:
    """(ring_id, r, c) on a grid of rows x cols."""
    own = runs(rings, all_touched).where(C("r").between(0, rows - 1)).select("ring_id", C("r").cast("int").alias("r"), F.greatest("c0", F.lit(0)).alias("c0"), F.least("c1", F.lit(cols - 1)).alias("c1")).where("c0 <= c1")
    return own.select("ring_id", "r", F.explode(F.sequence(C("c0").cast("int"), C("c1").cast("int"))).alias("c"))


def _odd(points: DataFrame, sides: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """keys of the points(keys, on, x, y) that an odd number of sides(on, xa, ya, xb, yb) lies to the right of."""
    met = points.join(sides, on).where(((C("ya") > C("y")) != (C("yb") > C("y"))) & (C("x") < _x_at(C("y"))))
    return met.groupBy(*keys).agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def _by_row(sides: DataFrame) -> DataFrame:
    return sides.withColumn("r", F.explode(F.sequence(F.floor(F.least("ya", "yb")), F.floor(F.greatest("ya", "yb")))))


def inside(points: DataFrame, rings: DataFrame) -> DataFrame:
    """points(x, y, ...) in rings, borders excluded on the upper right; (points, ring_id).

    A point whose cell no side passes is inside with its cell's centre; only those of cells that a side passes are tested."""
    own = points.select(F.struct(*points.columns).alias("p"), C("x").cast("double").alias("x"), C("y").cast("double").alias("y"), F.floor("y").alias("r"), F.floor("x").alias("c"))
    edge = merged(touched(edges(rings), "ring_id")).select("ring_id", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    whole = runs(rings).select("ring_id", "r", F.explode(F.sequence("c0", "c1")).alias("c")).join(edge, ["ring_id", "r", "c"], "left_anti")
    plain = own.join(whole, ["r", "c"]).select("p", "ring_id")
    near = own.join(edge, ["r", "c"])
    tested = _odd(near.select("x", "y", "r", "ring_id").distinct(), _by_row(edges(rings)).drop("e"), ["x", "y", "ring_id"], ["ring_id", "r"])
    return plain.unionByName(near.join(tested, ["x", "y", "ring_id"]).select("p", "ring_id")).select("p.*", "ring_id")


#: Of a line l and the sides whose boxes overlap its own: turn, and turn times the shares of both ways at which they meet.
_TURNS = """transform(filter(sides, s -> s.x0 <= l.x1 and s.x1 >= l.x0 and s.y0 <= l.y1 and s.y1 >= l.y0), s -> named_struct('turn', l.dx * s.dy - l.dy * s.dx,
 't', (s.xa - l.xa) * s.dy - (s.ya - l.ya) * s.dx, 'u', (s.xa - l.xa) * l.dy - (s.ya - l.ya) * l.dx))"""
_MET = "transform(filter(turns, m -> m.turn <> 0 and m.u / m.turn >= 0 and m.u / m.turn <= 1 and m.t / m.turn > 0 and m.t / m.turn < 1), m -> m.t / m.turn)"
_CUTS = "if(size(cuts) = 0, array(0D, 1D), sort_array(array_distinct(concat(array(0D), cuts, array(1D)))))"
#: The parts between cuts, with their middles; and how many sides lie to the right of one.
_PARTS = """transform(sequence(1, size(cuts) - 1), i -> named_struct('t0', cuts[i - 1], 't1', cuts[i],
 'x', l.xa + l.dx * ((cuts[i - 1] + cuts[i]) / 2), 'y', l.ya + l.dy * ((cuts[i - 1] + cuts[i]) / 2)))"""
_RIGHT = "size(filter(sides, s -> (s.ya > p.y) <> (s.yb > p.y) and p.x < s.xa + s.dx * ((p.y - s.ya) / s.dy)))"


def _spanned(a: Column, b: Column) -> Column:
    """xa, ya, xb, yb, dx, dy and the box x0, x1, y0, y1 of the way from a to b."""
    own = {f"{v}{k}": p[v].cast("double") for k, p in (("a", a), ("b", b)) for v in ("x", "y")}
    own |= {f"d{v}": own[f"{v}b"] - own[f"{v}a"] for v in ("x", "y")} | {f"{v}{k}": how(own[f"{v}a"], own[f"{v}b"]) for v in ("x", "y") for k, how in ((0, F.least), (1, F.greatest))}
    return F.struct(*(v.alias(n) for n, v in own.items()))


def clipped(lines: DataFrame, rings: DataFrame, tile: float = 64.0) -> DataFrame:
    """lines(..., xa, ya, xb, yb) -> (..., ring_id, t0, t1): the parts of each line inside each ring, as shares of its way.

    A line meets the rings whose boxes it passes, in the tile that holds the lower corner of both boxes' overlap, so no pair
    is made twice.  A pair's row has the ring's sides: where they cross the line, it is cut, and a part is inside if its
    middle is.  Nothing is shuffled after the join, and the join shuffles nothing where the rings are broadcast."""
    keys = [c for c in lines.columns if c not in ("xa", "ya", "xb", "yb")]
    span = lambda c, v: F.explode(F.sequence(F.floor(C(f"{c}.{v}0") / tile), F.floor(C(f"{c}.{v}1") / tile)))
    dealt = lambda df, c: df.withColumn("i", span(c, "x")).withColumn("j", span(c, "y"))
    own = dealt(lines.select(*keys, _spanned(F.struct(C("xa").alias("x"), C("ya").alias("y")), F.struct(C("xb").alias("x"), C("yb").alias("y"))).alias("l")), "l")
    n = F.size("pts")
    around = rings.where(n > 2).select("ring_id", F.zip_with("pts", F.concat(F.slice("pts", 2, n), F.slice("pts", 1, 1)), _spanned).alias("sides"))
    box = F.struct(*(how(f"sides.{v}{k}").alias(f"{v}{k}") for v in "xy" for k, how in ((0, F.array_min), (1, F.array_max))))
    met = own.join(dealt(around.withColumn("box", box), "box"), ["i", "j"])
    low = {v: F.greatest(f"l.{v}0", f"box.{v}0") for v in "xy"}
    mid, half = ({v: by(C(f"box.{v}1"), C(f"box.{v}0")) / 2 for v in "xy"} for by in (lambda a, b: a + b, lambda a, b: a - b))
    away = F.abs(C("l.dx") * (mid["y"] - C("l.ya")) - C("l.dy") * (mid["x"] - C("l.xa")))  # of the box's centre, times the line's length
    near = away <= (half["x"] * F.abs("l.dy") + half["y"] * F.abs("l.dx")) * (1 + 1e-9) + 1e-9
    both = [low[v] <= F.least(f"l.{v}1", f"box.{v}1") for v in "xy"]
    met = met.where(both[0] & both[1] & (F.floor(low["x"] / tile) == C("i")) & (F.floor(low["y"] / tile) == C("j")) & near)
    for name, how in (("turns", _TURNS), ("cuts", _MET), ("cuts", _CUTS)):
        met = met.select(*keys, "ring_id", "l", "sides", F.expr(how).alias(name))
    return met.select(*keys, "ring_id", "sides", F.explode(F.expr(_PARTS)).alias("p")).where(F.expr(f"{_RIGHT} % 2 = 1")).select(*keys, "ring_id", "p.t0", "p.t1")
