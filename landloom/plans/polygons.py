"""Polygons of nations over the grid: their cells, the classes inside, and polylines clipped at their borders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import roads as N
from ..sources import polygons as P
from .base import GRID, VERTICES, G, grid, read, vertices
from .registry import query

C = F.col
#: The corners of a nation's ring about its centre, in shares of its reach; it is not convex.
_SHAPE = ((-1.0, -1.0), (1.0, -0.75), (0.5, 1.0), (0.0, 0.25), (-0.75, 1.0))
_RING = f"""ring AS (SELECT CAST(n_nationkey AS INT) AS ring_id, n_nationkey * 7 % {G} + 0.25::DOUBLE AS x, n_nationkey * 13 % {G} + 0.5::DOUBLE AS y, CAST(4 + count(c_custkey) % 13 AS DOUBLE) AS reach
 FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey), corner AS (SELECT ring_id, k, x + reach * dx AS x, y + reach * dy AS y
 FROM ring, (VALUES {", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (a, b) in enumerate(_SHAPE))}) s(k, dx, dy)),
 side AS (SELECT a.ring_id, a.k AS e, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM corner a JOIN corner b ON a.ring_id = b.ring_id AND b.k = (a.k + 1) % {len(_SHAPE)})"""
_CROSSED = "(s.ya > q.y) <> (s.yb > q.y) AND q.x < s.xa + (s.xb - s.xa) * ((q.y - s.ya) / (s.yb - s.ya))"


def _rings(spark, sf):
    """ring_id, pts: a ring about the place of each nation, as wide as it has customers."""
    nation, customer = read(spark, sf, "nation"), read(spark, sf, "customer")
    own = nation.join(customer, C("c_nationkey") == C("n_nationkey"), "left").groupBy("n_nationkey").agg((F.count("c_custkey") % 13 + 4).cast("double").alias("reach"))
    x, y = (C("n_nationkey") * 7 % G + F.lit(0.25)), (C("n_nationkey") * 13 % G + F.lit(0.5))
    return own.select(C("n_nationkey").cast("int").alias("ring_id"), F.array(*(F.struct((x + C("reach") * a).alias("x"), (y + C("reach") * b).alias("y")) for a, b in _SHAPE)).alias("pts"))


_INNER = f"inner_ AS (SELECT q.ring_id, q.r, q.c FROM (SELECT ring_id, a.range AS r, b.range AS c, a.range + 0.5::DOUBLE AS y, b.range + 0.5::DOUBLE AS x FROM ring CROSS JOIN range({G}) a CROSS JOIN range({G}) b) q JOIN side s ON s.ring_id = q.ring_id WHERE {_CROSSED} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"


@query(f"WITH {GRID}, {_RING}, {_INNER} SELECT ring_id, year, lu, count(*) AS cells FROM inner_ i JOIN grid g ON g.r = i.r AND g.c = i.c GROUP BY 1, 2, 3")
def polygon_classes(spark, sf):
    """Cells of each class and year whose centres lie in each ring."""
    own = P.cells(_rings(spark, sf), G, G)
    return own.join(grid(spark, sf), ["r", "c"]).groupBy("ring_id", "year", "lu").agg(F.count("*").alias("cells"))


#: The cells of each row that a side passes, borders included.
_AT = "s.xa + (s.xb - s.xa) * (({} - s.ya) / (s.yb - s.ya))"
_BAND = f"SELECT s.*, r.range AS r, {_AT.format('greatest(least(s.ya, s.yb), CAST(r.range AS DOUBLE))')} AS p, {_AT.format('least(greatest(s.ya, s.yb), CAST(r.range + 1 AS DOUBLE))')} AS q FROM side s, range({G}) r WHERE r.range BETWEEN floor(least(s.ya, s.yb)) AND floor(greatest(s.ya, s.yb))"
_SPAN = "SELECT ring_id, r, CASE WHEN ya = yb THEN least(xa, xb) ELSE greatest(least(p, q), least(xa, xb)) END AS x0, CASE WHEN ya = yb THEN greatest(xa, xb) ELSE least(greatest(p, q), greatest(xa, xb)) END AS x1"


@query(
    f"WITH {_RING}, {_INNER}, met AS (SELECT DISTINCT ring_id, r, c.range AS c FROM ({_SPAN} FROM ({_BAND})), range({G}) c WHERE c.range BETWEEN floor(x0) AND floor(x1)), "
    "own AS (SELECT ring_id, r, c, 1 AS i, 0 AS m FROM inner_ UNION ALL SELECT ring_id, r, c, 0, 1 FROM met), one AS (SELECT ring_id, r, c, max(i) AS i, max(m) AS m FROM own GROUP BY 1, 2, 3) "
    "SELECT ring_id, count(*) FILTER (WHERE i = 1) AS inner_cells, count(*) AS touched_cells, CAST(sum(r) AS BIGINT) AS row_sum, CAST(sum(c) AS BIGINT) AS col_sum FROM one GROUP BY 1"
)
def polygon_cells(spark, sf):
    """How many cells lie in each ring by their centres, and how many when those that its sides pass count too."""
    rings = _rings(spark, sf)
    inner = P.cells(rings, G, G).groupBy("ring_id").agg(F.count("*").alias("inner_cells"))
    every = P.cells(rings, G, G, all_touched=True).groupBy("ring_id").agg(F.count("*").alias("touched_cells"), F.sum("r").alias("row_sum"), F.sum("c").alias("col_sum"))
    return every.join(inner, "ring_id", "left").select("ring_id", F.coalesce("inner_cells", F.lit(0)).alias("inner_cells"), "touched_cells", "row_sum", "col_sum")


_LINES = f"""{VERTICES}, line AS (SELECT pid, k, CAST(x AS DOUBLE) AS xa, CAST(y AS DOUBLE) AS ya, CAST(x1 AS DOUBLE) AS xb, CAST(y1 AS DOUBLE) AS yb FROM (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v WINDOW w AS (PARTITION BY pid ORDER BY k)) WHERE x1 IS NOT NULL AND (x1 <> x OR y1 <> y))"""


@query(
    f"WITH {_LINES}, {_RING}, d AS (SELECT l.pid, l.k, s.ring_id, l.xa, l.ya, l.xb, l.yb, (l.xb - l.xa) * (s.yb - s.ya) - (l.yb - l.ya) * (s.xb - s.xa) AS turn, (s.xa - l.xa) * (s.yb - s.ya) - (s.ya - l.ya) * (s.xb - s.xa) AS tn, (s.xa - l.xa) * (l.yb - l.ya) - (s.ya - l.ya) * (l.xb - l.xa) AS un FROM line l, side s WHERE turn <> 0), "
    "cut AS (SELECT DISTINCT pid, k, ring_id, tn / turn AS t FROM d WHERE tn / turn > 0 AND tn / turn < 1 AND un / turn >= 0 AND un / turn <= 1 UNION SELECT pid, k, ring_id, t FROM line, ring, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) x(t)), "
    "part AS (SELECT * FROM (SELECT *, lead(t) OVER (PARTITION BY pid, k, ring_id ORDER BY t) AS t1 FROM cut) WHERE t1 IS NOT NULL), "
    "q AS (SELECT part.*, xa + (xb - xa) * ((t + t1) / 2) AS x, ya + (yb - ya) * ((t + t1) / 2) AS y, sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) AS len FROM part JOIN line USING (pid, k)), "
    f"held AS (SELECT q.pid, q.k, q.ring_id, q.t, q.t1, q.len FROM q JOIN side s ON s.ring_id = q.ring_id WHERE {_CROSSED} GROUP BY ALL HAVING count(*) % 2 = 1) "
    "SELECT ring_id, pid, round(sum((t1 - t) * len), 6) AS length FROM held GROUP BY 1, 2"
)
def polygon_clip(spark, sf):
    """The length of each order's polyline inside each ring."""
    steps = N.steps(vertices(spark, sf)).where("len > 0").select("pid", "len", *(C(a).cast("double").alias(b) for a, b in (("x0", "xa"), ("y0", "ya"), ("x1", "xb"), ("y1", "yb"))))
    own = P.clipped(steps, F.broadcast(_rings(spark, sf)))  # a ring a nation: 25 rows
    return own.groupBy("ring_id", "pid").agg(F.round(F.sum((C("t1") - C("t0")) * C("len")), 6).alias("length"))
