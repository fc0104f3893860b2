"""Polylines, topology, the segment graph and its measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import focal
from ..operators import roads as N
from ..operators.cells import spine
from ..operators.durable import cut, materialise
from .base import VERTICES, read, sql_least, vertices
from .registry import query

C = F.col
#: Cities lie side by side, further apart than any board or search radius reaches.
_APART = 1 << 20
#: A board's places by a city's orders: its side grows so that places, and thus nodes, are as crowded in any table.
_PLACES = 7
_CITY_OF = "home AS (SELECT o_orderkey AS pid, CAST(coalesce(min(c_nationkey), -1) AS INT) AS city FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1)"
_CITY = (
    VERTICES.replace("v AS (", "own AS (", 1).replace(" % 64 AS INT)", " AS INT)") + f", {_CITY_OF}, "
    f"board AS (SELECT city, CAST(greatest(64, ceil(sqrt(CAST({_PLACES} * count(*) AS DOUBLE)))) AS INT) AS side FROM home GROUP BY 1), "
    f"v AS (SELECT coalesce(home.city, -1) AS city, own.pid, k, CAST(x % coalesce(side, 64) AS BIGINT) + {_APART} * coalesce(home.city, -1) AS x, y % coalesce(side, 64) AS y FROM own LEFT JOIN home ON home.pid = own.pid LEFT JOIN board ON board.city = coalesce(home.city, -1))"
)
#: The same with all cities on boards of one size, as surveyed: the more orders, the more segments meet at a node.
_CROWDED = (
    VERTICES.replace("v AS (", "own AS (", 1) + f", {_CITY_OF}, "
    f"v AS (SELECT coalesce(city, -1) AS city, own.pid, k, CAST(x AS BIGINT) + {_APART} * coalesce(city, -1) AS x, y FROM own LEFT JOIN home ON home.pid = own.pid)"
)
_STEPS = ", s AS (SELECT * FROM (SELECT pid, k, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, CAST(lead(x) OVER w AS DOUBLE) AS x1, CAST(lead(y) OVER w AS DOUBLE) AS y1 FROM v WINDOW w AS (PARTITION BY pid ORDER BY k)) WHERE x1 IS NOT NULL), l AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM s)"
_ARCS = _STEPS + ", a AS (SELECT *, sum(len) OVER (PARTITION BY pid ORDER BY k) - len AS before, sum(len) OVER (PARTITION BY pid) AS total FROM l)"
_ENDS = ", e AS (SELECT pid * 2 AS eid, pid, x, y FROM v WHERE k = 0 AND pid IN (SELECT pid FROM v GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT pid * 2 + 1, pid, arg_max(x, k), arg_max(y, k) FROM v GROUP BY pid HAVING count(*) > 1)"


def _nodes_sql(radius: float, city: str = _CITY) -> str:
    """The ends of all polylines merged within the radius (under 2): places are whole numbers, so partners are at most a step away."""
    return (
        f"RECURSIVE {city}{_ENDS}, place AS (SELECT x, y, min(eid) AS eid FROM e GROUP BY 1, 2), "
        f"beside AS (SELECT p.eid AS a, n.eid AS b FROM place p CROSS JOIN range(-1, 2) i CROSS JOIN range(-1, 2) j JOIN place n ON n.x = p.x + i.range AND n.y = p.y + j.range "
        f"WHERE n.eid <> p.eid AND (n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y) <= {radius * radius}), "
        + sql_least("merged", "SELECT eid AS id FROM place", "beside")
        + ", m AS (SELECT root AS nid, e.* FROM e JOIN place ON place.x = e.x AND place.y = e.y JOIN merged ON merged.id = place.eid), "
        "pn AS (SELECT a.pid, a.nid AS na, b.nid AS nb FROM m a JOIN m b ON a.pid = b.pid AND a.eid % 2 = 0 AND b.eid % 2 = 1)"
    )


_NODES, _MEETING = _nodes_sql(0.3), _nodes_sql(0.3, _CROWDED)


def _city_of(spark, sf):
    """pid, city: the nation of the customer of every order; -1 where there is none."""
    orders, customer = read(spark, sf, "orders"), read(spark, sf, "customer")
    home = orders.select(C("o_orderkey").alias("pid"), "o_custkey").join(customer.select(C("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    return home.groupBy("pid").agg(F.coalesce(F.min("c_nationkey"), F.lit(-1)).cast("int").alias("city"))


def _boards(spark, sf):
    """city, side: at most a row for each nation."""
    return _city_of(spark, sf).groupBy("city").agg(F.greatest(F.lit(64), F.ceil(F.sqrt((F.count("*") * _PLACES).cast("double")))).cast("int").alias("side"))


def _city_vertices(spark, sf, grown=True):
    """city and the vertices of all orders; no two cities share a node.  Boards grow with their cities or are all of one size."""
    if not grown:
        own = vertices(spark, sf).join(_city_of(spark, sf), "pid", "left").withColumn("city", F.coalesce("city", F.lit(-1)))
        return own.select("city", "pid", "k", (C("x") + C("city") * _APART).alias("x"), "y")
    own = vertices(spark, sf, None).join(_city_of(spark, sf), "pid", "left").withColumn("city", F.coalesce("city", F.lit(-1)))
    side = F.coalesce("side", F.lit(64))
    return own.join(F.broadcast(_boards(spark, sf)), "city", "left").select("city", "pid", "k", (C("x") % side + C("city") * _APART).alias("x"), (C("y") % side).alias("y"))


@query(f"WITH {VERTICES}{_STEPS}, p AS (SELECT pid, x0, y0, x1, y1, i.range AS i, greatest(CAST(trunc(len) AS INT) * 3, 3) AS n FROM l, LATERAL range(greatest(CAST(trunc(len) AS INT) * 3, 3)) i) SELECT DISTINCT pid, CAST(round_even(y0 + (y1 - y0) * (CAST(i AS DOUBLE) / (n - 1)), 0) AS INT) AS r, CAST(round_even(x0 + (x1 - x0) * (CAST(i AS DOUBLE) / (n - 1)), 0) AS INT) AS c FROM p")
def line_rasterise(spark, sf):
    return N.rasterise(vertices(spark, sf), 64, 64)


@query(f"WITH {VERTICES}{_STEPS} SELECT pid, k, round(len, 6) AS len, round(sum(len) OVER (PARTITION BY pid ORDER BY k), 6) AS through FROM l")
def arc_length(spark, sf):
    own = N.arcs(vertices(spark, sf))
    return own.select("pid", "k", F.round("len", 6).alias("len"), F.round(C("before") + C("len"), 6).alias("through"))


@query(f"WITH {VERTICES}{_ARCS}, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY k) AS j FROM a WHERE len > 0 AND total / 2 >= before AND total / 2 <= before + len) WHERE j = 1) SELECT pid, round(x0 + (x1 - x0) * ((total / 2 - before) / len), 5) AS x, round(y0 + (y1 - y0) * ((total / 2 - before) / len), 5) AS y FROM m")
def arc_midpoint(spark, sf):
    own = vertices(spark, sf)
    half = N.arcs(own).groupBy("pid").agg((F.max("total") / 2).alias("d")).where("d > 0").select("pid", F.lit(0).alias("i"), "d")
    return N.along(own, half).select("pid", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(f"WITH {VERTICES}{_ARCS}, t AS (SELECT pid, max(total) AS total, greatest(5, least(200, CAST(trunc(max(total)) AS INT))) AS n FROM a GROUP BY 1 HAVING max(total) >= 1), d AS (SELECT pid, i.range AS i, CASE WHEN i.range = n - 1 THEN total - 1e-9::DOUBLE ELSE i.range * total / (n - 1) END AS d FROM t, LATERAL range(n) i), f AS (SELECT d.pid, d.i, d.d, a.*, row_number() OVER (PARTITION BY d.pid, d.i ORDER BY k) AS j FROM d JOIN a ON a.pid = d.pid AND len > 0 AND d.d >= before AND d.d <= before + len), x AS (SELECT pid, CAST(round_even(x0 + (x1 - x0) * ((d - before) / len), 0) AS INT) AS c, CAST(round_even(y0 + (y1 - y0) * ((d - before) / len), 0) AS INT) AS r FROM f WHERE j = 1), h AS (SELECT pid, avg(CASE WHEN (r + c) % 2 = 0 AND r BETWEEN 0 AND 63 AND c BETWEEN 0 AND 63 THEN 1.0 ELSE 0.0 END) AS hit FROM x GROUP BY 1) SELECT v.pid, round(coalesce(max(hit), 0), 4) AS hit FROM v LEFT JOIN h ON h.pid = v.pid GROUP BY 1")
def line_hit_ratio(spark, sf):
    board = spine(spark, 64, 64).where((C("r") + C("c")) % 2 == 0)
    return N.hit_ratio(vertices(spark, sf), board).select("pid", F.round("hit", 4).alias("hit"))


@query(f"WITH {_NODES} SELECT nid, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(DISTINCT pid) AS degree FROM m GROUP BY 1")
def endpoint_topology(spark, sf):
    nodes, _ = N.topology(_city_vertices(spark, sf), 0.3)
    return nodes.select("nid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "degree")


@query(f"WITH {_nodes_sql(1.5)} SELECT a, b FROM beside WHERE a < b UNION ALL SELECT place.eid, e.eid FROM e JOIN place ON e.x = place.x AND e.y = place.y AND e.eid <> place.eid")
def distance_join(spark, sf):
    return N.within(N.endpoints(_city_vertices(spark, sf)).select("eid", "x", "y"), 1.5)


_LINKED = _nodes_sql(1.5) + ", line AS (SELECT na AS a, nb AS b FROM pn UNION SELECT nb, na FROM pn), " + sql_least("joined", "SELECT a AS id FROM line", "line")


@query(f"WITH {_LINKED}, z AS (SELECT pid, root AS component FROM pn JOIN joined ON joined.id = na) SELECT pid, component FROM z WHERE component = (SELECT component FROM z GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)")
def largest_component(spark, sf):
    _, poly_nodes = N.topology(_city_vertices(spark, sf), 1.5)
    return N.largest_component(poly_nodes)


_EDGE = f"(x - {_APART} * floor(x / {_APART}) <= 2 OR y <= 2 OR x - {_APART} * floor(x / {_APART}) >= coalesce(side, 64) - 3 OR y >= coalesce(side, 64) - 3)"


def _at_edge(nodes, spark, sf):
    """nodes with boundary: within a few places of the border of their city's board."""
    home = F.floor(C("x") / _APART)
    x, last = C("x") - home * _APART, F.coalesce("side", F.lit(64)) - 3
    return nodes.withColumn("home", home.cast("int")).join(F.broadcast(_boards(spark, sf).withColumnRenamed("city", "home")), "home", "left").withColumn("boundary", (x <= 2) | (C("y") <= 2) | (x >= last) | (C("y") >= last))


@query(f"WITH {_NODES}, b AS (SELECT nid, avg(x) AS x, avg(y) AS y, count(DISTINCT pid) AS degree FROM m GROUP BY 1) SELECT nid, degree, {_EDGE} AS boundary, degree = 1 AS dead_end FROM b LEFT JOIN board ON board.city = floor(x / {_APART})")
def boundary_nodes(spark, sf):
    nodes, _ = N.topology(_city_vertices(spark, sf), 0.3)
    return _at_edge(nodes, spark, sf).select("nid", "degree", "boundary", (C("degree") == 1).alias("dead_end"))


_SEG = ", per AS (SELECT pid, count(*) - 1 AS parts FROM v GROUP BY 1), len AS (SELECT pid, max(total) AS total FROM a GROUP BY 1), dir AS (SELECT v.pid, max(CASE WHEN k = 0 THEN x END) ax, max(CASE WHEN k = 0 THEN y END) ay, max(CASE WHEN k = least(3, parts) THEN x END) a1x, max(CASE WHEN k = least(3, parts) THEN y END) a1y, max(CASE WHEN k = parts THEN x END) bx, max(CASE WHEN k = parts THEN y END) by_, max(CASE WHEN k = parts - least(3, parts) THEN x END) b1x, max(CASE WHEN k = parts - least(3, parts) THEN y END) b1y FROM v JOIN per ON per.pid = v.pid GROUP BY 1), sd AS (SELECT pn.pid, total, na AS n, a1x - ax AS dx, a1y - ay AS dy FROM pn JOIN dir USING (pid) JOIN len USING (pid) WHERE na <> nb AND total > 0 UNION ALL SELECT pn.pid, total, nb, b1x - bx, b1y - by_ FROM pn JOIN dir USING (pid) JOIN len USING (pid) WHERE na <> nb AND total > 0), ae AS (SELECT a.pid AS src, b.pid AS dst, min((180 - degrees(acos(greatest(-1, least(1, CAST(a.dx * b.dx + a.dy * b.dy AS DOUBLE) / (sqrt(CAST(a.dx * a.dx + a.dy * a.dy AS DOUBLE)) * sqrt(CAST(b.dx * b.dx + b.dy * b.dy AS DOUBLE)))))))) / 90) AS ang, min((a.total + b.total) / 2) AS geo FROM sd a JOIN sd b ON a.n = b.n AND a.pid < b.pid WHERE (a.dx <> 0 OR a.dy <> 0) AND (b.dx <> 0 OR b.dy <> 0) GROUP BY 1, 2)"


def _cities(spark, sf, grown=True):
    """Nodes, ends and segments (with their city) of all orders' polylines, each city a graph of its own; line items are shuffled once."""
    shapes = materialise(N.shapes(_city_vertices(spark, sf, grown), ["city"]))
    nodes, poly_nodes = N.merged(N.ends_of(shapes), 0.3)
    return nodes, poly_nodes, N.segments_of(shapes, more=["city"])


@query(f"WITH {_MEETING}{_ARCS}{_SEG} SELECT src, dst, round(ang, 4) AS ang, round(geo, 5) AS geo FROM ae")
def angular_edges(spark, sf):
    _, poly_nodes, segs = _cities(spark, sf, grown=False)
    return N.angular_edges(segs, poly_nodes).select("src", "dst", F.round("ang", 4).alias("ang"), F.round("geo", 5).alias("geo"))


@query(f"WITH {_MEETING}{_ARCS}{_SEG} SELECT count(*) FILTER (WHERE ang < 0.499999) AS straight, count(*) FILTER (WHERE ang >= 0.499999 AND ang < 1.499999) AS turning, count(*) FILTER (WHERE ang >= 1.499999) AS back FROM ae")
def cost_bins(spark, sf):
    _, poly_nodes, segs = _cities(spark, sf, grown=False)
    return N.cost_bins(segs, poly_nodes)


@query(f"WITH {VERTICES}{_STEPS}, p AS (SELECT pid, x0, y0, x1, y1, i.range AS i, greatest(CAST(trunc(len) AS INT) * 3, 3) AS n FROM l, LATERAL range(greatest(CAST(trunc(len) AS INT) * 3, 3)) i), px AS (SELECT DISTINCT pid, CAST(round_even(y0 + (y1 - y0) * (CAST(i AS DOUBLE) / (n - 1)), 0) AS INT) AS r, CAST(round_even(x0 + (x1 - x0) * (CAST(i AS DOUBLE) / (n - 1)), 0) AS INT) AS c FROM p) SELECT DISTINCT CAST((r + a.range) * 64 + c + b.range AS BIGINT) AS cell, pid FROM px, range(-1, 2) a, range(-1, 2) b WHERE r + a.range BETWEEN 0 AND 63 AND c + b.range BETWEEN 0 AND 63")
def cell_links(spark, sf):
    return N.cell_links(vertices(spark, sf), 64, 64)


_PX = f"{VERTICES}{_STEPS}, p AS (SELECT pid, x0, y0, x1, y1, i.range AS i, greatest(CAST(trunc(len) AS INT) * 2, 3) AS n FROM l, LATERAL range(greatest(CAST(trunc(len) AS INT) * 2, 3)) i), px AS (SELECT DISTINCT pid, CAST(round_even(y0 + (y1 - y0) * (CAST(i AS DOUBLE) / (n - 1)), 0) AS INT) AS r, CAST(round_even(x0 + (x1 - x0) * (CAST(i AS DOUBLE) / (n - 1)), 0) AS INT) AS c FROM p)"


@query(f"WITH {_PX} SELECT r, c, max(pid) AS value, count(*) AS presence FROM px GROUP BY 1, 2")
def scatter_max(spark, sf):
    return N.rasterise(vertices(spark, sf), 64, 64, per=2).groupBy("r", "c").agg(F.max("pid").alias("value"), F.count("*").alias("presence"))


def _kernel_sql(sigma):
    return "kn(d, w) AS (VALUES " + ", ".join(f"({d}, CAST({w!r} AS DOUBLE))" for d, w in focal.gaussian_kernel(sigma).items()) + ")"


@query(
    f"WITH pt AS (SELECT CAST(l_partkey % 64 AS INT) AS r, CAST(l_suppkey % 64 AS INT) AS c, CAST(max(l_orderkey % 100) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2), {_kernel_sql(5.0)}, h AS (SELECT q.q + d AS r, c, sum(v * w) AS v, sum(w) AS p FROM (SELECT unnest([r, -r - 1, 127 - r]) AS q, c, v FROM pt) q, kn WHERE q.q + d BETWEEN 0 AND 63 GROUP BY 1, 2), g AS (SELECT r, q.q + d AS c, sum(v * w) AS v, sum(p * w) AS p FROM (SELECT r, unnest([c, -c - 1, 127 - c]) AS q, v, p FROM h) q, kn WHERE q.q + d BETWEEN 0 AND 63 GROUP BY 1, 2) SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(CASE WHEN p > 1e-9 THEN v / p ELSE 0 END, 6) AS value FROM g"
)
def gaussian_diffuse(spark, sf):
    points = read(spark, sf, "lineitem").groupBy((C("l_partkey") % 64).cast("int").alias("r"), (C("l_suppkey") % 64).cast("int").alias("c")).agg(F.max(C("l_orderkey") % 100).cast("double").alias("value"))
    return focal.diffuse(points.withColumn("year", F.lit(0)), "value", 64, 64, 5.0).select("r", "c", F.round("value", 6).alias("value"))


#: More sources than a city has segments: betweenness is not sampled.
_ALL = 1 << 31


#: Six radii in the proportions of 1 to 5 km and the two of choice, in the board's units; measures of each.
RADII, CHOICE_RADII = (60, 90, 120, 180, 240, 300), (60, 120)
MEASURES = ("nc", "td", "tl", "md", "integration", "nain")
METRICS = [*(f"r{r}_{m}" for r in RADII for m in MEASURES), *(f"r{r}_{m}" for r in CHOICE_RADII for m in ("choice", "nach"))]
#: Width of the diffusion in cells.
SIGMA = 5.0


def _searched(spark, sf):
    """The segments that meet others, their edges and their small components: all of it written once for several searches."""
    _, poly_nodes, segs = _cities(spark, sf)
    edges = materialise(N.angular_edges(segs, poly_nodes, ["city"]))
    met = edges.select(F.explode(F.array("src", "dst")).alias("pid")).distinct()
    segs = materialise(segs.join(met, "pid", "left_semi").select("city", "pid", "length", "xm", "ym"))
    return segs, edges, N.whole_components(edges)


@query()
def graph_metrics(spark, sf):
    segs, edges, bundles = _searched(spark, sf)
    return N.graph_metrics(edges, segs, [float(r) for r in RADII], bundles=bundles)


@query()
def betweenness(spark, sf):
    segs, edges, bundles = _searched(spark, sf)
    return N.betweenness(edges, float(CHOICE_RADII[1]), sources=_ALL, places=segs, bundles=bundles)


@query()
def syntax_wide(spark, sf):
    """The forty measures of each segment."""
    segs, edges, bundles = _searched(spark, sf)
    metrics = N.graph_metrics(edges, segs, [float(r) for r in RADII], bundles=bundles)
    wide = metrics.groupBy("city", "pid").agg(*(F.max(F.when(C("radius") == r, C(m))).alias(f"r{r}_{m}") for r in RADII for m in MEASURES))
    for r in CHOICE_RADII:
        wide = wide.join(N.betweenness(edges, float(r), sources=_ALL, places=segs, bundles=bundles).withColumnRenamed("choice", f"r{r}_choice"), ["city", "pid"])
    return wide.select("city", "pid", *(N.nach(C(f"{m[:-5]}_choice"), C(f"{m[:-5]}_td")).alias(m) if m.endswith("_nach") else C(m) for m in METRICS))


@query()
def syntax_cells(spark, sf):
    """Eighty columns of each cell: logs of the segments' measures, the largest of a pixel, diffused and as largest nearby."""
    logs = syntax_wide(spark, sf).select("pid", *(F.log1p(F.greatest(C(m), F.lit(0.0))).alias(m) for m in METRICS))
    roads = N.lines(vertices(spark, sf)).join(logs, "pid", "left")
    pixels = N.pixels(roads, 64, 64, per=2).select(F.explode("cells").alias("cell"), *METRICS)
    # a road without a measure is a road all the same
    most = pixels.groupBy("cell").agg(*(F.coalesce(F.max(m), F.lit(0.0)).alias(m) for m in METRICS))
    scattered = cut(most.select(F.expr("cast(cell div 64 as int)").alias("r"), (C("cell") % 64).alias("c"), *METRICS, F.lit(0).alias("year")))
    mean = focal.diffuse(scattered, METRICS, 64, 64, SIGMA)
    board = spine(spark, 64, 64).withColumn("year", F.lit(0)).join(scattered, ["year", "r", "c"], "left").na.fill(0.0, METRICS)
    most = focal.box(board, METRICS, [int(SIGMA)], how=F.max)
    return mean.select("r", "c", *(C(m).alias(f"mean_{m}") for m in METRICS)).join(most.select("r", "c", *(C(f"{m}_{int(SIGMA)}").alias(f"max_{m}") for m in METRICS)), ["r", "c"])


@query()
def road_closure(spark, sf):
    nodes, poly_nodes, segs = _cities(spark, sf)
    polys = segs.select("city", "pid", (C("pid") % 7).cast("int").alias("grade"), (C("pid") % 11).cast("string").alias("name"), "length", (C("pid") % 3 != 0).alias("alive"))
    return N.close_roads(polys, poly_nodes, _at_edge(nodes, spark, sf))
