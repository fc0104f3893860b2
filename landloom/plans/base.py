"""Derived inputs: grids, periods, polylines and panels out of the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import morphology as M

G = 64
SEEDS, RADIUS, LARGEST = (1, 2), 2, 3


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- grids


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """year, r, c, lu of the occupied cells."""
    line = read(spark, sf, "lineitem")
    return (
        line.groupBy(
            F.year("l_shipdate").alias("year"),
            ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % G).cast("int").alias("r"),
            ((F.col("l_partkey") * 5 + F.col("l_suppkey")) % G).cast("int").alias("c"),
        )
        .agg((F.sum(F.col("l_partkey") + F.col("l_suppkey")) % 7).cast("int").alias("lu"))
    )


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """year, r, c, lu of every cell of the grid."""
    return C.on_spine(cells(spark, sf), G, G)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """y1, r, c, lu1, lu2 of consecutive years."""
    full = grid(spark, sf)
    later = full.select((F.col("year") - 1).alias("y1"), "r", "c", F.col("lu").alias("lu2"))
    return full.select(F.col("year").alias("y1"), "r", "c", F.col("lu").alias("lu1")).join(later, ["y1", "r", "c"])


def extents(spark: SparkSession, sf: str) -> DataFrame:
    """year, r, c of the built-up extents."""
    return M.extent(grid(spark, sf), G, G, RADIUS, LARGEST, SEEDS)


CELLS = f"""cells AS (SELECT CAST(year(l_shipdate) AS INT) AS year, CAST((l_orderkey * 7 + l_linenumber * 3) % {G} AS INT) AS r,
 CAST((l_partkey * 5 + l_suppkey) % {G} AS INT) AS c, CAST(sum(l_partkey + l_suppkey) % 7 AS INT) AS lu FROM lineitem GROUP BY 1, 2, 3)"""
GRID = CELLS + f""", grid AS (SELECT y.year, CAST(a.range AS INT) AS r, CAST(b.range AS INT) AS c, coalesce(k.lu, 0) AS lu
 FROM (SELECT DISTINCT year FROM cells) y CROSS JOIN range({G}) a CROSS JOIN range({G}) b LEFT JOIN cells k ON k.year = y.year AND k.r = a.range AND k.c = b.range)"""
PAIRS = GRID + """, pairs AS (SELECT a.year AS y1, a.r, a.c, a.lu AS lu1, b.lu AS lu2 FROM grid a JOIN grid b ON b.year = a.year + 1 AND a.r = b.r AND a.c = b.c)"""


def sql_dilate(name: str, mask: str, offs: str) -> str:
    return f"{name} AS (SELECT DISTINCT year, r + dr AS r, c + dc AS c FROM {mask}, {offs} WHERE r + dr BETWEEN 0 AND {G - 1} AND c + dc BETWEEN 0 AND {G - 1})"


def sql_erode(name: str, mask: str, offs: str) -> str:
    return f"{name} AS (SELECT year, r + dr AS r, c + dc AS c FROM {mask}, {offs} WHERE r + dr BETWEEN 0 AND {G - 1} AND c + dc BETWEEN 0 AND {G - 1} GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM {offs}))"


def sql_disk(name: str, radius: int) -> str:
    return f"{name} AS (SELECT CAST(x.range AS INT) AS dr, CAST(y.range AS INT) AS dc FROM range({-radius}, {radius + 1}) x, range({-radius}, {radius + 1}) y WHERE x.range * x.range + y.range * y.range <= {radius * radius})"


def sql_reach(name: str, mask: str, start: str, near: str) -> str:
    """Cells of mask that steps (near: |dr|, |dc| condition) lead to from start's condition."""
    return f"{name} AS (SELECT year, r, c FROM {mask} WHERE {start} UNION SELECT m.year, m.r, m.c FROM {name} p JOIN {mask} m ON m.year = p.year AND m.r BETWEEN p.r - 1 AND p.r + 1 AND m.c BETWEEN p.c - 1 AND p.c + 1 AND {near})"


FOUR, EIGHT = "abs(m.r - p.r) + abs(m.c - p.c) = 1", "abs(m.r - p.r) + abs(m.c - p.c) > 0"


def sql_label(name: str, mask: str, near: str = EIGHT) -> str:
    """(year, r, c, comp): comp is the smallest r * G + c that steps reach."""
    return (
        f"{name}_w AS (SELECT year, r, c, r * {G} + c AS root FROM {mask} UNION SELECT m.year, m.r, m.c, p.root FROM {name}_w p JOIN {mask} m ON m.year = p.year AND m.r BETWEEN p.r - 1 AND p.r + 1 AND m.c BETWEEN p.c - 1 AND p.c + 1 AND {near}), "
        f"{name} AS (SELECT year, r, c, CAST(min(root) AS BIGINT) AS comp FROM {name}_w GROUP BY 1, 2, 3)"
    )


def sql_least(name: str, start: str, edges: str) -> str:
    """name(id, root): the smallest id that edges(a, b), given in both directions, lead to from each id of start."""
    return (
        f"{name}(id, root) USING KEY (id) AS (SELECT id, id FROM ({start}) UNION (SELECT e.b, min(w.root) FROM {name} w JOIN {edges} e ON e.a = w.id "
        f"JOIN recurring.{name} k ON k.id = e.b WHERE w.root < k.root GROUP BY e.b))"
    )


BORDER = f"(r IN (0, {G - 1}) OR c IN (0, {G - 1}))"
CLOSED = "RECURSIVE " + GRID + ", " + ", ".join([
    sql_disk("disk", RADIUS), f"seed AS (SELECT year, r, c FROM grid WHERE lu IN {SEEDS})", sql_dilate("dil", "seed", "disk"), sql_erode("ero", "dil", "disk"),
    "closed AS (SELECT year, r, c FROM ero UNION SELECT year, r, c FROM seed)",
])
HOLES = CLOSED + ", " + ", ".join([
    "back AS (SELECT g.year, g.r, g.c FROM grid g ANTI JOIN closed k ON k.year = g.year AND k.r = g.r AND k.c = g.c)",
    sql_reach("open_", "back", BORDER, FOUR),
    "hole AS (SELECT b.year, b.r, b.c FROM back b ANTI JOIN open_ o ON b.year = o.year AND b.r = o.r AND b.c = o.c)",
])
EXTENT = HOLES + ", " + ", ".join([
    sql_label("hl", "hole"), f"small AS (SELECT year, comp FROM hl GROUP BY 1, 2 HAVING count(*) <= {LARGEST})",
    "extent AS (SELECT year, r, c FROM closed UNION ALL SELECT h.year, h.r, h.c FROM hl h JOIN small s ON s.year = h.year AND s.comp = h.comp)",
])

# ---------------------------------------------------------------- panels


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """nation, region, year, n, value: orders of a nation's customers by year (value in cents, whole numbers)."""
    orders, customer = read(spark, sf, "orders"), read(spark, sf, "customer")
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    dims = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name"))  # 25 rows
    own = orders.join(customer, orders.o_custkey == customer.c_custkey).join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    return own.groupBy(F.col("n_nationkey").cast("int").alias("city"), F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("updates"), F.sum(F.round(F.col("o_totalprice").cast("double") * 100).cast("long")).alias("value"), F.count_distinct("c_custkey").alias("people"),
    )


PANEL = """panel AS (SELECT CAST(n_nationkey AS INT) AS city, n_name AS name, r_name AS region, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n,
 count(*) FILTER (WHERE o_orderstatus = 'O') AS updates, CAST(sum(CAST(round(CAST(o_totalprice AS DOUBLE) * 100) AS BIGINT)) AS BIGINT) AS value, count(DISTINCT c_custkey) AS people
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4)"""


def moves(spark: SparkSession, sf: str) -> DataFrame:
    """user, day (1 to 30), from_class, to_class: each event of a user after its predecessor."""
    events = read(spark, sf, "events")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("user_id").alias("city"), F.dayofmonth("ts").cast("int").alias("day"), before.alias("from_class"), F.col("event_type").alias("to_class")).where("from_class is not null")


MOVES = """moves AS (SELECT * FROM (SELECT user_id AS city, CAST(day(ts) AS INT) AS day, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_class, event_type AS to_class FROM events) WHERE from_class IS NOT NULL)"""

# ---------------------------------------------------------------- polylines


def vertices(spark: SparkSession, sf: str, side: int | None = 64) -> DataFrame:
    """pid, k (from 0), x, y: the points of each order's polyline, on a board of ``side`` places or as they are given."""
    line = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pid"), "l_linenumber", "l_partkey", "l_suppkey")
    order = Window.partitionBy("pid").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    # places after the window: its shuffle has four columns and serves what follows by pid
    placed = line.withColumn("k", (F.row_number().over(order) - 1).cast("int"))
    return placed.select("pid", "k", *((F.col(c) % side if side else F.col(c)).cast("int").alias(n) for c, n in (("l_partkey", "x"), ("l_suppkey", "y"))))


VERTICES = """v AS (SELECT l_orderkey AS pid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS k,
 CAST(l_partkey % 64 AS INT) AS x, CAST(l_suppkey % 64 AS INT) AS y FROM lineitem)"""
