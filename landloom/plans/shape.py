"""Morphology, components and city extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import components as K
from ..operators import extraction as X
from ..operators import morphology as M
from .base import CLOSED, EIGHT, EXTENT, FOUR, GRID, HOLES, G, extents, grid, sql_dilate, sql_disk, sql_label
from .registry import query


def _mask(spark, sf, *classes):
    return grid(spark, sf).where(F.col("lu").isin(*classes)).select("year", "r", "c")


def _seed(name, *classes):
    return f"{name} AS (SELECT year, r, c FROM grid WHERE lu IN ({', '.join(map(str, classes))}))"


@query(f"WITH {GRID}, {_seed('m', 1)}, {sql_disk('d3', 3)}, {sql_dilate('o', 'm', 'd3')} SELECT * FROM o")
def disk_dilation(spark, sf):
    return M.dilate_disk(_mask(spark, sf, 1), 3, G, G)


@query(f"WITH {CLOSED} SELECT * FROM closed")
def closing_or_seed(spark, sf):
    return M.close(_mask(spark, sf, 1, 2), 2, G, G)


@query(f"WITH {HOLES} SELECT year, r, c FROM closed UNION ALL SELECT * FROM hole")
def fill_holes(spark, sf):
    return M.fill_holes(M.close(_mask(spark, sf, 1, 2), 2, G, G), grid(spark, sf), G, G)


@query(f"WITH {EXTENT} SELECT h.year, h.comp, count(*) AS area, bool_or(s.comp IS NOT NULL) AS filled FROM hl h LEFT JOIN small s ON s.year = h.year AND s.comp = h.comp GROUP BY 1, 2")
def fill_small_holes(spark, sf):
    inner = M.holes(M.close(_mask(spark, sf, 1, 2), 2, G, G), grid(spark, sf), G, G)
    return K.grid_components(inner, G, G).groupBy("year", "comp").agg(F.count("*").alias("area")).withColumn("filled", F.col("area") <= 3)


@query(f"WITH {EXTENT} SELECT * FROM extent")
def dynamic_extent(spark, sf):
    return extents(spark, sf)


@query(f"WITH RECURSIVE {GRID}, {_seed('m', 1, 2)}, {sql_label('l', 'm')} SELECT year, comp, count(*) AS area, min(r) AS row_min, min(c) AS col_min, max(r) AS row_max, max(c) AS col_max, CAST(floor(avg(r)) AS INT) AS row_mid, CAST(floor(avg(c)) AS INT) AS col_mid FROM l GROUP BY 1, 2")
def components_sizes(spark, sf):
    return K.component_sizes(K.grid_components(_mask(spark, sf, 1, 2), G, G, tile=24))  # tiles that do not divide the grid


@query(f"WITH RECURSIVE {GRID}, {_seed('m', 1, 2)}, {sql_label('l', 'm')}, s AS (SELECT year, comp FROM l GROUP BY 1, 2 HAVING count(*) >= 5) SELECT l.year, r, c, CAST(dense_rank() OVER (PARTITION BY l.year ORDER BY l.comp) AS INT) AS label FROM l JOIN s ON s.year = l.year AND s.comp = l.comp")
def components_filtered_relabel(spark, sf):
    return X.relabel(K.grid_components(_mask(spark, sf, 1, 2), G, G), 5)


@query(f"WITH RECURSIVE {GRID}, {_seed('m', 1, 2)}, {sql_label('l', 'm')}, s AS (SELECT year, comp, count(*) AS n FROM l GROUP BY 1, 2) SELECT year, count(*) AS components, CAST(sum(n) AS BIGINT) AS total_cells, max(n) AS largest_cells FROM s GROUP BY 1")
def component_stats(spark, sf):
    sizes = K.grid_components(_mask(spark, sf, 1, 2), G, G).groupBy("year", "comp").agg(F.count("*").alias("n"))
    return sizes.groupBy("year").agg(F.count("*").alias("components"), F.sum("n").alias("total_cells"), F.max("n").alias("largest_cells"))


@query(f"WITH RECURSIVE {GRID}, {_seed('m', 1, 2)}, {sql_label('l', 'm')}, box AS (SELECT year, comp, count(*) AS n, bool_or(r = 32 AND c = 32) AS here FROM l WHERE r BETWEEN 20 AND 44 AND c BETWEEN 20 AND 44 GROUP BY 1, 2), k AS (SELECT year, comp, row_number() OVER (PARTITION BY year ORDER BY here DESC, n DESC, comp) AS k FROM box) SELECT l.year, l.r, l.c, l.comp FROM l JOIN k ON k.year = l.year AND k.comp = l.comp AND k.k = 1")
def anchor_component(spark, sf):
    return X.anchored(K.grid_components(_mask(spark, sf, 1, 2), G, G), 32, 32, 12)


@query(f"WITH RECURSIVE {GRID}, {_seed('m', 1, 2)}, {sql_label('l', 'm')}, z AS (SELECT year, comp, count(*) AS n FROM l GROUP BY 1, 2), b AS (SELECT year, comp FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, comp) AS k FROM z) WHERE k = 1), body AS (SELECT l.year, l.r, l.c FROM l JOIN b ON b.year = l.year AND b.comp = l.comp), {sql_disk('d4', 4)}, {sql_dilate('near', 'body', 'd4')}, keep AS (SELECT DISTINCT l.year, l.comp FROM l JOIN near n ON n.year = l.year AND n.r = l.r AND n.c = l.c) SELECT l.year, l.r, l.c, l.comp FROM l JOIN keep k ON k.year = l.year AND k.comp = l.comp")
def enclave_filter(spark, sf):
    return X.without_enclaves(K.grid_components(_mask(spark, sf, 1, 2), G, G), 4, G, G)


@query(f"WITH RECURSIVE {GRID}, {_seed('road', 5)}, {_seed('built', 1, 2)}, {sql_disk('d1', 1)}, {sql_dilate('near', 'road', 'd1')}, {sql_label('l', 'built')}, ok AS (SELECT DISTINCT l.year, l.comp FROM l JOIN near n ON n.year = l.year AND n.r = l.r AND n.c = l.c) SELECT l.year, l.r, l.c, (ok.comp IS NULL) AS isolated FROM l LEFT JOIN ok ON ok.year = l.year AND ok.comp = l.comp")
def reachability_isolated(spark, sf):
    return X.isolated(_mask(spark, sf, 1, 2), _mask(spark, sf, 5), G, G)


@query(f"WITH {GRID} SELECT year, br, bc, lu FROM (SELECT year, r // 10 AS br, c // 10 AS bc, lu, row_number() OVER (PARTITION BY year, r // 10, c // 10 ORDER BY count(*) DESC, lu) AS k FROM grid GROUP BY 1, 2, 3, 4) WHERE k = 1")
def block_mode(spark, sf):
    return X.block_mode(grid(spark, sf), 10)


@query(f"WITH {GRID} SELECT year, r // 10 AS br, c // 10 AS bc, round(avg(CASE WHEN lu IN (1, 2) THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN lu IN (1, 2) THEN 1.0 ELSE 0.0 END) >= 0.3 AS inside FROM grid GROUP BY 1, 2, 3")
def block_mean(spark, sf):
    return X.block_mean(grid(spark, sf).withColumn("inside", F.col("lu").isin(1, 2)), 10, 0.3)


_EVER = "ever AS (SELECT 0 AS year, r, c FROM grid WHERE lu IN (1, 2) GROUP BY r, c HAVING count(*) >= 3)"


@query("WITH RECURSIVE " + GRID + f", {_EVER}, whole AS (SELECT DISTINCT 0 AS year, r, c FROM grid), back AS (SELECT w.year, w.r, w.c FROM whole w ANTI JOIN ever e ON e.r = w.r AND e.c = w.c), op AS (SELECT year, r, c FROM back WHERE r IN (0, {G - 1}) OR c IN (0, {G - 1}) UNION SELECT m.year, m.r, m.c FROM op p JOIN back m ON m.r BETWEEN p.r - 1 AND p.r + 1 AND m.c BETWEEN p.c - 1 AND p.c + 1 AND {FOUR}), filled AS (SELECT year, r, c FROM ever UNION ALL SELECT b.year, b.r, b.c FROM back b ANTI JOIN op o ON o.r = b.r AND o.c = b.c), sq AS (SELECT CAST(x.range AS INT) AS dr, CAST(y.range AS INT) AS dc FROM range(-1, 2) x, range(-1, 2) y), {sql_dilate('out_', 'filled', 'sq')} SELECT r, c FROM out_")
def ever_urban(spark, sf):
    return X.ever_urban(grid(spark, sf), (1, 2), 3, 1, G, G)


@query(f"WITH RECURSIVE {GRID}, m AS (SELECT year, r, c FROM grid WHERE year = 2001 AND lu IN (1, 2, 3)), {sql_label('l', 'm')}, box AS (SELECT comp, count(*) AS n, bool_or(r = 32 AND c = 32) AS here FROM l WHERE r BETWEEN 20 AND 44 AND c BETWEEN 20 AND 44 GROUP BY 1), k AS (SELECT comp FROM box ORDER BY here DESC, n DESC, comp LIMIT 1), f AS (SELECT r, c FROM l JOIN k USING (comp)), b AS (SELECT min(r) r0, max(r) r1, min(c) c0, max(c) c1 FROM f) SELECT g.year, CAST(g.r - r0 AS INT) AS r, CAST(g.c - c0 AS INT) AS c, CASE WHEN f.r IS NULL THEN 0 ELSE lu END AS lu FROM grid g JOIN b ON g.r BETWEEN r0 AND r1 AND g.c BETWEEN c0 AND c1 LEFT JOIN f ON f.r = g.r AND f.c = g.c")
def city_window(spark, sf):
    return X.city_window(grid(spark, sf), (1, 2, 3), 2001, 32, 32, 12, G, G)


@query(f"WITH {GRID}, g2 AS (SELECT year, r, c, CASE WHEN r BETWEEN 8 AND 47 AND c BETWEEN 16 AND 55 THEN CASE WHEN (r + c) % 4 = 0 THEN 0 ELSE lu END END AS lu FROM grid), n AS (SELECT year, (r - 8) // 10 AS br, (c - 16) // 10 AS bc, lu, count(*) AS n FROM g2 WHERE lu IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT year, br, bc, lu, road_cells FROM (SELECT *, CAST(sum(CASE WHEN lu = 5 THEN n ELSE 0 END) OVER (PARTITION BY year, br, bc) AS BIGINT) AS road_cells, row_number() OVER (PARTITION BY year, br, bc ORDER BY n DESC, lu) AS k FROM n) WHERE k = 1")
def city_export_blocks(spark, sf):
    own = grid(spark, sf).where(F.col("r").between(8, 47) & F.col("c").between(16, 55))
    masked = own.select("year", (F.col("r") - 8).alias("r"), (F.col("c") - 16).alias("c"), F.when((F.col("r") + F.col("c")) % 4 == 0, 0).otherwise(F.col("lu")).alias("lu"))
    roads = masked.groupBy("year", F.expr("r div 10").cast("int").alias("br"), F.expr("c div 10").cast("int").alias("bc")).agg(F.count_if(F.col("lu") == 5).alias("road_cells"))
    return X.block_mode(masked, 10).join(roads, ["year", "br", "bc"])


@query(f"WITH {GRID} SELECT a.year AS y1, a.r, a.c, CASE WHEN b.lu = 5 AND a.lu <> 5 THEN a.lu ELSE 0 END AS source_class, CASE WHEN b.lu = 5 AND a.lu <> 5 THEN 1 ELSE 0 END AS gained, b.lu = 5 AS now FROM grid a JOIN grid b ON b.year = a.year + 1 AND a.r = b.r AND a.c = b.c WHERE a.lu BETWEEN 1 AND 6 AND b.lu BETWEEN 1 AND 6")
def source_layers(spark, sf):
    from .base import pairs

    gained = (F.col("lu2") == 5) & (F.col("lu1") != 5)
    return pairs(spark, sf).where("lu1 between 1 and 6 and lu2 between 1 and 6").select("y1", "r", "c", F.when(gained, F.col("lu1")).otherwise(0).alias("source_class"), gained.cast("int").alias("gained"), (F.col("lu2") == 5).alias("now"))


@query("WITH RECURSIVE " + GRID + f", {_seed('seed', 1, 2)}, adm AS (SELECT year, r, c FROM seed WHERE r BETWEEN 16 AND 22 AND (r + c) % 3 = 0), {sql_disk('d1', 1)}, {sql_dilate('buf', 'adm', 'd1')}, {sql_label('l', 'buf')}, s AS (SELECT a.year, l.comp, count(*) AS cells FROM adm a JOIN l ON l.year = a.year AND l.r = a.r AND l.c = a.c GROUP BY 1, 2) SELECT year, count(*) AS groups, CAST(sum(cells) AS BIGINT) AS total_cells, max(cells) AS largest_cells FROM s GROUP BY 1")
def admin_group_split(spark, sf):
    return X.admin_groups(_mask(spark, sf, 1, 2).where(F.col("r").between(16, 22) & ((F.col("r") + F.col("c")) % 3 == 0)), 1, G, G)


@query(f"WITH RECURSIVE {GRID}, {_seed('m', 1, 2)}, {sql_label('l', 'm')}, a AS (SELECT year, comp, count(*) AS n FROM l GROUP BY 1, 2 HAVING count(*) >= 4), k AS (SELECT DISTINCT l.year, l.comp FROM l JOIN grid g ON g.year = l.year AND g.r = l.r AND g.c = l.c AND g.lu = 2) SELECT year, CAST(row_number() OVER (PARTITION BY year ORDER BY comp) AS INT) AS city_id, n AS area FROM a JOIN k USING (year, comp)")
def city_clusters(spark, sf):
    return X.clusters(grid(spark, sf), (1, 2), (2,), 4, G, G)


@query(f"WITH {GRID}, x AS (SELECT year, r, c, lu, CAST(117.0 AS DOUBLE) + (c + CAST(0.5 AS DOUBLE)) * CAST(0.01 AS DOUBLE) AS lon, CAST(32.0 AS DOUBLE) - (r + CAST(0.5 AS DOUBLE)) * CAST(0.01 AS DOUBLE) AS lat FROM grid) SELECT year, r, c, lu, round(6378137 * radians(lon), 3) AS x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM x WHERE lon BETWEEN 117.1 AND 117.3 AND lat BETWEEN 31.6 AND 31.9")
def lonlat_bbox(spark, sf):
    return X.lonlat_crop(grid(spark, sf), 117.0, 32.0, 0.01, (117.1, 31.6, 117.3, 31.9))


@query(f"WITH {GRID} SELECT year, r, c, round((c + CAST(0.5 AS DOUBLE)) * CAST(99.65 AS DOUBLE), 6) AS x_m, round(({G} - r - CAST(0.5 AS DOUBLE)) * CAST(99.65 AS DOUBLE), 6) AS y_m, r AS row_back, c AS col_back FROM grid WHERE year = 1995")
def metre_pixel_affine(spark, sf):
    own = grid(spark, sf).where("year = 1995").select("year", "r", "c", ((F.col("c") + 0.5) * F.lit(99.65)).alias("x"), ((G - F.col("r") - 0.5) * F.lit(99.65)).alias("y"))
    return own.select("year", "r", "c", F.round("x", 6).alias("x_m"), F.round("y", 6).alias("y_m"), F.floor(G - F.col("y") / 99.65).cast("int").alias("row_back"), F.floor(F.col("x") / 99.65).cast("int").alias("col_back"))
