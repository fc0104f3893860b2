"""Cells, masks, transitions and focal windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import focal, transitions
from ..operators import morphology as M
from ..operators.durable import cut
from ..operators.filters import drops
from .base import CELLS, EXTENT, GRID, LARGEST, PAIRS, RADIUS, SEEDS, G, cells, extents, grid, pairs, read, sql_least
from .registry import query

def _n():
    return F.count("*").alias("n")


@query(f"WITH {CELLS} SELECT year, CAST(CASE lu WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 5 THEN 1 WHEN 6 THEN 2 ELSE 0 END AS INT) AS lu, count(*) AS n, round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (PARTITION BY year), 6) AS percent FROM cells GROUP BY 1, 2")
def cells_remap_histogram(spark, sf):
    counted = cells(spark, sf).groupBy("year", C.lookup(F.col("lu"), C.RAW_TO_CLASS).alias("lu")).agg(_n())
    return counted.withColumn("percent", F.round(F.col("n").cast("double") * 100 / F.sum("n").over(Window.partitionBy("year")), 6))


@query(f"WITH {CELLS} SELECT year, r, c, lu, " + ", ".join(f"CAST(lu = {k} AS INT) AS c{k}" for k in range(7)) + ", lu AS back FROM cells")
def cells_onehot(spark, sf):
    return C.one_hot(cells(spark, sf)).withColumn("back", C.hot_class([f"c{k}" for k in range(7)]))


@query(f"WITH {CELLS} SELECT year, r, c, CASE WHEN lu = 3 THEN 0 ELSE lu END AS lu FROM cells")
def nodata_fill(spark, sf):
    marked = cells(spark, sf).withColumn("lu", F.when(F.col("lu") == 3, C.OUTSIDE).otherwise(F.col("lu")))
    return marked.withColumn("lu", C.fill_outside(F.col("lu")))


@query(f"WITH {CELLS} SELECT y.year, CAST(a.range AS INT) AS r, CAST(b.range AS INT) AS c, coalesce(k.lu, 255) AS lu FROM (SELECT DISTINCT year FROM cells) y CROSS JOIN range(70) a CROSS JOIN range(60) b LEFT JOIN cells k ON k.year = y.year AND k.r = a.range AND k.c = b.range")
def crop_pad_spine(spark, sf):
    return C.on_spine(cells(spark, sf), 70, 60, fill=C.OUTSIDE)


@query(f"WITH {GRID}, m AS (SELECT year, r, c, CASE WHEN lu IN (0, 3) THEN 255 ELSE lu END AS lu FROM grid), k AS (SELECT r, c, count(*) FILTER (WHERE lu = 255) AS o, count(*) AS n FROM m GROUP BY 1, 2) SELECT year, m.r, m.c, CAST(CASE WHEN n > 1 AND o - CASE WHEN lu = 255 THEN 1 ELSE 0 END = n - 1 THEN 255 ELSE lu END AS INT) AS lu FROM m JOIN k ON m.r = k.r AND m.c = k.c")
def aoi_all_years_outside(spark, sf):
    return C.outside_elsewhere(grid(spark, sf).withColumn("lu", F.when(F.col("lu").isin(0, 3), C.OUTSIDE).otherwise(F.col("lu"))))


@query(f"WITH {CELLS} SELECT * FROM cells WHERE r BETWEEN 10 AND 30 AND c BETWEEN 5 AND 40")
def window_scan(spark, sf):
    return C.window_scan(cells(spark, sf), 10, 30, 5, 40)


@query(f"WITH {GRID}, p AS (SELECT CAST(range AS INT) AS o, CAST(floor((range + 0.5) * {G} / 19) AS INT) AS i FROM range(19)) SELECT year, a.o AS r, b.o AS c, lu FROM grid JOIN p a ON a.i = r JOIN p b ON b.i = c")
def decimated_scan(spark, sf):
    return C.decimate(grid(spark, sf), G, G, 64 / 19)


@query(f"WITH {CELLS} SELECT year, CAST(a.range AS INT) AS r, CAST(b.range AS INT) AS c, coalesce(lu, 0) AS lu FROM (SELECT DISTINCT year AS yy FROM cells) y CROSS JOIN range(40) a CROSS JOIN range(30) b LEFT JOIN cells k ON k.year = yy AND k.r = CAST(floor(a.range * 1.5 + 2) AS INT) AND k.c = CAST(floor(b.range * 2.0 + 1) AS INT)".replace("SELECT year, CAST(a", "SELECT yy AS year, CAST(a"))
def nearest_resample(spark, sf):
    return C.resample(cells(spark, sf), 40, 30, F.floor(F.col("r") * F.lit(1.5) + 2), F.floor(F.col("c") * F.lit(2.0) + 1))


@query(
    "WITH a(r, g, b, cls, ord) AS (VALUES " + ", ".join(f"({r}, {g}, {b}, {k}, {o})" for o, (r, g, b, k) in enumerate(C.ANCHORS)) + "), e AS (SELECT vec_id, CAST(floor((CAST(embedding[1] AS DOUBLE) + 0.5) * 255) AS INT) AS x, CAST(floor((CAST(embedding[2] AS DOUBLE) + 0.5) * 255) AS INT) AS y, CAST(floor((CAST(embedding[3] AS DOUBLE) + 0.5) * 255) AS INT) AS z FROM embeddings)"
    " SELECT vec_id, CAST(dist AS INT) AS dist, CAST(CASE WHEN cls < 0 THEN 255 ELSE cls END AS INT) AS lu FROM (SELECT vec_id, cls, (x - a.r) * (x - a.r) + (y - g) * (y - g) + (z - b) * (z - b) AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY (x - a.r) * (x - a.r) + (y - g) * (y - g) + (z - b) * (z - b), ord) AS k FROM e, a) WHERE k = 1"
)
def colour_anchor_nearest(spark, sf):
    scaled = lambda k: F.floor((F.col("embedding")[k].cast("double") + 0.5) * 255).cast("int")
    points = read(spark, sf, "embeddings").select("vec_id", scaled(0).alias("r"), scaled(1).alias("g"), scaled(2).alias("b"))
    anchors = spark.createDataFrame([(*a, k) for k, a in enumerate(C.ANCHORS)], "r int, g int, b int, cls int, ord int")
    return C.nearest_anchor(points, anchors, ("r", "g", "b")).select("vec_id", F.col("dist").cast("int").alias("dist"), "lu")


@query(f"WITH {CELLS} SELECT year, r, c FROM cells WHERE lu IN (1, 2, 3, 4)")
def seed_mask(spark, sf):
    return cells(spark, sf).where(F.col("lu").isin(1, 2, 3, 4)).select("year", "r", "c")


@query(f"WITH {CELLS} SELECT year, r, c, CASE WHEN (r + c) % 3 = 0 THEN 0 ELSE lu END AS lu FROM cells")
def mask_out(spark, sf):
    mask = cells(spark, sf).where((F.col("r") + F.col("c")) % 3 != 0).select("year", "r", "c", F.lit(True).alias("inside"))
    return cells(spark, sf).join(mask, ["year", "r", "c"], "left").select("year", "r", "c", F.when(F.col("inside"), F.col("lu")).otherwise(0).alias("lu"))


@query(f"WITH {CELLS} SELECT year, r, c, CAST(r * {G} + c AS BIGINT) AS cell_idx, r BETWEEN 0 AND 49 AND c BETWEEN 0 AND 39 AS inside, CASE WHEN r BETWEEN 0 AND 49 AND c BETWEEN 0 AND 39 THEN CAST(r * 40 + c AS BIGINT) ELSE -1 END AS cropped_idx FROM cells")
def bounds_check(spark, sf):
    inside = F.col("r").between(0, 49) & F.col("c").between(0, 39)
    return cells(spark, sf).select("year", "r", "c", (F.col("r") * G + F.col("c")).cast("long").alias("cell_idx"), inside.alias("inside"), F.when(inside, (F.col("r") * 40 + F.col("c")).cast("long")).otherwise(F.lit(-1).cast("long")).alias("cropped_idx"))


@query(f"WITH {PAIRS} SELECT y1, count(*) FILTER (WHERE lu1 IN (1, 2) AND lu2 IN (1, 2)) AS both, count(*) FILTER (WHERE lu1 IN (1, 2) OR lu2 IN (1, 2)) AS either, count(*) FILTER (WHERE (lu1 IN (1, 2)) <> (lu2 IN (1, 2))) AS one, count(*) FILTER (WHERE NOT (lu1 IN (1, 2))) AS neither_before FROM pairs GROUP BY 1")
def mask_algebra(spark, sf):
    a, b = F.col("lu1").isin(1, 2), F.col("lu2").isin(1, 2)
    return pairs(spark, sf).groupBy("y1").agg(F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either"), F.count_if(a != b).alias("one"), F.count_if(~a).alias("neither_before"))


@query(f"WITH {CELLS} SELECT a.r, a.c, a.lu AS lu_a, b.lu AS lu_b FROM cells a JOIN cells b ON a.r = b.r AND a.c = b.c WHERE a.year = 1996 AND b.year = 1999")
def coregistered_join(spark, sf):
    own = lambda y, n: cells(spark, sf).where(F.col("year") == y).select("r", "c", F.col("lu").alias(n))
    return own(1996, "lu_a").join(own(1999, "lu_b"), ["r", "c"])


@query(f"WITH {PAIRS} SELECT * FROM pairs WHERE lu1 <> lu2 AND lu1 BETWEEN 1 AND 6 AND lu2 BETWEEN 1 AND 6")
def year_pair_join(spark, sf):
    return pairs(spark, sf).where(transitions.sampled() & transitions.updated())


# ---------------------------------------------------------------- transitions

_SAMPLED = "lu1 BETWEEN 1 AND 6 AND lu2 BETWEEN 1 AND 6"
_IN_EXTENT = "t AS (SELECT p.y1, p.r, p.c, lu1, lu2 FROM pairs p JOIN extent e ON e.year = p.y1 AND e.r = p.r AND e.c = p.c WHERE lu1 BETWEEN 1 AND 6 AND lu2 BETWEEN 1 AND 6)"
_PAIRS_TAIL = PAIRS[len(GRID) + 2 :]


@query(f"WITH {EXTENT}, {_PAIRS_TAIL}, {_IN_EXTENT}, u AS (SELECT y1, count(*) AS samples, count(*) FILTER (WHERE lu1 <> lu2) AS updates FROM t GROUP BY 1), e2 AS (SELECT y.y1, count(*) FILTER (WHERE a.year IS NOT NULL) AS t1_cells, count(*) FILTER (WHERE b.year IS NOT NULL) AS t2_cells, count(*) FILTER (WHERE b.year IS NOT NULL AND a.year IS NULL) AS expansion, count(*) FILTER (WHERE a.year IS NOT NULL AND b.year IS NULL) AS contraction FROM pairs y LEFT JOIN extent a ON a.year = y.y1 AND a.r = y.r AND a.c = y.c LEFT JOIN extent b ON b.year = y.y1 + 1 AND b.r = y.r AND b.c = y.c GROUP BY 1) SELECT y1 AS year_t1, y1 + 1 AS year_t2, y1 || '->' || (y1 + 1) AS period, samples, updates, round(CAST(updates AS DOUBLE) * 100 / samples, 6) AS update_rate_percent, t1_cells, t2_cells, expansion, contraction, t2_cells - t1_cells AS net FROM u JOIN e2 USING (y1)")
def period_rates(spark, sf):
    return transitions.period_rates(pairs(spark, sf), cut(extents(spark, sf)))  # three readers, one labelling


@query(f"WITH {PAIRS}, n AS (SELECT y1, lu1, lu2, count(*) AS n FROM pairs WHERE {_SAMPLED} AND lu1 <> lu2 GROUP BY ALL) SELECT y.y1 || '->' || (y.y1 + 1) AS period, CAST(a.range AS INT) AS from_class, CAST(b.range AS INT) AS to_class, coalesce(n, 0) AS n, round(CAST(coalesce(n, 0) AS DOUBLE) * 100 / sum(coalesce(n, 0)) OVER (PARTITION BY y.y1), 6) AS share_percent FROM (SELECT DISTINCT y1 FROM pairs) y CROSS JOIN range(1, 7) a CROSS JOIN range(1, 7) b LEFT JOIN n ON n.y1 = y.y1 AND lu1 = a.range AND lu2 = b.range WHERE a.range <> b.range")
def transition_counts_full_spine(spark, sf):
    return transitions.complete_counts(pairs(spark, sf))


@query(f"WITH {PAIRS} SELECT lu1 AS from_class, " + ", ".join(f"count(*) FILTER (WHERE lu2 = {k}) AS to_{k}" for k in range(1, 7)) + f" FROM pairs WHERE {_SAMPLED} AND lu1 <> lu2 GROUP BY 1")
def transition_matrix(spark, sf):
    return transitions.matrix(pairs(spark, sf))


@query(f"WITH {PAIRS}, n AS (SELECT y1, lu1, lu2, count(*) AS n FROM pairs WHERE {_SAMPLED} AND lu1 <> lu2 GROUP BY ALL) SELECT * FROM (SELECT y1 || '->' || (y1 + 1) AS period, lu1 AS from_class, lu2 AS to_class, n, CAST(row_number() OVER (PARTITION BY y1 ORDER BY n DESC, lu1, lu2) AS INT) AS rank FROM n) WHERE rank <= 10")
def transition_topk(spark, sf):
    return transitions.top(pairs(spark, sf), 10)


@query(f"WITH {PAIRS} SELECT y1, lu1 AS from_class, lu2 AS to_class, count(*) AS n FROM pairs WHERE {_SAMPLED} AND lu1 <> lu2 GROUP BY GROUPING SETS ((y1, lu1, lu2), (lu1, lu2))")
def transition_grouping_sets(spark, sf):
    kept = pairs(spark, sf).where(transitions.sampled() & transitions.updated()).select("y1", F.col("lu1").alias("from_class"), F.col("lu2").alias("to_class"))
    return kept.groupingSets([["y1", "from_class", "to_class"], ["from_class", "to_class"]], "y1", "from_class", "to_class").agg(_n())


_EXP = f"{_PAIRS_TAIL}, ex AS (SELECT p.y1, p.r, p.c, p.lu2 FROM pairs p JOIN extent b ON b.year = p.y1 + 1 AND b.r = p.r AND b.c = p.c ANTI JOIN extent a ON a.year = p.y1 AND a.r = p.r AND a.c = p.c)"


@query(f"WITH {EXTENT} SELECT a.year AS y1, a.r, a.c, 'contraction' AS kind FROM extent a ANTI JOIN extent b ON b.year = a.year + 1 AND a.r = b.r AND a.c = b.c WHERE a.year < 2001 UNION ALL SELECT b.year - 1, b.r, b.c, 'expansion' FROM extent b ANTI JOIN extent a ON b.year = a.year + 1 AND a.r = b.r AND a.c = b.c WHERE b.year > 1995")
def expansion_contraction(spark, sf):
    return transitions.expansion_contraction(extents(spark, sf))


@query(f"WITH {EXTENT}, {_EXP} SELECT y1, " + ", ".join(f"count(*) FILTER (WHERE lu2 = {k}) AS class_{k}" for k in range(7)) + ", count(*) AS total FROM ex GROUP BY 1")
def expansion_by_class_wide(spark, sf):
    return transitions.expansion_by_class(pairs(spark, sf), extents(spark, sf))


@query(f"WITH {EXTENT}, {_EXP} SELECT y1, CAST(k.range AS INT) AS lu, count(*) FILTER (WHERE lu2 = k.range) AS n, round(CAST(count(*) FILTER (WHERE lu2 = k.range) AS DOUBLE) / nullif(count(*) FILTER (WHERE lu2 > 0), 0), 6) AS share_classified, round(CAST(count(*) FILTER (WHERE lu2 = k.range) AS DOUBLE) / count(*), 6) AS share_total FROM ex CROSS JOIN range(1, 7) k GROUP BY ALL")
def expansion_by_class_long(spark, sf):
    wide = transitions.expansion_by_class(pairs(spark, sf), extents(spark, sf))
    classified = sum((F.col(f"class_{k}") for k in range(2, 7)), F.col("class_1"))
    long = wide.withColumn("classified", classified).unpivot(["y1", "total", "classified"], [f"class_{k}" for k in range(1, 7)], "class", "n")
    return long.select("y1", F.substring("class", 7, 1).cast("int").alias("lu"), "n", F.round(F.try_divide(F.col("n").cast("double"), F.col("classified").cast("double")), 6).alias("share_classified"), F.round(F.col("n").cast("double") / F.col("total"), 6).alias("share_total"))


@query(f"WITH {PAIRS}, b AS (SELECT * FROM pairs WHERE lu1 BETWEEN 1 AND 4 AND lu2 BETWEEN 1 AND 4) SELECT y1, list_sort(list(DISTINCT lu1)) AS origins, list_sort(list(DISTINCT lu2)) AS targets, count(*) AS samples, count(*) FILTER (WHERE lu1 <> lu2) AS changed, round(CAST(count(*) FILTER (WHERE lu1 <> lu2) AS DOUBLE) / count(*), 6) AS change_rate, bool_and(lu1 IN (1, 2, 3, 4) AND lu2 IN (1, 2, 3, 4)) AS passed FROM b GROUP BY 1")
def built_audit(spark, sf):
    return transitions.built_audit(pairs(spark, sf))


@query(f"WITH {EXTENT} SELECT g.year, count(*) FILTER (WHERE lu IN (1, 2)) AS seed_cells, (SELECT count(*) FROM closed k WHERE k.year = g.year) AS closed_cells, (SELECT count(*) FROM hole k WHERE k.year = g.year) AS hole_cells, (SELECT count(*) FROM extent k WHERE k.year = g.year) AS extent_cells, round((SELECT count(*) FROM extent k WHERE k.year = g.year) * CAST(0.01 AS DOUBLE), 6) AS extent_km2 FROM grid g GROUP BY 1")
def extent_summary(spark, sf):
    return M.extent_steps(grid(spark, sf), G, G, RADIUS, LARGEST, SEEDS)


# ---------------------------------------------------------------- sets


@query(f"WITH {CELLS} SELECT r, c FROM cells WHERE year = 1996 AND lu = 1 INTERSECT SELECT r, c FROM cells WHERE year = 1997 AND lu IN (1, 2, 3)")
def set_intersect(spark, sf):
    own = cells(spark, sf)
    return own.where("year = 1996 and lu = 1").select("r", "c").intersect(own.where("year = 1997 and lu in (1, 2, 3)").select("r", "c"))


@query(f"WITH {CELLS} SELECT r, c, bool_or(lu IN (1, 2)) AS ever, count(*) FILTER (WHERE lu IN (1, 2)) AS years FROM cells GROUP BY 1, 2")
def any_year_union(spark, sf):
    return cells(spark, sf).groupBy("r", "c").agg(F.bool_or(F.col("lu").isin(1, 2)).alias("ever"), F.count_if(F.col("lu").isin(1, 2)).alias("years"))


@query(f"WITH {PAIRS} SELECT y1, count(*) AS differing FROM pairs WHERE (lu1 = 5) <> (lu2 = 5) GROUP BY 1")
def symmetric_difference(spark, sf):
    return pairs(spark, sf).where((F.col("lu1") == 5) != (F.col("lu2") == 5)).groupBy("y1").agg(F.count("*").alias("differing"))


@query(f"WITH {CELLS} SELECT year, list_sort(list(DISTINCT lu)) AS classes, bool_and(lu IN (0, 1, 2, 3, 4, 5, 6)) AS subset, bool_and(lu < 6) AS below_six FROM cells GROUP BY 1")
def subset_check(spark, sf):
    classes = F.array_sort(F.collect_set("lu"))
    out = cells(spark, sf).groupBy("year").agg(classes.alias("classes"))
    return out.withColumns({"subset": F.size(F.array_except("classes", F.array(*map(F.lit, range(7))))) == 0, "below_six": F.size(F.array_except("classes", F.array(*map(F.lit, range(6))))) == 0})


@query(f"WITH {PAIRS} SELECT DISTINCT lu1, lu2 FROM pairs")
def distinct_pairs(spark, sf):
    return pairs(spark, sf).select("lu1", "lu2").distinct()


@query(f"WITH {CELLS} SELECT year, lu AS class, count(*) AS n FROM cells GROUP BY ALL")
def wide_long_roundtrip(spark, sf):
    wide = cells(spark, sf).groupBy("year").pivot("lu", list(range(7))).count()
    return wide.unpivot("year", [str(k) for k in range(7)], "class", "n").select("year", F.col("class").cast("int").alias("class"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ---------------------------------------------------------------- focal windows


#: Working radii in cells: of the neighbourhood and of the functional features.
NEAR_RADII, FUNCTIONAL_RADII = (10, 15, 20, 30, 40, 50), (5, 10, 20)


def _box_sql(ks, classes=range(7)):
    """s(year, r, c, c0_2, ...): how many cells of each class a box of each radius holds, rows first and then columns."""
    flat = ", ".join(f"sum(CASE WHEN lu = {k} THEN 1 ELSE 0 END) OVER (PARTITION BY year, r ORDER BY c RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS c{k}_{r}" for r in ks for k in classes)
    tall = ", ".join(f"CAST(sum(c{k}_{r}) OVER (PARTITION BY year, c ORDER BY r RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS BIGINT) AS c{k}_{r}" for r in ks for k in classes)
    return f"s AS (SELECT year, r, c, {tall} FROM (SELECT year, r, c, {flat} FROM grid))"


def _area(r):
    return f"CAST({float((2 * r + 1) ** 2)} AS DOUBLE)"


def _counts(r):
    return "[" + ", ".join(f"c{k}_{r}" for k in range(7)) + "]"


def _entropy_sql(r):
    area = float((2 * r + 1) ** 2)
    total = "(" + " + ".join(f"c{k}_{r} / CAST({area} AS DOUBLE)" for k in range(7)) + " + CAST(1e-9 AS DOUBLE))"
    return "-(" + " + ".join(f"(c{k}_{r} / CAST({area} AS DOUBLE) / {total}) * ln(c{k}_{r} / CAST({area} AS DOUBLE) / {total} + CAST(1e-9 AS DOUBLE))" for k in range(7)) + ")"


def near_sql(ks):
    """The neighbourhood columns of s."""
    return ", ".join(
        ", ".join(f"round(c{k}_{r} / {_area(r)}, 6) AS ratio_c{k}_{r}" for k in range(7))
        + f", round((c1_{r} + c2_{r} + c3_{r} + c4_{r}) / {_area(r)}, 6) AS built_{r}, round(c5_{r} / {_area(r)}, 6) AS road_{r}, round({_entropy_sql(r)}, 6) AS entropy_{r}, "
        f"CAST(list_position({_counts(r)}, list_max({_counts(r)})) - 1 AS INT) AS dominant_{r}"
        for r in ks
    )


def functional_sql(ks, prefix=""):
    """The functional columns of s for radii."""
    return ", ".join(
        f"round({_entropy_sql(r)}, 6) AS {prefix}entropy_{r}, round((list_sort({_counts(r)}, 'DESC')[1] - list_sort({_counts(r)}, 'DESC')[2]) / {_area(r)}, 6) AS {prefix}purity_{r}, "
        f"round((c1_{r} + c2_{r} + c3_{r} + c4_{r}) / {_area(r)}, 6) AS {prefix}built_{r}, round(1 - list_max({_counts(r)}) / {_area(r)}, 6) AS {prefix}boundary_{r}"
        for r in ks
    )


#: f(year, r, c, cluster_size_log, diversity): cells of the own class that steps of that class reach; neighbours of another class, edges repeated.
WHOLE = (
    f"cell AS (SELECT year * {G * G} + r * {G} + c AS id, * FROM grid), "
    "part AS (SELECT *, c - row_number() OVER (PARTITION BY year, r, lu ORDER BY c) AS k FROM cell), "
    "run AS (SELECT min(id) AS id, year, r, lu, k, min(c) AS c0, max(c) AS c1, count(*) AS n FROM part GROUP BY year, r, lu, k), "
    "same AS (SELECT a.id AS a, b.id AS b FROM run a JOIN run b ON a.year = b.year AND a.lu = b.lu AND b.r IN (a.r - 1, a.r + 1) AND b.c0 <= a.c1 + 1 AND b.c1 >= a.c0 - 1), "
    + sql_least("cluster", "SELECT id FROM run", "same")
    + ", size AS (SELECT root, sum(n) AS n FROM cluster JOIN run USING (id) GROUP BY 1), "
    "d AS (SELECT CAST(x.range AS INT) AS dr, CAST(y.range AS INT) AS dc FROM range(-1, 2) x, range(-1, 2) y WHERE x.range <> 0 OR y.range <> 0), "
    f"other AS (SELECT a.id, CAST(count(*) FILTER (WHERE b.lu <> a.lu) AS INT) AS n FROM cell a CROSS JOIN d JOIN cell b ON b.year = a.year AND b.r = least(greatest(a.r + dr, 0), {G - 1}) AND b.c = least(greatest(a.c + dc, 0), {G - 1}) GROUP BY 1), "
    "f AS (SELECT year, part.r, part.c, round(ln(1 + size.n), 6) AS cluster_size_log, other.n AS diversity FROM part JOIN run USING (year, r, lu, k) JOIN cluster ON cluster.id = run.id JOIN size ON size.root = cluster.root JOIN other ON other.id = part.id)"
)


def rounded(df, keep):
    """All columns but ``keep`` and whole numbers, to six places."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(x, 6).alias(x) if kinds[x] == "double" and x not in keep else F.col(x) for x in df.columns))


@query(f"WITH {GRID}, {_box_sql((2, 5))} SELECT * FROM s")
def focal_box_features(spark, sf):
    names = [f"c{k}" for k in range(7)]
    hot = C.one_hot(grid(spark, sf))
    return focal.box(hot, names, (2, 5)).select("year", "r", "c", *(f"{n}_{k}" for k in (2, 5) for n in names))


@query(f"WITH RECURSIVE {GRID}, {_box_sql(FUNCTIONAL_RADII)}, {WHOLE} SELECT year, r, c, {functional_sql(FUNCTIONAL_RADII)}, cluster_size_log, diversity FROM s JOIN f USING (year, r, c)")
def focal_entropy_purity(spark, sf):
    return rounded(focal.functional(grid(spark, sf), FUNCTIONAL_RADII, G, G), ())


@query(f"WITH {GRID}, {_box_sql(NEAR_RADII)} SELECT year, r, c, {near_sql(NEAR_RADII)} FROM s")
def neighbourhood_features(spark, sf):
    return rounded(focal.neighbourhood(grid(spark, sf), NEAR_RADII), ())


@query(f"WITH {GRID} SELECT a.year, a.r, a.c, max(b.lu) AS lu_5 FROM grid a JOIN grid b ON a.year = b.year AND b.r BETWEEN a.r - 5 AND a.r + 5 AND b.c BETWEEN a.c - 5 AND a.c + 5 GROUP BY ALL")
def focal_max(spark, sf):
    return focal.box(grid(spark, sf), ["lu"], [5], how=F.max).select("year", "r", "c", "lu_5")


@query(f"WITH {GRID}, d AS (SELECT CAST(x.range AS INT) AS dr, CAST(y.range AS INT) AS dc FROM range(-1, 2) x, range(-1, 2) y WHERE x.range <> 0 OR y.range <> 0) SELECT a.year, a.r, a.c, CAST(count(*) FILTER (WHERE b.lu <> a.lu) AS INT) AS diversity, CAST(count(DISTINCT b.lu) AS INT) AS distinct_classes FROM grid a, d JOIN grid b ON b.year = a.year AND b.r = least(greatest(a.r + dr, 0), {G - 1}) AND b.c = least(greatest(a.c + dc, 0), {G - 1}) GROUP BY ALL")
def neighbour_diversity(spark, sf):
    return focal.differing_neighbours(grid(spark, sf), G, G)


#: What a training row must be: known in both years, not built in the first, away from the border.
_TRAINABLE = {"known": "lu1 <> 0 AND lu2 <> 0", "unbuilt": "lu1 NOT IN (1, 2)", "inside": f"r BETWEEN 2 AND {G - 3} AND c BETWEEN 2 AND {G - 3}"}
_DROPPED = ", ".join(f"count(*) FILTER (WHERE {' AND '.join([*(f'({x})' for x in list(_TRAINABLE.values())[:k]), f'NOT ({v})'])}) AS d{k + 1}" for k, v in enumerate(_TRAINABLE.values()))
_STEPS_OF = " UNION ALL ".join(f"SELECT y1, {k + 1} AS step, '{n}' AS filter, d{k + 1} AS dropped, n - {' - '.join(f'd{j + 1}' for j in range(k + 1))} AS \"left\" FROM t" for k, n in enumerate(_TRAINABLE))


@query(f"WITH {PAIRS}, t AS (SELECT y1, count(*) AS n, {_DROPPED} FROM pairs GROUP BY 1) {_STEPS_OF}")
def filter_drops(spark, sf):
    """How many pairs of cells each filter of the training rows drops in each period."""
    return drops(pairs(spark, sf), {n: F.expr(x) for n, x in _TRAINABLE.items()}, ["y1"])
