"""City-by-period panels: summaries, ranks, pivots, joins and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import stats as T
from .base import MOVES, PANEL, moves, panel, read
from .registry import query

C = F.col
D = "CAST({} AS DOUBLE)".format


def _r(x, k=6):
    return F.round(x, k)


# ---------------------------------------------------------------- summaries


@query(f"WITH {PANEL} SELECT year, count(DISTINCT city) AS cities, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(updates) AS BIGINT) AS updates, CAST(median(updates) AS DOUBLE) AS median_updates, round(avg(updates), 6) AS mean_updates, round({D('sum(updates)')} / sum(n), 6) AS rate FROM panel GROUP BY 1")
def city_period_summary(spark, sf):
    return panel(spark, sf).groupBy("year").agg(
        F.count_distinct("city").alias("cities"), F.sum("n").alias("samples"), F.sum("updates").alias("updates"), F.median("updates").alias("median_updates"),
        _r(F.avg("updates")).alias("mean_updates"), _r(F.sum("updates").cast("double") / F.sum("n")).alias("rate"),
    )


@query(f"WITH {MOVES}, k AS (SELECT city, day, from_class, to_class, count(*) AS n FROM moves WHERE from_class <> to_class GROUP BY ALL) SELECT city, day, from_class, to_class, n FROM (SELECT *, row_number() OVER (PARTITION BY city, day ORDER BY n DESC, from_class, to_class) AS k FROM k) WHERE k = 1")
def city_main_transition(spark, sf):
    counted = moves(spark, sf).where("from_class <> to_class").groupBy("city", "day", "from_class", "to_class").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-C("n")).alias("m"), "from_class", "to_class")).alias("b")
    return counted.groupBy("city", "day").agg(best).select("city", "day", "b.from_class", "b.to_class", (-C("b.m")).alias("n"))


@query(f"WITH {PANEL} SELECT * FROM (SELECT year, name, updates, n, CAST(row_number() OVER (PARTITION BY year ORDER BY updates DESC, name) AS INT) AS rank FROM panel) WHERE rank <= 10")
def city_top10(spark, sf):
    return R.top(panel(spark, sf).select("year", "name", "updates", "n"), ["year"], [F.desc("updates"), C("name")], 10)


@query(f"WITH {PANEL} SELECT * FROM (SELECT year, name, updates, round({D('updates')} / n, 6) AS rate, CAST(row_number() OVER (PARTITION BY year ORDER BY {D('updates')} / n DESC, name) AS INT) AS rank FROM panel WHERE updates >= 10) WHERE rank <= 10")
def city_top10_rate_floor(spark, sf):
    rated = panel(spark, sf).where("updates >= 10").withColumn("exact", C("updates").cast("double") / C("n"))
    return R.top(rated, ["year"], [F.desc("exact"), C("name")], 10).select("year", "name", "updates", _r("exact").alias("rate"), "rank")


@query(f"WITH {PANEL}, s AS (SELECT unnest(CASE WHEN region IN ('ASIA', 'EUROPE') THEN ['formal', 'all'] ELSE ['all'] END) AS scope, * FROM panel) SELECT scope, year, count(DISTINCT city) AS cities, CAST(sum(updates) AS BIGINT) AS updates, CAST(median(n) AS DOUBLE) AS median_n FROM s GROUP BY 1, 2")
def two_scope_summary(spark, sf):
    scopes = F.when(C("region").isin("ASIA", "EUROPE"), F.array(F.lit("formal"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    return panel(spark, sf).withColumn("scope", F.explode(scopes)).groupBy("scope", "year").agg(F.count_distinct("city").alias("cities"), F.sum("updates").alias("updates"), F.median("n").alias("median_n"))


@query(f"WITH {PANEL}, a AS (SELECT year, name, updates FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY updates DESC, name) k FROM panel) WHERE k = 1), b AS (SELECT year, name FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY {D('updates')} / n DESC, name) k FROM panel) WHERE k = 1), c AS (SELECT year, region FROM (SELECT year, region, row_number() OVER (PARTITION BY year ORDER BY sum(updates) DESC, region) k FROM panel GROUP BY 1, 2) WHERE k = 1), d AS (SELECT year, name FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY value DESC, name) k FROM panel) WHERE k = 1) SELECT year, a.name AS top_city, a.updates AS top_updates, b.name AS top_rate_city, c.region AS top_region, d.name AS top_value_city FROM a JOIN b USING (year) JOIN c USING (year) JOIN d USING (year)")
def key_findings(spark, sf):
    own = panel(spark, sf).withColumn("rate", C("updates").cast("double") / C("n"))
    first = lambda df, order, **cols: R.top(df, ["year"], order, 1).select("year", *(C(v).alias(k) for k, v in cols.items()))
    regions = own.groupBy("year", "region").agg(F.sum("updates").alias("updates"))
    return (
        first(own, [F.desc("updates"), C("name")], top_city="name", top_updates="updates")
        .join(first(own, [F.desc("rate"), C("name")], top_rate_city="name"), "year")
        .join(first(regions, [F.desc("updates"), C("region")], top_region="region"), "year")
        .join(first(own, [F.desc("value"), C("name")], top_value_city="name"), "year")
    )


_SUB = f"{MOVES}, k AS (SELECT city % 50 AS city, day % 6 AS period, from_class, to_class, count(*) AS n FROM moves WHERE from_class <> to_class GROUP BY ALL)"


def _sub(spark, sf):
    return moves(spark, sf).where("from_class <> to_class").groupBy((C("city") % 50).alias("city"), (C("day") % 6).alias("period"), "from_class", "to_class").agg(F.count("*").alias("n"))


@query(f"WITH {_SUB}, a AS (SELECT city, period, CAST(sum(n) AS BIGINT) AS updates, CAST(coalesce(sum(n) FILTER (WHERE to_class = 'error'), 0) AS BIGINT) AS inflow, CAST(coalesce(sum(n) FILTER (WHERE from_class = 'error'), 0) AS BIGINT) AS outflow FROM k GROUP BY 1, 2), m AS (SELECT city, period, from_class AS main_source FROM (SELECT *, row_number() OVER (PARTITION BY city, period ORDER BY n DESC, from_class) AS j FROM k WHERE to_class = 'error') WHERE j = 1) SELECT city, period, updates, inflow, outflow, inflow - outflow AS net, round({D('inflow')} / updates, 6) AS inflow_share, main_source FROM a LEFT JOIN m USING (city, period)")
def municipal_audit(spark, sf):
    into, out = C("to_class") == "error", C("from_class") == "error"
    source = F.min(F.when(into, F.struct((-C("n")).alias("m"), "from_class"))).alias("b")
    own = _sub(spark, sf).groupBy("city", "period").agg(F.sum("n").alias("updates"), F.coalesce(F.sum(F.when(into, C("n"))), F.lit(0)).alias("inflow"), F.coalesce(F.sum(F.when(out, C("n"))), F.lit(0)).alias("outflow"), source)
    return own.select("city", "period", "updates", "inflow", "outflow", (C("inflow") - C("outflow")).alias("net"), _r(C("inflow").cast("double") / C("updates")).alias("inflow_share"), C("b.from_class").alias("main_source"))


@query(f"WITH {_SUB}, t AS (SELECT city, period, to_class, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY ALL), z AS (SELECT *, CASE WHEN (city + period) % 7 = 0 AND to_class = 'error' THEN 0 ELSE n END AS v FROM t) SELECT city, period, to_class, v AS n, CASE WHEN v > 0 THEN CAST(rank() OVER (PARTITION BY city, period ORDER BY CASE WHEN v > 0 THEN v END DESC NULLS LAST) AS INT) END AS target_rank FROM z")
def municipal_rank(spark, sf):
    totals = _sub(spark, sf).groupBy("city", "period", "to_class").agg(F.sum("n").alias("n"))
    zeroed = totals.withColumn("n", F.when(((C("city") + C("period")) % 7 == 0) & (C("to_class") == "error"), 0).otherwise(C("n")))
    return R.positive_rank(zeroed, ["city", "period"], "n", "target_rank")


@query(f"WITH {_SUB} SELECT period, from_class AS source, CAST(sum(n) AS BIGINT) AS n, round({D('sum(n)')} / sum(sum(n)) OVER (PARTITION BY period), 6) AS share FROM k WHERE to_class = 'error' GROUP BY 1, 2")
def municipal_sources(spark, sf):
    own = _sub(spark, sf).where("to_class = 'error'").groupBy("period", C("from_class").alias("source")).agg(F.sum("n").alias("n"))
    return own.withColumn("share", _r(R.share("n", "period")))


@query(f"WITH {_SUB} SELECT period, CAST(sum(n) AS BIGINT) AS updates, CAST(sum(n) FILTER (WHERE to_class = 'error') AS BIGINT) AS inflow, round({D('''sum(n) FILTER (WHERE to_class = 'error')''')} / sum(n), 6) AS inflow_share FROM k GROUP BY 1")
def inflow_share(spark, sf):
    own = _sub(spark, sf).groupBy("period").agg(F.sum("n").alias("updates"), F.sum(F.when(C("to_class") == "error", C("n"))).alias("inflow"))
    return own.withColumn("inflow_share", _r(C("inflow").cast("double") / C("updates")))


_CASES = f"{_SUB}, a AS (SELECT city, period, CAST(sum(n) AS BIGINT) AS updates, CAST(coalesce(sum(n) FILTER (WHERE to_class = 'error'), 0) AS BIGINT) AS inflow FROM k WHERE period >= 3 GROUP BY 1, 2), f AS (SELECT *, {D('inflow')} / updates AS share FROM a)"


@query(f"WITH {_CASES}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY inflow DESC, share DESC, period) AS j FROM f) WHERE j = 1), p1 AS (SELECT city, period, inflow, updates, row_number() OVER (ORDER BY inflow DESC, share DESC, city, period) AS k FROM b ORDER BY k LIMIT 2), p2 AS (SELECT city, period, inflow, updates FROM f WHERE updates >= 10 AND city NOT IN (SELECT city FROM p1) ORDER BY share DESC, inflow DESC, city, period LIMIT 1), p3 AS (SELECT city, period, inflow, updates FROM f WHERE city = 7 AND city NOT IN (SELECT city FROM p1) ORDER BY inflow DESC, period LIMIT 1) SELECT 'count_' || k AS reason, city, period, inflow, updates FROM p1 UNION ALL SELECT 'share', * FROM p2 UNION ALL SELECT 'pinned', * FROM p3")
def case_selection(spark, sf):
    own = _sub(spark, sf).where("period >= 3").groupBy("city", "period").agg(F.sum("n").alias("updates"), F.coalesce(F.sum(F.when(C("to_class") == "error", C("n"))), F.lit(0)).alias("inflow"))
    rated = own.withColumn("share", C("inflow").cast("double") / C("updates"))
    cols = ["city", "period", "inflow", "updates"]
    each = R.top(rated, ["city"], [F.desc("inflow"), F.desc("share"), C("period")], 1)
    two = each.orderBy(F.desc("inflow"), F.desc("share"), "city", "period").limit(2)  # the feature: the two leading cities
    first = R.numbered(two.withColumn("all", F.lit(1)), ["all"], [F.desc("inflow"), F.desc("share"), C("city"), C("period")], "k").select(F.concat(F.lit("count_"), C("k").cast("string")).alias("reason"), *cols)
    others = rated.join(F.broadcast(two.select("city")), "city", "left_anti")
    second = others.where("updates >= 10").orderBy(F.desc("share"), F.desc("inflow"), "city", "period").limit(1).select(F.lit("share").alias("reason"), *cols)
    pinned = others.where("city = 7").orderBy(F.desc("inflow"), "period").limit(1).select(F.lit("pinned").alias("reason"), *cols)
    return first.unionByName(second).unionByName(pinned)


# ---------------------------------------------------------------- size classes and sample plans

_SIZE = "CASE WHEN people >= 60 THEN 'super' WHEN people >= 55 THEN 'mega' WHEN people >= 50 THEN 'large_1' WHEN people >= 40 THEN 'large_2' WHEN people >= 35 THEN 'medium' WHEN people >= 20 THEN 'small_1' ELSE 'small_2' END"
_CITY = f"city AS (SELECT n_nationkey * 5 + s AS id, r_name AS region, people, {_SIZE} AS size FROM (SELECT c_nationkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS s, count(*) * 4 AS people FROM customer GROUP BY 1, 2) JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"
_GROUP = "CASE WHEN size IN ('super', 'mega', 'large_1', 'large_2') THEN size ELSE 'middle_small' END"
_SIZES = ("super", "mega", "large_1", "large_2", "medium", "small_1", "small_2")
_GROUPS = ("super", "mega", "large_1", "large_2", "middle_small")


def _size(people):
    out = F.lit("small_2")
    for least, name in ((20, "small_1"), (35, "medium"), (40, "large_2"), (50, "large_1"), (55, "mega"), (60, "super")):
        out = F.when(people >= least, name).otherwise(out)
    return out


def _cities(spark, sf):
    seg = F.when(C("c_mktsegment") == "AUTOMOBILE", 0).when(C("c_mktsegment") == "BUILDING", 1).when(C("c_mktsegment") == "FURNITURE", 2).when(C("c_mktsegment") == "HOUSEHOLD", 3).otherwise(4)
    people = read(spark, sf, "customer").groupBy("c_nationkey", seg.alias("s")).agg((F.count("*") * 4).alias("people"))
    dims = read(spark, sf, "nation").join(read(spark, sf, "region"), C("n_regionkey") == C("r_regionkey"))
    own = people.join(F.broadcast(dims), C("c_nationkey") == C("n_nationkey"))  # 25 rows
    return own.select((C("n_nationkey") * 5 + C("s")).alias("id"), C("r_name").alias("region"), "people", _size(C("people")).alias("size"))


def _group(size="size"):
    return F.when(C(size).isin(*_GROUPS[:4]), C(size)).otherwise("middle_small")


@query(f"WITH {_CITY}, g AS (SELECT *, {_GROUP} AS grp FROM city), p AS (SELECT id, 'all' AS rule, 0 AS o FROM g WHERE size IN ('super', 'mega', 'large_1') UNION ALL SELECT id, grp || '-' || region, 1 FROM (SELECT *, row_number() OVER (PARTITION BY grp, region ORDER BY people DESC, id) AS k FROM g WHERE grp IN ('large_2', 'middle_small')) WHERE k <= 5), u AS (SELECT id, rule FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, rule) AS k FROM p) WHERE k = 1) SELECT CAST(id AS BIGINT) AS id, region, people, size, grp, rule, CAST(row_number() OVER (ORDER BY list_position(['super', 'mega', 'large_1', 'large_2', 'middle_small'], grp), region, people DESC, id) AS INT) AS place FROM u JOIN g USING (id)")
def size_class_plan(spark, sf):
    own = _cities(spark, sf).withColumn("grp", _group())
    all_ = own.where(C("size").isin(*_GROUPS[:3])).select("id", F.lit("all").alias("rule"), F.lit(0).alias("o"))
    some = R.top(own.where(C("grp").isin("large_2", "middle_small")), ["grp", "region"], [F.desc("people"), C("id")], 5).select("id", F.concat_ws("-", "grp", "region").alias("rule"), F.lit(1).alias("o"))
    once = R.top(all_.unionByName(some), ["id"], [C("o"), C("rule")], 1, "k").select("id", "rule")
    order = F.array_position(F.array(*map(F.lit, _GROUPS)), C("grp"))
    plan = own.join(once, "id").withColumn("all", F.lit(1))
    return R.numbered(plan, ["all"], [order, C("region"), F.desc("people"), C("id")], "place").select(C("id").cast("long").alias("id"), "region", "people", "size", "grp", "rule", "place")


@query(f"WITH {_CITY}, s(size, o) AS (VALUES " + ", ".join(f"('{s}', {k})" for k, s in enumerate(_SIZES)) + f") SELECT s.size, o AS position, count(id) AS n, round({D('count(id)')} / sum(count(id)) OVER (), 6) AS share, round(avg(people), 6) AS mean, min(people) AS least, max(people) AS most FROM s LEFT JOIN city ON city.size = s.size GROUP BY 1, 2")
def size_summary(spark, sf):
    sizes = spark.createDataFrame([(s, k) for k, s in enumerate(_SIZES)], "size string, position int")
    own = F.broadcast(sizes).join(_cities(spark, sf), "size", "right").groupBy("size").agg(F.count("id").alias("n"), _r(F.avg("people")).alias("mean"), F.min("people").alias("least"), F.max("people").alias("most"))
    full = sizes.join(own, "size", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).withColumn("all", F.lit(1))
    return full.select("size", "position", "n", _r(R.share("n", "all")).alias("share"), "mean", "least", "most")


@query(f"WITH {_CITY}, g(grp) AS (VALUES " + ", ".join(f"('{s}')" for s in _GROUPS) + f") SELECT g.grp, r_name AS region, count(id) AS n FROM g CROSS JOIN region LEFT JOIN city ON region = r_name AND {_GROUP} = g.grp GROUP BY 1, 2")
def sample_matrix(spark, sf):
    groups = spark.createDataFrame([(g,) for g in _GROUPS], "grp string")
    spine = read(spark, sf, "region").select(C("r_name").alias("region")).crossJoin(F.broadcast(groups))  # 25 rows
    return R.completed(_cities(spark, sf).groupBy(_group().alias("grp"), "region").agg(F.count("*").alias("n")), spine, ["grp", "region"], {"n": 0})


# ---------------------------------------------------------------- joins


@query("WITH o AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, CAST(round(o_totalprice * 100) AS BIGINT) AS v, o_orderkey FROM orders WHERE year(o_orderdate) <= 1998) SELECT o_custkey, year, o_orderkey, v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year DESC, o_orderkey DESC, v DESC) AS k FROM o) WHERE k = 1")
def asof_latest(spark, sf):
    own = read(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.round(C("o_totalprice").cast("double") * 100).cast("long").alias("v"), "o_orderkey").where("year <= 1998")
    return R.latest(own, ["o_custkey"], "year", ["o_orderkey", "v"])


@query("WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) SELECT c_custkey AS k, coalesce(a.v, b.v, -1) AS v, CASE WHEN a.v IS NOT NULL THEN 'real' WHEN b.v IS NOT NULL THEN 'proxy' ELSE 'none' END AS source FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey")
def precedence_coalesce(spark, sf):
    by = lambda y, n: read(spark, sf, "orders").where(F.year("o_orderdate") == y).groupBy(C("o_custkey").alias("k")).agg(F.max("o_orderkey").alias(n))
    own = read(spark, sf, "customer").select(C("c_custkey").alias("k")).join(by(1997, "real"), "k", "left").join(by(1996, "proxy"), "k", "left")
    return own.select("k", F.coalesce("real", "proxy", F.lit(-1)).alias("v"), F.when(C("real").isNotNull(), "real").when(C("proxy").isNotNull(), "proxy").otherwise("none").alias("source"))


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5) GROUP BY 1")
def semi_complete(spark, sf):
    events = read(spark, sf, "events")
    full = events.groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds")).where("kinds = 5")
    return events.join(full, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996)")
def anti_seen(spark, sf):
    seen = read(spark, sf, "orders").where(F.year("o_orderdate") == 1996).select(C("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


@query("WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, c_nationkey + 100 AS v FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v, b.k IS NOT NULL AS replaced FROM a FULL JOIN b ON a.k = b.k")
def upsert_index(spark, sf):
    customer = read(spark, sf, "customer")
    old = customer.where("c_custkey % 3 <> 0").select(C("c_custkey").alias("k"), C("c_nationkey").alias("old"))
    new = customer.where("c_custkey % 2 = 0").select(C("c_custkey").alias("k"), (C("c_nationkey") + 100).alias("new"))
    return old.join(new, "k", "full").select("k", F.coalesce("new", "old").alias("v"), C("new").isNotNull().alias("replaced"))


@query("SELECT c_custkey AS k, c_nationkey AS nation, CAST(NULL AS VARCHAR) AS part FROM customer UNION ALL SELECT p_partkey, NULL, p_type FROM part")
def union_align(spark, sf):
    a = read(spark, sf, "customer").select(C("c_custkey").alias("k"), C("c_nationkey").alias("nation"))
    return a.unionByName(read(spark, sf, "part").select(C("p_partkey").alias("k"), C("p_type").alias("part")), allowMissingColumns=True)


@query("SELECT o_orderkey, l_linenumber, l_partkey, o_custkey AS custkey_order, l_suppkey AS key_line, o_orderstatus AS status FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND year(l_shipdate) = year(o_orderdate)")
def wide_key_left_join(spark, sf):
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.year("l_shipdate").alias("y"))
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("oy"))
    met = line.join(orders, (C("l_orderkey") == C("o_orderkey")) & (C("y") == C("oy")), "left")
    return met.select("o_orderkey", "l_linenumber", "l_partkey", C("o_custkey").alias("custkey_order"), C("l_suppkey").alias("key_line"), C("o_orderstatus").alias("status"))


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_join(spark, sf):
    dims = read(spark, sf, "nation").join(read(spark, sf, "region"), C("n_regionkey") == C("r_regionkey"), "left")
    return read(spark, sf, "customer").join(F.broadcast(dims), C("c_nationkey") == C("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")  # 25 rows


@query(f"WITH {PANEL}, num AS (SELECT city, CAST(sum(updates) AS BIGINT) AS u FROM panel WHERE year = 1997 AND city % 2 = 0 GROUP BY 1), den AS (SELECT city, CAST(sum(n) AS BIGINT) AS n FROM panel GROUP BY 1) SELECT city, coalesce(u, 0) AS u, n, round({D('coalesce(u, 0)')} / nullif(n, 0), 6) AS ratio FROM den LEFT JOIN num USING (city)")
def ratio_join(spark, sf):
    own = panel(spark, sf)
    num = own.where("year = 1997 and city % 2 = 0").groupBy("city").agg(F.sum("updates").alias("u"))
    met = own.groupBy("city").agg(F.sum("n").alias("n")).join(num, "city", "left").na.fill({"u": 0})
    return met.withColumn("ratio", _r(F.try_divide(C("u").cast("double"), C("n").cast("double"))))


@query(f"WITH {PANEL}, t AS (SELECT region, CAST(sum(n) AS BIGINT) AS total FROM panel GROUP BY 1) SELECT region, total, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE year = {y}), 0) AS BIGINT) AS y{y}" for y in range(1995, 2002)) + " FROM panel JOIN t USING (region) GROUP BY 1, 2")
def totals_join(spark, sf):
    own = panel(spark, sf)
    wide = own.groupBy("region").pivot("year", list(range(1995, 2002))).agg(F.sum("n"))
    return own.groupBy("region").agg(F.sum("n").alias("total")).join(wide, "region").select("region", "total", *(F.coalesce(str(y), F.lit(0)).cast("long").alias(f"y{y}") for y in range(1995, 2002)))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS code FROM events")
def map_join(spark, sf):
    codes = F.create_map(*(F.lit(x) for x in ("click", 1, "view", 2, "purchase", 3)))
    return read(spark, sf, "events").select("event_id", F.coalesce(codes[C("event_type")], F.lit(0)).alias("code"))


# ---------------------------------------------------------------- dominance, heat maps, distributions

_DOM = f"{PANEL}, d AS (SELECT city, name, region, year, {D('updates')} / nullif(n, 0) AS dominance FROM panel)"


def _dominance(spark, sf):
    return panel(spark, sf).select("city", "name", "region", "year", F.try_divide(C("updates").cast("double"), C("n").cast("double")).alias("dominance"))


@query(f"WITH {_DOM} SELECT name, coalesce(CAST(min(CASE WHEN dominance > 0.5 THEN year END) AS VARCHAR), 'not_crossed') AS first_crossing, round(max(dominance), 6) AS most, round(avg(CASE WHEN dominance > 0.5 THEN 1.0 ELSE 0.0 END) * 100, 6) AS percent_above FROM d GROUP BY 1")
def dominance_first_crossing(spark, sf):
    above = C("dominance") > 0.5
    return _dominance(spark, sf).groupBy("name").agg(F.coalesce(F.min(F.when(above, C("year"))).cast("string"), F.lit("not_crossed")).alias("first_crossing"), _r(F.max("dominance")).alias("most"), _r(F.avg(F.when(above, 1.0).otherwise(0.0)) * 100).alias("percent_above"))


@query(f"WITH {_DOM}, m AS (SELECT name, avg(y) AS m FROM (SELECT name, year, avg(dominance) AS y FROM d GROUP BY 1, 2) GROUP BY 1), t AS (SELECT name FROM m ORDER BY m DESC, name LIMIT 12) SELECT name, " + ", ".join(f"round(avg(dominance) FILTER (WHERE year = {y}), 6) AS y{y}" for y in range(1995, 2002)) + " FROM d JOIN t USING (name) GROUP BY 1")
def dominance_heatmap(spark, sf):
    by_year = _dominance(spark, sf).groupBy("name", "year").agg(F.avg("dominance").alias("d"))
    best = by_year.groupBy("name").agg(F.avg("d").alias("m")).orderBy(F.desc("m"), "name").limit(12).select("name")  # the feature: twelve rows
    wide = by_year.join(F.broadcast(best), "name").groupBy("name").pivot("year", list(range(1995, 2002))).agg(F.first("d"))
    return wide.select("name", *(_r(str(y)).alias(f"y{y}") for y in range(1995, 2002)))


@query(f"WITH {PANEL} SELECT CASE WHEN people >= 40 THEN 'large' WHEN people >= 30 THEN 'medium' ELSE 'small' END AS size, year, round(avg({D('updates')} / n), 6) AS mean_rate, count(*) AS n FROM panel GROUP BY 1, 2")
def size_period_mean(spark, sf):
    size = F.when(C("people") >= 40, "large").when(C("people") >= 30, "medium").otherwise("small")
    return panel(spark, sf).groupBy(size.alias("size"), "year").agg(_r(F.avg(C("updates").cast("double") / C("n"))).alias("mean_rate"), F.count("*").alias("n"))


_IMP = "imp AS (SELECT p_type AS family, p_brand AS feature, CAST(year(l_shipdate) AS INT) AS period, sum(l_partkey % 11) - 5 * count(*) AS delta FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"


def _importance(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", C("p_type").alias("family"), C("p_brand").alias("feature"))
    line = read(spark, sf, "lineitem").select("l_partkey", F.year("l_shipdate").alias("period"))
    return line.join(part, C("l_partkey") == C("p_partkey")).groupBy("family", "feature", "period").agg((F.sum(C("l_partkey") % 11) - 5 * F.count("*")).alias("delta"))


@query(f"WITH {_IMP} SELECT period, family, CAST(sum(delta) AS BIGINT) AS delta, round({D('sum(greatest(delta, 0))')} / nullif(sum(sum(greatest(delta, 0))) OVER (PARTITION BY period), 0), 6) AS share_positive FROM imp GROUP BY 1, 2")
def group_importance_share(spark, sf):
    own = _importance(spark, sf).groupBy("period", "family").agg(F.sum("delta").alias("delta"), F.sum(F.greatest("delta", F.lit(0))).alias("up"))
    return own.select("period", "family", "delta", _r(R.share("up", "period")).alias("share_positive"))


@query(f"WITH {_IMP}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, period ORDER BY delta DESC, feature) AS k FROM imp) WHERE k = 1) SELECT feature, count(*) AS times, count(DISTINCT family) AS families, CAST(max(delta) AS BIGINT) AS best FROM t GROUP BY 1")
def top_feature_frequency(spark, sf):
    first = R.top(_importance(spark, sf), ["family", "period"], [F.desc("delta"), C("feature")], 1)
    return first.groupBy("feature").agg(F.count("*").alias("times"), F.count_distinct("family").alias("families"), F.max("delta").alias("best"))


@query(f"WITH {_IMP}, k AS (SELECT period, family || '/' || feature AS name, CAST(row_number() OVER (PARTITION BY period ORDER BY delta DESC, family, feature) AS INT) AS rank FROM imp), f AS (SELECT name, min(period * 1000 + rank) AS o FROM k WHERE rank <= 5 GROUP BY 1) SELECT name, CAST(o AS BIGINT) AS first_seen FROM f ORDER BY o LIMIT 20")
def rank_order(spark, sf):
    ranked = R.top(_importance(spark, sf), ["period"], [F.desc("delta"), C("family"), C("feature")], 5)
    seen = ranked.groupBy(F.concat_ws("/", "family", "feature").alias("name")).agg(F.min(C("period") * 1000 + C("rank")).cast("long").alias("first_seen"))
    return seen.orderBy("first_seen").limit(20)  # the feature: twenty names


@query("SELECT measure, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75 FROM (SELECT 'quantity' AS measure, CAST(l_quantity AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'part', CAST(l_partkey AS DOUBLE) FROM lineitem) GROUP BY 1")
def distribution_summary(spark, sf):
    wide = read(spark, sf, "lineitem").select(C("l_quantity").cast("double").alias("quantity"), C("l_partkey").cast("double").alias("part"))
    own = wide.unpivot([], ["quantity", "part"], "measure", "v")
    middle = T.quantiles(own, "v", [0.5, 0.25, 0.75], ["measure"]).select("measure", *(_r(C(q)).alias(n) for q, n in (("q0", "median"), ("q1", "q25"), ("q2", "q75"))))
    return own.groupBy("measure").agg(F.count("v").alias("n"), _r(F.avg("v")).alias("mean")).join(middle, "measure", "left")


@query("SELECT CAST(least(greatest(floor(l_quantity * 18 / 51), -1), 18) AS INT) + 1 AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def width_bucket_hist(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.expr("cast(width_bucket(cast(l_quantity as double), 0, 51, 18) as int)").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {_DOM} SELECT region, year, round(avg(dominance), 6) AS mean, round(stddev_samp(dominance), 6) AS std, count(DISTINCT city) AS n, round(stddev_samp(dominance) / sqrt(count(*)), 6) AS se, round(avg(dominance) - 1.96 * stddev_samp(dominance) / sqrt(count(*)), 6) AS low, round(avg(dominance) + 1.96 * stddev_samp(dominance) / sqrt(count(*)), 6) AS high FROM d GROUP BY 1, 2")
def mean_se_ci(spark, sf):
    se = F.stddev_samp("dominance") / F.sqrt(F.count("*"))
    m = F.avg("dominance")
    return _dominance(spark, sf).groupBy("region", "year").agg(_r(m).alias("mean"), _r(F.stddev_samp("dominance")).alias("std"), F.count_distinct("city").alias("n"), _r(se).alias("se"), _r(m - F.lit(1.96) * se).alias("low"), _r(m + F.lit(1.96) * se).alias("high"))


@query(f"WITH {PANEL} SELECT year, count(DISTINCT city) AS cities, CAST(sum(n) AS BIGINT) AS samples, round({D('sum(n)')} / count(DISTINCT city), 6) AS samples_per_city, round({D('sum(updates)')} / count(DISTINCT city), 6) AS updates_per_city FROM panel GROUP BY 1")
def period_city_means(spark, sf):
    cities = F.count_distinct("city")
    return panel(spark, sf).groupBy("year").agg(cities.alias("cities"), F.sum("n").alias("samples"), _r(F.sum("n").cast("double") / cities).alias("samples_per_city"), _r(F.sum("updates").cast("double") / cities).alias("updates_per_city"))


@query("SELECT p_type AS category, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS large FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT 10")
def category_top10(spark, sf):
    return read(spark, sf, "part").groupBy(C("p_type").alias("category")).agg(F.count("*").alias("n"), F.count_if(C("p_size") > 25).alias("large")).orderBy(F.desc("n"), "category").limit(10)  # the feature: ten rows


@query(f"WITH {_SUB}, s AS (SELECT from_class || '>' || to_class AS transition, period, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1, 2), t AS (SELECT transition FROM s GROUP BY 1 ORDER BY sum(n) DESC, transition LIMIT 8) SELECT transition, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE period = {p}), 0) AS BIGINT) AS p{p}" for p in range(6)) + " FROM s JOIN t USING (transition) GROUP BY 1")
def top_transition_pivot(spark, sf):
    own = _sub(spark, sf).groupBy(F.concat_ws(">", "from_class", "to_class").alias("transition"), "period").agg(F.sum("n").alias("n"))
    best = own.groupBy("transition").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "transition").limit(8).select("transition")  # the feature: eight rows
    wide = own.join(F.broadcast(best), "transition").groupBy("transition").pivot("period", list(range(6))).agg(F.sum("n"))
    return wide.select("transition", *(F.coalesce(str(p), F.lit(0)).cast("long").alias(f"p{p}") for p in range(6)))


@query(f"WITH {PANEL} SELECT city, count(*) AS years, arg_min(n, year) AS n_first, arg_max(n, year) AS n_last, CAST(sum(n) AS BIGINT) AS n_total, round(2.0 * {D('sum(updates)')} / sum(n), 6) AS mean_degree, count(*) = 7 AS complete FROM panel GROUP BY 1")
def graph_qc(spark, sf):
    return panel(spark, sf).groupBy("city").agg(F.count("*").alias("years"), F.min_by("n", "year").alias("n_first"), F.max_by("n", "year").alias("n_last"), F.sum("n").alias("n_total"), _r(F.lit(2.0) * F.sum("updates").cast("double") / F.sum("n")).alias("mean_degree"), (F.count("*") == 7).alias("complete"))


# ---------------------------------------------------------------- windows and selections


@query("WITH a AS (SELECT DISTINCT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS y FROM orders), f AS (SELECT c_custkey AS k, CAST(y.range AS INT) AS year, a.k IS NOT NULL AS raw FROM customer CROSS JOIN range(1995, 2002) y LEFT JOIN a ON a.k = c_custkey AND a.y = y.range) SELECT k, year, raw, raw OR (coalesce(bool_or(raw) OVER (PARTITION BY k ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND coalesce(bool_or(raw) OVER (PARTITION BY k ORDER BY year ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false)) AS filled FROM f")
def gap_fill(spark, sf):
    seen = read(spark, sf, "orders").select(C("o_custkey").alias("k"), F.year("o_orderdate").alias("year"), F.lit(True).alias("raw")).distinct()
    spine = read(spark, sf, "customer").select(C("c_custkey").alias("k"), F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"))
    return R.gap_filled(R.completed(seen, spine, ["k", "year"], {"raw": False}), "k", "year", "raw")


@query(f"WITH {PANEL} SELECT year, name, n, round({D('n')} / sum(n) OVER (PARTITION BY year), 6) AS share FROM panel")
def group_share(spark, sf):
    return panel(spark, sf).select("year", "name", "n", _r(R.share("n", "year")).alias("share"))


@query(f"WITH {PANEL} SELECT city, year AS year_t1, lead(year) OVER w AS year_t2, n, lead(n) OVER w - n AS change FROM panel WINDOW w AS (PARTITION BY city ORDER BY year)")
def lead_year(spark, sf):
    w = Window.partitionBy("city").orderBy("year")
    return panel(spark, sf).select("city", C("year").alias("year_t1"), F.lead("year").over(w).alias("year_t2"), "n", (F.lead("n").over(w) - C("n")).alias("change"))


@query(f"WITH {PANEL}, m AS (SELECT *, CASE WHEN n % 3 = 0 THEN n END AS seen FROM panel) SELECT city, year, seen, last_value(seen IGNORE NULLS) OVER (PARTITION BY city ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM m")
def carry_forward(spark, sf):
    own = panel(spark, sf).select("city", "year", F.when(C("n") % 3 == 0, C("n")).alias("seen"))
    return own.withColumn("carried", F.last("seen", ignorenulls=True).over(Window.partitionBy("city").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


@query(f"WITH {PANEL} SELECT city, year, round(n - avg(n) OVER (PARTITION BY city) - avg(n) OVER (PARTITION BY year) + avg(n) OVER (), 6) AS residual FROM panel")
def two_way_demean(spark, sf):
    own = panel(spark, sf).withColumn("x", C("n").cast("double"))
    grand = own.agg(F.avg("x").alias("g"))  # one row
    return own.join(F.broadcast(grand)).select("city", "year", (_r(C("x") - F.avg("x").over(R.over("city")) - F.avg("x").over(R.over("year")) + C("g"))).alias("residual"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS q FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25")
def global_topn(spark, sf):
    return read(spark, sf, "lineitem").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(25).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C("l_quantity").cast("double").alias("q"))  # the feature: 25 rows


@query(f"WITH {PANEL} SELECT region, CAST(sum(n) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY list_position(['EUROPE', 'ASIA', 'AMERICA', 'AFRICA', 'MIDDLE EAST'], region)) AS INT) AS position FROM panel GROUP BY 1")
def custom_order(spark, sf):
    order = F.array_position(F.array(*map(F.lit, ("EUROPE", "ASIA", "AMERICA", "AFRICA", "MIDDLE EAST"))), C("region"))
    own = panel(spark, sf).groupBy("region").agg(F.sum("n").alias("n")).withColumn("all", F.lit(1))
    return R.numbered(own, ["all"], [order], "position").drop("all")


@query("SELECT p_partkey, p_type, CAST(CASE p_type WHEN 'ECONOMY' THEN 0.30 WHEN 'LARGE' THEN 0.35 WHEN 'MEDIUM' THEN 0.40 WHEN 'PROMO' THEN 0.45 ELSE 0.50 END AS DOUBLE) AS least, p_size % 10 / CAST(10 AS DOUBLE) >= CAST(CASE p_type WHEN 'ECONOMY' THEN 0.30 WHEN 'LARGE' THEN 0.35 WHEN 'MEDIUM' THEN 0.40 WHEN 'PROMO' THEN 0.45 ELSE 0.50 END AS DOUBLE) AS alive FROM part")
def graded_threshold(spark, sf):
    least = F.when(C("p_type") == "ECONOMY", 0.30).when(C("p_type") == "LARGE", 0.35).when(C("p_type") == "MEDIUM", 0.40).when(C("p_type") == "PROMO", 0.45).otherwise(0.50)
    return read(spark, sf, "part").select("p_partkey", "p_type", least.alias("least"), ((C("p_size") % 10) / F.lit(10.0) >= least).alias("alive"))


@query("WITH w(want) AS (VALUES ('CHINA'), ('UNITED'), ('IA'), ('NOWHERE')), m AS (SELECT want, n_nationkey, n_name, CASE WHEN n_name = want THEN 0 ELSE 1 END AS o FROM w JOIN nation ON n_name = want OR contains(n_name, want)) SELECT want, CAST(n_nationkey AS INT) AS n_nationkey, n_name FROM (SELECT *, row_number() OVER (PARTITION BY want ORDER BY o, n_nationkey DESC) AS k FROM m) WHERE k = 1")
def name_match_fallback(spark, sf):
    wants = spark.createDataFrame([("CHINA",), ("UNITED",), ("IA",), ("NOWHERE",)], "want string")
    met = read(spark, sf, "nation").join(F.broadcast(wants), F.contains("n_name", "want")).withColumn("o", (C("n_name") != C("want")).cast("int"))  # four rows
    return R.top(met, ["want"], [C("o"), F.desc("n_nationkey")], 1, "k").select("want", C("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE (n_name LIKE '%A' OR n_name IN ('CHINA', 'JAPAN')) AND n_name <> 'INDIA' AND n_nationkey > 0")
def city_row_filter(spark, sf):
    return read(spark, sf, "nation").where((C("n_name").endswith("A") | C("n_name").isin("CHINA", "JAPAN")) & (C("n_name") != "INDIA") & (C("n_nationkey") > 0)).select("n_nationkey", "n_name")


@query("SELECT doc_id, 'ok_' || lang AS status, nullif(quality, 0) AS metric FROM documents LEFT JOIN labels USING (doc_id) WHERE starts_with('ok_' || lang, 'ok_e') AND nullif(quality, 0) IS NOT NULL")
def status_filter(spark, sf):
    own = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("ok_"), "lang").alias("status")).join(read(spark, sf, "labels").select("doc_id", F.nullif("quality", F.lit(0)).alias("metric")), "doc_id", "left")
    return own.where(C("status").startswith("ok_e") & C("metric").isNotNull())


@query("SELECT source, count(*) FILTER (WHERE toxic = 1) AS pos, count(*) FILTER (WHERE toxic = 0) AS neg, CASE WHEN count(*) FILTER (WHERE toxic = 1) >= 5 AND count(*) FILTER (WHERE toxic = 0) >= 5 THEN 'ok' ELSE 'skipped_class_support' END AS status FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def min_support(spark, sf):
    own = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.count_if(C("toxic") == 1).alias("pos"), F.count_if(C("toxic") == 0).alias("neg"))
    return own.withColumn("status", F.when((C("pos") >= 5) & (C("neg") >= 5), "ok").otherwise("skipped_class_support"))
