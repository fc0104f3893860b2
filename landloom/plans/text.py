"""Scalar functions, text, JSON, files and status tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ranking as R
from .base import read
from .registry import query

C = F.col


def _r(x, k=6):
    return F.round(x, k)


@query("WITH l AS (SELECT n_nationkey AS line, CASE WHEN n_nationkey % 4 = 0 THEN n_name END AS province, n_name AS city, (n_nationkey * 37) % 1200 AS population FROM nation) SELECT line, last_value(province IGNORE NULLS) OVER (ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS province, city, population FROM l")
def yearbook_carry_forward(spark, sf):
    """A positional file is one ordered unit: the whole yearbook is a few hundred lines."""
    lines = read(spark, sf, "nation").select(C("n_nationkey").alias("line"), F.when(C("n_nationkey") % 4 == 0, C("n_name")).alias("province"), C("n_name").alias("city"), ((C("n_nationkey") * 37) % 1200).alias("population"), F.lit("yearbook").alias("file"))
    return lines.withColumn("province", F.last("province", ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))).drop("file")


_MESSY = "CASE l_linenumber % 4 WHEN 0 THEN ' ' || l_partkey || ',000' WHEN 1 THEN l_partkey || '%' WHEN 2 THEN 'n/a' ELSE chr(10) || l_partkey END"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, coalesce(TRY_CAST(regexp_replace(trim({_MESSY}), '[,%\\n\\r]', '', 'g') AS DOUBLE), 0) AS v FROM lineitem")
def text_number_clean(spark, sf):
    key = C("l_partkey").cast("string")
    messy = F.when(C("l_linenumber") % 4 == 0, F.concat(F.lit(" "), key, F.lit(",000"))).when(C("l_linenumber") % 4 == 1, F.concat(key, F.lit("%"))).when(C("l_linenumber") % 4 == 2, "n/a").otherwise(F.concat(F.lit("\n"), key))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.number(messy).alias("v"))


@query("SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(concat('x', o_orderkey, '_', CAST(year(o_orderdate) AS VARCHAR), 'b.png'), '(?:^|\\D)(19\\d{2}|20\\d{2})(?:\\D|$)', 1), '') AS INT) AS year FROM orders")
def year_regex(spark, sf):
    name = F.concat(F.lit("x"), C("o_orderkey").cast("string"), F.lit("_"), F.year("o_orderdate").cast("string"), F.lit("b.png"))
    return read(spark, sf, "orders").select("o_orderkey", S.year_in(name).alias("year"))


_NAMES = ("cell_1", "nb_500_class_2", "R1000_NACH_mean", "R500_entropy", "R2_Integration_max", "cluster_size_log", "R3_TD_mean", "neighbor_diversity_8", "nb_R_NC", "cell_NACH")


@query("WITH n(name) AS (VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ") SELECT name, CASE WHEN starts_with(name, 'cell_') THEN 'Cell class' WHEN starts_with(name, 'nb_') THEN 'Neighborhood' WHEN regexp_matches(name, 'NACH|Choice|Integration|NAIN|_NC|_TD|_TL|_MD') THEN 'Syntax' ELSE 'Functional' END AS family FROM n")
def feature_family(spark, sf):
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").withColumn("family", S.family(C("name")))


@query("WITH p AS (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '->' END || CAST(year(o_orderdate) + 5 AS VARCHAR) AS p FROM orders) SELECT o_orderkey, regexp_replace(p, '->?', '->') AS period, (CAST(left(p, 4) AS DOUBLE) + CAST(right(p, 4) AS DOUBLE)) / 2 AS mid, left(p, 4) || chr(8211) || right(p, 2) AS label FROM p")
def period_normalise(spark, sf):
    y = F.year("o_orderdate")
    p = F.concat(y.cast("string"), F.when(C("o_orderkey") % 2 == 0, "-").otherwise("->"), (y + 5).cast("string"))
    own = read(spark, sf, "orders").select("o_orderkey", S.normal_period(S.normal_period(p)).alias("period"))
    return own.select("o_orderkey", "period", S.mid_year(C("period")).alias("mid"), F.concat(F.substring("period", 1, 4), F.lit("–"), F.substring("period", -2, 2)).alias("label"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 3")
def json_read(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k > 3")


@query("SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"grid\":{\"rows\":' || (n_nationkey + 64) || ',\"cols\":64}}' AS meta FROM nation")
def struct_json(spark, sf):
    meta = F.struct(C("n_name").alias("name"), F.struct((C("n_nationkey") + 64).alias("rows"), F.lit(64).alias("cols")).alias("grid"))
    return read(spark, sf, "nation").select("n_nationkey", F.to_json(meta).alias("meta"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS twice FROM events")
def json_struct(spark, sf):
    return read(spark, sf, "events").select("event_id", "event_type", (F.get_json_object("props", "$.k").cast("long") * 2).alias("twice"))


@query("SELECT k, CAST(('0x' || substr(h, 2, 2))::INT AS INT) AS r, CAST(('0x' || substr(h, 4, 2))::INT AS INT) AS g, CAST(('0x' || substr(h, 6, 2))::INT AS INT) AS b FROM (VALUES (0, '#f0f0f0'), (1, '#f9a825'), (2, '#e31a1c'), (3, '#006380'), (4, '#6d4c41'), (5, '#616161'), (6, '#388e3c')) t(k, h)")
def hex_to_rgb(spark, sf):
    own = spark.createDataFrame(list(enumerate(("#f0f0f0", "#f9a825", "#e31a1c", "#006380", "#6d4c41", "#616161", "#388e3c"))), "k int, h string")
    return own.select("k", S.hex_rgb(C("h")).alias("x")).select("k", "x.*")


# ---------------------------------------------------------------- files


@query("WITH f AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, page_id, url, CASE WHEN contains(url, '/en/') THEN 0 ELSE 1 END AS priority FROM pages) SELECT host, page_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority, page_id) AS k FROM f) WHERE k = 1")
def file_priority_pick(spark, sf):
    own = read(spark, sf, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "page_id", F.when(F.contains("url", F.lit("/en/")), 0).otherwise(1).alias("priority"))
    return R.top(own, ["host"], [C("priority"), C("page_id")], 1, "k").drop("k")


@query("SELECT p_partkey FROM (SELECT p_partkey, p_partkey % 100 AS x0, p_partkey % 100 + p_size AS x1, p_partkey % 37 AS y0, p_partkey % 37 + p_size AS y1 FROM part) WHERE x1 >= 40 AND x0 <= 60 AND y1 >= 10 AND y0 <= 20")
def bbox_prefilter(spark, sf):
    x, y = C("p_partkey") % 100, C("p_partkey") % 37
    return read(spark, sf, "part").where((x + C("p_size") >= 40) & (x <= 60) & (y + C("p_size") >= 10) & (y <= 20)).select("p_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey BETWEEN 100 AND 300")
def filtered_csv_shape(spark, sf):
    return read(spark, sf, "orders").where("o_orderstatus = 'O' and o_custkey between 100 and 300").select("o_orderkey", "o_custkey")


@query("SELECT regexp_extract(url, '://([^/]*)/([a-z]+)/', 2) AS city, count(*) AS n FROM pages GROUP BY 1")
def path_partition_value(spark, sf):
    return read(spark, sf, "pages").groupBy(F.regexp_extract("url", "://([^/]*)/([a-z]+)/", 2).alias("city")).agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(url, '://[^/?#]*', '://<redacted>') AS url FROM pages")
def redacted_sink(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_replace("url", "://[^/?#]*", "://<redacted>").alias("url"))


@query("SELECT user_id, arg_max(event_type, ts * 0 + event_id) AS status, count(*) AS steps, CAST(date_diff('second', min(ts), max(ts)) AS BIGINT) AS elapsed_s, coalesce(bool_or(event_type = 'error'), false) AS failed FROM (SELECT user_id, event_type, event_id, ts AS t0, ts, 0 AS z FROM events) GROUP BY 1".replace("ts * 0 + event_id", "event_id"))
def batch_status(spark, sf):
    seconds = lambda x: F.unix_timestamp(x.cast("timestamp"))
    return read(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.count("*").alias("steps"), (seconds(F.max("ts")) - seconds(F.min("ts"))).alias("elapsed_s"), F.bool_or(C("event_type") == "error").alias("failed"))


def _case(name):
    return "CASE " + " ".join(f"WHEN regexp_matches({name}, '{pattern}') THEN '{group}'" for pattern, group in S.FINE_GROUPS) + " END"


@query("WITH n(name) AS (VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + f") SELECT name, {_case('name')} AS fine_group FROM n")
def fine_feature_group(spark, sf):
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").withColumn("fine_group", S.fine_group(C("name")))


@query("SELECT p_partkey, replace(replace(p_name || '市', '市', ''), ' ', '_') AS slug FROM part")
def city_slug(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.slug(F.concat("p_name", F.lit("市"))).alias("slug"))


#: What a progress table shows for a step.
STEP_LABELS = {"click": "selecting", "purchase": "storing"}


@query(
    "WITH log AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'note ' ELSE 'RUN ' END || event_type || ' ' AS line FROM events), "
    "last AS (SELECT user_id, trim(substr(arg_max(line, event_id) FILTER (WHERE starts_with(line, 'RUN ')), 5)) AS step FROM log GROUP BY 1) "
    "SELECT user_id, CASE " + " ".join(f"WHEN step = '{k}' THEN '{v}'" for k, v in STEP_LABELS.items()) + " ELSE coalesce(nullif(step, ''), 'computing') END AS step FROM last"
)
def current_step(spark, sf):
    line = F.concat(F.when(C("event_id") % 3 == 0, "note ").otherwise("RUN "), C("event_type"), F.lit(" "))
    log = read(spark, sf, "events").select("user_id", "event_id", line.alias("line"))
    last = log.groupBy("user_id").agg(F.max_by("line", F.when(C("line").startswith("RUN "), C("event_id"))).alias("line"))
    step = F.trim(F.substring("line", 5, 1000))
    shown = F.coalesce(*(F.when(step == k, v) for k, v in STEP_LABELS.items()), F.when(step != "", step), F.lit("computing"))
    return last.select("user_id", F.when(C("line").startswith("RUN "), shown).otherwise("computing").alias("step"))


# ---------------------------------------------------------------- arithmetic

_E = "(SELECT event_id, CAST(value AS DOUBLE) AS v FROM events)"


def _values(spark, sf):
    return read(spark, sf, "events").select("event_id", C("value").cast("double").alias("v"))


@query(f"SELECT event_id, round(ln(nullif(abs(v), 0)), 6) AS ln_v, round(ln(1 + greatest(v, 0)), 6) AS log1p_v, round(pow(abs(v), 1.2), 6) AS pow_v FROM {_E}")
def log_transforms(spark, sf):
    v = C("v")
    return _values(spark, sf).select("event_id", _r(F.ln(F.nullif(F.abs(v), F.lit(0.0)))).alias("ln_v"), _r(F.log1p(F.greatest(v, F.lit(0.0)))).alias("log1p_v"), _r(F.pow(F.abs(v), F.lit(1.2))).alias("pow_v"))


@query("SELECT p_partkey, CAST(round_even(p_size / CAST(2 AS DOUBLE), 0) AS BIGINT) AS half_even, CAST(trunc(p_size / CAST(2 AS DOUBLE)) AS BIGINT) AS truncated FROM part")
def half_even_rounding(spark, sf):
    half = C("p_size") / F.lit(2.0)
    return read(spark, sf, "part").select("p_partkey", F.rint(half).cast("long").alias("half_even"), half.cast("long").alias("truncated"))


@query("SELECT n, round(-sum(CASE WHEN k > 0 THEN k / CAST(n AS DOUBLE) * ln(k / CAST(n AS DOUBLE)) ELSE 0 END), 6) AS entropy, c_nationkey FROM (SELECT c_nationkey, count(*) AS k, sum(count(*)) OVER (PARTITION BY c_nationkey) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) GROUP BY c_nationkey, n".replace("SELECT n,", "SELECT CAST(n AS BIGINT) AS n,"))
def entropy(spark, sf):
    own = read(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("k"))
    counts = own.groupBy("c_nationkey").agg(F.sum("k").alias("n"), F.collect_list("k").alias("ks"))  # five segments
    return counts.select("n", _r(-F.aggregate("ks", F.lit(0.0), lambda s, k: s + k.cast("double") / C("n") * F.ln(k.cast("double") / C("n")))).alias("entropy"), "c_nationkey")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS dominant, round(CAST(list_sort(embedding, 'DESC')[1] AS DOUBLE) - CAST(list_sort(embedding, 'DESC')[2] AS DOUBLE), 6) AS purity, round(1 - CAST(list_max(embedding) AS DOUBLE), 6) AS boundary FROM embeddings")
def argmax_purity(spark, sf):
    from ..operators.focal import top_two

    parts = [C("embedding")[k] for k in range(64)]
    at, most, second = top_two(parts)
    return read(spark, sf, "embeddings").select("vec_id", at.alias("dominant"), _r(most.cast("double") - second.cast("double")).alias("purity"), _r(1 - most.cast("double")).alias("boundary"))


@query(f"SELECT event_id, round(least(greatest(v, 10), 50), 6) AS clipped, CASE WHEN v > 50 THEN 1 ELSE 0 END AS high, round(coalesce(nullif(v, 0), 1), 6) AS filled FROM {_E}")
def clip_where(spark, sf):
    v = C("v")
    return _values(spark, sf).select("event_id", _r(F.least(F.greatest(v, F.lit(10.0)), F.lit(50.0))).alias("clipped"), F.when(v > 50, 1).otherwise(0).alias("high"), _r(F.coalesce(F.nullif(v, F.lit(0.0)), F.lit(1.0))).alias("filled"))


@query("SELECT p_partkey, round(CAST(p_partkey AS DOUBLE) / nullif(p_size % 5, 0), 6) AS ratio, coalesce(round(CAST(p_partkey AS DOUBLE) / nullif(p_size % 5, 0), 6), 0) AS ratio_or_zero FROM part")
def safe_divide(spark, sf):
    ratio = _r(S.safe_ratio(C("p_partkey"), C("p_size") % 5))
    return read(spark, sf, "part").select("p_partkey", ratio.alias("ratio"), F.coalesce(ratio, F.lit(0.0)).alias("ratio_or_zero"))


@query("SELECT vec_id, round((180 - degrees(acos(greatest(-1, least(1, (x1 * x2 + y1 * y2) / (sqrt(x1 * x1 + y1 * y1) * sqrt(x2 * x2 + y2 * y2))))))) / 90, 5) AS cost FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) x1, CAST(embedding[2] AS DOUBLE) y1, CAST(embedding[3] AS DOUBLE) x2, CAST(embedding[4] AS DOUBLE) y2 FROM embeddings)")
def angle_cost(spark, sf):
    e = [C("embedding")[k].cast("double") for k in range(4)]
    return read(spark, sf, "embeddings").select("vec_id", _r(S.angular_cost(*e), 5).alias("cost"))


@query("WITH q AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * 1.7 AS d FROM part) SELECT p_partkey, round(CASE WHEN d < 30 THEN d / 30 * 4 WHEN d < 60 THEN 4 + (d - 30) / 30 * 2 ELSE 6 + (least(d, 90) - 60) / 30 * 3 END, 6) AS y FROM q")
def interpolate(spark, sf):
    """Linear interpolation over knots: 0, 30, 60, 90 -> 0, 4, 6, 9."""
    d = F.least(C("p_size") * F.lit(1.7), F.lit(90.0))
    knots = F.array(*(F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1"), F.lit(float(p)).alias("y0"), F.lit(float(q)).alias("y1")) for a, b, p, q in ((0, 30, 0, 4), (30, 60, 4, 6), (60, 90, 6, 9))))
    part = F.element_at(F.filter(knots, lambda k: (k["x0"] <= d) & (d <= k["x1"])), -1)
    return read(spark, sf, "part").select("p_partkey", _r(part["y0"] + (d - part["x0"]) / (part["x1"] - part["x0"]) * (part["y1"] - part["y0"])).alias("y"))


@query("SELECT p_partkey, CAST(i.range AS INT) AS i, round(p_size + i.range * CAST(p_retailprice AS DOUBLE) / (greatest(p_size % 7, 3) - 1), 6) AS x FROM part, LATERAL range(greatest(p_size % 7, 3)) i")
def linspace_samples(spark, sf):
    n = F.greatest(C("p_size") % 7, F.lit(3)).cast("int")
    own = read(spark, sf, "part").select("p_partkey", "p_size", C("p_retailprice").cast("double").alias("span"), n.alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), C("n") - 1)))
    return own.select("p_partkey", "i", _r(C("p_size") + C("i") * C("span") / (C("n") - 1)).alias("x"))


@query("SELECT n_nationkey, round(b - 1.96 * se, 6) AS low, round(b + 1.96 * se, 6) AS high, CASE WHEN p < 0.001 THEN 'p < 0.001' ELSE 'p = ' || printf('%.3f', p) END AS label FROM (SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) / 10 AS b, CAST(n_regionkey + 1 AS DOUBLE) / 7 AS se, CAST(n_nationkey AS DOUBLE) / 25 AS p FROM nation)")
def ci_label(spark, sf):
    own = read(spark, sf, "nation").select("n_nationkey", (C("n_nationkey").cast("double") / 10).alias("b"), ((C("n_regionkey") + 1).cast("double") / 7).alias("se"), (C("n_nationkey").cast("double") / 25).alias("p"))
    return own.select("n_nationkey", _r(C("b") - F.lit(1.96) * C("se")).alias("low"), _r(C("b") + F.lit(1.96) * C("se")).alias("high"), F.when(C("p") < 0.001, "p < 0.001").otherwise(F.concat(F.lit("p = "), F.format_string("%.3f", "p"))).alias("label"))


@query("SELECT doc_id, TRY_CAST(left(text, 2) AS INT) AS n FROM documents")
def try_cast(spark, sf):
    return read(spark, sf, "documents").select("doc_id", S.whole_number(F.substring("text", 1, 2)).alias("n"))


@query(f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(v, 6) END AS v, CASE WHEN event_id % 5 = 0 THEN 0 ELSE round(v, 6) END AS zeroed FROM {_E}")
def nan_to_null(spark, sf):
    own = _values(spark, sf).withColumn("v", F.when(C("event_id") % 5 == 0, float("nan")).otherwise(C("v")))
    return own.select("event_id", _r(F.when(~F.isnan("v"), C("v"))).alias("v"), _r(S.finite(C("v"))).alias("zeroed"))


@query("SELECT user_id, bool_or(event_type = 'error') AS any_error, bool_and(event_type <> 'signup') AS no_signup, CAST(count(DISTINCT event_type) AS INT) AS kinds FROM events GROUP BY 1")
def array_predicates(spark, sf):
    kinds = read(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))  # five types at most
    return kinds.select("user_id", F.exists("k", lambda x: x == "error").alias("any_error"), F.forall("k", lambda x: x != "signup").alias("no_signup"), F.size(F.array_distinct("k")).alias("kinds"))
