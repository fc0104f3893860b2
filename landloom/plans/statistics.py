"""Slopes, rank tests, fixed effects and classifier metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from .base import PAIRS, PANEL, pairs, panel, read
from .registry import query

C = F.col
_SCORED = "s AS (SELECT quality AS label, n_chars AS score, lang FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf):
    return read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select(C("quality").alias("label"), C("n_chars").alias("score"), "lang")


@query(f"WITH {_SCORED}, r AS (SELECT lang, label, CAST(rank() OVER (PARTITION BY lang ORDER BY score) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY lang, score) AS DOUBLE) - 1) / 2 AS k FROM s), t AS (SELECT lang, sum(k) FILTER (WHERE label = 1) AS r, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS q FROM r GROUP BY 1) SELECT lang, round((r - p * (p + 1) / 2) / nullif(p * q, 0), 6) AS auc FROM t")
def auc_exact(spark, sf):
    return S.auc(_scored(spark, sf), "label", "score", ["lang"]).select("lang", F.round("auc", 6).alias("auc"))


@query(f"WITH {_SCORED}, g AS (SELECT lang, score, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS p FROM s GROUP BY 1, 2), c AS (SELECT lang, p, sum(p) OVER w AS tp, sum(n) OVER w AS a FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC)) SELECT lang, round(sum(p * tp / a) / nullif(sum(p), 0), 6) AS ap FROM c GROUP BY 1")
def average_precision(spark, sf):
    return S.average_precision(_scored(spark, sf), "label", "score", ["lang"]).select("lang", F.round("ap", 6).alias("ap"))


@query(f"WITH {_SCORED} SELECT lang, count(*) AS n, round(avg(score) FILTER (WHERE label = 1), 6) AS mean_pos, round(avg(score) FILTER (WHERE label = 0), 6) AS mean_neg, CAST(median(score) AS DOUBLE) AS median FROM s GROUP BY 1")
def ap_table(spark, sf):
    mean = lambda k: F.round(F.avg(F.when(C("label") == k, C("score"))), 6)
    return _scored(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), mean(1).alias("mean_pos"), mean(0).alias("mean_neg"), F.median("score").alias("median"))


@query(f"WITH {PANEL} SELECT city, round(regr_slope(CAST(n AS DOUBLE), CAST(year AS DOUBLE)) * 10, 6) AS slope, count(*) AS n FROM panel GROUP BY 1 HAVING count(*) >= 3")
def slope_per_decade(spark, sf):
    return S.slopes(panel(spark, sf), "city", "year", "n", 10).select("city", F.round("slope", 6).alias("slope"), "n")


@query(f"WITH {PANEL}, s AS (SELECT city, regr_slope(CAST(n AS DOUBLE), CAST(year AS DOUBLE)) * 10 AS slope FROM panel GROUP BY 1 HAVING count(*) >= 3) SELECT count(*) AS cities, round(avg(slope), 6) AS mean_slope, round(avg(CASE WHEN slope < 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS percent_negative FROM s")
def slope_summary(spark, sf):
    return S.slopes(panel(spark, sf), "city", "year", "n", 10).agg(F.count("*").alias("cities"), F.round(F.avg("slope"), 6).alias("mean_slope"), F.round(F.avg((C("slope") < 0).cast("double")) * 100, 6).alias("percent_negative"))


@query(f"WITH {PANEL}, r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / CAST(2 AS DOUBLE) AS a, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / CAST(2 AS DOUBLE) AS b FROM panel) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r")
def spearman(spark, sf):
    return S.spearman(panel(spark, sf), "n", "value").select(F.round("rho", 6).alias("rho"), "n")


@query(f"WITH {PANEL}, r AS (SELECT region, n, CAST(rank() OVER (ORDER BY n) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY n) AS DOUBLE) - 1) / 2 AS k FROM panel), t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT count(*) AS c FROM panel GROUP BY n)), g AS (SELECT sum(k) AS r, CAST(count(*) AS DOUBLE) AS m FROM r GROUP BY region), z AS (SELECT sum(r * r / m) AS s, sum(m) AS m, count(*) AS groups FROM g) SELECT round((12 / (m * (m + 1)) * s - 3 * (m + 1)) / (1 - ties / (m * m * m - m)), 6) AS h, groups - 1 AS df, CAST(m AS BIGINT) AS n FROM z, t")
def kruskal_h(spark, sf):
    return S.kruskal(panel(spark, sf), "region", "n").select(F.round("h", 6).alias("h"), "df", "n")


@query(f"WITH {PANEL}, d AS (SELECT n - avg(n) OVER (PARTITION BY city) - avg(n) OVER (PARTITION BY year) + avg(n) OVER () AS y, people - avg(people) OVER (PARTITION BY city) - avg(people) OVER (PARTITION BY year) + avg(people) OVER () AS x FROM panel) SELECT count(*) AS n, round(sum(x * y) / sum(x * x), 5) AS slope FROM d")
def twfe_balanced(spark, sf):
    inner = S.within_balanced(panel(spark, sf), "city", "year", ["n", "people"])
    return inner.agg(F.count("*").alias("n"), F.round(F.sum(C("people") * C("n")) / F.sum(C("people") * C("people")), 5).alias("slope")).select("n", "slope")


@query(f"WITH {PANEL}, m AS (SELECT count(*) AS k, avg(CAST(people AS DOUBLE)) AS mx, avg(CAST(n AS DOUBLE)) AS my, regr_slope(CAST(n AS DOUBLE), CAST(people AS DOUBLE)) AS b FROM panel), e AS (SELECT people - mx AS dx, n - my - b * (people - mx) AS e, k, b FROM panel, m), v AS (SELECT any_value(b) AS b, any_value(k) AS k, sqrt(sum(dx * dx * e * e) / (sum(dx * dx) * sum(dx * dx)) * any_value(k) / (any_value(k) - 2)) AS se FROM e) SELECT round(b, 6) AS coefficient, round(se, 6) AS se, round(b - 1.96 * se, 6) AS low, round(b + 1.96 * se, 6) AS high, k AS n FROM v")
def ols_hc1(spark, sf):
    own = panel(spark, sf)
    (_, b, se, _, _), _ = S.ols(own, "n", ["people"])
    return own.agg(F.count("*").alias("n")).select(F.round(F.lit(b), 6).alias("coefficient"), F.round(F.lit(se), 6).alias("se"), F.round(F.lit(b - 1.96 * se), 6).alias("low"), F.round(F.lit(b + 1.96 * se), 6).alias("high"), "n")


@query()
def twfe_specifications(spark, sf):
    """Four nested specifications after two-way demeaning: coefficients, HC1 errors, p and within R2."""
    own = panel(spark, sf).withColumns({"y": F.ln(C("n").cast("double")), "a": F.ln(C("people").cast("double")), "b": F.ln(C("value").cast("double")), "c": C("updates").cast("double") / C("n")})
    from ..operators.durable import cut

    inner = cut(S.within_balanced(own, "city", "year", ["y", "a", "b", "c"]))
    out = []
    for name, xs in (("M1", ["a"]), ("M2", ["a", "b"]), ("M3", ["a", "c"]), ("M4", ["a", "b", "c"])):
        fit = S.ols(inner, "y", xs, intercept=False)
        pred = sum((C(x) * F.lit(row[1]) for x, row in zip(xs, fit, strict=True)), F.lit(0.0))
        r2 = inner.agg(1 - F.sum((C("y") - pred) * (C("y") - pred)) / F.sum(C("y") * C("y"))).first()[0]
        out += [(name, *row, float(r2)) for row in fit]
    return spark.createDataFrame(out, "spec string, term string, coefficient double, se double, t double, p double, within_r2 double")


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query(
    f"WITH {PANEL}, p AS (SELECT 'all' AS scope, region, n FROM panel UNION ALL SELECT 'recent', region, n FROM panel WHERE year >= 1999), "
    "r AS (SELECT scope, region, CAST(rank() OVER (PARTITION BY scope ORDER BY n) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY scope, n) AS DOUBLE) - 1) / 2 AS k FROM p), "
    "t AS (SELECT scope, sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT scope, count(*) AS c FROM p GROUP BY scope, n) GROUP BY scope), "
    "g AS (SELECT scope, region, sum(k) AS r, CAST(count(*) AS DOUBLE) AS m FROM r GROUP BY ALL), z AS (SELECT scope, sum(r * r / m) AS s, sum(m) AS m, count(*) AS groups FROM g GROUP BY scope), "
    "h AS (SELECT scope, (12 / (m * (m + 1)) * s - 3 * (m + 1)) / (1 - ties / (m * m * m - m)) AS h, groups - 1 AS df FROM z JOIN t USING (scope)), "
    "md AS (SELECT scope, " + ", ".join(f"median(n) FILTER (WHERE region = '{r}') AS {r.replace(' ', '_')}" for r in _REGIONS) + " FROM p GROUP BY scope) "
    "SELECT scope, round(h, 6) AS h, df, round(exp(-h / 2) * (1 + h / 2), 6) AS p, " + ", ".join(r.replace(" ", "_") for r in _REGIONS) + " FROM h JOIN md USING (scope)"
)
def kruskal_scopes(spark, sf):
    """H, its p and the medians of each region, over all years and the recent ones."""
    own = panel(spark, sf)
    out = []
    for scope, part in (("all", own), ("recent", own.where("year >= 1999"))):
        r = S.kruskal(part, "region", "n").first()
        out.append((scope, round(r.h, 6), r.df, round(S.chi2_tail(r.h, r.df), 6)))
    tests = spark.createDataFrame(out, "scope string, h double, df long, p double")
    scopes = F.explode(F.when(C("year") >= 1999, F.array(F.lit("all"), F.lit("recent"))).otherwise(F.array(F.lit("all"))))
    medians = own.withColumn("scope", scopes).groupBy("scope").pivot("region", list(_REGIONS)).agg(F.median("n"))
    return tests.join(medians.withColumnsRenamed({r: r.replace(" ", "_") for r in _REGIONS}), "scope")


@query(
    f"WITH {PANEL}, r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / CAST(2 AS DOUBLE) AS a, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / CAST(2 AS DOUBLE) AS b FROM panel), "
    "s AS (SELECT corr(a, b) AS rho, count(*) AS n, CAST(count(*) - 2 AS DOUBLE) AS df FROM r), q AS (SELECT *, atan(abs(rho * sqrt(df / greatest(CAST(1e-12 AS DOUBLE), 1 - rho * rho))) / sqrt(df)) AS top FROM s), "
    "f AS (SELECT rho, n, df, sum(CASE WHEN i.range IN (0, 2000) THEN 1 WHEN i.range % 2 = 1 THEN 4 ELSE 2 END * pow(cos(i.range * top / 2000), df - 1)) * any_value(top) / 6000 AS area FROM q, range(2001) i GROUP BY ALL) "
    "SELECT round(rho, 6) AS rho, n, round(greatest(0, 1 - area / (sqrt(pi()) * exp(lgamma(df / 2) - lgamma((df + 1) / 2)) / 2)), 6) AS p FROM f"
)
def spearman_p(spark, sf):
    r = S.spearman(panel(spark, sf), "n", "value").first()
    t = r.rho * ((r.n - 2) / max(1e-12, 1 - r.rho**2)) ** 0.5
    return spark.createDataFrame([(round(r.rho, 6), r.n, round(S.student_p(t, r.n - 2), 6))], "rho double, n long, p double")


@query(f"WITH {PAIRS} SELECT y1, round(CAST(count(*) FILTER (WHERE lu1 IN (1, 4) AND lu2 IN (1, 4)) AS DOUBLE) / count(*), 6) AS reciprocal, round(CAST(count(*) FILTER (WHERE lu2 IN (2, 3)) AS DOUBLE) / count(*), 6) AS to_services, round(CAST(count(*) FILTER (WHERE lu1 = 4 AND lu2 IN (2, 3)) AS DOUBLE) / nullif(count(*) FILTER (WHERE lu1 = 4), 0), 6) AS industry_to_services FROM pairs WHERE lu1 BETWEEN 1 AND 6 AND lu2 BETWEEN 1 AND 6 AND lu1 <> lu2 GROUP BY 1")
def reciprocal_share(spark, sf):
    moved = pairs(spark, sf).where("lu1 between 1 and 6 and lu2 between 1 and 6 and lu1 <> lu2")
    share = lambda a, b: F.round(F.try_divide(F.count_if(a).cast("double"), F.count_if(b).cast("double")), 6)
    every, four = F.lit(True), C("lu1") == 4
    return moved.groupBy("y1").agg(share(C("lu1").isin(1, 4) & C("lu2").isin(1, 4), every).alias("reciprocal"), share(C("lu2").isin(2, 3), every).alias("to_services"), share(four & C("lu2").isin(2, 3), four).alias("industry_to_services"))


@query(f"WITH {PANEL} SELECT region, round(regr_slope(CAST(value AS DOUBLE), CAST(n AS DOUBLE)) / 1000, 5) AS slope, round(regr_intercept(CAST(value AS DOUBLE), CAST(n AS DOUBLE)) / 1000000, 5) AS intercept, CAST(min(n) AS BIGINT) AS low, CAST(max(n) AS BIGINT) AS high FROM panel GROUP BY 1")
def line_fit(spark, sf):
    y, x = C("value").cast("double"), C("n").cast("double")
    return panel(spark, sf).groupBy("region").agg(F.round(F.regr_slope(y, x) / 1000, 5).alias("slope"), F.round(F.regr_intercept(y, x) / 1000000, 5).alias("intercept"), F.min("n").alias("low"), F.max("n").alias("high"))


@query(f"WITH {PANEL} SELECT region, round(avg(n) FILTER (WHERE year = 1995), 6) AS first_mean, round(avg(n) FILTER (WHERE year = 2000), 6) AS last_mean, round(avg(n) FILTER (WHERE year = 2000) - avg(n) FILTER (WHERE year = 1995), 6) AS change FROM panel GROUP BY 1")
def first_last_means(spark, sf):
    mean = lambda y: F.avg(F.when(C("year") == y, C("n")))
    return panel(spark, sf).groupBy("region").agg(F.round(mean(1995), 6).alias("first_mean"), F.round(mean(2000), 6).alias("last_mean"), F.round(mean(2000) - mean(1995), 6).alias("change"))
