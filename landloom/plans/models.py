"""The assembled feature table and the models over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cells as K
from ..operators import focal
from ..operators import models as M
from ..operators.durable import cut
from .base import GRID, PAIRS, G, grid, pairs
from .grid import FUNCTIONAL_RADII, NEAR_RADII, WHOLE, _box_sql, functional_sql, near_sql, rounded
from .registry import query
from .roads import METRICS, syntax_cells

C = F.col
CELL = [f"c{k}" for k in range(7)]
NEAR = [f"{n}_{k}" for k in NEAR_RADII for n in (*(f"ratio_c{j}" for j in range(7)), "built", "road", "entropy", "dominant")]
FUNCTIONAL = [*(f"fn_{n}_{k}" for k in FUNCTIONAL_RADII for n in ("entropy", "purity", "built", "boundary")), "cluster_size_log", "diversity"]
SYNTAX = [f"{how}_{m}" for how in ("mean", "max") for m in METRICS]
#: The feature sets of the ablation.
SETS = {
    "M0": CELL, "M1": [*CELL, *NEAR], "M2": [*CELL, *SYNTAX], "M3": [*CELL, *FUNCTIONAL], "M4": [*CELL, *NEAR, *SYNTAX], "M5": [*CELL, *NEAR, *FUNCTIONAL],
    "M6": [*CELL, *SYNTAX, *FUNCTIONAL], "M7": [*CELL, *NEAR, *SYNTAX, *FUNCTIONAL],
}
#: Periods that begin before this year train, the others test.
FIRST_TEST = 1996
#: Partitions of a table that has only the grid's own features.
PARTS = 8


def _features(spark, sf):
    """is_update with the class, neighbourhood and functional features of t1, of the sampled cells of every period."""
    full = grid(spark, sf)
    later = full.select((C("year") - 1).alias("year"), "r", "c", C("lu").alias("lu2"))
    whole = focal.functional(full, FUNCTIONAL_RADII, G, G)
    whole = whole.withColumnsRenamed({n: f"fn_{n}" for n in whole.columns[3:] if f"fn_{n}" in FUNCTIONAL})
    met = K.one_hot(full).join(later, ["year", "r", "c"]).where("lu between 1 and 6 and lu2 between 1 and 6")
    met = met.join(focal.neighbourhood(full, NEAR_RADII), ["year", "r", "c"]).join(whole, ["year", "r", "c"])
    names = [*NEAR, *FUNCTIONAL]
    return met.select("year", "r", "c", (C("year") * G * G + C("r") * G + C("c")).cast("long").alias("id"), (C("lu") != C("lu2")).cast("int").alias("is_update"), *(C(h).cast("double").alias(h) for h in CELL), *names)


@query(
    f"WITH RECURSIVE {GRID}, {_box_sql(sorted({*NEAR_RADII, *FUNCTIONAL_RADII}))}, {WHOLE} SELECT s.year, CAST(s.year * {G * G} + s.r * {G} + s.c AS BIGINT) AS id, CAST(a.lu <> b.lu AS INT) AS is_update, "
    + ", ".join(f"CAST(CASE WHEN a.lu = {k} THEN 1 ELSE 0 END AS DOUBLE) AS c{k}" for k in range(7)) + f", {near_sql(NEAR_RADII)}, {functional_sql(FUNCTIONAL_RADII, 'fn_')}, cluster_size_log, diversity "
    "FROM s JOIN grid a ON a.year = s.year AND a.r = s.r AND a.c = s.c JOIN grid b ON b.year = s.year + 1 AND b.r = s.r AND b.c = s.c JOIN f ON f.year = s.year AND f.r = s.r AND f.c = s.c WHERE a.lu BETWEEN 1 AND 6 AND b.lu BETWEEN 1 AND 6"
)
def feature_matrix(spark, sf):
    return rounded(_features(spark, sf).drop("r", "c"), CELL)


def _split(spark, sf, features=SETS["M7"]):
    """Training and test periods of the feature table with these columns; the network's features of a cell hold for all periods.

    The network is searched only for features that are its own: the join adds columns to the same rows."""
    own = _features(spark, sf)
    if set(features) & set(SYNTAX):
        own = own.join(syntax_cells(spark, sf), ["r", "c"], "left")
    else:  # boosting depends on how rows lie in partitions: a place by id is the same in every run
        own = own.repartition(PARTS, "id").sortWithinPartitions("id")
    own = cut(own.select("year", "id", "is_update", *(C(n) if n in CELL else S.finite(C(n).cast("double")).alias(n) for n in features)))
    return own.where(C("year") < FIRST_TEST), own.where(C("year") >= FIRST_TEST)


@query()
def ablation(spark, sf):
    train, test = _split(spark, sf)
    return M.ablation(train, test, "is_update", SETS)


@query()
def random_forest(spark, sf):
    train, test = _split(spark, sf)
    model = M.forest(SETS["M7"], "is_update").fit(M.balanced_weights(train, "is_update"))
    return spark.createDataFrame([("forest", *M.evaluate(model, test, "is_update"))], "model string, auc double, ap double")


@query()
def logistic_regression(spark, sf):
    train, test = _split(spark, sf)
    model = M.logistic(SETS["M7"], "is_update", train.count()).fit(M.balanced_weights(train, "is_update"))
    return spark.createDataFrame([("logistic", *M.evaluate(model, test, "is_update"))], "model string, auc double, ap double")


def _fitted(spark, sf, features):
    train, test = _split(spark, sf, features)
    return M.boosted(features, "is_update", M.ROUNDS, M.DEPTH).fit(train), test


@query()
def permutation_importance(spark, sf):
    model, test = _fitted(spark, sf, SETS["M7"])
    return M.permutation_importance(model, test, "is_update", SETS["M7"], "id")


@query()
def period_importance(spark, sf):
    """Importance in each test period of the features of cells and their functional whole, and their group's share."""
    model, test = _fitted(spark, sf, SETS["M3"])
    years = sorted(r.year for r in test.select("year").distinct().collect())  # periods
    out = None
    for year in years:
        own = M.permutation_importance(model, test.where(C("year") == year), "is_update", SETS["M3"], "id").withColumn("year", F.lit(year))
        out = own if out is None else out.unionByName(own)
    return out


@query()
def partial_dependence(spark, sf):
    model, test = _fitted(spark, sf, SETS["M3"])
    return M.partial_dependence(model, test, "fn_entropy_5", [0.05 + 0.9 * k / 11 for k in range(12)])


@query(
    f"WITH {PAIRS}, s AS (SELECT y1 AS year, CAST(y1 * {G * G} + r * {G} + c AS BIGINT) AS id, CAST(lu1 <> lu2 AS INT) AS is_update FROM pairs WHERE lu1 BETWEEN 1 AND 6 AND lu2 BETWEEN 1 AND 6), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY year, is_update ORDER BY CAST('0x' || substr(md5(id || ' 42'), 1, 8) AS BIGINT), id) AS place, count(*) OVER (PARTITION BY year, is_update) AS size FROM s) "
    "SELECT year, id, is_update, place <= round(size * 0.65) AS is_train FROM p"
)
def stratified_split(spark, sf):
    own = pairs(spark, sf).where("lu1 between 1 and 6 and lu2 between 1 and 6")
    rows = own.select(C("y1").alias("year"), (C("y1") * G * G + C("r") * G + C("c")).cast("long").alias("id"), (C("lu1") != C("lu2")).cast("int").alias("is_update"))
    return M.stratified_split(rows, "is_update", "id", keys=["year"]).select("year", "id", "is_update", "is_train")


_MOST = 500


@query(
    f"WITH {PAIRS}, s AS (SELECT y1 AS year, CAST(y1 * {G * G} + r * {G} + c AS BIGINT) AS id, CAST(lu1 <> lu2 AS INT) AS is_update FROM pairs WHERE lu1 BETWEEN 1 AND 6 AND lu2 BETWEEN 1 AND 6), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY year, is_update ORDER BY CAST('0x' || substr(md5(id || ' 42'), 1, 8) AS BIGINT), id) AS place, count(*) OVER (PARTITION BY year, is_update) AS size, count(*) OVER (PARTITION BY year) AS total FROM s) "
    f"SELECT year, id, is_update FROM p WHERE place <= CASE WHEN total <= {_MOST} THEN size ELSE greatest(1, round(size * CAST({_MOST} AS DOUBLE) / total)) END"
)
def pooled_sample(spark, sf):
    own = pairs(spark, sf).where("lu1 between 1 and 6 and lu2 between 1 and 6")
    rows = own.select(C("y1").alias("year"), (C("y1") * G * G + C("r") * G + C("c")).cast("long").alias("id"), (C("lu1") != C("lu2")).cast("int").alias("is_update"))
    return M.pooled_sample(rows, "year", "is_update", "id", _MOST)
