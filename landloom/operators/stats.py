"""Panel statistics from moment sums; every operand is a double."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut

C = F.col


def before(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], down: bool = False) -> DataFrame:
    """df with ``<name>_before`` for each of ``sums``: its sum over the rows of the same keys that come earlier.

    Rows are sorted into ranges, each range is summed by itself, and what lies in earlier ranges is joined back: a task
    holds a range, not a key.  Rows of equal keys and order must be one."""
    turn = lambda c: F.desc(c) if down else F.asc(c)
    placed = cut(df.repartitionByRange(*(F.asc(k) for k in keys), turn(order))).withColumn("_part", F.spark_partition_id())
    parts = placed.groupBy(*keys, "_part").agg(*(F.sum(c).alias(c) for c in sums))
    if keys:
        earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        held = parts.select(*keys, "_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"{c}_earlier") for c in sums))
    else:  # a row a range
        now, rows = [0.0] * len(sums), []
        for r in sorted(parts.collect(), key=lambda r: r["_part"]):
            rows.append((r["_part"], *now))
            now = [a + float(r[c]) for a, c in zip(now, sums, strict=True)]
        held = F.broadcast(df.sparkSession.createDataFrame(rows, ", ".join(["_part int", *(f"`{c}_earlier` double" for c in sums)])))
    line = Window.partitionBy(*keys, "_part").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({f"{c}_own": F.coalesce(F.sum(c).over(line), F.lit(0.0)) for c in sums})
    for k in keys:
        held = held.withColumnRenamed(k, f"_{k}")
    same = reduce(and_, (own[k].eqNullSafe(held[f"_{k}"]) for k in keys), own["_part"] == held["_part"])
    return own.join(held, same).select(*(own[c] for c in df.columns), *((C(f"{c}_own") + C(f"{c}_earlier")).alias(f"{c}_before") for c in sums))


def mid_ranks(df: DataFrame, value: str) -> DataFrame:
    """value, n, rank: each distinct value, how often it occurs, and its average rank among all rows."""
    per = df.groupBy(C(value).alias("value")).agg(F.count("*").cast("double").alias("n"))
    return before(per, [], "value", ["n"]).select("value", "n", (C("n_before") + (C("n") + 1) / 2).alias("rank"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """keys, q0, q1, ...: the quantiles between neighbouring values of each key; keys are few.

    Only distinct values with their counts are ordered, in ranges; no task holds a key's values."""
    per = df.where(C(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").cast("double").alias("n"))
    total = per.groupBy(*keys).agg((F.sum("n") - 1).alias("last"))  # a row a key
    ranked = before(per, keys, value, ["n"]).join(F.broadcast(total), list(keys))
    at = lambda place: F.max(F.when((C("n_before") <= place) & (place < C("n_before") + C("n")), C(value)))
    ends = [(at(F.floor(C("last") * p)), at(F.ceil(C("last") * p)), F.max(C("last") * p - F.floor(C("last") * p))) for p in shares]
    return ranked.groupBy(*keys).agg(*((low + (high - low) * part).alias(f"q{k}") for k, (low, high, part) in enumerate(ends)))


def auc(scored: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by mid-ranks; null if a class is missing.

    Ranks come from counts per distinct score, so only distinct scores are ordered, in ranges."""
    per = scored.groupBy(*keys, score).agg(F.count("*").cast("double").alias("n"), F.count_if(C(label) == 1).cast("double").alias("pos"))
    ranked = before(per, keys, score, ["n"]).withColumn("rank", C("n_before") + (C("n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(C("pos") * C("rank")).alias("r"), F.sum("pos").alias("p"), F.sum(C("n") - C("pos")).alias("q"))
    return sums.select(*keys, F.try_divide(C("r") - C("p") * (C("p") + 1) / 2, C("p") * C("q")).alias("auc"))


def average_precision(scored: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision; equal scores are one step."""
    per = scored.groupBy(*keys, score).agg(F.count("*").cast("double").alias("n"), F.count_if(C(label) == 1).cast("double").alias("pos"))
    run = before(per, keys, score, ["n", "pos"], down=True)
    step = C("pos") * (C("pos_before") + C("pos")) / (C("n_before") + C("n"))
    return run.groupBy(*keys).agg(F.try_divide(F.sum(step), F.sum("pos")).alias("ap"))


def slopes(panel: DataFrame, key: str, time: str, value: str, per: float, least: int = 3) -> DataFrame:
    """Least-squares slope of each key, times ``per``; keys with fewer than ``least`` periods are left out."""
    fit = panel.groupBy(key).agg(F.regr_slope(C(value).cast("double"), C(time).cast("double")).alias("s"), F.count(value).alias("n"))
    return fit.where(C("n") >= least).select(key, (C("s") * per).alias("slope"), "n")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    own = df.select(C(x).alias("x"), C(y).alias("y"))
    ranked = own.join(mid_ranks(own, "x").select(C("value").alias("x"), C("rank").alias("rx")), "x").join(mid_ranks(own, "y").select(C("value").alias("y"), C("rank").alias("ry")), "y")
    return ranked.agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def kruskal(df: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """Kruskal-Wallis H with tie correction over groups with enough values, and its degrees of freedom."""
    big = df.groupBy(group).agg(F.count(value).alias("k")).where(C("k") >= least).select(group)
    one = df.join(big, group, "left_semi")
    ranks = mid_ranks(one, value)
    ties = ranks.agg(F.sum(C("n") * C("n") * C("n") - C("n")).alias("ties"))
    placed = one.select(C(group).alias("group"), C(value).alias("value")).join(ranks.select("value", "rank"), "value")
    sums = placed.groupBy("group").agg(F.sum("rank").alias("r"), F.count("*").cast("double").alias("n"))
    total = sums.agg(F.sum(C("r") * C("r") / C("n")).alias("s"), F.sum("n").alias("n"), F.count("*").alias("groups"))
    h = 12 / (C("n") * (C("n") + 1)) * C("s") - 3 * (C("n") + 1)
    return total.join(F.broadcast(ties)).select((h / (1 - C("ties") / (C("n") * C("n") * C("n") - C("n")))).alias("h"), (C("groups") - 1).alias("df"), C("n").cast("long").alias("n"))  # one row each


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-square, in closed form for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term, total = math.exp(-x / 2), 0.0
        for k in range(df // 2):
            total += term
            term *= x / 2 / (k + 1)
        return total
    total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= x / (2 * k + 1)
    return total


def student_p(t: float, df: int) -> float:
    """Two-sided p of Student's t, by Simpson's rule on its density."""
    if df <= 0:
        return math.nan
    top, n = math.atan(abs(t) / math.sqrt(df)), 2000
    xs = np.linspace(0, top, n + 1)
    f = np.cos(xs) ** (df - 1)
    area = top / n / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
    whole = math.sqrt(math.pi) * math.exp(math.lgamma(df / 2) - math.lgamma((df + 1) / 2)) / 2
    return max(0.0, 1 - area / whole)


def within_balanced(panel: DataFrame, unit: str, time: str, columns: Sequence[str]) -> DataFrame:
    """Two-way demeaned columns of a balanced panel: x - mean of the unit - mean of the time + grand mean."""
    grand = panel.agg(*(F.avg(C(c).cast("double")).alias(f"g_{c}") for c in columns))  # one row
    mean = lambda c, k: F.avg(C(c).cast("double")).over(Window.partitionBy(k))
    return panel.join(F.broadcast(grand)).select(unit, time, *((C(c).cast("double") - mean(c, unit) - mean(c, time) + C(f"g_{c}")).alias(c) for c in columns))


def within_iterated(panel: DataFrame, unit: str, time: str, columns: Sequence[str], tolerance: float = 1e-12, rounds: int = 1000) -> DataFrame:
    """The same for an unbalanced panel, by alternating means until the largest mean is below the tolerance."""
    now = panel.select(unit, time, *(C(c).cast("double").alias(c) for c in columns))
    for _ in range(rounds):
        for key in (unit, time):
            now = now.select(unit, time, *((C(c) - F.avg(c).over(Window.partitionBy(key))).alias(c) for c in columns))
        now = cut(now)
        worst = now.groupBy(unit).agg(*(F.abs(F.avg(c)).alias(c) for c in columns)).agg(F.max(F.greatest(*columns, F.lit(0.0)))).first()[0]
        if worst is None or worst < tolerance:
            break
    return now


def ols(df: DataFrame, y: str, xs: Sequence[str], intercept: bool = True) -> list[tuple[str, float, float, float, float]]:
    """(name, coefficient, HC1 standard error, t, p); moments are summed in Spark, the small system is solved here."""
    names = [*xs, *(["intercept"] if intercept else [])]
    cols = [C(x).cast("double") for x in xs] + ([F.lit(1.0)] if intercept else [])
    k = len(names)
    yy = C(y).cast("double")
    m = df.agg(F.count("*"), *(F.sum(a * b) for a in cols for b in cols), *(F.sum(a * yy) for a in cols)).first()
    n, xtx, xty = m[0], np.array(m[1 : 1 + k * k], float).reshape(k, k), np.array(m[1 + k * k :], float)
    inv = np.linalg.inv(xtx)
    beta = inv @ xty
    e = yy - sum((c * F.lit(float(b)) for c, b in zip(cols, beta, strict=True)), F.lit(0.0))
    meat = np.array(df.agg(*(F.sum(a * b * e * e) for a in cols for b in cols)).first(), float).reshape(k, k)
    se = np.sqrt(np.diag(inv @ meat @ inv) * n / (n - k))
    return [(name, float(b), float(s), float(b / s), chi2_tail(float((b / s) ** 2), 1)) for name, b, s in zip(names, beta, se, strict=True)]
