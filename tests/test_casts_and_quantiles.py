"""Casts and quantiles against DuckDB, and angular edges against plain loops."""

import math
import random
from collections import defaultdict

import duckdb
import pytest
from landloom.functions import scalars as S
from landloom.operators import roads, stats
from pyspark.sql import functions as F


def test_whole_numbers_of_two_characters_are_those_of_the_sql(spark):
    marks = [*map(chr, range(1, 128)), "\x85", "\xa0", " ", "١"]
    texts = ["", *marks, *(a + b for a in marks for b in marks)]
    con = duckdb.connect()
    want = con.execute("SELECT t, TRY_CAST(t AS INT) FROM (SELECT unnest(?) AS t)", [texts]).fetchall()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.whole_number(F.col("t")).alias("n")).collect()
    assert dict(map(tuple, got)) == dict(want)


def test_quantiles_lie_between_neighbours(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, float(rng.randrange(9)), rng.random()])) for k in "ab" for _ in range(101)] + [("c", 4.0)]
    got = {r.k: (r.q0, r.q1, r.q2) for r in stats.quantiles(spark.createDataFrame(rows, "k string, v double"), "v", [0.5, 0.25, 0.9], ["k"]).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    for k, *want in con.execute("SELECT k, quantile_cont(v, 0.5), quantile_cont(v, 0.25), quantile_cont(v, 0.9) FROM t GROUP BY 1").fetchall():
        assert got[k] == pytest.approx(want)


def test_summary_does_not_gather_a_measure_in_one_task(spark):
    from landloom.plans import registry

    plan = registry.queries()["distribution_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def test_edges_take_the_smaller_angle_of_two_shared_nodes(spark):
    rng = random.Random(7)
    segs, nodes = [], []
    for p in range(80):
        d = [rng.randrange(-2, 3) for _ in range(4)]
        segs.append((p, float(p), *d))
        nodes.append((p, rng.randrange(6), rng.randrange(6)))
    best = defaultdict(lambda: math.inf)
    sides = defaultdict(list)
    for (p, _, a, b, c, d), (_, na, nb) in zip(segs, nodes, strict=True):
        if na != nb:
            for n, v in ((na, (a, b)), (nb, (c, d))):
                if v != (0, 0):
                    sides[n].append((p, v))
    for here in sides.values():
        for p, u in here:
            for q, v in here:
                if p < q:
                    cos = max(-1, min(1, (u[0] * v[0] + u[1] * v[1]) / (math.hypot(*u) * math.hypot(*v))))
                    best[p, q] = min(best[p, q], (180 - math.degrees(math.acos(cos))) / 90)
    edges = roads.angular_edges(spark.createDataFrame(segs, "pid long, length double, dxa int, dya int, dxb int, dyb int"), spark.createDataFrame(nodes, "pid long, na long, nb long"))
    got = [(r.src, r.dst, r.ang, r.geo) for r in edges.collect()]
    assert len(got) == len(best) and {(a, b) for a, b, *_ in got} == set(best)
    assert all(math.isclose(w, best[a, b], abs_tol=1e-6) and g == (a + b) / 2 for a, b, w, g in got)
    assert "Aggregate" not in edges._jdf.queryExecution().executedPlan().toString()
