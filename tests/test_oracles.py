"""Every query with SQL gives the oracle's rows on the smallest tables; the others run."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from landloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
#: Tested by themselves in test_models.py and test_whole_networks.py.
ELSEWHERE = {"permutation_importance", "period_importance", "partial_dependence", "logistic_regression", "ablation", "random_forest", "graph_metrics", "betweenness", "road_closure"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(cur.fetchall(), names)


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(ORACLES) - ELSEWHERE == {"syntax_wide", "syntax_cells", "twfe_specifications"}


def test_syntax_wide_has_forty_measures_of_each_segment(spark):
    from landloom.plans.roads import METRICS

    rows = QUERIES["syntax_wide"](spark, SF).collect()
    assert len(METRICS) == 40 and len({r.pid for r in rows}) == len(rows) > 0
    for r in rows:
        assert 1 <= r.r60_nc <= r.r120_nc <= r.r300_nc and r.r60_tl <= r.r300_tl + 1e-9 and r.r60_choice >= 0
        assert math.isclose(r.r60_nach, math.log(r.r60_choice + 1) / max(math.log(r.r60_td + 3), 1e-9), abs_tol=1e-9)


def test_syntax_cells_are_means_and_maxima_of_the_roads(spark):
    from landloom.plans.roads import METRICS

    rows = QUERIES["syntax_cells"](spark, SF).collect()
    assert len({(r.r, r.c) for r in rows}) == len(rows) > 0
    top = {m: max(r[f"max_{m}"] for r in rows) for m in METRICS}
    assert all(-1e-9 <= r[f"mean_{m}"] <= top[m] + 1e-9 for r in rows for m in METRICS)


def test_nested_specifications_equal_least_squares(spark):
    import numpy as np
    from landloom.plans.base import panel

    rows = panel(spark, SF).collect()
    cities, years = sorted({r.city for r in rows}), sorted({r.year for r in rows})
    data = np.array([[np.log(r.n), np.log(r.people), np.log(r.value), r.updates / r.n] for r in rows])

    def mean(x, key):
        own = {k: x[[key(r) == k for r in rows]].mean(0) for k in {key(r) for r in rows}}
        return np.array([own[key(r)] for r in rows])

    inner = data - mean(data, lambda r: r.city) - mean(data, lambda r: r.year) + data.mean(0)
    got = {(r.spec, r.term): r for r in QUERIES["twfe_specifications"](spark, SF).collect()}
    assert cities and years
    for spec, terms in (("M1", "a"), ("M2", "ab"), ("M3", "ac"), ("M4", "abc")):
        x, y = inner[:, ["yabc".index(t) for t in terms]], inner[:, 0]
        inverse = np.linalg.inv(x.T @ x)
        b = inverse @ x.T @ y
        e = y - x @ b
        se = np.sqrt(np.diag(inverse @ (x.T * e**2) @ x @ inverse) * len(y) / (len(y) - len(terms)))
        for k, t in enumerate(terms):
            r = got[spec, t]
            assert np.allclose([r.coefficient, r.se, r.t, r.within_r2], [b[k], se[k], b[k] / se[k], 1 - (e @ e) / (y @ y)], rtol=1e-5, atol=1e-8)
            assert math.isclose(r.p, math.erfc(abs(r.t) / math.sqrt(2)), abs_tol=1e-9)
