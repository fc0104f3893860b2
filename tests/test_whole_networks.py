"""The graph searches cover every order's polyline, each in the network of its own city."""

from collections import defaultdict

import pytest
from landloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def network(spark):
    """city, ends and length > 0 of each order's polyline, by plain loops."""
    home = {r.c_custkey: r.c_nationkey for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    city = {r.o_orderkey: home[r.o_custkey] for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        lines[r.l_orderkey].append((r.l_linenumber, r.l_partkey, r.l_suppkey))
    points = {p: [(b % 64, c % 64) for _, b, c in sorted(own)] for p, own in lines.items()}
    return {p: (city[p], own) for p, own in points.items() if len(set(own)) > 1}


def meeting(network):
    """pid -> the others of its city that it meets at an end; ends that lead nowhere do not turn."""
    at = defaultdict(set)
    for p, (city, own) in network.items():
        look = min(3, len(own) - 1)
        if own[0] != own[-1]:
            for end, ahead in ((own[0], own[look]), (own[-1], own[-1 - look])):
                if end != ahead:
                    at[city, end].add(p)
    near = defaultdict(set)
    for here in at.values():
        for p in here:
            near[p] |= here - {p}
    return {p: others for p, others in near.items() if others}


def test_searches_take_every_polyline_that_meets_another(spark, network):
    near = meeting(network)
    assert len({network[p][0] for p in near}) > 1
    rows = registry.queries()["graph_metrics"](spark, SF).collect()
    assert {(r.city, r.pid) for r in rows} == {(network[p][0], p) for p in near}
    # every path has a second segment at least, and nobody reaches another city
    sizes = defaultdict(int)
    for p in near:
        sizes[network[p][0]] += 1
    assert all(1 <= r.nc <= sizes[r.city] for r in rows)
    choice = registry.queries()["betweenness"](spark, SF).collect()
    assert {(r.city, r.pid) for r in choice} == {(network[p][0], p) for p in near}


def test_road_closure_takes_every_polyline(spark, network):
    rows = registry.queries()["road_closure"](spark, SF).collect()
    assert sorted((r.city, r.pid) for r in rows) == sorted((city, p) for p, (city, _) in network.items())
