"""Hand-made grids, graphs and samples, and properties that hold for any input."""

import heapq
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.functions import scalars
from landloom.operators import cells, components, filters, focal, models, morphology, ranking, roads, stats, transitions


def mask(spark, text, year=1):
    rows = [(year, r, c) for r, line in enumerate(text.split()) for c, x in enumerate(line) if x == "#"]
    return spark.createDataFrame(rows, "year int, r int, c int")


def places(df):
    return {(x.r, x.c) for x in df.collect()}


RING = ".....\n.###.\n.#.#.\n.###.\n....."


def frame(spark, n, m=None):
    return cells.spine(spark, n, m or n).withColumn("year", F.lit(1))


def test_holes_fill_through_edges_only(spark):
    ring = mask(spark, RING)
    assert places(morphology.fill_holes(ring, frame(spark, 5), 5, 5)) - places(ring) == {(2, 2)}
    open_ = mask(spark, RING.replace(".###.\n.#", ".#.#.\n.#", 1))
    assert places(morphology.fill_holes(open_, frame(spark, 5), 5, 5)) == places(open_)
    assert places(morphology.fill_holes(ring, frame(spark, 5), 5, 5, largest=0)) == places(ring)


def test_diagonal_cells_touch_in_eight_only(spark):
    two = mask(spark, "#..\n.#.\n...")
    assert {x.comp for x in components.grid_components(two, 3, 3).collect()} == {0}
    assert {x.comp for x in components.grid_components(two, 3, 3, eight=False).collect()} == {0, 4}


def test_empty_masks(spark):
    none = spark.createDataFrame([], "year int, r int, c int")
    assert components.grid_components(none, 5, 5).count() == 0
    assert morphology.close(none, 2, 5, 5).count() == 0
    assert components.graph_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("eight", [True, False])
def test_tiles_do_not_change_components(spark, eight):
    rng = random.Random(1)
    own = spark.createDataFrame([(y, r, c) for y in (1, 2) for r in range(20) for c in range(20) if rng.random() < 0.5], "year int, r int, c int")
    key = lambda df: {(x.year, x.r, x.c, x.comp) for x in df.collect()}
    assert key(components.grid_components(own, 20, 20, eight)) == key(components.grid_components(own, 20, 20, eight, tile=6))


def _flooded(cells, eight, cols):
    """Every cell with the smallest number of its component, by plain flooding."""
    left, out = set(cells), {}
    while left:
        todo, met = [left.pop()], []
        while todo:
            r, c = todo.pop()
            met.append((r, c))
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (eight or not a or not b) and (r + a, c + b) in left:
                        left.remove((r + a, c + b))
                        todo.append((r + a, c + b))
        out.update(dict.fromkeys(met, min(r * cols + c for r, c in met)))
    return out


@pytest.mark.parametrize("eight", [True, False])
@pytest.mark.parametrize("tile", [3, 7, 512])
def test_runs_equal_flooding(spark, eight, tile):
    rng = random.Random(tile)
    kept = {y: {(r, c) for r in range(15) for c in range(22) if rng.random() < share} for y, share in (("a", 0.35), ("b", 0.55), ("c", 0.9))}
    kept["spiral"] = {(r, c) for r in range(15) for c in range(22) if r % 2 == 0 or c == (21 if r % 4 == 1 else 0)}
    rows = [(y, r, c) for y, own in kept.items() for r, c in own]
    own = spark.createDataFrame([*rows, *rows[:40], ("a", None, 3), ("a", 3, None)], "kind string, r int, c int")
    got = components.grid_components(own, 15, 22, eight, group="kind", tile=tile)
    assert got.columns == ["kind", "r", "c", "comp"]
    found = [(x.kind, x.r, x.c, x.comp) for x in got.collect()]
    assert sorted(found) == sorted((y, *at, n) for y, cells in kept.items() for at, n in _flooded(cells, eight, 22).items())


def test_runs_need_one_shuffle_of_cells(spark):
    cells = spark.range(400).select(F.lit(1).alias("year"), F.expr("int(id div 20)").alias("r"), F.expr("int(id % 20)").alias("c"))
    plan = components.grid_components(cells, 20, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_graphs_of_several_keys_stay_apart(spark):
    edges = spark.createDataFrame([("x", 1, 2), ("x", 2, 3), ("y", 3, 4), ("y", 9, 9)], "k string, a long, b long")
    got = {(r.k, r.id): r.component for r in components.graph_components(edges, ["k"]).collect()}
    assert got == {("x", 1): 1, ("x", 2): 1, ("x", 3): 1, ("y", 3): 3, ("y", 4): 3}


def test_graph_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.id: x.component for x in components.graph_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def test_closing_keeps_the_seed_and_dilation_grows(spark):
    rng = random.Random(3)
    seed = spark.createDataFrame([(1, r, c) for r in range(15) for c in range(15) if rng.random() < 0.2], "year int, r int, c int")
    closed = morphology.close(seed, 2, 15, 15)
    assert places(seed) <= places(closed)
    assert places(seed) <= places(morphology.dilate(seed, morphology.disk(2), 15, 15))


def test_extent_parameters_of_the_default_pixel():
    assert morphology.extent_parameters(99.65) == (10, 403)


def test_box_sums_equal_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 5, (9, 11))
    df = spark.createDataFrame([(1, r, c, int(a[r, c])) for r in range(9) for c in range(11)], "year int, r int, c int, v int")
    got = {(x.r, x.c): x.v_2 for x in focal.box(df, ["v"], [2]).collect()}
    for r, c in itertools.product(range(9), range(11)):
        assert got[r, c] == a[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3].sum()


def test_diffusion_keeps_a_constant(spark):
    df = spark.createDataFrame([(1, 0, 0, 4.0), (1, 5, 3, 4.0)], "year int, r int, c int, v double")
    assert all(abs(x.v - 4) < 1e-9 or x.v == 0 for x in focal.diffuse(df, "v", 8, 8, 1.0).collect())


def test_transitions_conserve_cells(spark):
    rng = random.Random(5)
    pairs = spark.createDataFrame([(1, r, c, rng.randrange(7), rng.randrange(7)) for r in range(12) for c in range(12)], "y1 int, r int, c int, lu1 int, lu2 int")
    full = transitions.complete_counts(pairs)
    updates = pairs.where(transitions.sampled() & transitions.updated()).count()
    assert full.count() == 30 and full.agg(F.sum("n")).first()[0] == updates
    extents = spark.createDataFrame([(y, r, c) for y in (1, 2) for r in range(6) for c in range(6) if rng.random() < 0.5], "year int, r int, c int")
    row = transitions.period_rates(pairs, extents).first()
    assert row.expansion - row.contraction == row.net


def test_gap_fill_uses_raw_flags(spark):
    df = spark.createDataFrame([(1, t, f) for t, f in enumerate([False, True, False, False, True, False])], "k int, t int, raw boolean")
    assert [x.filled for x in ranking.gap_filled(df, "k", "t", "raw").orderBy("t").collect()] == [False, True, True, True, True, False]


def test_ranks_with_ties_are_total(spark):
    df = spark.createDataFrame([("a", k, 5) for k in range(20)], "g string, id int, v int")
    assert [x.id for x in ranking.top(df, ["g"], [F.desc("v"), F.col("id")], 3).orderBy("rank").collect()] == [0, 1, 2]


def test_auc_and_ap_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.1)], "y int, s double")
    assert abs(stats.auc(df, "y", "s").first().auc - 4 / 6) < 1e-12
    assert abs(stats.average_precision(df, "y", "s").first().ap - (1 / 3 + 2 / 3 / 3 + 3 / 5 / 3)) < 1e-12
    assert stats.auc(df.where("y = 1"), "y", "s").first().auc is None
    up = df.withColumn("s", F.exp(F.col("s") * 3))
    assert abs(stats.auc(up, "y", "s").first().auc - 4 / 6) < 1e-12


def test_tails():
    assert abs(stats.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(stats.chi2_tail(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(stats.chi2_tail(7.814727903251179, 3) - 0.05) < 1e-9
    assert abs(stats.student_p(2.2281388519649385, 10) - 0.05) < 1e-6


def test_iterated_means_equal_the_closed_form(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(u, t, rng.random()) for u in range(4) for t in range(3)], "u int, t int, x double")
    key = lambda d: [round(r.x, 9) for r in d.orderBy("u", "t").collect()]
    assert key(stats.within_balanced(df, "u", "t", ["x"])) == key(stats.within_iterated(df, "u", "t", ["x"]))


def test_searches_equal_brute_force(spark):
    rng = random.Random(7)
    edges = {(a, b): (rng.random(), 1 + rng.random()) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(30)) if a < b}
    df = spark.createDataFrame([(0, a, b, x, g) for (a, b), (x, g) in edges.items()], "city int, src long, dst long, ang double, geo double")
    lens = spark.createDataFrame([(0, k, float(k)) for k in range(12)], "city int, pid long, length double")
    near = {}
    for (a, b), (x, _) in edges.items():
        near.setdefault(a, []).append((b, x)), near.setdefault(b, []).append((a, x))
    got = {r.pid: r for r in roads.graph_metrics(df, lens, [1e9]).collect()}
    for s in near:
        dist, heap = {}, [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if u not in dist:
                dist[u] = d
                for v, x in near[u]:
                    heapq.heappush(heap, (d + x, v))
        assert got[s].nc == len(dist) and abs(got[s].td - sum(dist.values())) < 1e-9 and abs(got[s].tl - sum(dist)) < 1e-9


def _plain_search(source, near, radius):
    """Settling by (angle, length, id) from a sorted list; a label changes only for an angle that is smaller by 1e-9."""
    label, ways, before, order, queue = {source: 0.0}, {source: 1.0}, {source: []}, [], [(0.0, 0.0, source)]
    while queue:
        queue.sort()
        angle, length, u = queue.pop(0)
        if u in order or label[u] < angle - 1e-9:
            continue
        order.append(u)
        for v, (x, g) in sorted(near[u].items()):
            if v in order or length + g > radius + 1e-9:
                continue
            old = label.get(v, float("inf"))
            if angle + x < old - 1e-9:
                label[v], ways[v], before[v] = angle + x, ways[u], [u]
                queue.append((angle + x, length + g, v))
            elif abs(angle + x - old) < 1e-9:
                ways[v] += ways[u]
                before[v].append(u)
    share = dict.fromkeys(order, 0.0)
    for v in sorted(order, key=lambda v: -label[v]):
        for u in before[v]:
            share[u] += ways[u] / ways[v] * (1 + share[v])
    share[source] = 0.0
    return {v: label[v] for v in order}, share


def test_equal_angles_settle_the_shorter_way_first(spark):
    edges = [(0, 1, 10.0), (0, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 1.0)]
    df = spark.createDataFrame([(0, a, b, 0.0, g) for a, b, g in edges], "city int, src long, dst long, ang double, geo double")
    lens = spark.createDataFrame([(0, k, 1.0) for k in range(5)], "city int, pid long, length double")
    assert {r.pid: r.nc for r in roads.graph_metrics(df, lens, [11.5]).collect()}[0] == 5


def test_searches_in_blocks_equal_the_search_of_the_whole(spark):
    rng = random.Random(11)
    spots = {k: (rng.uniform(0, 40), rng.uniform(0, 40)) for k in range(130)}
    edges = {}
    for a in spots:
        for b in spots:
            away = ((spots[a][0] - spots[b][0]) ** 2 + (spots[a][1] - spots[b][1]) ** 2) ** 0.5
            if a < b and away < 6 and rng.random() < 0.6:
                edges[a, b] = (rng.choice([0.0, 0.0, 0.5, 1.0, rng.random()]), round(away * rng.choice([0.9, 1.0, 1.3]), 1) + 0.1)
    near = {}
    for (a, b), v in edges.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = v
    df = spark.createDataFrame([(7, a, b, x, g) for (a, b), (x, g) in edges.items()], "city int, src long, dst long, ang double, geo double")
    lens = spark.createDataFrame([(7, k, float(k), x, y) for k, (x, y) in spots.items()], "city int, pid long, length double, xm double, ym double")
    radii = [4.0, 9.0]
    plain = {(s, r): _plain_search(s, near, r) for s in near for r in radii}
    choice = dict.fromkeys(near, 0.0)
    for s in near:
        for v, x in plain[s, 9.0][1].items():
            choice[v] += x
    for tile, most in ((1e6, 2000), (20.0, 2000), (7.0, 2000), (20.0, 4)):
        got = roads.graph_metrics(df, lens, radii, tile=tile, most=most).collect()
        assert len(got) == 2 * len(near)
        for r in got:
            label, _ = plain[r.pid, r.radius]
            assert r.nc == len(label) and abs(r.td - sum(label.values())) < 1e-9 and abs(r.tl - sum(label)) < 1e-9
        laid = {r.pid: r.choice for r in roads.betweenness(df, 9.0, places=lens, tile=tile, most=most).collect()}
        assert laid.keys() == choice.keys() and all(abs(laid[k] - choice[k]) < 1e-9 for k in choice)


def test_sampled_betweenness_is_scaled(spark):
    df = spark.createDataFrame([(0, k, k + 1, 1.0, 1.0) for k in range(9)], "city int, src long, dst long, ang double, geo double")
    whole, some = ({r.pid: r.choice for r in roads.betweenness(df, 1e9, sources=n).collect()} for n in (10, 5))
    assert sum(whole.values()) == 240 and all(x % 2 == 0 for x in some.values()) and some != whole


def test_betweenness_of_a_path(spark):
    df = spark.createDataFrame([(0, k, k + 1, 1.0, 1.0) for k in range(4)], "city int, src long, dst long, ang double, geo double")
    assert {r.pid: r.choice for r in roads.betweenness(df, 1e9).collect()} == {0: 4.0 - 4.0, 1: 6.0, 2: 8.0, 3: 6.0, 4: 0.0}


def test_road_closure_takes_the_best_grade(spark):
    polys = spark.createDataFrame([(0, 1, 2, "a", 5.0, True), (0, 2, 3, "b", 1.0, False), (0, 3, 3, "a", 9.0, False), (0, 4, 6, "a", 0.1, False)], "city int, pid long, grade int, name string, length double, alive boolean")
    ends = spark.createDataFrame([(1, 10, 11), (2, 11, 12), (3, 11, 13), (4, 11, 14)], "pid long, na long, nb long")
    nodes = spark.createDataFrame([(n, n == 10) for n in range(10, 15)], "nid long, boundary boolean")
    assert {r.pid for r in roads.close_roads(polys, ends, nodes, main=3).collect() if r.added} == {3}


def test_periods_are_normalised_once_and_again(spark):
    df = spark.createDataFrame([("1984-1990",), ("1984->1990",)], "p string")
    twice = df.select(scalars.normal_period(scalars.normal_period(F.col("p"))).alias("p"), scalars.mid_year(F.col("p")).alias("m")).collect()
    assert {(r.p, r.m) for r in twice} == {("1984->1990", 1987.0)}


def test_numbers_and_years_from_text(spark):
    df = spark.createDataFrame([(" 1,234 ",), ("5%",), ("x",), (None,), ("a1999b",), ("x120001",)], "t string")
    assert [r.n for r in df.select(scalars.number(F.col("t")).alias("n")).collect()] == [1234.0, 5.0, 0.0, 0.0, 0.0, 0.0]
    assert [r.y for r in df.select(scalars.year_in(F.col("t")).alias("y")).collect()] == [None, None, None, None, 1999, None]


def test_splits_keep_class_shares(spark):
    df = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "id long, y int")
    got = {(r.y, r.is_train): r["count"] for r in models.stratified_split(df, "y", "id").groupBy("y", "is_train").count().collect()}
    assert got == {(0, True): 104, (0, False): 56, (1, True): 26, (1, False): 14}
    assert models.stratified_cap(df, "y", "id", 50).groupBy("y").count().orderBy("y").collect()[0]["count"] == 40


def test_nothing_in_the_library_imports_the_optional_part():
    import pathlib
    import re

    root = pathlib.Path(cells.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts[len(root.parts) :][0]:
            assert not re.search(r"import .*\bllm\b|from .*\bllm\b", p.read_text()), p


def test_road_closure_takes_main_roads_and_real_names_only(spark):
    # at node 11 a grade-3 main road ends: grade 4 is no main road; at 21 the shorter of two nameless roads joins, as no name is shared
    polys = spark.createDataFrame(
        [(0, 1, 3, "a", 5.0, True), (0, 2, 4, "a", 1.0, False), (1, 3, 2, "", 5.0, True), (1, 4, 3, "", 9.0, False), (1, 5, 3, "x", 2.0, False)],
        "city int, pid long, grade int, name string, length double, alive boolean",
    )
    ends = spark.createDataFrame([(1, 10, 11), (2, 11, 12), (3, 20, 21), (4, 21, 22), (5, 21, 23)], "pid long, na long, nb long")
    nodes = spark.createDataFrame([(n, n in (10, 20)) for n in (10, 11, 12, 20, 21, 22, 23)], "nid long, boundary boolean")
    assert {r.pid for r in roads.close_roads(polys, ends, nodes, main=3).collect() if r.added} == {5}


def _closed_in_turn(polys, ends, boundary, main=3, rounds=15):
    """Main-road closure node by node."""
    rows, alive, at = {p[1]: p for p in polys}, {p[1] for p in polys if p[5]}, {}
    for pid, a, b in ends:
        for n in {a, b}:
            at.setdefault(n, []).append(pid)
    for _ in range(rounds):
        single = [(n, own[0]) for n, own in ((n, [p for p in at[n] if p in alive]) for n in sorted(at)) if len(own) == 1]
        added = False
        for n, ref in [(n, ref) for n, ref in single if rows[ref][2] <= main and n not in boundary and len(at[n]) > 1]:
            _, _, grade, name, _, _ = rows[ref]
            there = [rows[p] for p in at[n] if p not in alive and rows[p][2] <= min(main, grade + 1)]
            if there:
                alive.add(min((g, not q or q != name, length, p) for _, p, g, q, length, _ in there)[3])
                added = True
        if not added:
            break
    return alive


def test_road_closure_in_joined_rounds_equals_taking_turns(spark):
    contested = 0
    for seed in range(6):
        rng = random.Random(seed)
        polys, ends = [], []
        for pid in range(160):
            city = pid % 3
            polys.append((city, pid, rng.randrange(6), rng.choice(["", "a", "b"]), float(rng.randrange(4)), rng.random() < 0.3))
            ends.append((pid, *(100 * city + rng.randrange(22) for _ in range(2))))
        boundary = {n for n in range(300) if n % 9 == 0}
        want = _closed_in_turn(polys, ends, boundary)
        got = roads.close_roads(
            spark.createDataFrame(polys, "city int, pid long, grade int, name string, length double, alive boolean"), spark.createDataFrame(ends, "pid long, na long, nb long"),
            spark.createDataFrame([(n, n in boundary) for n in range(300)], "nid long, boundary boolean"),
        ).collect()
        assert len(got) == len(polys) and {r.pid for r in got if r.alive} == want
        assert {r.pid for r in got if r.added} == want - {p[1] for p in polys if p[5]}
        contested += len(want) > sum(p[5] for p in polys)
    assert contested == 6


def test_nodes_that_want_one_road_take_turns(spark):
    # 1 and 2 want road 10; 2 falls back on 20, which 3 wanted; 3 goes without
    rows = [(1, 10, 0), (2, 10, 0), (2, 20, 1), (3, 20, 0)]
    wants = spark.createDataFrame(rows, "nid long, pid long, rank int").select("nid", "pid", F.struct("rank", "pid").alias("order"))
    assert sorted(r.pid for r in roads._granted(wants).collect()) == [10, 20]


@pytest.mark.parametrize("radius", [0, 1, 1.5, 2, 3.7, 10])
def test_disks_in_two_passes_equal_their_offsets(spark, radius):
    rng = random.Random(int(radius * 10))
    cells_ = [(y, r, c) for y in (1, 2) for r in range(26) for c in range(31) if rng.random() < (0.03 if y == 1 else 0.93)] * 2
    mask = spark.createDataFrame(cells_, "year int, r int, c int")
    disk = [(a, b) for a in range(-10, 11) for b in range(-10, 11) if a * a + b * b <= radius * radius]
    held = set(cells_)
    inside = lambda r, c: 0 <= r < 26 and 0 <= c < 31
    grown = {(y, r + a, c + b) for y, r, c in held for a, b in disk if inside(r + a, c + b)}
    got = [tuple(x) for x in morphology.dilate_disk(mask, radius, 26, 31).collect()]
    assert len(got) == len(set(got)) and set(got) == grown
    got = [tuple(x) for x in morphology.erode_disk(mask, radius, 26, 31).collect()]
    assert len(got) == len(set(got)) and set(got) == {(y, r, c) for y, r, c in held if all((y, r + a, c + b) in held for a, b in disk)}
    if radius < 4:
        assert {tuple(x) for x in morphology.dilate(mask, disk, 26, 31).collect()} == grown


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("down", [False, True])
def test_sums_before_a_row_come_from_ranges(spark, keys, down):
    rng = random.Random(9)
    rows = [(g, v, float(rng.randrange(9)), float(rng.randrange(9))) for g in ("a", "b", None) for v in rng.sample(range(500), 120)]
    if not keys:
        rows = [(g, 1000 * k + v, n, p) for k, (g, v, n, p) in enumerate(rows)]
    df = spark.createDataFrame(rows, "g string, v int, n double, p double").repartition(5)
    got = {(r.g, r.v): (r.n_before, r.p_before) for r in stats.before(df, keys, "v", ["n", "p"], down).collect()}
    sign = -1 if down else 1
    for g, v, *_ in rows:
        earlier = [r for r in rows if (not keys or r[0] == g) and sign * r[1] < sign * v]
        assert got[g, v] == (sum(r[2] for r in earlier), sum(r[3] for r in earlier))


def test_rank_statistics_have_no_window_without_a_key(spark):
    df = spark.createDataFrame([(k % 3, float(k % 7), float(k * k % 11)) for k in range(60)], "g int, x double, y double")
    for out in (stats.spearman(df, "x", "y"), stats.kruskal(df, "g", "x"), stats.auc(df.withColumn("l", F.col("g") % 2), "l", "x")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "SinglePartition" not in plan.split("Window")[-1].split("\n")[1]


def test_filters_count_what_they_drop_while_they_filter(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, 0, 1, 2, 3]), rng.random()) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, lu int, x double").repartition(3)
    chain = {"known": F.col("lu") > 0, "low": F.col("x") < 0.7, "odd": F.col("id") % 2 == 1}
    out, seen = filters.observed(df, chain)
    kept = {r.id for r in out.collect()}
    a = [r for r in rows if r[1]]
    b = [r for r in a if r[2] < 0.7]
    c = [r for r in b if r[0] % 2]
    assert kept == {r[0] for r in c}
    assert seen.get == {"rows": 300, "known": 300 - len(a), "low": len(a) - len(b), "odd": len(b) - len(c)}
    table = [tuple(r) for r in filters.drops(df, chain).orderBy("step").collect()]
    assert table == [(1, "known", 300 - len(a), len(a)), (2, "low", len(a) - len(b), len(b)), (3, "odd", len(b) - len(c), len(c))]


def test_small_components_are_dealt_whole_and_once(spark):
    places = [(0, k, float(k % 40 * 9), float(k // 40 * 9)) for k in range(400)]
    chains = [(0, k, k + 1, 0.5, 9.0) for k in range(399) if k % 4 < 3]
    long = [(0, 1000 + k, 1001 + k, 0.5, 1.0) for k in range(9)]
    edges = spark.createDataFrame(chains + long, "city int, src long, dst long, ang double, geo double")
    at = spark.createDataFrame(places + [(0, 1000 + k, float(k), -50.0) for k in range(10)], "city int, pid long, xm double, ym double")
    whole, dealt = roads._tiles(edges, at, 100.0, "city", None, 6)
    rows = [(r.src, r.part) for r in whole.collect()]
    small = [s for s, part in rows if part < 0]
    assert sorted(small) == sorted(e[1] for e in chains)  # no halo, no copy a part
    assert {s for s, part in rows if part >= 0} == {e[1] for e in long}
    own = [r.pid for r in dealt.collect()]
    assert sorted(own) == sorted({k for e in chains + long for k in e[1:3]})
