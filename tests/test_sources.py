"""Readers, polygons and the step runner."""

import random

import pytest
from pyspark.sql import functions as F

from landloom.plans import steps
from landloom.sources import polygons, tables


def test_csv_with_mark_and_other_names(spark, tmp_path):
    (tmp_path / "city=a").mkdir()
    (tmp_path / "city=a/rates.csv").write_text("﻿period,rate\n1984->1990,1.5\n1990->1995,x\n", encoding="utf-8")
    raw = spark.read.csv(str(tmp_path / "city=a/rates.csv"), header=True)
    own = tables.aligned(raw, {"period": ("string", []), "update_rate": ("double", ["rate"]), "samples": ("bigint", [])})
    assert [tuple(r) for r in own.collect()] == [("1984->1990", 1.5, None), ("1990->1995", None, None)]
    typed = tables.csv_table(spark, str(tmp_path / "city=a/rates.csv"), "period string, rate string")
    assert tables.with_path_parts(typed, r"city=(\w+)/(\w+)\.csv", ["city_", "kind"]).select("city_", "kind").distinct().collect()[0] == ("a", "rates")
    with pytest.raises(ValueError, match="missing columns: n"):
        tables.require(own, ["period", "n"])


def test_complete_and_preferred(spark):
    files = spark.createDataFrame([("a", "x", "a_1.png"), ("a", "y", "1.png"), ("b", "x", "b_1.png")], "city string, kind string, file string")
    assert {r.city for r in tables.complete_only(files, "city", "kind", ["x", "y"]).collect()} == {"a"}
    best = tables.preferred(files, ["city"], [F.col("file").startswith("a_")], "file")
    assert {r.file for r in best.collect()} == {"a_1.png", "b_1.png"}


def test_points_in_rings(spark):
    points = spark.createDataFrame([(x, y) for x in range(6) for y in range(6)], "x int, y int").select((F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    rings = spark.createDataFrame([(1, [(1, 1), (4, 1), (4, 4), (1, 4)]), (2, [(0, 0), (6, 0), (0, 6)])], "ring_id int, pts array<struct<x:int,y:int>>")
    got = {(r.x, r.y, r.ring_id) for r in polygons.inside(points, rings).collect()}
    assert {(x, y) for x, y, k in got if k == 1} == {(x + 0.5, y + 0.5) for x in range(1, 4) for y in range(1, 4)}
    assert all(x + y < 6 for x, y, k in got if k == 2) and len([1 for *_, k in got if k == 2]) == 15


def test_steps_store_resume_and_report(spark, tmp_path):
    calls = []

    def first(s, _):
        calls.append(1)
        return s.range(3)

    plan = {"a": first, "b": lambda s, t: t["a"].where("id > 0"), "c": lambda s, t: t["a"].select("nothing"), "d": lambda s, t: s.range(1)}
    done, status = steps.run(spark, plan, str(tmp_path))
    assert [(r.step, r.status) for r in status.collect()] == [("a", "ok"), ("b", "ok"), ("c", "failed")]
    assert done["b"].count() == 2
    steps.run(spark, plan, str(tmp_path), stop="b")
    assert len(calls) == 1
    again, status = steps.run(spark, plan, str(tmp_path), start="b", stop="b", overwrite=True)
    assert again["b"].count() == 2 and len(calls) == 1


def test_polylines_of_shapefiles(spark, tmp_path):
    import struct

    from landloom.sources import shapes

    records = [[[(0.0, 1.0), (2.0, 3.0)], [(5.0, 5.0), (6.0, 7.5), (8.0, 9.0)]], [], [[(1.0, 1.0), (1.0, 2.0)]]]
    (tmp_path / "a.shp").write_bytes(shapes.encode_lines(records))
    got = shapes.read_lines(spark, str(tmp_path / "*.shp")).orderBy("record", "part", "k").collect()
    assert [(r.record, r.part, r.k, r.x, r.y) for r in got] == [(n, j, k, *p) for n, parts in enumerate(records) for j, part in enumerate(parts) for k, p in enumerate(part)]
    fields = [(b"name", 8), (b"fclass", 4)]
    rows = [(b"High St", b"a"), (b"", b"b"), (b"x", b"")]
    head = struct.pack("<4BIHH20x", 3, 1, 1, 1, len(rows), 32 + 32 * len(fields) + 1, 1 + 12)
    head += b"".join(struct.pack("<11sc4xBB14x", n, b"C", size, 0) for n, size in fields) + b"\r"
    (tmp_path / "a.dbf").write_bytes(head + b"".join(b" " + a.ljust(8) + b.ljust(4) for a, b in rows))
    own = shapes.read_attributes(spark, str(tmp_path / "*.dbf")).orderBy("record").collect()
    assert [r.attributes for r in own] == [{"name": "High St", "fclass": "a"}, {"name": None, "fclass": "b"}, {"name": "x", "fclass": None}]
    with pytest.raises(ValueError):
        list(shapes.decode_lines(b"x" * 200))
    x, y = shapes.web_metres(F.lit(180.0), F.lit(45.0))
    at = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(at.x - 20037508.342789244) < 1e-6 and abs(at.y - 5621521.486192066) < 1e-6


def test_sheets_and_arrays(spark, tmp_path):
    import numpy as np

    from landloom.sinks import tables
    from landloom.sources import sheets

    df = spark.createDataFrame([("a", 1, None), ("b & c", None, 2.5)], "name string, n int, v double")
    (tmp_path / "book.xlsx").write_bytes(tables.workbook({"first": df, "none": df.limit(0)}))
    rows = sheets.read_sheets(spark, str(tmp_path / "*.xlsx"))
    assert {(r.sheet, r.r, tuple(r.cells)) for r in rows.collect()} == {("first", 0, ("name", "n", "v")), ("first", 1, ("a", "1", None)), ("first", 2, ("b & c", None, "2.5")), ("none", 0, ("name", "n", "v"))}
    assert sorted((r.r, r.fields["name"], r.fields["v"]) for r in sheets.with_header(rows).collect()) == [(1, "a", None), (2, "b & c", "2.5")]
    np.save(tmp_path / "g.npy", np.arange(6).reshape(2, 3))
    np.savez_compressed(tmp_path / "z.npz", lu=np.eye(2), line=np.array([7.0, 8.0]))
    got = sheets.read_arrays(spark, str(tmp_path / "*.np[yz]")).collect()
    assert {(r.name, r.r, r.c, r.value) for r in got} == {("", k // 3, k % 3, float(k)) for k in range(6)} | {("lu", 0, 0, 1.0), ("lu", 0, 1, 0.0), ("lu", 1, 0, 0.0), ("lu", 1, 1, 1.0), ("line", 0, 0, 7.0), ("line", 0, 1, 8.0)}


def _crossings(pts, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < a[0] + (b[0] - a[0]) * ((y - a[1]) / (b[1] - a[1])) for a, b in zip(pts, pts[1:] + pts[:1], strict=True))


def test_scanlines_and_clips_equal_plain_tests(spark):
    rng = random.Random(4)
    shapes = {k: [(rng.randrange(-8, 100) / 4, rng.randrange(-8, 100) / 4) for _ in range(rng.randrange(3, 9))] for k in range(7)}
    shapes[7] = [(2.0, 2.0), (6.0, 2.0), (6.0, 5.0), (2.0, 5.0)]
    shapes[8] = [(1.0, 1.0), (4.0, 4.0)]  # no ring
    rings = spark.createDataFrame(list(shapes.items()), "ring_id int, pts array<struct<x: double, y: double>>")
    shapes.pop(8)
    inner = {(k, r, c) for k, pts in shapes.items() for r in range(22) for c in range(22) if _crossings(pts, c + 0.5, r + 0.5) % 2}
    assert {tuple(r) for r in polygons.cells(rings, 22, 22).collect()} == inner
    got = [tuple(r) for r in polygons.cells(rings, 22, 22, all_touched=True).collect()]
    passed = {
        (k, int(y // 1), int(x // 1))
        for k, pts in shapes.items() for a, b in zip(pts, pts[1:] + pts[:1], strict=True) for t in range(2001)
        for x, y in [(a[0] + (b[0] - a[0]) * t / 2000, a[1] + (b[1] - a[1]) * t / 2000)] if 0 <= x < 22 and 0 <= y < 22
    }
    assert len(got) == len(set(got)) and inner | passed <= set(got)
    # what no sample met is passed by a corner at most
    assert all(any(abs(r - q) + abs(c - p) <= 1 for k2, q, p in passed if k2 == k) for k, r, c in set(got) - inner - passed)
    spots = [(rng.randrange(88) / 4, rng.randrange(88) / 4) for _ in range(150)] * 2
    points = spark.createDataFrame(spots, "x double, y double")
    want = sorted((x, y, k) for x, y in spots for k, pts in shapes.items() if _crossings(pts, x, y) % 2)
    assert sorted(tuple(r) for r in polygons.inside(points, rings).collect()) == want
    lines = [(j, *(rng.randrange(88) / 4 + 0.1 for _ in range(4))) for j in range(40)]
    held = {}
    for r in polygons.clipped(spark.createDataFrame(lines, "id int, xa double, ya double, xb double, yb double"), rings).collect():
        held[r.id, r.ring_id] = held.get((r.id, r.ring_id), 0.0) + r.t1 - r.t0
    for j, xa, ya, xb, yb in lines:
        for k, pts in shapes.items():
            share = sum(_crossings(pts, xa + (xb - xa) * (t + 0.5) / 4000, ya + (yb - ya) * (t + 0.5) / 4000) % 2 for t in range(4000)) / 4000
            assert abs(held.get((j, k), 0.0) - share) < 0.005


def test_clipping_shuffles_nothing_and_makes_no_pair_twice(spark):
    rings = spark.createDataFrame([(0, [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)]), (1, [(-3.0, 2.0), (2.5, 2.0), (2.5, 3.0)])], "ring_id int, pts array<struct<x: double, y: double>>")
    lines = spark.createDataFrame([(0, 0.0, 5.0, 10.0, 5.0), (1, 2.0, 2.0, 8.0, 8.0), (2, 9.5, 0.0, 9.5, 10.0), (3, -2.0, 2.5, 2.0, 2.5)], "id int, xa double, ya double, xb double, yb double")
    for tile in (64.0, 0.75):
        got = polygons.clipped(lines, F.broadcast(rings), tile)
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.id, r.ring_id, round(r.t0, 9), round(r.t1, 9)) for r in got.collect())
        assert [r for r in rows if r[1] == 0] == [(0, 0, 0.1, 0.9), (1, 0, 0.0, 1.0), (3, 0, 0.75, 1.0)]
        assert [r[:2] for r in rows if r[1] == 1] == [(1, 1), (3, 1)]
