"""What is written is what is read."""

import io
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.plans import steps
from landloom.sinks import tables
from landloom.sources import rasters


def test_partitioned_tables_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 1990, 2.5), (1, 1995, None), (2, 1990, 1.0)], "city int, year int, v double")
    tables.partitioned(df, str(tmp_path / "t"))
    assert (tmp_path / "t" / "city=1" / "year=1995").is_dir()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select("city", "year", "v").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_fixed_fields_and_digits(spark, tmp_path):
    df = spark.createDataFrame([("b", 1 / 3, 1, "x"), ("a", None, 2, "y"), ("c", float("nan"), None, "z")], "name string, v double, n int, more string")
    with pytest.raises(ValueError, match="more"):
        tables.fixed(df, ["n", "v", "name"])
    with pytest.raises(ValueError, match="absent"):
        tables.fixed(df, ["absent"], extras="ignore")
    tables.csv(df, str(tmp_path / "c"), ["n", "v", "name"], digits=8, extras="ignore", order=["name"])
    lines = [line for f in sorted((tmp_path / "c").glob("part-*")) for line in f.read_text().splitlines() if line != "n,v,name"]
    assert lines == ["2,,a", "1,0.33333333,b", ",nan,c"]


def test_metadata_manifest_and_errors(spark, tmp_path):
    tables.metadata(spark, str(tmp_path / "m"), {"rows": 3, "names": ["ä", "b"], "of": {"k": None}})
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"rows": 3, "names": ["ä", "b"], "of": {"k": None}}
    df = spark.createDataFrame([("see /home/me/x", "#REF!", 1), ("ok", "a #N/A b", 2)], "p string, q string, n int")
    assert [r.p for r in tables.redacted(df, "/home/[a-z]+").orderBy("n").collect()] == ["see <redacted>/x", "ok"]
    assert tables.manifest(spark, {"t": df}).first().asDict() == {"name": "t", "rows": 2, "columns": 3, "fields": "p,q,n"}
    assert {(r.column, r.error, r.n) for r in tables.errors(df).collect()} == {("q", "#REF!", 1), ("q", "#N/A", 1)}
    assert tables.errors(df.select("n")).count() == tables.manifest(spark, {}).count() == 0


def test_workbook_has_a_sheet_for_each_table(spark):
    df = spark.range(5).select("id", F.lit("a<b & c").alias("t"), F.lit(None).cast("double").alias("v"))
    book = zipfile.ZipFile(io.BytesIO(tables.workbook({"one": df, "two": df.limit(0)}, head=3)))
    assert book.testzip() is None
    first = book.read("xl/worksheets/sheet1.xml").decode()
    assert first.count("<row>") == 4 and "a&lt;b &amp; c" in first and book.read("xl/worksheets/sheet2.xml").decode().count("<row>") == 1
    assert b'name="two"' in book.read("xl/workbook.xml")


def test_lines_as_text(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 3.0), (1, 0, 0.0, 1.5)], "pid long, k int, x double, y double")
    assert [tuple(r) for r in tables.wkt_lines(df).collect()] == [(1, "LINESTRING (0.0 1.5, 2.0 3.0)")]


@pytest.mark.parametrize("seed", range(6))
def test_lzw_round_trip(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice((rng.randrange(256), 7, 7, 7)) for _ in range((0, 1, 300, 5000, 70_000, 20_000)[seed]))
    assert rasters.unpack(rasters.pack(data), len(data)) == data


@pytest.mark.parametrize("lzw", [True, False])
def test_rasters_come_back(spark, tmp_path, lzw):
    grid = np.random.default_rng(1).integers(0, 7, (40, 33)).astype(np.uint8)
    grid[0, :5] = 255
    content = rasters.encode(grid, 100.0, 900.0, 30.0, nodata=255, palette={1: (255, 0, 0)}, lzw=lzw)
    got, at = rasters.decode(content)
    assert (got == grid).all() and at == {"x0": 100.0, "y0": 900.0, "step": 30.0, "nodata": 255}
    (tmp_path / "a.tif").write_bytes(content)
    rows = rasters.read_cells(spark, str(tmp_path / "*.tif")).collect()
    assert len(rows) == 40 * 33 - 5 and all(grid[r.r, r.c] == r.value and r.x == 115.0 + 30 * r.c and r.y == 885.0 - 30 * r.r for r in rows)
    with pytest.raises(ValueError):
        rasters.decode(b"GIF8")


def test_cells_to_files_and_back(spark, tmp_path):
    cells = spark.createDataFrame([("x", 0, 1, 4), ("x", 2, 2, 0), ("y", 1, 0, 6), ("y", 1, 1, None)], "city string, r int, c int, lu int")
    for r in rasters.file_contents(cells, "city", "lu", 3, 4).collect():
        (tmp_path / f"{r.city}.tif").write_bytes(bytes(r.content))
    back = rasters.read_cells(spark, str(tmp_path / "*.tif")).select(F.regexp_extract("path", r"(\w)\.tif", 1).alias("city"), "r", "c", "value")
    assert {tuple(r) for r in back.collect()} == {("x", 0, 1, 4), ("x", 2, 2, 0), ("y", 1, 0, 6)}


def test_a_failed_city_does_not_stop_the_others(spark, tmp_path):
    def load(city):
        def step(spark, tables):
            if city == "b":
                raise RuntimeError("no such city\nand more")
            return spark.createDataFrame([(city,)], "city string")

        return step

    plans = {c: {"load": load(c), "again": lambda spark, tables: tables["load"]} for c in ("a", "b", "c")}
    status = steps.run_cities(spark, plans, str(tmp_path), needed=["again"])
    rows = {r.city: r for r in status.collect()}
    assert {c: r.status for c, r in rows.items()} == {"a": "ok", "b": "failed", "c": "ok"}
    assert rows["b"].message == "no such city" and rows["a"].complete and not rows["b"].complete
    assert steps.exit_code(status) == 1


def test_stale_results_are_put_away(spark, tmp_path):
    plan = {n: (lambda n: lambda spark, tables: spark.createDataFrame([(n,)], "n string"))(n) for n in ("one", "two", "three")}
    steps.run(spark, plan, str(tmp_path))
    moved = steps.invalidate(spark, plan, str(tmp_path), "two", "v1")
    assert moved == ["two", "three"]
    assert not (tmp_path / "two").exists() and (tmp_path / "_stale" / "v1" / "three").is_dir() and (tmp_path / "one").is_dir()
    _, status = steps.run(spark, plan, str(tmp_path), start="two")
    assert [r.status for r in status.collect()] == ["ok", "ok"]
