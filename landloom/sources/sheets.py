"""Sheets of workbooks and stored arrays: a file is one task's row, its rows or cells are rows of a table."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"\{.*\}")


def _children(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in node.iter() if _NAME.sub("", x.tag) == name]


def _column(place: str) -> int:
    n = 0
    for ch in place.rstrip("0123456789"):
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 0, values as text) of a workbook; cells that are not there are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        there = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in there:
            shared = ["".join(t.text or "" for t in _children(s, "t")) for s in _children(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")]
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in _children(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
            target = next(links[v] for k, v in sheet.attrib.items() if _NAME.sub("", k) == "id")
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for k, row in enumerate(_children(ElementTree.fromstring(z.read(path)), "row")):
                values: list[str | None] = []
                for cell in _children(row, "c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(values)
                    values += [None] * (at - len(values))
                    value = next((x.text for x in _children(cell, "v")), None)
                    if cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in _children(cell, "t"))
                    values.append(shared[int(value)] if cell.get("t") == "s" and value is not None else value)
                yield sheet.get("name"), int(row.get("r", k + 1)) - 1, values


def read_sheets(spark: SparkSession, glob: str) -> DataFrame:
    """path, sheet, r, cells (array of text) of every row of every sheet of the workbooks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *row) for row in sheet_rows(content)], columns=["path", "sheet", "r", "cells"])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "path string, sheet string, r int, cells array<string>")


def with_header(rows: DataFrame) -> DataFrame:
    """path, sheet, r, fields (name -> text): each row under the names of its sheet's first row; the last of equal names counts."""
    first = rows.where("r = 0").select("path", "sheet", F.col("cells").alias("names"))
    named = F.map_from_entries(F.filter(F.zip_with("names", "cells", lambda n, v: F.struct(n.alias("key"), v.alias("value"))), lambda e: e["key"].isNotNull()))
    last = F.transform("names", lambda n, k: F.when(~F.array_contains(F.slice("names", k + 2, F.greatest(F.size("names"), F.lit(1))), n), n))
    return rows.where("r > 0").join(first, ["path", "sheet"]).withColumn("names", last).select("path", "sheet", "r", named.alias("fields"))


def read_arrays(spark: SparkSession, glob: str) -> DataFrame:
    """path, name, r, c, value of .npy files (name is empty) and of the arrays in .npz files; one row or column is a grid too.

    Pickled objects are never loaded: an array of objects is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                held = np.load(io.BytesIO(content), allow_pickle=False)
                for name, array in {n: held[n] for n in held.files}.items() if hasattr(held, "files") else [("", held)]:
                    grid = np.atleast_2d(array) if array.ndim <= 2 else array.reshape(array.shape[0], -1)
                    r, c = np.indices(grid.shape)
                    yield pd.DataFrame({"path": path, "name": name, "r": r.ravel().astype(np.int32), "c": c.ravel().astype(np.int32), "value": grid.ravel().astype(float)})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "path string, name string, r int, c int, value double")
