"""Polylines in shapefiles: records to vertices, with their attributes, and the projection to web metres.

A file is one task's row; its vertices are rows of a table.  Records that are not polylines or hold no point are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: file mark, shape types of polylines (plain, with heights, with measures).
MARK, POLYLINES = 9994, (3, 13, 23)
#: Radius of the earth in the web projection, in metres.
EARTH = 6378137.0


def decode_lines(content: bytes) -> Iterator[tuple[int, int, list[tuple[float, float]]]]:
    """(record from 0, part, points) of a .shp file."""
    if len(content) < 100 or struct.unpack(">i", content[:4])[0] != MARK:
        raise ValueError("not a shapefile")
    at, record = 100, 0
    while at + 8 <= len(content):
        size = 2 * struct.unpack(">i", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if len(body) >= 44 and struct.unpack("<i", body[:4])[0] in POLYLINES:
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            for k in range(parts):
                own = list(zip(flat[2 * starts[k] : 2 * starts[k + 1] : 2], flat[2 * starts[k] + 1 : 2 * starts[k + 1] : 2], strict=True))
                if own:
                    yield record, k, own
        at += 8 + size
        record += 1


def encode_lines(records: Sequence[Sequence[Sequence[tuple[float, float]]]]) -> bytes:
    """A .shp file of records, each of parts of points; a record without points is a null shape."""
    out = b""
    for number, parts in enumerate(records, 1):
        points = [p for part in parts for p in part]
        body = struct.pack("<i", 0)
        if points:
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            starts = [sum(len(p) for p in parts[:k]) for k in range(len(parts))]
            body = struct.pack("<i4d2i", 3, min(xs), min(ys), max(xs), max(ys), len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts)
            body += struct.pack(f"<{2 * len(points)}d", *(v for p in points for v in p))
        out += struct.pack(">2i", number, len(body) // 2) + body
    every = [p for parts in records for part in parts for p in part] or [(0.0, 0.0)]
    xs, ys = [p[0] for p in every], [p[1] for p in every]
    head = struct.pack(">7i", MARK, 0, 0, 0, 0, 0, (100 + len(out)) // 2) + struct.pack("<2i8d", 1000, 3, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0)
    return head + out


def decode_attributes(content: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str | None]]:
    """The rows of a .dbf file as text; empty values are null, deleted rows keep their place."""
    rows, head, width = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode(encoding), content[at + 16]))
        at += 32
    for k in range(rows):
        at, own = head + k * width + 1, {}
        for name, size in fields:
            own[name] = content[at : at + size].decode(encoding, "replace").strip(" \0") or None
            at += size
        yield own


def read_lines(spark: SparkSession, glob: str) -> DataFrame:
    """path, record, part, k, x, y: the vertices of all polylines of the .shp files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, record, part, k, x, y) for record, part, points in decode_lines(content) for k, (x, y) in enumerate(points)]
                yield pd.DataFrame(rows, columns=["path", "record", "part", "k", "x", "y"])

    return _files(spark, glob).mapInPandas(run, "path string, record int, part int, k int, x double, y double")


def read_attributes(spark: SparkSession, glob: str, encoding: str = "utf-8") -> DataFrame:
    """path, record, attributes (name -> text) of the .dbf files; the same records as those of the .shp files beside them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, k, own) for k, own in enumerate(decode_attributes(content, encoding))], columns=["path", "record", "attributes"])

    return _files(spark, glob).mapInPandas(run, "path string, record int, attributes map<string,string>")


def _files(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path", "content")


def web_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres of the web projection."""
    return F.radians(lon) * EARTH, F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * EARTH
