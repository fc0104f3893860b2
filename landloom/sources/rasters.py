"""Rasters of one byte a cell in TIFF files: cells to file contents and back, strips plain or LZW, with a place on earth.

A file is one task's row at a time; its cells are rows of a table.  Only what such files need is read and written: one band
of unsigned bytes, strips, no compression or LZW.  Anything else is an error that names the tag.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

WIDTH, HEIGHT, BITS, PACKED, COLOURS, STRIPS, BANDS, ROWS, SIZES, PALETTE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 320
SCALE, TIE, NODATA = 33550, 33922, 42113
CLEAR, STOP = 256, 257


def _lzw_codes(data: bytes) -> Iterator[tuple[int, int]]:
    """(code, bits) of the LZW form of data."""
    table, width, last = {bytes([k]): k for k in range(256)}, 9, b""
    yield CLEAR, 9
    for k in range(len(data)):
        own = last + data[k : k + 1]
        if own in table:
            last = own
            continue
        yield table[last], width
        table[own] = len(table) + 2
        if len(table) + 2 == (1 << width) and width < 12:
            width += 1
        if len(table) + 2 >= 4094:
            yield CLEAR, width
            table, width = {bytes([k]): k for k in range(256)}, 9
        last = data[k : k + 1]
    if last:
        yield table[last], width
        if len(table) + 3 >= (1 << width) and width < 12:
            width += 1
    yield STOP, width


def pack(data: bytes) -> bytes:
    held = bits = 0
    out = bytearray()
    for code, width in _lzw_codes(data):
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> bits - 8 & 255)
            bits -= 8
        held &= (1 << bits) - 1
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def unpack(data: bytes, size: int) -> bytes:
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        code = held >> bits - width
        bits -= width
        held &= (1 << bits) - 1
        if code == STOP:
            break
        if code == CLEAR:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("broken LZW data")
        own = table[code] if code < len(table) else last + last[:1]
        out += own
        if last:
            table.append(last + own[:1])
        last = own
        if len(table) + 1 >= (1 << width) and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out[:size])


def encode(grid: np.ndarray, x0: float = 0.0, y0: float = 0.0, step: float = 1.0, nodata: int | None = None, palette: Mapping[int, tuple[int, int, int]] | None = None, lzw: bool = True) -> bytes:
    """A grid of bytes as a file: its upper left corner at (x0, y0), cells ``step`` wide, colours by value."""
    rows, cols = grid.shape
    body = np.ascontiguousarray(grid, np.uint8).tobytes()
    data = pack(body) if lzw else body
    tags: list[tuple[int, int, int, bytes]] = []

    def tag(number: int, kind: str, values: Sequence) -> None:
        code = {"H": 3, "I": 4, "d": 12, "s": 2}[kind]
        raw = values if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        tags.append((number, code, len(raw) if kind == "s" else len(values), raw))

    tag(WIDTH, "I", [cols]), tag(HEIGHT, "I", [rows]), tag(BITS, "H", [8]), tag(PACKED, "H", [5 if lzw else 1]), tag(COLOURS, "H", [3 if palette else 1])
    tag(STRIPS, "I", [8]), tag(BANDS, "H", [1]), tag(ROWS, "I", [rows]), tag(SIZES, "I", [len(data)])
    if palette:
        tag(PALETTE, "H", [palette.get(v, (0, 0, 0))[band] * 257 for band in range(3) for v in range(256)])
    tag(SCALE, "d", [step, step, 0.0]), tag(TIE, "d", [0.0, 0.0, 0.0, x0, y0, 0.0])
    if nodata is not None:
        tag(NODATA, "s", f"{nodata}\0".encode())
    at = 8 + len(data) + len(data) % 2
    more, entries = at + 2 + 12 * len(tags) + 4, b""
    extra = b""
    for number, code, count, raw in sorted(tags):
        if len(raw) <= 4:
            entries += struct.pack("<HHI", number, code, count) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", number, code, count, more + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return b"II*\0" + struct.pack("<I", at) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra


def decode(content: bytes) -> tuple[np.ndarray, dict[str, object]]:
    """The grid of a file, and where it lies: x0, y0, step, nodata."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", content[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        number, code, count = struct.unpack(order + "HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
        kind = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d"}.get(code)
        if kind is None:
            continue
        size = struct.calcsize(kind) * count
        place = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", content[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        tags[number] = struct.unpack(f"{order}{count}{kind}", content[place : place + size])
    one = lambda number, default: tags.get(number, (default,))[0]
    for number, fine in ((BITS, (8,)), (BANDS, (1,)), (PACKED, (1, 5))):
        if one(number, 1 if number != BITS else 0) not in fine:
            raise ValueError(f"tag {number} is {tags.get(number)}: not a grid of single bytes in plain or LZW strips")
    rows, cols = one(HEIGHT, 0), one(WIDTH, 0)
    per, out = one(ROWS, rows) or rows, b""
    for k, (start, size) in enumerate(zip(tags.get(STRIPS, ()), tags.get(SIZES, ()), strict=True)):
        raw, want = content[start : start + size], min(per, rows - k * per) * cols
        out += unpack(raw, want) if one(PACKED, 1) == 5 else raw[:want]
    tie, scale = tags.get(TIE, (0.0,) * 6), tags.get(SCALE, (1.0, 1.0, 0.0))
    nodata = one(NODATA, b"").rstrip(b"\0").decode()
    return np.frombuffer(out, np.uint8).reshape(rows, cols), {"x0": tie[3], "y0": tie[4], "step": scale[0], "nodata": int(float(nodata)) if nodata else None}


def read_cells(spark: SparkSession, glob: str) -> DataFrame:
    """path, r, c, x, y, value of every cell (its middle) of the files, those without data left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                grid, at = decode(content)
                r, c = np.indices(grid.shape)
                own = pd.DataFrame({"path": path, "r": r.ravel().astype(np.int32), "c": c.ravel().astype(np.int32), "value": grid.ravel().astype(np.int32)})
                own = own.assign(x=at["x0"] + (own["c"] + 0.5) * at["step"], y=at["y0"] - (own["r"] + 0.5) * at["step"])
                yield own[own["value"] != at["nodata"]][["path", "r", "c", "x", "y", "value"]]

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInPandas(run, "path string, r int, c int, x double, y double, value int")


def file_contents(cells: DataFrame, key: str, value: str, rows: int, cols: int, fill: int = 255, x0: float = 0.0, y0: float = 0.0, step: float = 1.0, palette: Mapping[int, tuple[int, int, int]] | None = None) -> DataFrame:
    """(key, content): one file for each key's grid; cells that are not there hold ``fill``, which is marked as no data."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((rows, cols), fill, np.uint8)
        grid[part["r"], part["c"]] = part["value"]
        return pd.DataFrame({"key": [part["key"].iloc[0]], "content": [encode(grid, x0, y0, step, fill, palette)]})

    kind = cells.schema[key].dataType.simpleString()
    own = cells.selectExpr(f"`{key}` AS key", "r", "c", f"`{value}` AS value").where("value IS NOT NULL")
    return own.groupBy("key").applyInPandas(run, f"key {kind}, content binary").withColumnRenamed("key", key)
