"""Writers of tables.  All but the workbook go through Spark's writers, so any store that Spark writes to will do."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a spreadsheet shows where a formula fails.
ERRORS = ("#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#N/A", "#NUM!", "#NULL!")


def partitioned(df: DataFrame, path: str, by: Sequence[str] = ("city", "year"), mode: str = "overwrite") -> None:
    """Parquet in one folder for each value of ``by``; a value's rows are gathered first, so that files stay few."""
    there = [c for c in by if c in df.columns]
    (df.repartition(*there) if there else df).write.mode(mode).partitionBy(*there).parquet(path)


def fixed(df: DataFrame, fields: Sequence[str], digits: int | None = None, extras: str = "raise") -> DataFrame:
    """The fields in their order, fractions as text of ``digits`` places; null stays null.

    Columns beyond the fields are an error, or dropped with ``extras="ignore"``; a field that is not there is an error."""
    if missing := [f for f in fields if f not in df.columns]:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    if extras != "ignore" and (more := [c for c in df.columns if c not in fields]):
        raise ValueError(f"fields beyond the header: {', '.join(more)}")

    def shown(name: str) -> Column:
        kind = df.schema[name].dataType
        if digits is None or not isinstance(kind, T.FractionalType):
            return F.col(f"`{name}`")
        return F.format_string(f"%.{digits}f", F.col(f"`{name}`").cast("double")).alias(name) if isinstance(kind, T.DecimalType) else _plain(name, digits)

    return df.select(*(F.when(F.col(f"`{f}`").isNotNull(), shown(f)).alias(f) for f in fields))


def _plain(name: str, digits: int) -> Column:
    x = F.col(f"`{name}`").cast("double")
    return F.when(F.isnan(x), "nan").otherwise(F.format_string(f"%.{digits}f", x))


def csv(df: DataFrame, path: str, fields: Sequence[str], digits: int | None = None, extras: str = "raise", order: Sequence[str] = ()) -> None:
    """CSV with a header and fixed fields; ``order`` sorts the rows over all files."""
    out = df.orderBy(*order) if order else df
    fixed(out, fields, digits, extras).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def metadata(spark: SparkSession, path: str, values: Mapping[str, object]) -> None:
    """One JSON object; nested values become nested objects."""
    import json

    spark.createDataFrame([(json.dumps(values, ensure_ascii=False, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def redacted(df: DataFrame, pattern: str, mark: str = "<redacted>") -> DataFrame:
    """Every string column with what fits the pattern replaced."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*(F.regexp_replace(F.col(f"`{c}`"), F.lit(pattern), F.lit(mark)).alias(c) if c in text else F.col(f"`{c}`") for c in df.columns))


def manifest(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """name, rows, columns, fields of each table; rows are counted in one pass over all tables."""
    counts = None
    for name, df in tables.items():
        own = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"), F.lit(",".join(df.columns)).alias("fields"))
        counts = own if counts is None else counts.unionByName(own)
    return counts if counts is not None else spark.createDataFrame([], "name string, rows long, columns int, fields string")


def errors(df: DataFrame) -> DataFrame:
    """column, error, n: failed formulas among the string columns of a table."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, error string, n long")
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in text))).alias("x")).select("x.*")
    hit = F.regexp_extract("value", "(" + "|".join(e.replace("?", r"\?") for e in ERRORS) + ")", 1)
    return cells.withColumn("error", hit).where("error <> ''").groupBy("column", "error").agg(F.count("*").alias("n"))


def workbook(tables: Mapping[str, DataFrame], head: int = 1000) -> bytes:
    """An XLSX file with one sheet for each table; its first ``head`` rows are what a reader of a sheet is shown."""
    out = io.BytesIO()
    names = [n[:31] for n in tables]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, df in enumerate(tables.values(), 1):
            rows = [df.columns, *(list(r) for r in df.limit(head).collect())]  # head rows
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(map(_row, rows))}</sheetData></worksheet>')
    return out.getvalue()


def _row(values: Sequence[object]) -> str:
    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    return f"<row>{''.join(map(cell, values))}</row>"


def wkt_lines(vertices: DataFrame, key: str = "pid") -> DataFrame:
    """(key, wkt): each polyline's vertices(key, k, x, y) as a LINESTRING, for a store that keeps geometry as text."""
    at = F.array_sort(F.collect_list(F.struct("k", "x", "y")))  # one polyline's vertices
    text = F.transform(at, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return vertices.groupBy(key).agg(F.concat(F.lit("LINESTRING ("), F.array_join(text, ", "), F.lit(")")).alias("wkt"))
