"""Readers of city files: discovery, completeness, schema alignment and caching.

All go through Spark's readers, so any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def csv_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, header: bool = True) -> DataFrame:
    """A CSV with an explicit schema; a byte order mark before the first name does no harm."""
    return spark.read.csv(path, schema=schema, header=header, encoding="UTF-8", enforceSchema=True)


def aligned(df: DataFrame, fields: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """fields: name -> (type, other names that it may have).  What is missing becomes null."""
    there = {c.strip().removeprefix(BOM): c for c in df.columns}
    out = []
    for name, (kind, others) in fields.items():
        found = next((there[n] for n in (name, *others) if n in there), None)
        out.append((F.col(f"`{found}`").try_cast(kind) if found else F.lit(None).cast(kind)).alias(name))
    return df.select(*out)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_path_parts(df: DataFrame, pattern: str, names: Sequence[str]) -> DataFrame:
    """Values that a file's path holds, as columns: one capturing group each."""
    path = F.col("_metadata.file_path")
    return df.select("*", *(F.regexp_extract(path, pattern, k + 1).alias(n) for k, n in enumerate(names)))


def complete_only(files: DataFrame, key: str, kind: str, needed: Sequence[str]) -> DataFrame:
    """Rows of keys that have every needed kind."""
    full = files.where(F.col(kind).isin(*needed)).groupBy(key).agg(F.count_distinct(kind).alias("n")).where(F.col("n") == len(set(needed)))
    return files.join(full.select(key), key, "left_semi")


def preferred(files: DataFrame, keys: Sequence[str], rules: Sequence[Column], name: str) -> DataFrame:
    """One file of each key: the first rule that a file fits decides, then its name."""
    place = F.coalesce(*(F.when(rule, F.lit(k)) for k, rule in enumerate(rules)), F.lit(len(rules)))
    order = Window.partitionBy(*keys).orderBy(place, name)
    return files.withColumn("choice", F.row_number().over(order)).where("choice = 1").drop("choice")


def read_through(spark: SparkSession, path: str, make, overwrite: bool = False) -> DataFrame:
    """The stored table if there is one, else ``make()``, stored."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if overwrite or not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def grid_from_images(spark: SparkSession, glob: str) -> DataFrame:
    """path, r, c, b, g, red of every pixel of the images that Spark's image source reads."""
    image = spark.read.format("image").option("dropInvalid", True).load(glob).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    at = image.select("origin", "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("k"))
    byte = lambda i: F.conv(F.hex(F.substring("data", F.col("k") * F.col("nChannels") + i + 1, F.lit(1))), 16, 10).cast("int")
    last = F.col("nChannels") - 1
    return at.select(F.col("origin").alias("path"), F.expr("k div width").cast("int").alias("r"), (F.col("k") % F.col("width")).cast("int").alias("c"), byte(F.lit(0)).alias("b"), byte(F.least(F.lit(1), last)).alias("g"), byte(F.least(F.lit(2), last)).alias("red"))
