"""Shared plumbing of the training-data operators: durable intermediate tables and Arrow helpers."""

from __future__ import annotations

import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import discard, materialise, shared_folder  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def crc_bucket(doc_id: int | None, n: int = 5) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def crc_bucket_col(doc_id, n: int = 5):
    """crc32 of the id's decimal text, modulo n."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % n).cast("int")


def hashed_parts(spark: SparkSession, rows: int, per_part: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))
