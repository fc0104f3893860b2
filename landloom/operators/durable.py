"""Cutting lineage of iterative operators in a folder that every executor sees."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of our own in local mode, an error on a cluster."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="landloom-")
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is already gone; the shared folder is the cluster's to clean
            return


def materialise(df: DataFrame, codec: str = "zstd", **options: str | int) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and lost executors cost nothing.

    Columns are compressed there, which those of a checkpoint are not."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/landloom-{uuid.uuid4().hex}"
    df.write.options(compression=codec, **options).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._landloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing reads any more."""
    path = df._landloom_path
    _delete(df.sparkSession, path)
    _written.remove((df.sparkSession, path))
