"""Ordered steps over cities: ranges of steps, stored results and a status table that outlives failures."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_through

Step = Callable[[SparkSession, Mapping[str, DataFrame]], DataFrame]
STATUS = "step string, status string, seconds double, message string"


def run(spark: SparkSession, steps: Mapping[str, Step], folder: str, start: str | None = None, stop: str | None = None, overwrite: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run the steps from ``start`` to ``stop`` in order; each sees the tables of those before it.

    A stored result is used again unless ``overwrite``; the first failure ends the run and is a row of the status table."""
    names = list(steps)
    chosen = names[names.index(start) if start else 0 : names.index(stop) + 1 if stop else None]
    tables: dict[str, DataFrame] = {}
    rows = []
    for name in names[: names.index(chosen[0])] if chosen else []:
        tables[name] = spark.read.parquet(f"{folder}/{name}")
    for name in chosen:
        began = time.time()
        try:
            tables[name] = read_through(spark, f"{folder}/{name}", lambda f=steps[name]: f(spark, tables), overwrite)
        except Exception as e:  # noqa: BLE001  the status table reports it
            rows.append((name, "failed", time.time() - began, str(e).splitlines()[0][:300]))
            break
        rows.append((name, "ok", time.time() - began, ""))
    return tables, spark.createDataFrame(rows, STATUS)


# ---------------------------------------------------------------- many cities


def _there(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def complete(spark: SparkSession, folder: str, needed: Sequence[str]) -> bool:
    """Whether every needed result is stored whole."""
    return all(fs.exists(at) for at, fs in (_there(spark, f"{folder}/{n}/_SUCCESS") for n in needed))


def run_cities(spark: SparkSession, plans: Mapping[str, Mapping[str, Step]], folder: str, needed: Sequence[str] = (), **how) -> DataFrame:
    """Run each city's steps in a folder of its own; a failed city is a row of the status table and the others go on.

    For steps that cannot be one job keyed by city.  city, status, step, seconds, message, complete."""
    rows = []
    for city, plan in plans.items():
        _, status = run(spark, plan, f"{folder}/{city}", **how)
        done = status.collect()  # steps
        last = done[-1] if done else None
        rows.append((city, last.status if last else "ok", last.step if last else None, sum(r.seconds for r in done), last.message if last else "", complete(spark, f"{folder}/{city}", needed)))
    return spark.createDataFrame(rows, "city string, status string, step string, seconds double, message string, complete boolean")


def exit_code(status: DataFrame) -> int:
    return 0 if status.where("status <> 'ok'").isEmpty() else 1


def invalidate(spark: SparkSession, steps: Mapping[str, Step], folder: str, name: str, version: str) -> list[str]:
    """Put away the stored results of a step and of all after it, under ``_stale/version``; their names."""
    names, moved = list(steps), []
    for n in names[names.index(name) :]:
        at, fs = _there(spark, f"{folder}/{n}")
        if fs.exists(at):
            to, _ = _there(spark, f"{folder}/_stale/{version}/{n}")
            fs.mkdirs(to.getParent())
            if not fs.rename(at, to):
                raise OSError(f"could not move {at} to {to}")
            moved.append(n)
    return moved


def first_complete(spark: SparkSession, ways: Mapping[str, tuple[str, Sequence[str]]], default: str) -> str:
    """The first way whose folder holds all that it needs: full results before substitutes."""
    return next((way for way, (folder, needed) in ways.items() if complete(spark, folder, needed)), default)
