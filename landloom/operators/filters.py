"""Chains of filters that say how many rows each of them drops, without a second scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _counts(filters: Mapping[str, Column]) -> tuple[list[Column], Column]:
    """A count of what each filter is the first to drop, and the condition of what all keep; null drops."""
    kept, counts = F.lit(True), []
    for name, condition in filters.items():
        fine = F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(kept & ~fine).alias(name))
        kept = kept & fine
    return counts, kept


def observed(df: DataFrame, filters: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows that all filters keep, and an observation with ``rows`` and each filter's drops.

    It is filled by the first action on the result (``observation.get``)."""
    counts, kept = _counts(filters)
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).where(kept), seen


def drops(df: DataFrame, filters: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, step, filter, dropped, left): what each filter drops and leaves, from one pass."""
    counts, _ = _counts(filters)
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *counts)
    lost, steps = F.lit(0), []
    for k, name in enumerate(filters):
        lost = lost + F.col(name)
        steps.append(F.struct(F.lit(k + 1).alias("step"), F.lit(name).alias("filter"), F.col(name).alias("dropped"), (F.col("rows") - lost).alias("left")))
    return per.select(*keys, F.inline(F.array(*steps)))
