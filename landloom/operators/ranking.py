"""Ranks, shares, windows and completions over keyed tables; every order is total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def share(value: str | Column, *keys: str) -> Column:
    """The share of the group's total, null where that is 0."""
    value = F.col(value) if isinstance(value, str) else value
    return F.try_divide(value.cast("double"), F.sum(value).over(over(*keys)).cast("double"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits the groups before it shuffles them."""
    return numbered(df, keys, order, name).where(F.col(name) <= k)


def positive_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Competition rank among positive values; null for others."""
    best = Window.partitionBy(*keys).orderBy(F.when(F.col(value) > 0, F.col(value)).desc_nulls_last())
    return df.withColumn(name, F.when(F.col(value) > 0, F.rank().over(best)))


def gap_filled(df: DataFrame, key: str, time: str, flag: str) -> DataFrame:
    """A false between two trues of its key becomes true; the raw flags decide, so nothing cascades."""
    line = Window.partitionBy(key).orderBy(time)
    before = F.max(F.col(flag)).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.max(F.col(flag)).over(line.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("filled", F.col(flag) | (F.coalesce(before, F.lit(False)) & F.coalesce(after, F.lit(False))))


def latest(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """The columns of each key's latest row; equals are decided by the columns themselves."""
    best = F.max(F.struct(time, *columns)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, f"best.{time}", *(f"best.{c}" for c in columns))


def completed(df: DataFrame, spine: DataFrame, keys: Sequence[str], fills: dict[str, object]) -> DataFrame:
    """Every row of the spine, with the fill where the table has none."""
    return spine.join(df, list(keys), "left").na.fill(fills)
