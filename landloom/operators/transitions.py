"""Class transitions between consecutive years and what extents gain and lose.

``pairs`` has y1, r, c, lu1, lu2; ``extents`` has year, r, c.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = range(1, 7)


def sampled() -> Column:
    return F.col("lu1").between(1, 6) & F.col("lu2").between(1, 6)


def updated() -> Column:
    return F.col("lu1") != F.col("lu2")


def period(y1: str = "y1") -> Column:
    return F.concat(F.col(y1).cast("string"), F.lit("->"), (F.col(y1) + 1).cast("string"))


def counts(pairs: DataFrame) -> DataFrame:
    """Counts of updates by period and classes."""
    return pairs.where(sampled() & updated()).groupBy("y1", F.col("lu1").alias("from_class"), F.col("lu2").alias("to_class")).agg(F.count("*").alias("n"))


def complete_counts(pairs: DataFrame) -> DataFrame:
    """Counts with a row for every ordered pair of different classes in every period, and the share of the period."""
    spark = pairs.sparkSession
    classes = F.broadcast(spark.createDataFrame([(a, b) for a in CLASSES for b in CLASSES if a != b], "from_class int, to_class int"))  # 30 rows
    frame = pairs.select("y1").distinct().crossJoin(classes)
    full = frame.join(counts(pairs), ["y1", "from_class", "to_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    share = F.round(F.try_divide(F.col("n").cast("double") * 100, F.sum("n").over(Window.partitionBy("y1"))), 6)
    return full.select(period().alias("period"), "from_class", "to_class", "n", share.alias("share_percent"))


def matrix(pairs: DataFrame) -> DataFrame:
    wide = counts(pairs).groupBy("from_class").pivot("to_class", list(CLASSES)).agg(F.sum("n"))
    return wide.select("from_class", *(F.coalesce(str(k), F.lit(0)).cast("long").alias(f"to_{k}") for k in CLASSES))


def top(pairs: DataFrame, k: int) -> DataFrame:
    """The k most frequent transitions of each period; ties go to the smaller classes."""
    rank = F.row_number().over(Window.partitionBy("y1").orderBy(F.desc("n"), "from_class", "to_class"))
    return counts(pairs).withColumn("rank", rank).where(F.col("rank") <= k).select(period().alias("period"), "from_class", "to_class", "n", "rank")


def _sides(extents: DataFrame) -> DataFrame:
    """y1, r, c and whether the cell is in the extent of y1 and of the year after; only years that have both."""
    years = extents.agg(F.min("year").alias("first"), F.max("year").alias("last"))
    at = extents.select(F.col("year").alias("y1"), "r", "c", F.lit(1).alias("a"), F.lit(0).alias("b"))
    after = extents.select((F.col("year") - 1).alias("y1"), "r", "c", F.lit(0).alias("a"), F.lit(1).alias("b"))
    both = at.unionByName(after).groupBy("y1", "r", "c").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.join(F.broadcast(years), (F.col("y1") >= F.col("first")) & (F.col("y1") < F.col("last"))).drop("first", "last")


def expansion_contraction(extents: DataFrame) -> DataFrame:
    return _sides(extents).where("a <> b").select("y1", "r", "c", F.when(F.col("b") == 1, "expansion").otherwise("contraction").alias("kind"))


def period_rates(pairs: DataFrame, extents: DataFrame) -> DataFrame:
    """Samples and updates inside the extent of t1, and the sizes of both extents with gains and losses."""
    inside = pairs.where(sampled()).join(extents.withColumnRenamed("year", "y1"), ["y1", "r", "c"], "left_semi")
    rates = inside.groupBy("y1").agg(F.count("*").alias("samples"), F.count_if(updated()).alias("updates"))
    sizes = _sides(extents).groupBy("y1").agg(
        F.sum("a").cast("long").alias("t1_cells"), F.sum("b").cast("long").alias("t2_cells"), F.count_if(F.col("b") > F.col("a")).alias("expansion"), F.count_if(F.col("a") > F.col("b")).alias("contraction"),
    )
    return rates.join(sizes, "y1").select(
        F.col("y1").alias("year_t1"), (F.col("y1") + 1).alias("year_t2"), period().alias("period"), "samples", "updates",
        F.round(F.try_divide(F.col("updates").cast("double") * 100, F.col("samples").cast("double")), 6).alias("update_rate_percent"),
        "t1_cells", "t2_cells", "expansion", "contraction", (F.col("t2_cells") - F.col("t1_cells")).alias("net"),
    )


def expansion_by_class(pairs: DataFrame, extents: DataFrame) -> DataFrame:
    """Cells gained per period by their class in t2."""
    gained = expansion_contraction(extents).where("kind = 'expansion'").drop("kind")
    met = pairs.select("y1", "r", "c", "lu2").join(gained, ["y1", "r", "c"])
    return met.groupBy("y1").agg(*(F.count_if(F.col("lu2") == k).alias(f"class_{k}") for k in range(7)), F.count("*").alias("total"))


def built_audit(pairs: DataFrame) -> DataFrame:
    """Changes among built classes; passes if nothing else is among origins or targets."""
    built = [1, 2, 3, 4]
    own = pairs.where(F.col("lu1").isin(*built) & F.col("lu2").isin(*built)).groupBy("y1").agg(
        F.array_sort(F.collect_set("lu1")).alias("origins"), F.array_sort(F.collect_set("lu2")).alias("targets"), F.count("*").alias("samples"), F.count_if(updated()).alias("changed"),
    )
    allowed = F.array(*map(F.lit, built))
    fine = (F.size(F.array_except("origins", allowed)) == 0) & (F.size(F.array_except("targets", allowed)) == 0)
    return own.withColumns({"change_rate": F.round(F.col("changed").cast("double") / F.col("samples"), 6), "passed": fine})
