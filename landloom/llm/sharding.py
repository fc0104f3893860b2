"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents of equal text form a group that is never divided.  A partial partition is a vector of subset sums; differencing
repeatedly takes the two with the largest spread and adds the largest subset of one to the smallest of the other.  Groups
that hold a noteworthy share of all bytes or rows (at most ``2 * LARGE``, as each has a ``LARGE``-th) go to the last round
as they are.  The others are dealt by hash into blocks of bounded size, and each block is differenced into ``BUNDLES``
subsets; those are the items of the next round, until at most ``TOP`` items are left for the last one, on the driver.

Law: ``bytes``.  Rows: null text counts as empty and shares its group; null ids stay; repeated rows share a group; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, table

SHARDS, LARGE, TOP, BUNDLES, BLOCK = 8, 4096, 16_384, 32, 50_000


def differencing(sizes: Sequence[int], ways: int) -> list[int]:
    """The subset, 0 to ways - 1, of each item; ties are broken by position."""
    out = [0] * len(sizes)
    if not out:
        return out
    # (negative spread, order, sums descending, members of each subset as nested pairs)
    heap = [(-s, k, (s,) + (0,) * (ways - 1), (k,) + (None,) * (ways - 1)) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a, p = heapq.heappop(heap)
        _, _, b, q = heapq.heappop(heap)
        merged = sorted(
            ((x + y, i) for i, (x, y) in enumerate(zip(a, reversed(b), strict=True))), key=lambda v: (-v[0], v[1])
        )
        members = []
        for _, i in merged:
            left, right = p[i], q[ways - 1 - i]
            members.append(right if left is None else left if right is None else (left, right))
        sums = tuple(s for s, _ in merged)
        heapq.heappush(heap, (sums[-1] - sums[0], order, sums, tuple(members)))
        order += 1
    for subset, root in enumerate(heap[0][3]):
        stack = [root] if root is not None else []
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                out[x] = subset
    return out


def _bundler(bundles: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        """Difference one block into bundles, named by the block."""
        part = part.sort_values(["bytes", "item"], ascending=[False, True], kind="stable")
        subset = differencing(part["bytes"].tolist(), bundles)
        return pd.DataFrame({"item": part["item"], "bytes": part["bytes"], "bundle": [f"{b}.{k}" for b, k in zip(part["block"], subset, strict=True)]})

    return run


def assign(items: DataFrame, shards: int = SHARDS, large: DataFrame | None = None) -> DataFrame:
    """items(item string, bytes long), large with the same columns -> (item, shard) with near-equal sums of bytes."""
    spark = items.sparkSession
    levels: list[DataFrame] = []
    while (n := items.count()) > TOP:
        blocks = max(-(-n // BLOCK), TOP // (2 * BUNDLES))  # many small bundles for the last round
        dealt = items.withColumn("block", F.concat(F.lit(f"{len(levels)}."), F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("string")))
        made = materialise(dealt.groupBy("block").applyInPandas(_bundler(BUNDLES), "item string, bytes long, bundle string"))
        levels.append(made.select("item", "bundle"))
        items = made.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).withColumnRenamed("bundle", "item")
    last = [(r.item, r.bytes) for r in (items if large is None else items.unionByName(large)).collect()]  # TOP + 2 * LARGE at most
    last.sort(key=lambda r: (-r[1], r[0]))
    subset = differencing([b for _, b in last], shards)
    out = spark.createDataFrame([(i, s) for (i, _), s in zip(last, subset, strict=True)], "item string, shard int")
    if not levels:
        return out
    kept = large.select("item").join(F.broadcast(out), "item") if large is not None else None
    for made in reversed(levels):
        out = made.join(out.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard")
    return out if kept is None else out.unionByName(kept)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = materialise(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("item")))
    groups = materialise(rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    hot = (F.col("bytes") * LARGE >= (total.bytes or 0)) | (F.col("n") * LARGE >= (total.n or 0))
    large = groups.where(hot).select("item", "bytes")
    placed = materialise(assign(groups.where(~hot).select("item", "bytes"), shards, large))
    few = F.broadcast(placed.join(F.broadcast(large.select("item")), "item", "left_semi"))  # 2 * LARGE rows at most
    cold = rows.join(F.broadcast(large.select("item")), "item", "left_anti").join(placed, "item")
    put = materialise(rows.join(few, "item").unionByName(cold).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = put.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "item"))
    return put.join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("earlier") + nth - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
