"""Connected components of a link table, as alternating star contractions on DataFrames.

Each partition first contracts its own links with union-find (at most one row per node leaves it); then large-star and
small-star rounds run until nothing changes.  Minima are pre-aggregated before every shuffle and joined back, so a node
that holds a large share of all links is split like any skewed join; every round is written to the shared folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise


def _contract(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent.setdefault(a, a), parent.setdefault(b, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
    for k in range(0, len(rows), 50_000):
        part = rows[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (id, component): every id of a link with the smallest id that it reaches.

    Null ends and links of an id to itself are ignored; an empty table gives an empty result."""
    a, b = links.columns[:2]
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = materialise(edges.mapInArrow(_contract, "u long, v long"))
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = materialise(small)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.count_distinct("u")).first()
        discard(now)
        now = after
        if tuple(state) == seen or not state[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = tuple(state)
