"""Centroid clustering by kd-tree filtering: Lloyd's rounds in whole numbers, exact.

Vectors are quantised and dealt into blocks of bounded size.  A block keeps a kd-tree over its vectors: every node has its
count, its integer sums and its box, and the vectors lie in the order of the leaves.  The blocks are written once and read
in each round.  A round walks the trees with the centroids that can still be nearest: one that is farther than another
over the node's whole box is dropped (strictly, so ties stay open); a node with one centroid left is assigned as a whole by its sums, leaves
with several are resolved vector by vector.  Tasks return sums and counts by centroid, Spark adds them.

Only the centroids (``K`` of them) pass through the driver.  All sums and distances are exact: components are limited to
``MOST`` in size, beyond which no distance fits 64 bits, and a larger one is an error that says so.

Rows: vectors that are null, of another length than ``WIDTH`` or hold null or non-finite components are left out; null and
repeated ids stay, one result per row (a null id starts no centroid); fewer vectors than ``K`` start as many centroids as
there are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, table

K, ROUNDS, SCALE, WIDTH, SEED = 40, 5, 256, 64, "2"
BLOCK, LEAF, MOST = 4096, 32, 1 << 26


def kept(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, x: the quantised vectors that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.floor(x.cast("double") * scale)
    most = F.forall(e, lambda x: F.abs(x.cast("double")) < MOST / scale)
    checked = F.when(most, F.transform(e, whole)).otherwise(F.raise_error(F.lit(f"a component is {MOST // scale} or more in size")).cast("array<bigint>"))
    return vectors.where(F.coalesce((F.size(e) == width) & fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("x"))


# ---------------------------------------------------------------- trees


def tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The order of the vectors, and the nodes (first, last, left child or 0) from the root; children stand side by side."""
    order, nodes, todo = np.arange(len(x)), [[0, len(x), 0]], [0]
    for node in todo:
        a, b, _ = nodes[node]
        own = x[order[a:b]]
        if b - a <= leaf or (spread := own.max(0) - own.min(0)).max() == 0:
            continue
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, spread.argmax()], half, kind="introselect")]
        nodes[node][2] = len(nodes)
        todo += [len(nodes), len(nodes) + 1]
        nodes += [[a, a + half, 0], [a + half, b, 0]]
    return order, np.array(nodes, np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (the smaller number of equals) and its squared distance."""
    # floating products are exact while they and their sums fit 53 bits
    small = int(max(np.abs(x).max(initial=1), np.abs(centroids).max(initial=1))) ** 2 * x.shape[1] < 1 << 50
    u, c = (x.astype(np.float64), centroids.astype(np.float64)) if small else (x, centroids)
    d = (u * u).sum(1)[:, None] - 2 * (u @ c.T) + (c * c).sum(1)[None]
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at].astype(np.int64)


def filtered(x: np.ndarray, nodes: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int]]:
    """(first, last, centroid or centroids of each vector) that together cover a tree's vectors."""
    boxes = [None] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        a, b, child = nodes[k]
        boxes[k] = (x[a:b].min(0), x[a:b].max(0)) if not child else (np.minimum(boxes[child][0], boxes[child + 1][0]), np.maximum(boxes[child][1], boxes[child + 1][1]))
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        node, open_ = todo.pop()
        a, b, child = nodes[node].tolist()
        low, high = boxes[node]
        c = centroids[open_]
        near = c[int(((2 * c - (low + high)) ** 2).sum(1).argmin())]
        # the corner that lies farthest in a centroid's direction from the near one: if even that is nearer to the latter, all are
        corner = np.where(c > near, high, low)
        open_ = open_[((c - corner) ** 2).sum(1) <= ((near - corner) ** 2).sum(1)]
        if len(open_) == 1:
            yield a, b, int(open_[0])
        elif child:
            todo += [(child, open_), (child + 1, open_)]
        else:
            yield a, b, open_[nearest(x[a:b], centroids[open_])[0]]


def _stack(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(-1, width)


def trees(vectors: DataFrame, width: int = WIDTH, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """ids, x and nodes of one block a row, as arrays."""

    def build(batches):
        ids, held, n = [], [], 0

        def made():
            x = np.concatenate(held)
            order, nodes = tree(x, leaf)
            own = pa.concat_arrays(ids).take(pa.array(order))
            sums = np.array([x[order[a:b]].sum(0) for a, b, _ in nodes])
            return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(t)) for v, t in ((own.to_pylist(), pa.int64()), (x[order].ravel(), pa.int64()), (nodes.ravel(), pa.int64()), (sums.ravel(), pa.int64()))], names=["ids", "x", "nodes", "sums"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if n + part.num_rows > block and n:
                    yield made()
                    ids, held, n = [], [], 0
                ids.append(part.column(0))
                held.append(_stack(part.column(1), width))
                n += part.num_rows
        if n:
            yield made()

    return vectors.mapInArrow(build, "ids array<bigint>, x array<bigint>, nodes array<bigint>, sums array<bigint>")


def _blocks(batches, width: int):
    for batch in batches:
        for k in range(batch.num_rows):
            ids, x, nodes, sums = (batch.column(c)[k].values for c in range(4))
            yield ids, x.to_numpy().reshape(-1, width), nodes.to_numpy().reshape(-1, 3), sums.to_numpy().reshape(-1, width)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of exact means; one without vectors stays."""
    k, width = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, x, nodes, own in _blocks(batches, width):
            whole = {(a, b): j for j, (a, b, _) in enumerate(nodes.tolist())}
            for a, b, at in filtered(x, nodes, centroids):
                if isinstance(at, int):
                    sums[at] += own[whole[a, b]]
                    counts[at] += b - a
                else:
                    np.add.at(sums, at, x[a:b])
                    counts += np.bincount(at, minlength=k)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there]), pa.array(sums[there].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = blocks.mapInArrow(run, "cluster int, n long, sums array<bigint>")
    # sums in 38 digits: those of all vectors may exceed 64 bits
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)))
    out = centroids.copy()
    for r in total.collect():  # a row a centroid
        out[r.cluster] = [int(r[f"s{d}"]) // r.n for d in range(width)]
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    width = centroids.shape[1]

    def run(batches):
        for ids, x, nodes, _ in _blocks(batches, width):
            cluster = np.empty(len(x), np.int32)
            for a, b, at in filtered(x, nodes, centroids):
                cluster[a:b] = at
            away = x - centroids[cluster]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array((away * away).sum(1))], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def _hash(vec_id: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), vec_id.cast("string")), 256)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED, block: int = BLOCK) -> DataFrame:
    """Every vector's cluster, its distance, the inertia of its cluster and of all, and the digest of its centroid."""
    own = kept(vectors, width, scale)
    first = own.where("vec_id is not null").select(_hash(F.col("vec_id"), seed).alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return own.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in schema.split(", ")[1:]))).limit(0)
    centroids = np.array([r.x for r in first], np.int64)
    blocks = materialise(trees(own, width, block))
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    placed = materialise(assigned(blocks, centroids))
    inertia = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows at most
    total = inertia.agg(F.sum("cluster_inertia")).first()[0]
    digest = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    names = vectors.sparkSession.createDataFrame(digest, "cluster int, centroid_sha256 string")
    return placed.join(F.broadcast(inertia), "cluster").join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def sql(k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED) -> str:
    """All rounds by comparison of every vector with every centroid."""
    parts = [
        f"x AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {width})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x AS z FROM x WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k})",
    ]
    for j in range(rounds + 1):
        near = f"SELECT row, vec_id, x, c, list_sum(list_transform(list_zip(x, z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM x, c{j}"
        parts.append(f"a{j} AS (SELECT row, vec_id, x, c, CAST(d AS BIGINT) AS d FROM ({near}) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)")
        if j < rounds:
            sums = f"SELECT c, i, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS v, unnest(range({width})) AS i FROM a{j}) GROUP BY 1, 2"
            parts.append(f"m{j} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS z FROM ({sums}) GROUP BY 1)")
            parts.append(f"c{j + 1} AS (SELECT c{j}.c, coalesce(m{j}.z, c{j}.z) AS z FROM c{j} LEFT JOIN m{j} ON m{j}.c = c{j}.c)")
    last = f"a{rounds}"
    return f"WITH {', '.join(p.replace(' AS (', ' AS MATERIALIZED (', 1) for p in parts)} SELECT vec_id, CAST({last}.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} ON c{rounds}.c = {last}.c"
