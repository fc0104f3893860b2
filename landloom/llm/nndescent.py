"""Embedding near-duplicates by NN-descent.

Equal vectors of a label are one class with a count, so copies cost nothing.  Each class starts with the neighbours that
stand beside it in ``TABLES`` orders by random sign codes, and keeps the ``LIST`` nearest.  A round joins every class's list
(and the lists that it is on) with the vectors, compares neighbours of neighbours with each other where one of the two is
new, and sends improvements to both; rounds end when few lists change.  Edges of at least the threshold are kept.

A list is saturated when its last place still holds a link.  Then it is enlarged to all links there are: a link that
neither end's list holds has two saturated ends, so saturated vectors of different groups are compared with each other in
blocks, and the links found join the groups.  Links are counted at last by comparing each linked group completely: at once
where it fits a block, in pairs of blocks where it is larger, which returns counts, not pairs.

Recall is audited against brute force for ``AUDIT`` vectors of all and as many of those with links; below ``RECALL`` the
search goes on with further orders, and after ``TRIES`` searches everything is compared in blocks, with a warning.

Rows: vectors that are null, zero or hold null or non-finite components, and rows with a null label or id, link with
nothing; vectors of different lengths are not compared; labels may be of any type that can be grouped; repeated rows are
vectors of their own; a null id is not kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._common import discard, materialise, table
from .components import components
from .vectors import arrow_matrix, matrix, unit, usable

THRESHOLD, LIST, TABLES, BESIDE, ROUNDS, FEW = 0.93, 8, 8, 4, 4, 0.01
BLOCK, SALTS, AUDIT, RECALL, TRIES = 512, 64, 512, 0.98, 3


def _nearest(pairs: DataFrame, k: int, *more: str) -> DataFrame:
    """The k most similar u of each v; Spark limits the groups before it shuffles them."""
    best = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    return pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("v", "u", "sim", *more)


def _begin(classes: DataFrame, seed: int, bits: int) -> DataFrame:
    """(v, u, sim) of classes that stand side by side in orders by sign codes.

    The few that stand on two sides of a partition's border meet in another order or in the descent."""

    def coded(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x = unit(arrow_matrix(own.column(3)))
                for t in range(TABLES):
                    p = x @ np.random.default_rng((seed, t, int(dim))).standard_normal((int(dim), bits + 1))
                    code = ((p[:, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), *own.columns, pa.array(code), pa.array(p[:, bits])], names=["t", *own.schema.names, "code", "p"])

    def beside(batches):
        last = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if last is not None:
                now = pa.concat_tables([last, now])
            key = np.stack([now.column(c).to_numpy() for c in ("t", "label", "dim")], 1).astype(np.int64)
            ids, old = now.column("id").to_numpy(), 0 if last is None else last.num_rows
            for dim in np.unique(key[:, 2]):
                at = np.flatnonzero(key[:, 2] == dim)
                x = unit(arrow_matrix(now.column("e").combine_chunks().take(pa.array(at))))
                for s in range(1, BESIDE + 1):
                    fit = (key[at[:-s]] == key[at[s:]]).all(1) & (at[s:] >= old) if len(at) > s else np.empty(0, bool)
                    if fit.any():
                        a, b = at[:-s][fit], at[s:][fit]
                        sim = (x[:-s][fit] * x[s:][fit]).sum(1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[a], ids[b]])), pa.array(np.concatenate([ids[b], ids[a]])), pa.array(np.concatenate([sim, sim]))], names=["v", "u", "sim"])
            last = now.slice(max(0, now.num_rows - BESIDE))

    kind = classes.schema["e"].dataType.simpleString()
    own = classes.select("id", "label", "dim", "e").mapInArrow(coded, f"t int, id long, label long, dim int, e {kind}, code long, p double")
    order = ["t", "label", "dim", "code", "p", "id"]
    sorted_ = own.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.mapInArrow(beside, "v long, u long, sim double").where("u <> v").groupBy("v", "u").agg(F.max("sim").alias("sim"))


def _compare(batches):
    """Neighbours of one class against each other: (v, u, sim) where it would improve v's list."""
    for batch in batches:
        vs, us, sims = [], [], []
        lists, sizes = batch.column(0), np.diff(batch.column(0).offsets.to_numpy())
        flat = lists.flatten()
        ids, least, fresh = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("u", "least", "fresh"))
        vectors, at = flat.field("e"), 0
        for n in sizes:
            if n > 1:
                x = unit(arrow_matrix(vectors.slice(at, n)))
                own, floor, new = ids[at : at + n], least[at : at + n], fresh[at : at + n]
                g = x @ x.T
                better = (g > floor[:, None]) & (new[:, None] | new[None, :])
                np.fill_diagonal(better, False)
                i, j = np.nonzero(better)
                vs.append(own[i]), us.append(own[j]), sims.append(g[i, j])
            at += n
        if vs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (vs, us, sims)], names=["v", "u", "sim"])


def _descend(classes: DataFrame, graph: DataFrame, n: int) -> DataFrame:
    """Rounds of neighbours-of-neighbours joins; graph(v, u, sim, fresh)."""
    for _ in range(ROUNDS):
        least = graph.groupBy("v").agg(F.when(F.count("*") >= LIST, F.min("sim")).otherwise(-2.0).alias("least"))
        both = graph.unionByName(graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "sim", "fresh"))
        once = both.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh"))
        lists = _nearest(once, 2 * LIST, "fresh").join(classes.select(F.col("id").alias("u"), "e", "label"), "u").join(least.withColumnRenamed("v", "u"), "u", "left")
        held = lists.groupBy("v").agg(F.collect_list(F.struct("u", F.coalesce("least", F.lit(-2.0)).alias("least"), "fresh", "e")).alias("near"))  # 2 * LIST rows a class
        found = held.select("near").mapInArrow(_compare, "v long, u long, sim double").groupBy("v", "u").agg(F.max("sim").alias("sim"))
        merged = graph.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))).groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        after = materialise(_nearest(merged, LIST, "fresh"))
        discard(graph)
        graph = after
        if graph.where("fresh").count() <= FEW * n * LIST:
            break
    return graph


def _linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return (a @ b.T) / np.sqrt((a * a).sum(1))[:, None] / np.sqrt((b * b).sum(1))[None, :] >= threshold


def _counter(threshold: float):
    def count(batches):
        """Groups that fit a block: how many vectors each of their classes is linked with."""
        for batch in batches:
            ids, counts = [], []
            lists, at = batch.column(0), 0
            flat = lists.flatten()
            own, many, vectors = flat.field("id").to_numpy(zero_copy_only=False), flat.field("many").to_numpy(zero_copy_only=False), flat.field("e")
            for n in np.diff(lists.offsets.to_numpy()):
                x = arrow_matrix(vectors.slice(at, n))
                linked = _linked(x, x, threshold)
                np.fill_diagonal(linked, False)
                ids.append(own[at : at + n])
                counts.append(linked @ many[at : at + n])
                at += n
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], names=["id", "n"])

    return count


def _group_counts(part: pd.DataFrame) -> pd.DataFrame:
    """Links between the two blocks of a linked group: how many vectors each class is linked with there."""
    lo, hi = (part[part["block"] == part[c].iloc[0]] for c in ("lo", "hi"))
    linked = _linked(matrix(lo["e"]), matrix(hi["e"]), part["threshold"].iloc[0])
    if part["lo"].iloc[0] == part["hi"].iloc[0]:
        np.fill_diagonal(linked, False)
        return pd.DataFrame({"id": lo["id"], "n": linked @ hi["many"].to_numpy()})
    return pd.DataFrame({"id": pd.concat([lo["id"], hi["id"]]), "n": np.concatenate([linked @ hi["many"].to_numpy(), linked.T @ lo["many"].to_numpy()])})


def _bridging(part: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks that join different groups."""
    lo, hi = (part[part["block"] == part[c].iloc[0]] for c in ("lo", "hi"))
    g, h = lo["component"].to_numpy(), hi["component"].to_numpy()
    a, b, root, out = lo["id"].to_numpy(), hi["id"].to_numpy(), {}, []

    def find(v):
        while v in root:
            v = root[v]
        return v

    for i, j in zip(*np.nonzero(_linked(matrix(lo["e"]), matrix(hi["e"]), part["threshold"].iloc[0]) & (g[:, None] != h[None, :])), strict=True):
        p, q = find(g[i]), find(h[j])
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((a[i], b[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _block_pairs(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The rows of each key dealt into blocks, each block once for every block of its key; a hot key's rows are many blocks."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    counted = rows.withColumn("salt", salt).groupBy(*keys, "salt").agg(F.count("*").alias("own"))
    sizes = counted.withColumn("blocks", F.ceil(F.sum("own").over(Window.partitionBy(*keys)) / BLOCK).cast("int")).drop("own")  # SALTS rows a key
    dealt = rows.withColumn("salt", salt).join(sizes, [*keys, "salt"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).withColumn("threshold", F.lit(threshold)).drop("salt", "blocks", "other")


def _links(classes: DataFrame, graph: DataFrame, threshold: float, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, n) linked vectors of other classes, and (id, component); ``everything`` compares all with all of their label."""
    close = graph.where(F.col("sim") >= threshold)
    edges = materialise(close.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct())
    joined = materialise(components(edges))
    full = classes.select("id") if everything else close.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") >= LIST).select(F.col("v").alias("id"))
    full = materialise(full)
    if not full.isEmpty():
        placed = classes.select("id", "label", "dim", "e").join(full, "id").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
        pairs = _block_pairs(placed, ["label", "dim"], threshold)
        bridges = materialise(pairs.groupBy("label", "dim", "lo", "hi").applyInPandas(_bridging, "a long, b long"))
        if not bridges.isEmpty():
            edges = edges.unionByName(bridges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
            joined = materialise(components(edges))
    sizes = materialise(joined.groupBy("component").agg(F.count("*").alias("size")))
    own = joined.join(classes.select("id", "e", "many"), "id")
    few = own.join(sizes.where(F.col("size") <= BLOCK).select("component"), "component").groupBy("component").agg(F.collect_list(F.struct("id", "e", "many")).alias("own"))  # BLOCK rows a group
    counts = few.select("own").mapInArrow(_counter(threshold), "id long, n long")
    large = sizes.where(F.col("size") > BLOCK).select("component")
    if not large.isEmpty():
        pairs = _block_pairs(own.join(large, "component", "left_semi"), ["component"], threshold)
        counts = counts.unionByName(pairs.groupBy("component", "lo", "hi").applyInPandas(_group_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")))
    return materialise(counts), joined


def _audit(classes: DataFrame, counts: DataFrame, threshold: float) -> float:
    """The share of the true links, found by brute force over all, that were found, of ``AUDIT`` vectors of all and as many
    that have links."""
    chosen = lambda ids: ids.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(AUDIT)
    sample = chosen(classes.select("id")).unionByName(chosen(counts.where("n > 0").select("id"))).distinct()
    asked = classes.select("id", "label", "dim", "e").join(sample, "id").collect()  # twice AUDIT rows at most
    by_dim = {d: [r for r in asked if r.dim == d] for d in {r.dim for r in asked}}
    known = {d: (np.array([r.id for r in rs]), np.array([r.label for r in rs]), unit(np.array([r.e for r in rs], np.float64))) for d, rs in by_dim.items()}

    def brute(batches):
        total = {int(i): 0 for ids, _, _ in known.values() for i in ids}
        for batch in batches:
            dims, labels, many, ids = (batch.column(c).to_numpy() for c in ("dim", "label", "many", "id"))
            for d, (q, q_label, qx) in known.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    x = unit(arrow_matrix(batch.column("e").take(pa.array(at))))
                    hit = (qx @ x.T >= threshold) & (q_label[:, None] == labels[at][None, :]) & (q[:, None] != ids[at][None, :])
                    for i, n in zip(q, hit @ many[at], strict=True):
                        total[int(i)] += int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["id", "true"])

    truth = classes.select("id", "label", "dim", "many", "e").mapInArrow(brute, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    got = truth.join(counts, "id", "left").agg(F.sum("true").alias("true"), F.sum(F.least("true", F.coalesce("n", F.lit(0)))).alias("found")).first()
    return 1.0 if not got.true else got.found / got.true


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    kind = vectors.schema["label"].dataType
    label = F.col("label").cast("long") if isinstance(kind, IntegralType) else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    e = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), label.alias("label"), e.alias("e"))
    part = usable(F.col("e")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # copies are counted where they lie first, and meet their class again in parts: a hot vector is not one task's
    live = rows.where(part).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    salted = materialise(live.groupBy("label", "e", "salt").agg(F.min("vec_id").alias("least"), F.count("*").alias("own")))
    classes = materialise(salted.groupBy("label", "e").agg(F.min("least").alias("id"), F.sum("own").alias("many")).withColumn("dim", F.size("e")))
    n = classes.count()
    bits = max(1, int(np.log2(max(2, n))) - 3)
    graph = counts = joined = None
    for attempt in range(TRIES):
        began = _begin(classes, 42 + attempt, bits)
        began = _nearest(began if graph is None else began.unionByName(graph.drop("fresh")).groupBy("v", "u").agg(F.max("sim").alias("sim")), LIST)
        graph = _descend(classes, materialise(began.withColumn("fresh", F.lit(True))), n)
        counts, joined = _links(classes, graph, threshold)
        if (recall := _audit(classes, counts, threshold)) >= RECALL:
            break
    else:
        warnings.warn(f"audited recall {recall:.3f} after {TRIES} searches: all vectors of a label are compared in blocks", stacklevel=2)
        counts, joined = _links(classes, graph, threshold, everything=True)
    linked = classes.join(counts, "id", "left").join(joined, "id", "left").select("label", "e", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    named = salted.select("label", "e", "salt").join(linked, ["label", "e"])  # SALTS rows a class at most
    out = live.join(named, ["label", "e", "salt"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where(~part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
