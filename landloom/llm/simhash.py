"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is mapped to the numbers of set bits of its 16 four-bit segments.  Flipping one bit moves one of those
counts by one, so the Manhattan distance of two such vectors never exceeds the Hamming distance: a grid range-join on the
vectors with radius 2 loses no pair within two bits.  Two lattice points within distance 2 have a lattice point within 1 of
both, hence each distinct fingerprint is entered at its own grid cell and at the 32 cells beside it, and partners meet in
an equi-join of cells instead of a scan of all 545 cells around each; Hamming distance then verifies exactly.

Cells that hold more than ``bucket`` fingerprints are not paired.  There each fingerprint is entered at itself and its 64
one-bit neighbours; two of them share such a point exactly if they differ in at most two bits, and each is linked with the
smallest one at the point.  That is exact, gives the same components, and stays in proportion to the number of members.

Rows: null text counts as empty; null ids stay and are never a component's smallest; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, table
from .components import components

SEED = 42
BUCKET = 32

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (256 * np.arange(8)).astype(np.int64)


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, repeats included; fewer words are one shingle; none gives an empty array."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z fold, only ASCII white space splits
    if not own:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= words:
        return np.array([digest(line, seed)], np.uint64)
    starts = [0, *accumulate([len(w) + 1 for w in own])]
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, [e - 1 for e in starts[words:]], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").ravel().view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp (signed long) of every whole text."""

    def run(batches):
        for batch in batches:
            fps = [majority(shingle_hashes(t.as_py(), words, seed)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _hex(n: int):
    """A 64-bit constant."""
    return F.lit(n - (1 << 64) if n >> 63 else n).cast("long")


def segment_counts(fp):
    """Sixteen four-bit segments' numbers of set bits, each in its own nibble of one long."""

    def half(x):  # 32 bits at a time: no sum leaves the range of a long
        pairs = x - F.shiftrightunsigned(x, 1).bitwiseAND(_hex(0x55555555))
        return pairs.bitwiseAND(_hex(0x33333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(_hex(0x33333333))

    return F.shiftleft(half(F.shiftrightunsigned(fp, 32)), 32).bitwiseOR(half(fp.bitwiseAND(_hex(0xFFFFFFFF))))


def _cells(counts):
    """Own grid cell and those beside it."""
    near = [counts]
    for i in range(16):
        nibble = F.shiftrightunsigned(counts, 4 * i).bitwiseAND(F.lit(15).cast("long"))
        step = _hex(1 << 4 * i)
        near += [F.when(nibble < 4, counts + step), F.when(nibble > 0, counts - step)]
    return F.array_compact(F.array(*near))


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """distinct(fp), each once -> (a, b): links that join exactly what links of at most two differing bits join."""
    entered = materialise(distinct.select("fp", F.explode(_cells(segment_counts(F.col("fp")))).alias("cell")))
    held = entered.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(entered.join(held, "cell"))
    small = shared.where(F.col("n") <= bucket)
    left, right = small.select("cell", F.col("fp").alias("a")), small.select("cell", F.col("fp").alias("b"))
    paired = left.join(right, "cell").where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")
    large = shared.where(F.col("n") > bucket).select("fp").distinct()
    points = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(_hex(1 << i)) for i in range(64)))
    at = large.select("fp", F.explode(points).alias("point"))
    least = at.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    starred = at.join(least, "point").where("a <> fp").select("a", F.col("fp").alias("b"))
    return paired.unionByName(starred)


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reached by links of at most two differing bits."""
    own = materialise(fingerprints(docs, words, seed))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(distinct.select("fp"), bucket))
    roots = distinct.join(joined.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- near-duplicates by a similarity of shingle sets

#: Partial fingerprints of a text, and shingles in each.  Two texts of similarity s share none of them with a chance of
#: about (1 - s ** TAKE) ** SKETCHES: 3e-5 at 0.8, 2e-12 at 0.9.
SKETCHES, TAKE = 20, 4
#: Members of a bucket whose pairs are listed; larger buckets are compared in blocks.  Star rounds that come before.
PAIRED, STARS = 24, 2
#: Texts in a block of a larger bucket, shingles that blocks are multiplied over at once.
BLOCK, WIDTH = 256, 8192
#: Odd factors without a common pattern: multiples of one factor would put the same shingles first in every order.
_STIR = np.random.default_rng(SEED).integers(0, 1 << 64, SKETCHES, np.uint64) | np.uint64(1)


def partial_fingerprints(hashes: np.ndarray) -> list[int]:
    """``SKETCHES`` fingerprints, each of the ``TAKE`` shingles that come first in an order of its own.

    Texts whose shingle sets have similarity s share each one with a chance of about s ** TAKE."""
    own = np.unique(hashes)
    if not len(own):
        return []
    out = []
    for stir in _STIR:
        order = (own ^ own >> np.uint64(31)) * stir
        first = own[np.argpartition(order, TAKE)[:TAKE]] if len(own) > TAKE else own
        out.append(majority(first))
    return out


def _similar(left: str | None, right: str | None, words: int, similarity: float) -> bool:
    a, b = (np.unique(shingle_hashes(t, words)) for t in (left, right))
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _shared(own: list[np.ndarray], k: int) -> np.ndarray:
    """How many shingles each of the first ``k`` sets shares with each of all."""
    who = np.repeat(np.arange(len(own)), [len(x) for x in own])
    _, at, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    common = (often > 1)[at]
    who, at = who[common], np.unique(at[common], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    out = np.zeros((k, len(own)), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, WIDTH):
        a, b = np.searchsorted(at, (low, low + WIDTH))
        has = np.zeros((len(own), WIDTH), np.float32)
        has[who[a:b], at[a:b] - low] = 1
        out += has[:k] @ has.T
    return out.astype(np.int64)


def _grouped(buckets: DataFrame, joined: DataFrame | None) -> DataFrame:
    """buckets(row, j, fp, n, met) with each row's group, only buckets that hold several groups."""
    if joined is None:
        return buckets.withColumn("group", F.col("row"))
    placed = buckets.join(joined.withColumnRenamed("id", "row"), "row", "left").withColumn("group", F.coalesce("component", "row")).drop("component")
    several = placed.groupBy("j", "fp").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("j", "fp")
    return placed.join(several, ["j", "fp"])


def _star(placed: DataFrame) -> DataFrame:
    """(a, b): each row with one head, the most central member of most of its buckets that is not of its own group."""
    heads = placed.groupBy("j", "fp").agg(F.max(F.struct("met", "row", "group")).alias("head"))
    met = placed.join(heads, ["j", "fp"]).where(F.col("group") != F.col("head.group")).groupBy("row", F.col("head.row").alias("head")).agg(F.count("*").alias("times"))
    best = met.groupBy("row").agg(F.max(F.struct("times", "head")).alias("best"))
    return best.select(F.least("row", "best.head").alias("a"), F.greatest("row", "best.head").alias("b")).distinct()


def _crowded_links(crowded: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links that join all similar texts of the buckets (row, j, fp, group) which groups have not joined.

    Pairs of one group need no comparison, so a bucket's largest group is compared with the rest only, and the rest with
    itself, each dealt into blocks; a pair of blocks returns what joins its groups, not all of its pairs."""
    sizes = crowded.groupBy("j", "fp", "group").agg(F.count("*").alias("n")).groupBy("j", "fp").agg(F.max(F.struct("n", "group")).alias("most"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    split = sizes.where("most.n < n").select("j", "fp", F.col("most.group").alias("main"), blocks(F.col("n") - F.col("most.n")).alias("rest"), blocks(F.col("most.n")).alias("held"))
    met = crowded.select("j", "fp", "row", "group").join(split, ["j", "fp"])
    deal = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    inside = F.col("group") == F.col("main")
    dealt = met.withColumn("block", F.when(inside, F.col("rest") + deal("held")).otherwise(deal("rest")))
    others = F.sequence(F.lit(0), F.when(inside, F.col("rest") - 1).otherwise(F.col("rest") + F.col("held") - 1))
    pairs = dealt.withColumn("other", F.explode(others)).select("j", "fp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "row", "group")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["block", "row"])
        own = [np.unique(shingle_hashes(t, words)) for t in part["text"]]
        rows, k = part["row"].to_numpy(), int((part["block"] == part["lo"].iloc[0]).sum())
        n, group = np.array([len(x) for x in own]), part["group"].to_numpy()
        both = _shared(own, k)
        fine = (both >= similarity * (n[:k, None] + n[None, :] - both)) & (both > 0) & (group[:k, None] != group[None, :])
        root, out = {}, []

        def find(x):
            while x in root:
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(fine), strict=True):
            a, b = find(group[i]), find(group[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((rows[i], rows[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return pairs.join(texts, "row").groupBy("j", "fp", "lo", "hi").applyInPandas(run, "a long, b long")


def _free_name(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest doc_id (nulls last) stays.

    Groups are what links of equal texts, and of texts whose sets of ``words``-word shingles have a Jaccard similarity of
    at least ``similarity``, connect.  Texts whose fingerprints the segment-popcount grid brings together are candidates
    first; at that similarity fingerprints differ in up to 17 of 64 bits, where no count of bits selects, so texts that
    share one of ``SKETCHES`` partial fingerprints are candidates too.  Every candidate pair is verified on the whole texts
    unless its two texts are already of one group.  ``STARS`` rounds that compare each text with one central text of its
    buckets spare most comparisons; they decide nothing, since afterwards all pairs of a bucket between different groups
    are compared: listed where it is small, in blocks where it holds more than ``PAIRED`` texts.  Empty and null texts are
    equal."""
    mark = _free_name(docs, "dedup row")
    rows = materialise(docs.withColumn(mark, F.monotonically_increasing_id()))
    row, text = F.col(mark).alias("row"), F.coalesce("text", F.lit(""))
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), row)
    nodes = materialise(rows.groupBy(F.sha2(text, 256)).agg(F.min(best).alias("best")).select(F.col("best.row").alias("row"), "best"))  # one row for equal texts

    def sketch(batches):
        for batch in batches:
            own = [shingle_hashes(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(majority, own), pa.int64()), pa.array(map(partial_fingerprints, own), pa.list_(pa.int64()))], names=["row", "whole", "sketches"]
            )

    sketched = materialise(rows.select(row, "text").mapInArrow(sketch, "row long, whole long, sketches array<long>").join(nodes.select("row"), "row").where(F.size("sketches") > 0))
    texts = rows.select(row, "text").join(sketched.select("row"), "row", "left_semi")

    def verify(batches):
        for batch in batches:
            fine = [_similar(x.as_py(), y.as_py(), words, similarity) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fine, pa.bool_()))

    near = told = None

    def ask(pairs: DataFrame) -> DataFrame:
        """Verifies the pairs that were not asked before; the groups that all links so far connect."""
        nonlocal near, told
        asked = materialise(pairs if told is None else pairs.join(told, ["a", "b"], "left_anti"))
        with_texts = asked.join(texts.select(F.col("row").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("right")), "b")
        found = materialise(with_texts.select("a", "b", "left", "right").mapInArrow(verify, "a long, b long"))
        told, near = (asked, found) if told is None else (told.unionByName(asked), near.unionByName(found))
        return materialise(components(near))

    # fingerprints within two bits: each of a fingerprint's texts with its least one, and the least ones with each other
    least = sketched.groupBy("whole").agg(F.min("row").alias("a"))
    beside = links(least.select(F.col("whole").alias("fp"))).join(least.select(F.col("whole").alias("a"), F.col("a").alias("x")), "a").join(least.select(F.col("whole").alias("b"), F.col("a").alias("y")), "b")
    alike = sketched.join(least, "whole").where("row <> a").select("a", F.col("row").alias("b"))
    joined = ask(alike.unionByName(beside.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct())

    entered = sketched.select("row", F.posexplode("sketches").alias("j", "fp"))
    sizes = entered.groupBy("j", "fp").agg(F.count("*").alias("n")).where("n > 1")
    # whoever shares most of its fingerprints with others stands in the middle of them
    buckets = materialise(entered.join(sizes, ["j", "fp"]).withColumn("met", F.sum("n").over(Window.partitionBy("row"))))
    for _ in range(STARS):
        joined = ask(_star(_grouped(buckets, joined)))
    placed = materialise(_grouped(buckets, joined))
    small = placed.where(F.col("n") <= PAIRED).select("j", "fp", "row", "group")
    pairs = small.select("j", "fp", F.col("row").alias("a"), F.col("group").alias("g")).join(small.select("j", "fp", F.col("row").alias("b"), F.col("group").alias("h")), ["j", "fp"]).where("a < b and g <> h").select("a", "b").distinct()
    crowded = materialise(_crowded_links(placed.where(F.col("n") > PAIRED), texts, words, similarity))
    ask(pairs)
    joined = components(near.unionByName(crowded))
    grouped = nodes.join(joined.withColumnRenamed("id", "row"), "row", "left").select("best", F.coalesce("component", "row").alias("group"))
    stay = grouped.groupBy("group").agg(F.min("best").alias("best")).select(F.col("best.row").alias(mark))
    return rows.join(stay, mark, "left_semi").drop(mark)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
