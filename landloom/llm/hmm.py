"""Language-model scoring with a hidden Markov model trained by Baum-Welch over the whole corpus.

Words are lower-cased (A-Z) runs of non-white-space; every text ends with one end token.  A latent state emits a word class
(a hash of the word's beginning and ending; short words are their own key; the end token is a class of its own) and the
class emits the word in proportion to its training count, so the emission table is states x classes, whatever the
vocabulary.  The probability of a text is the scaled forward recursion over its classes times its words' shares of their
classes.  A word that training never saw has half a count in its class, as in the unigram base.

Documents are first coded into blocks of bounded size, each with a dictionary of its own; a block is one row of a table in
the shared folder.  Word counts are pre-aggregated per block, summed by word over all blocks and joined back to each block
by (block, word), so no task ever holds the vocabulary.  Baum-Welch passes read all training texts of the table: each task
sums its expected counts over its blocks, Spark adds them up, and the driver only divides tables of fixed size.  No text is
cut, neither in training nor in scoring.  Training goes through the segments (``SEGMENT`` tokens) of all texts side by
side: what a segment does to any message is a small matrix, the matrices of a text give the exact forward and backward
messages at its segments' borders, and from these each segment is passed alone.  The first
``WARM`` passes read a share of the training texts of every block (one in ``SHARE``, by hash, so it grows with the corpus),
the last ``PASSES`` all of them.

Rows: null text counts as empty (the end token alone); a null id is in training and not held out; repeated rows count
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_bucket, hashed_parts, materialise, partition_id, table

STATES, CLASSES, PASSES, WARM, SHARE = 8, 4096, 4, 12, 16
END = CLASSES
BLOCK_BYTES, BATCH, SEGMENT, CHUNK = 12 << 20, 2048, 1024, 2 << 20


class _Ids(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def word_class(word: bytes) -> int:
    return zlib.crc32(word if len(word) <= 4 else word[:3] + b" " + word[-2:]) % CLASSES


_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary()), ("classes", pa.binary()), ("words", pa.list_(pa.binary())), ("n_train", pa.list_(pa.int64()))])
_BLOCK_SQL = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, ids binary, classes binary, words array<binary>, n_train array<long>"


def coded_blocks(docs: DataFrame, fold: int, folds: int) -> DataFrame:
    """The documents as blocks of about ``BLOCK_BYTES`` of text (one document at least)."""

    def run(batches):
        at, made = partition_id(), 0
        ids, doc_ids, held, coded, size = _Ids(), [], [], [], 0

        def block():
            lengths = [len(c) for c in coded]
            flat = np.concatenate(coded) if coded else np.empty(0, np.int32)
            train = np.repeat(~np.array(held, bool), lengths)
            n_train = np.bincount(flat[train], minlength=len(ids))
            classes = np.fromiter(map(word_class, ids), np.uint16, len(ids))
            row = [(at << 24) + made, doc_ids, held, lengths, flat.astype("<i4").tobytes(), classes.tobytes(), list(ids), n_train]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if size and size + len(data) > BLOCK_BYTES:
                    yield block()
                    made += 1
                    ids, doc_ids, held, coded, size = _Ids(), [], [], [], 0
                words = data.lower().split()
                coded.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                doc_ids.append(doc)
                held.append(crc_bucket(doc, folds) == fold)
                size += len(data) + 16
        if doc_ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _BLOCK_SQL)


# ---------------------------------------------------------------- the model


class Model:
    """start, transitions (states x states), emissions (classes x states)."""

    def __init__(self, start, moves, emits):
        self.start, self.moves, self.emits = start, moves, emits

    @staticmethod
    def begin(class_counts: np.ndarray, seed: int = 42) -> Model:
        draw = np.random.default_rng(seed)
        emits = (class_counts + 0.5)[:, None] * np.exp(0.5 * draw.standard_normal((len(class_counts), STATES)))
        moves = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        return Model(np.full(STATES, 1 / STATES), moves, emits / emits.sum(0))

    @staticmethod
    def divide(counts: np.ndarray, class_counts: np.ndarray) -> Model:
        """Expected counts, as :func:`expect` lays them out, to probabilities; each class keeps a little of its overall share."""
        k = STATES
        share = (class_counts + 0.5) / (class_counts + 0.5).sum()
        start, moves, emits = counts[0] + 1e-2, counts[1 : 1 + k] + 1e-2, counts[1 + k :] + share[:, None]
        return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def _by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all sequences, longest first already, as all first ones, all second ones and so on; where each time
    begins."""
    lengths = np.array([len(s) for s in sequences])
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")  # how many are longer than each time
    begin = np.concatenate([[0], np.cumsum(active)])
    out = np.empty(int(begin[-1]), np.uint16)
    for j, s in enumerate(sequences):
        out[begin[: len(s)] + j] = s
    return out, begin


def _batches(parts: list[np.ndarray], own: list[int]) -> Iterator[list[int]]:
    """The parts named by ``own``, longest first, at most CHUNK tokens at a time (one part at least)."""
    batch, size = [], 0
    for i in sorted(own, key=lambda i: -len(parts[i])):
        if batch and size + len(parts[i]) > CHUNK:
            yield batch
            batch, size = [], 0
        batch.append(i)
        size += len(parts[i])
    if batch:
        yield batch


def _transfers(model: Model, parts: list[np.ndarray], first: list[bool], own: list[int]) -> dict[int, np.ndarray]:
    """What each part does to the message before it, up to a factor; a first part gives its own message in every row."""
    out, moves, emits = {}, model.moves.astype(np.float32), model.emits.astype(np.float32)
    for batch in _batches(parts, own):
        seen, begin = _by_time([parts[i] for i in batch])
        a = np.where(np.array([first[i] for i in batch])[:, None, None], model.start.astype(np.float32)[None, None, :], moves[None])
        for t in range(len(begin) - 1):
            n = begin[t + 1] - begin[t]
            after = (a[:n] if t == 0 else (a[:n].reshape(-1, STATES) @ moves).reshape(n, STATES, STATES)) * emits[seen[begin[t] : begin[t + 1]]][:, None, :]
            a[:n] = after / after.sum((1, 2), keepdims=True)
        out |= dict(zip(batch, a.astype(float), strict=True))
    return out


def _borders(model: Model, parts: list[np.ndarray], first: list[bool], last: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The forward message before each part (the start for first ones) and the backward message after it."""
    before, after = np.repeat(model.start[None, :], len(parts), 0), np.ones((len(parts), STATES))
    step = _transfers(model, parts, first, [i for i in range(len(parts)) if not (first[i] and last[i])])
    for i in range(len(parts)):
        if not first[i]:
            message = step[i - 1][0] if first[i - 1] else before[i - 1] @ step[i - 1]
            before[i] = message / message.sum()
    for i in reversed(range(len(parts))):
        if not last[i]:
            message = step[i + 1] @ after[i + 1]
            after[i] = message / (before[i + 1] @ message)
    return before, after


def expect(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Baum-Welch expected counts of the whole class sequences: rows start, moves (states), emissions (classes)."""
    k = STATES
    out, jumps = np.zeros((1 + k + CLASSES + 1, k)), np.zeros((k, k))
    parts = [s[at : at + SEGMENT] for s in sequences for at in range(0, len(s), SEGMENT)]
    first = [at == 0 for s in sequences for at in range(0, len(s), SEGMENT)]
    last = [*first[1:], True]
    before, after = _borders(model, parts, first, last)
    moves, emits = model.moves.astype(np.float32), model.emits.astype(np.float32)
    for own in _batches(parts, range(len(parts))):
        seen, begin = _by_time([parts[i] for i in own])
        starts, came, ends = np.array([first[i] for i in own]), before[own].astype(np.float32), after[own].astype(np.float32)
        a = np.where(starts[:, None], came, came @ moves)
        alpha, scale = np.empty((len(seen), k), np.float32), np.empty(len(seen), np.float32)
        for t in range(len(begin) - 1):
            at, to = begin[t], begin[t + 1]
            a = (a if t == 0 else a[: to - at] @ moves) * emits[seen[at:to]]
            c = a.sum(1)
            a /= c[:, None]
            alpha[at:to], scale[at:to] = a, c
        later = np.empty((0, k), np.float32)
        for t in range(len(begin) - 2, -1, -1):
            at, to = begin[t], begin[t + 1]
            back = ends[: to - at].copy()  # of the parts that end here; the others follow what the time after says
            back[: len(later)] = later @ moves.T
            jumps += alpha[at : at + len(later)].T @ later
            later = back * emits[seen[at:to]] / scale[at:to, None]
            alpha[at:to] *= back
        jumps += came[~starts].T @ later[~starts]
        out[0] += alpha[: begin[1]][starts].sum(0)
        for s in range(k):
            out[1 + k :, s] += np.bincount(seen, weights=alpha[:, s], minlength=CLASSES + 1)
    out[1 : 1 + k] = jumps * model.moves
    return out


def log_likelihood(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each whole sequence's probability, by the scaled forward recursion in double precision."""
    out = np.zeros(len(sequences))
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    for at in range(0, len(order), 8 * BATCH):
        own = np.array(order[at : at + 8 * BATCH])
        lengths = np.array([len(sequences[i]) for i in own])
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.concatenate([sequences[i] for i in own])
        a = np.repeat(model.start[None, :], len(own), 0)
        total = np.zeros(len(own))
        active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
        for t, n in enumerate(active):
            a = (a[:n] if t == 0 else a[:n] @ model.moves) * model.emits[flat[offsets[:n] + t]]
            c = a.sum(1)
            a /= c[:, None]
            total[:n] += np.log(c)
        out[own] = total
    return out


def _sequences(ids: bytes, classes: bytes, lengths: list[int], keep: list[bool] | None = None) -> list[np.ndarray]:
    """Class sequences with their ends of the documents to keep."""
    flat = np.frombuffer(classes, np.uint16)[np.frombuffer(ids, "<i4")] if ids else np.empty(0, np.uint16)
    out, at, end = [], 0, np.array([END], np.uint16)
    for j, n in enumerate(lengths):
        if keep is None or keep[j]:
            out.append(np.concatenate([flat[at : at + n], end]))
        at += n
    return out


def _shared(blocks: DataFrame) -> DataFrame:
    """The class sequences of one training text in ``SHARE``, by hash, of every block: (sequences, lengths)."""

    def run(batches):
        for batch in batches:
            for doc_ids, ids, classes, lengths, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keep = [not h and zlib.crc32(b"warm %d" % (j if d is None else d)) % SHARE == 0 for j, (d, h) in enumerate(zip(doc_ids, held, strict=True))]
                if own := _sequences(ids, classes, lengths, keep):
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(own).tobytes()], pa.binary()), pa.array([[len(s) for s in own]], pa.list_(pa.int32()))], names=["classes", "lengths"])

    return blocks.select("doc_ids", "ids", "classes", "lengths", "held").mapInArrow(run, "classes binary, lengths array<int>")


def _training(batch: pa.RecordBatch):
    """The training sequences of each row of blocks, or of their share."""
    columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
    for j, lengths in enumerate(columns["lengths"]):
        if "ids" in columns:
            yield _sequences(columns["ids"][j], columns["classes"][j], lengths, [not h for h in columns["held"][j]])
        else:
            yield np.split(np.frombuffer(columns["classes"][j], np.uint16), np.cumsum(lengths)[:-1])


def _pass(texts: DataFrame, model: Model) -> np.ndarray:
    """One Baum-Welch pass over all training texts of blocks, or of their share."""
    rows = 1 + STATES + CLASSES + 1

    def run(batches):
        total = np.zeros((rows, STATES))
        for batch in batches:
            for own in _training(batch):
                if own:
                    total += expect(model, own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), STATES).cast(pa.list_(pa.float64()))], names=["row", "counts"])

    got = texts.mapInArrow(run, "row int, counts array<double>")
    out = np.zeros((rows, STATES))
    for r in got.groupBy("row").agg(*(F.sum(F.col("counts")[s]).alias(f"c{s}") for s in range(STATES))).collect():  # classes + states rows
        out[r.row] = r[1:]
    return out


def score(docs: DataFrame, fold: int = 1, folds: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; documents of ``fold`` are held out."""
    spark = docs.sparkSession
    blocks = materialise(coded_blocks(docs, fold, folds))
    train_docs = blocks.agg(F.sum(F.size(F.filter("held", lambda h: ~h))).alias("n")).first().n or 0
    flat = blocks.select("block", F.posexplode(F.arrays_zip("words", "n_train"))).select("block", F.col("pos").alias("id"), F.col("col.words").alias("word"), F.col("col.n_train").alias("n"))
    counts = materialise(flat.groupBy("word").agg(F.sum("n").alias("c")))
    key = F.when(F.octet_length("word") <= 4, F.col("word")).otherwise(F.concat(F.substring("word", 1, 3), F.lit(b" "), F.expr("substring(word, -2, 2)")))
    by_class = counts.groupBy((F.crc32(key) % CLASSES).cast("int").alias("class")).agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).collect()  # CLASSES rows
    class_counts, class_words = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in by_class:
        class_counts[r["class"]], class_words[r["class"]] = r.c, r.v
    class_counts[END] = train_docs
    tokens, words = int(class_counts.sum()), int(class_words.sum()) + (train_docs > 0)

    model = Model.begin(class_counts)
    share = materialise(_shared(blocks))
    for _ in range(0 if share.isEmpty() else WARM):
        model = Model.divide(_pass(share, model), class_counts)
    for _ in range(PASSES if train_docs else 0):
        model = Model.divide(_pass(blocks.select("ids", "classes", "lengths", "held"), model), class_counts)

    base_total, class_total = np.log10(tokens + 0.5 * (words + 1)), np.log10(class_counts + 0.5 * (class_words + 1))
    end_base = np.log10(train_docs + 0.5) - base_total

    def rate(block: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        c = np.zeros(len(known))
        c[known["id"].to_numpy()] = known["c"].to_numpy()
        for r in block.itertuples():
            classes, ids = np.frombuffer(r.classes, np.uint16), np.frombuffer(r.ids, "<i4")
            seen = np.log10(c + 0.5)
            ends = np.cumsum(r.lengths)
            spans = [np.concatenate([[0.0], np.cumsum(x[ids])]) for x in ((c > 0).astype(float), seen - base_total, seen - class_total[classes])]
            n_known, base, inner = (s[ends] - s[ends - r.lengths] for s in spans)
            likely = log_likelihood(model, _sequences(r.ids, r.classes, r.lengths)) / np.log(10)
            out.append(pd.DataFrame({"doc_id": pd.array(list(r.doc_ids), "Int64"), "held_out": list(r.held), "n_tokens": np.asarray(r.lengths, np.int64) + 1, "n_known": n_known.astype(np.int64) + (train_docs > 0), "train_tokens": tokens, "base_score": base + end_base, "score": likely + inner}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    known = flat.select(F.col("block").alias("home"), "id", "word").join(counts, "word").select("home", "id", "c")
    parts = hashed_parts(spark, blocks.count(), 2)  # a task holds a few blocks, whatever the number of shuffle partitions
    own = blocks.select("block", "doc_ids", "held", "lengths", "ids", "classes").repartition(parts, "block")
    return own.groupBy("block").cogroup(known.repartition(parts, "home").groupBy("home")).applyInPandas(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
