"""Toxicity of whole texts after noisy-channel deobfuscation.

A disguised word is a sequence of symbols that stand for letters (leetspeak), for nothing (separators, spacing) or for one
letter several times (repetition).  The symbols' readings form a lattice; Viterbi search under a character trigram model,
counted over the whole corpus, keeps the ``BEST`` paths into every state (its last two letters) and so finds the likeliest
words exactly.  A logistic model over words and word beginnings then scores the restored text.  Words of plain letters
without a repeated one are their own only reading and skip the search, as do figures and addresses.  Letters that stand
apart are read as one word, and two neighbouring words as one where that is a word of the model and likelier under the
trigrams than the two.

Labels are learned from at most ``LABELLED`` rows (those with the smallest hashes) of the training folds.  Features are all
words and beginnings that at least ``LEAST`` different toxic texts hold and that are commoner there than in others; a
ridge-penalised logistic regression weighs them.  Language, source and id are no inputs of a score.

Rows: null text counts as empty and gets the model's base rate; null ids stay and are not held out; repeated rows get equal
scores; labels with null ids or values teach nothing, and of several for one id the largest counts; with no labels at all
every score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from heapq import nlargest
from itertools import pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_bucket_col, materialise, table

LABELLED, LEAST, BEGINNING = 20_000, 3, 4
MEMORY = 400_000

# ---------------------------------------------------------------- characters

#: Codes of characters: 0 no letter, 1 to 26 a to z, then Latin-1 letters, 63 any other letter.
OTHER, CODES = 63, 64


def _codes() -> np.ndarray:
    out = np.zeros(0x251, np.uint8)
    out[0x250] = OTHER
    for c in range(0x250):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else low - 0xDF + 27 if 0xDF <= low <= 0xFF else OTHER
    return out


_CODE = _codes()
#: The same by letter, for searches that look at one letter at a time.
_LETTER = {chr(k): int(c) or OTHER for k, c in enumerate(_CODE[:0x250])}


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return _CODE[np.minimum(points, 0x250)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each three codes follow each other, over all texts."""

    def run(batches):
        total = np.zeros(CODES**3, np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            size, own = 0, []
            for k, t in enumerate(texts):
                own.append(t)
                size += len(t)
                if size > 1 << 22 or k + 1 == len(texts):
                    c = encode("  ".join(["", *own, ""])).astype(np.int32)
                    total += np.bincount((c[:-2] << 12) + (c[1:-1] << 6) + c[2:], minlength=CODES**3)
                    size, own = 0, []
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(CODES**3)
    for r in docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # CODES ** 3 rows
        out[r.gram] = r.n
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with P(c | b) and a little of everything."""
    three = counts.reshape(CODES, CODES, CODES)
    two = three.sum(0)
    low = (two + 0.5) / (two + 0.5).sum(1, keepdims=True)
    return np.log((three + 2 * low[None]) / (three.sum(2, keepdims=True) + 2)).astype(np.float32)


# ---------------------------------------------------------------- channel

#: Letters that a symbol stands for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou",
}
#: Costs in nats of a reading: symbol as letter, symbol as nothing, run of a letter as fewer of them.
AS_LETTER, AS_NOTHING, SEPARATOR, SHORTENED = 0.7, 9.0, 0.7, 1.0
#: Readings that are features of a token: so many, and none so many nats behind the best.
BEST, BEHIND = 6, 9.0
_TWICE = re.compile(r"(.)\1", re.S)


_BRANCHING = re.compile(r"([^\W\d_])\1+|([\W\d_])\2*", re.S)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """The readings, with their costs, of each part: runs of a letter or of a symbol, and single letters between them."""
    out, at, low = [], 0, token.lower()
    for m in _BRANCHING.finditer(low):
        if m.start() > at:
            out.append([(low[at : m.start()], 0.0)])
        at, c, n = m.end(), m.group()[0], m.end() - m.start()
        if m.group(1):
            readings = [(c, SHORTENED), (c * 2, 0.0 if n == 2 else SHORTENED)] + ([(c * n, 0.0)] if n > 2 else [])
        else:
            readings = [("", (AS_NOTHING if c.isalnum() or c in "@$" else SEPARATOR))]
            for x in LEET.get(c, ""):
                cost = AS_LETTER + (2.0 if c == "*" else 0.0)
                readings += [(x * k, cost * k if k == n else cost + SHORTENED) for k in sorted({n, 1})] if n < 4 else [(x, cost + SHORTENED)]
        out.append(readings)
    return out if at == len(low) else [*out, [(low[at:], 0.0)]]


def _spelled(letters: str, a: int, b: int, model: Sequence[float]) -> tuple[float, int, int]:
    """The log probability of the letters after the state (a, b), and the state they lead to."""
    total = 0.0
    for ch in letters:
        z = _LETTER.get(ch, OTHER)
        total += model[(a << 12) + (b << 6) + z]
        a, b = b, z
    return total, a, b


def spelling(word: str, model: Sequence[float]) -> float:
    """The log probability of a whole word."""
    total, a, b = _spelled(word, 0, 0, model)
    return total + model[(a << 12) + (b << 6)]


def restore(token: str, model: Sequence[float], best: int = BEST) -> list[str]:
    """The likeliest words that a disguised token stands for, best first; the model as one list, by three codes."""
    states: dict = {(0, 0): [(0.0, None)]}  # state -> its best paths: score, (path before, letters)
    for readings in lattice(token):
        after: dict = {}
        for (a, b), paths in states.items():
            for letters, cost in readings:
                add, x, y = _spelled(letters, a, b, model)
                add -= cost
                after.setdefault((x, y), []).extend([(s + add, (path, letters) if letters else path) for s, path in paths])
        states = {k: v if len(v) <= best else nlargest(best, v, key=itemgetter(0)) for k, v in after.items()}
    ended = nlargest(best, ((s + model[(a << 12) + (b << 6)], path) for (a, b), paths in states.items() for s, path in paths), key=itemgetter(0))
    out = []
    for s, path in ended:
        letters = []
        while path:
            path, own = path
            letters.append(own)
        if letters and s > ended[0][0] - BEHIND:
            out.append("".join(reversed(letters)))
    return out


_TAIL, _HEAD = "#%&?.,;:'\"`)]}>…»”’-_~^=", "#%&?.,;:'\"`([{<«“‘-_~^="
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_SYMBOLS = frozenset("@$!|+*€£¥")


class Readings(dict):
    """Token -> the features of what it is read as; learns what it misses, and forgets all when it holds too many."""

    def __init__(self, model: np.ndarray, known: dict[str, int] | None):
        super().__init__()
        self.model, self.known = model.ravel().tolist(), known
        self.long = {f: k for f, k in (known or {}).items() if len(f) > BEGINNING and not f.endswith("+")}
        self.starts = {f[:k] for f in self.long for k in range(1, len(f))}

    def features(self, word: str) -> tuple:
        own = (word, word[:BEGINNING] + "+") if len(word) > BEGINNING else (word,)
        return own if self.known is None else tuple(self.known[f] for f in own if f in self.known)

    def words(self, token: str) -> list[str]:
        core = token.lower().rstrip(_TAIL).lstrip(_HEAD)
        if core.isalpha():
            return [core] if not _TWICE.search(core) else restore(core, self.model)
        if not any(c.isalpha() or c in _SYMBOLS for c in core) or ("@" in core[1:] and "." in core[core.rindex("@") :]) or "://" in core:
            return []  # figures, addresses
        return restore(core, self.model)

    def __missing__(self, token: str) -> tuple:
        if len(self) >= MEMORY:
            self.clear()
        own = self[token] = tuple({f for w in self.words(token) for f in self.features(w)})
        return own

    def spaced(self, text: str) -> set:
        """Features of words whose letters stand apart."""
        out: set = set()
        for m in _SPACED.finditer(text):
            letters = re.sub(r"\s", "", m.group())
            for w in self.words(letters):
                out |= set(self.features(w))
                if self.known is not None:
                    out |= {k for f, k in self.long.items() if f in w}
        return out

    def split(self, words: list[str]) -> set:
        """Features of known words that stand in two parts, where one word is likelier than two."""
        out: set = set()
        for a, b in pairwise(words):
            if a in self.starts and (w := a + b) in self.long and spelling(w, self.model) - SEPARATOR > spelling(a, self.model) + spelling(b, self.model):
                out |= set(self.features(w))
        return out

    def text(self, text: str) -> set:
        if not text:
            return set()
        words = text.lower().split()
        return set().union(*map(self.__getitem__, set(words)), self.spaced(text), self.split(words) if self.long else ())


# ---------------------------------------------------------------- labels


class Sparse:
    """Rows of positions that hold a one, and a last column of ones."""

    def __init__(self, rows: list[list[int]], width: int):
        self.width, self.sizes = width, np.array([len(r) for r in rows])
        self.at, self.row = np.array([k for r in rows for k in r], np.int64), np.repeat(np.arange(len(rows)), self.sizes)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=len(self.sizes)) + w[-1]

    def across(self, v: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.at, weights=v[self.row], minlength=self.width), v.sum())


def _logistic(x: Sparse, y: np.ndarray, times: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method, its steps by conjugate gradients, on the ridge-penalised likelihood; the last weight is the
    constant's, unpenalised."""
    w, penalty = np.zeros(x.width + 1), np.append(np.full(x.width, ridge), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        bend = times * p * (1 - p) + 1e-9
        step, left = np.zeros_like(w), x.across(times * (y - p)) - penalty * w
        scale = 1 / (x.across(bend) + penalty)  # the diagonal
        toward, size = scale * left, left @ (scale * left)
        least = 1e-16 * size
        for _ in range(400):
            if size <= least or size == 0:
                break
            bent = x.across(bend * x.times(toward)) + penalty * toward
            far = size / (toward @ bent)
            step, left = step + far * toward, left - far * bent
            size, before = left @ (scale * left), size
            toward = scale * left + size / before * toward
        w += step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, labelled: int = LABELLED) -> tuple[dict[str, int], np.ndarray] | None:
    """Feature -> position, and weights with the constant last; None where there is nothing to learn from."""
    taught = labels.where("doc_id is not null and toxic is not null").where(crc_bucket_col(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = F.broadcast(taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))  # the documented bound

    def read(batches):
        readings = Readings(model, None)
        for batch in batches:
            own = [sorted(readings.text(t.as_py() or "")) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.string()))], names=["text_key", "toxic", "features"])

    own = docs.select("doc_id", "text").join(sample, "doc_id").select(F.xxhash64("text").alias("text_key"), F.col("toxic").cast("int"), "text")
    read_docs = materialise(own.mapInArrow(read, "text_key long, toxic int, features array<string>"))
    single = materialise(read_docs.groupBy("text_key").agg(F.max("toxic").alias("toxic"), F.first("features").alias("features")))
    sizes = {r.toxic: r["count"] for r in single.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return None
    by = single.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    lift = F.log((F.col("t") + 0.5) / (n_toxic + 1) / ((F.col("c") + 0.5) / (n_clean + 1)))
    named = by.where((F.col("t") >= LEAST) & (F.col("t") > F.col("c"))).withColumn("lift", lift).where("lift > 1").select("f")
    names = sorted(r.f for r in named.collect())  # of LABELLED texts at most
    if not names:
        return {}, np.array([math.log((n_toxic + 0.5) / (n_clean + 0.5))])
    kept = single.select("toxic", F.explode_outer("features").alias("f"), "text_key").join(F.broadcast(named.withColumn("own", F.col("f"))), "f", "left")
    kept = kept.groupBy("text_key", "toxic").agg(F.array_sort(F.collect_list("own")).alias("features"))
    rows = [(r.toxic, tuple(r.features)) for r in kept.collect()]  # LABELLED rows at most, selected features only
    known, same = {f: k for k, f in enumerate(names)}, sorted(Counter(rows).items())
    x = Sparse([[known[f] for f in own] for (_, own), _ in same], len(names))
    return known, _logistic(x, np.array([t for (t, _), _ in same], float), np.array([n for _, n in same], float))


def score(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = _scored(docs.select(F.col("doc_id").cast("long"), "text"), docs, labels, labelled)
    return out.select("doc_id", F.coalesce(crc_bucket_col(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def _learn(docs: DataFrame, labels: DataFrame, labelled: int):
    model = log_model(trigram_counts(docs))
    return model, fit(docs, labels, model, labelled)


def _scored(rows: DataFrame, docs: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """rows (the last column is the text) with the text replaced by its score."""
    model, learned = _learn(docs, labels, labelled)
    known, weights = learned or ({}, np.array([-np.inf]))
    names, last = rows.columns[:-1], len(rows.columns) - 1

    def run(batches):
        readings = Readings(model, known)
        for batch in batches:
            sums = np.array([weights[list(readings.text(t.as_py() or ""))].sum() + weights[-1] for t in batch.column(last)])
            with np.errstate(over="ignore"):
                scores = 1 / (1 + np.exp(-sums))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled: int = LABELLED) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    model, learned = _learn(docs, labels, labelled)
    known, weights = learned or ({}, np.array([-np.inf]))
    k = docs.columns.index("text")
    limit = math.log(threshold / (1 - threshold))

    def run(batches):
        readings = Readings(model, known)
        for batch in batches:
            fine = [weights[list(readings.text(t.as_py() or ""))].sum() + weights[-1] < limit for t in batch.column(k)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
