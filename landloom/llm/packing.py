"""Best-fit packing of tokenised documents into fixed-length training sequences.

The lengths of all pieces are counted exactly.  On that histogram (at most ``capacity`` entries, whatever the size of the
corpus) the configuration linear program is solved by multiplicative weights: a configuration is a multiset of lengths
that fits one sequence, and the pricing problem - the most valuable configurations under the present weights - is an
unbounded knapsack solved by dynamic programming.  The solution is in whole sequences, rounded to the pieces there are;
what it leaves over is placed by best fit, in the histogram too.  The plan is a small table of runs (length, ranks, first sequence, offset); every piece
finds its place from its rank among the pieces of its length.

Rows: null text counts as empty (one end token); null ``doc_id`` stays null; repeated rows are packed once each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, partition_id, table

CAPACITY, END_ID = 4096, 1
#: Distinct words whose ids a Python worker remembers; beyond it the memory starts anew.
CACHE = 500_000
CHUNK_ROWS = 200_000

# ---------------------------------------------------------------- tokens

_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-\x7e\xa1-įı-ſ]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 stays, the rest follows from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in seen}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return out


def _packed(ids: Iterable[int]) -> bytes:
    words = array("I", ids)
    if sys.byteorder != "little":
        words.byteswap()
    return words.tobytes()


class WordIds(dict):
    """White-space separated piece of text -> its ids as little-endian 32-bit words; learns what it misses.

    The vocabulary never joins text across white space, so a text's ids are its words' ids in order."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.parts = Tokenizer.from_file(path), {}
        self.model, self.letters = self.tokenizer.model, str.maketrans(_byte_letters())

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            got = self.parts[part] = _packed(t.id for t in self.model.tokenize(spelled))
        return got

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        low = word.lower()
        if word.isascii() and word.isprintable():  # letters with a stop or comma are most of what is missed
            if word.isalpha():
                ids = self.part(low)
            elif word[-1] in ",." and word[:-1].isalpha():
                ids = self.part(low[:-1]) + self.part(low[-1])
            else:
                ids = b"".join(map(self.part, _PRETOKEN.findall(low)))
        elif _PLAIN.fullmatch(word) and unicodedata.is_normalized("NFC", word):
            ids = b"".join(map(self.part, _PRETOKEN.findall(low)))
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self.whole(text)  # special tokens, and separators on which Python and the vocabulary differ
        return b"".join(map(self.__getitem__, text.split()))


_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _ids:
        _ids[path] = WordIds(path)
    return _ids[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and the chunk (of bounded rows) that it was made in."""

    def cut(batches):
        ids, end, step, done, at = word_ids(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity, 0, partition_id()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (ids.text(text.as_py()) if text.is_valid else b"") + end
                for k, b in enumerate(range(0, len(data), step)):
                    own = data[b : b + step]
                    out.append((doc, k, b // 4, len(own) // 4, zlib.crc32(own), (at << 24) + done // CHUNK_ROWS))
                    done += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "chunk"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long")


# ---------------------------------------------------------------- plan over the histogram


def _table(values: np.ndarray, units: int) -> np.ndarray:
    """The worth of the most valuable multiset of sizes 1..units that fits each room 0..units: unbounded knapsack."""
    turned = np.zeros(units + 1)  # the best value of each room, the largest room first, so that sums run side by side
    sizes, gains = np.ascontiguousarray(values[1:]), np.empty(units)
    for room in range(1, units + 1):
        turned[units - room] = np.add(sizes[:room], turned[units - room + 1 :], out=gains[:room]).max()
    return turned[::-1].copy()


def _filled(first: int, kinds: np.ndarray, values: np.ndarray, best: np.ndarray, free: np.ndarray, units: int, least: float = 0.0) -> tuple[list[int], float]:
    """A configuration that begins with ``first`` and goes on with what is worth most by the table among what is still free.

    It stops where the table says that ``least`` is out of reach."""
    own, room, worth = [first], units - first, values[first]
    free, prices = free.copy(), values[kinds]
    free[np.searchsorted(kinds, first)] -= 1
    while n := int(np.searchsorted(kinds, room, side="right")):
        at = np.where(free[:n] >= 1, prices[:n] + best[room - kinds[:n]], -1.0)
        k = int(at.argmax())
        if at[k] <= 0 or worth + at[k] < least:
            break
        own.append(int(kinds[k]))
        worth += prices[k]
        room -= int(kinds[k])
        free[k] -= 1
    return own, worth


def configurations(counts: np.ndarray, rate: float = 4.0, near: float = 0.004, widest: float = 0.6, part: float = 0.25) -> tuple[list[tuple[list[int], int]], float]:
    """Multiplicative weights on the covering program: min sum x_P with sum_P a_Pu x_P >= counts_u; (configurations, bound).

    ``counts[u]`` is how many pieces have length u, up to the capacity.  A length's weight falls by the share of it that is
    covered.  A round's table of the dynamic program prices every room, so it yields many configurations: one that begins
    with each length, taken if it is within ``near`` of the most valuable and as full as that one.  A round covers at most
    ``part`` of a length (or one piece), in whole sequences, so that rounding loses nothing.  A round that finds none (the most
    valuable wants more pieces of a length than there are) doubles ``near``.  The rounds end when all is covered or ``near``
    passes ``widest``: never by their number, which depends on the lengths and not on their counts.
    The bound is the best dual value of the rounds: no packing takes fewer sequences."""
    units, wanted = len(counts) - 1, counts.astype(np.int64)
    covered, chosen, bound = np.zeros_like(wanted), defaultdict(int), 0.0
    sizes = np.arange(units + 1) / units
    while (left := wanted - covered).any():
        share = np.divide(covered, wanted, out=np.ones(units + 1), where=wanted > 0)
        # a size's space prices it; the exponential of its uncovered share moves the price
        values = np.where(left > 0, sizes * np.exp(-rate * (share - 1)), 0.0)
        best = _table(values, units)
        bound = max(bound, float((values * wanted).sum() / best[units]))
        kinds = np.flatnonzero(left)
        free = np.minimum(left, np.maximum(1, (part * wanted).astype(np.int64)))[kinds]
        worth = values[kinds] + best[units - kinds]
        added, least = False, (1 - near) * best[units]
        full = sum(_filled(int(kinds[worth.argmax()]), kinds, values, best, np.full(len(kinds), units), units)[0])
        for k in np.argsort(-worth, kind="stable").tolist():
            while free[k] >= 1 and worth[k] >= least:
                own, value = _filled(int(kinds[k]), kinds, values, best, free, units, least)
                if value < least or sum(own) < full:
                    break
                sorts, times = np.unique(own, return_counts=True)
                at = np.searchsorted(kinds, sorts)
                step = int((free[at] // times).min())
                chosen[tuple(sorted(own, reverse=True))] += step
                covered[sorts] += step * times
                free[at] -= step * times
                added = True
        if not added and (near := 2 * near) > widest:
            break
    return [(list(p), x) for p, x in chosen.items()], bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, sequences, copies per sequence, first sequence, offset) that place every piece.

    Rank r of a run's length goes to sequence first + (r - rank) // copies at offset + (r - rank) % copies * length."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    queue = {n: [0, c] for n, c in histogram.items() if c}  # length -> next rank, how many are left
    sequences = 0
    if histogram.get(capacity):
        runs.append((capacity, 0, queue[capacity][1], 1, 0, 0))
        sequences = queue.pop(capacity)[1]
    counts = np.zeros(capacity + 1, int)
    for n, (_, there) in queue.items():
        counts[n] = there
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, how many)
    for pattern, x in sorted(configurations(counts)[0], key=lambda p: -p[1]):
        kinds, times = np.unique(pattern, return_counts=True)
        if (m := int(min(x, *(queue.get(n, (0, 0))[1] // a for n, a in zip(kinds.tolist(), times.tolist(), strict=True))))) <= 0:
            continue
        used = 0
        for n in pattern:
            rank, there = queue[n]
            runs.append((n, rank, m, 1, sequences, used))
            queue[n] = [rank + m, there - m]
            used += n
            if there == m:
                del queue[n]
        if used < capacity:
            gaps[capacity - used].append((sequences, m))
        sequences += m
    rooms = sorted(gaps)
    for n in sorted(queue, reverse=True):  # best fit, longest first
        rank, there = queue[n]
        while there:
            k = bisect_left(rooms, n)
            if k == len(rooms):
                per = capacity // n
                many = max(1, there // per)
                groups, room, sequences = [(sequences, many)], capacity, sequences + many
            else:
                room = rooms[k]
                groups = gaps.pop(room)
                rooms.pop(k)
            for at, (first, many) in enumerate(groups):
                copies = min(room // n, there)
                fill = min(many, there // copies) if copies else 0
                if fill:
                    runs.append((n, rank, fill, copies, first, capacity - room))
                    rank, there = rank + fill * copies, there - fill * copies
                    if rest := room - copies * n:
                        if rest not in gaps:
                            insort(rooms, rest)
                        gaps[rest].append((first, fill))
                if fill < many:
                    if room not in gaps:
                        insort(rooms, room)
                    gaps[room].append((first + fill, many - fill))
                    gaps[room].extend(groups[at + 1 :])
                    break
    return runs


def audit(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, float]:
    """Sequences of the plan, the fewest that any packing could take (dual bound), pieces and those that configurations place."""
    whole = histogram.get(capacity, 0)
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c if n < capacity else 0
    chosen, bound = configurations(counts)
    sequences = max((first + many for _, _, many, _, first, _ in plan(histogram, capacity)), default=0)
    return {"sequences": sequences, "bound": whole + bound, "pieces": sum(histogram.values()), "placed": whole + sum(len(p) * x for p, x in chosen)}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Place all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialise(pieces(docs, tokenizer, capacity, end_id))
    counts = cut.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = sorted(plan(histogram, capacity))
    key = np.array([(n << 44) + rank for n, rank, *_ in runs], np.int64)
    rank0, copies, first, offset = (np.array([r[i] for r in runs], np.int64) for i in (1, 3, 4, 5))
    ranked = cut.join(starts, ["length", "chunk"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("earlier") + F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1).alias("rank"),
    )

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            k = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            nth = rank - rank0[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(first[k] + nth // copies[k]), pa.array(offset[k] + nth % copies[k] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
