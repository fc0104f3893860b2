"""Alignment of two tokenizers over the same bytes: one Arrow function encodes and cuts, what is corpus-wide is DataFrames.

Texts are cut into chunks at the spaces between two visible characters, over which neither library joins; about a megabyte
of texts is one row: the distinct groups of these texts and how often each occurs, the distinct chunks as places of their
groups, and the documents as places of their chunks, with what a document's own tokens say (sizes and digest).

* groups: both sides' byte ends grow over a row's chunks alike, so the places where both end are one intersection of
  two arrays; a document's groups are those of its chunks in order;
* links: a group's bytes are cut by the ends of either side, and every piece lies in exactly one A and one B token; pieces
  and overlapping pairs correspond one to one.  So a text has n_a + n_b - n_groups links, and a group's links are the ids
  over its pieces.  They depend on the group alone and are built once for each distinct group of the corpus;
* counts: occurrences of groups, then of id pairs; then back from pairs to groups and to the distinct groups of each row,
  over whose places ``aggregate`` sums chunks and documents.  Only a row's distinct groups are shuffled, not its tokens or
  chunks.  A join sends the keys that hold a ``FEW``-th of the rows (so at most ``FEW`` of them) by broadcast and shuffles
  the others, so no key of the shuffle holds more than that share.

Rows: texts that are null, empty or not given back by their tokens have zeros and an empty digest; null and repeated ids
stay, one result per row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, materialise, table
from .packing import _byte_letters

FEW = 1 << 16
#: Distinct chunks that a Python worker remembers in either of two generations, and the longest that it does.
CACHE, LONGEST = 120_000, 200
#: Bytes of text to a row of chunks, and chunks that are encoded as one text.
BATCH, JOINED = 1 << 20, 512
#: Bytes of a row group of encoded rows: a reader holds one whole, and by itself the writer first looks after 100 rows.
BLOCK = 1 << 23
#: Groups that are joined by their digest instead of themselves.
LONG = 64
_PLACE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Other white space than spaces and line ends, and chunks that cannot stand beside others.
_OTHER = re.compile("[" + "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n") + "▁]")
_LOOSE = re.compile(r"^[\s▁]|[\s▁]$")
#: Added to the ids of B where both sides' ids stand in one array.
_B = 1 << 24


def chunks_of(text: str) -> list[str]:
    """The runs between those spaces that lie between two visible characters."""
    plain = "  " not in text and " \n" not in text and "\n " not in text and text[0] != " " and text[-1] != " " and not _OTHER.search(text)
    return text.split(" ") if plain else _PLACE.split(text)


def _flat(ids: Iterable[Sequence[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int32)


class Pair:
    """Chunk -> the ids of A, then those of B, as 32-bit words; None where a side does not give its bytes back."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task is the unit of parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.a.encode_special_tokens = True
        byte = {letter: k for k, letter in _byte_letters().items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for t, k in self.a.get_vocab(with_added_tokens=False).items():
            if all(x in byte for x in t):
                self.a_bytes[k] = bytes(byte[x] for x in t)
        model, self.b_bytes = self.b, []
        for k in range(model.get_piece_size()):
            p = model.id_to_piece(k)
            self.b_bytes.append(bytes([int(p[3:-1], 16)]) if model.is_byte(k) else b"" if model.is_control(k) or model.is_unknown(k) else p.replace("▁", " ").encode())
        self.a_sizes, self.b_sizes = (np.array([*map(len, x)], np.int32) for x in (self.a_bytes, self.b_bytes))

    def _alone(self, chunk: str) -> bytes | None:
        a, b, want = self.a.encode(" " + chunk, add_special_tokens=False).ids, self.b.encode(chunk), b" " + chunk.encode()
        left, right = [self.a_bytes[k] for k in a], [self.b_bytes[k] for k in b]
        fine = b"".join(left) == want == b"".join(right) and all(left) and all(right)
        return np.array(a + [k + _B for k in b], np.int32).tobytes() if fine else None

    def learn(self, chunks: Sequence[str]) -> dict[str, bytes | None]:
        """Chunks beside each other are one text to both libraries, as neither joins over the spaces between them."""
        out = {c: self._alone(c) for c in chunks if _LOOSE.search(c)}
        firm = [c for c in chunks if c not in out]
        texts = [" ".join(firm[k : k + JOINED]) for k in range(0, len(firm), JOINED)]
        a = _flat(e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False))
        b = _flat(self.b.encode(texts, num_threads=1))
        want = np.cumsum([len(c.encode()) + 1 for c in firm])
        ends = [np.cumsum(sizes[ids], dtype=np.int64) for ids, sizes in ((a, self.a_sizes), (b, self.b_sizes))]
        last = [np.searchsorted(e, want) for e in ends]
        whole = "".join(" " + t for t in texts).encode()
        fine = all(
            b"".join(map(spelled.__getitem__, ids.tolist())) == whole and sizes[ids].all() and (e[at] == want).all()
            for ids, spelled, sizes, e, at in zip((a, b), (self.a_bytes, self.b_bytes), (self.a_sizes, self.b_sizes), ends, last, strict=True)
        )
        if not fine:  # some chunk is not given back: find out which
            return out | {c: self._alone(c) for c in firm}
        left, right = a.tobytes(), (b + _B).tobytes()
        i = j = 0
        for c, p, q in zip(firm, ((last[0] + 1) * 4).tolist(), ((last[1] + 1) * 4).tolist(), strict=True):
            out[c] = left[i:p] + right[j:q]
            i, j = p, q
        return out

    def ids(self, chunks: list[str]) -> list[bytes | None]:
        """The ids of distinct chunks; those seen lately are remembered."""
        got = [self.young.get(c, 0) for c in chunks]
        if missed := [k for k, v in enumerate(got) if v == 0]:
            found = {chunks[k]: self.old.get(chunks[k], 0) for k in missed}
            found.update(self.learn([c for c, v in found.items() if v == 0]))
            for k in missed:
                got[k] = found[chunks[k]]
            if len(self.young) + len(found) > CACHE:
                self.young, self.old = {}, self.young
            self.young.update((c, v) for c, v in found.items() if len(c) <= LONGEST)
        return got

    def cut(self, known: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of chunks' ids: the tokens of A and of B and the groups of each chunk, the place of each group among the distinct ones, and those."""
        flat = np.frombuffer(b"".join(known), np.int32)
        borders = np.concatenate([[0], np.cumsum([len(v) for v in known], dtype=np.int64) // 4]).astype(np.int64)
        right = flat >= _B
        before = np.concatenate([[0], np.cumsum(right)])[borders]  # tokens of B before each chunk
        a, b = flat[~right], flat[right] - _B
        ae, be = np.cumsum(self.a_sizes[a], dtype=np.int64), np.cumsum(self.b_sizes[b], dtype=np.int64)
        common = np.intersect1d(ae, be, assume_unique=True)  # a chunk's bytes are the same on both sides, so its end is one
        p, q = np.searchsorted(ae, common) + 1, np.searchsorted(be, common) + 1
        p0, q0 = np.concatenate([[0], p[:-1]]), np.concatenate([[0], q[:-1]])
        single = (p - p0 == 1) & (q - q0 == 1)
        at = np.zeros(len(common), np.int64)
        pairs, at[single] = np.unique(a[p0[single]].astype(np.int64) * _B + b[q0[single]], return_inverse=True)
        names = [f"{x}|{y}" for x, y in zip((pairs // _B).tolist(), (pairs % _B).tolist(), strict=True)]
        left, right_, place = a.tobytes(), b.tobytes(), {}
        spans = ((v[~single] * 4).tolist() for v in (p0, p, q0, q))
        at[~single] = np.fromiter((place.setdefault((left[i:j], right_[k:m]), len(place)) for i, j, k, m in zip(*spans, strict=True)), np.int64) + len(names)
        names += ["|".join(",".join(map(str, np.frombuffer(side, np.int32).tolist())) for side in group) for group in place]
        ends = np.searchsorted(p, (borders - before)[1:]) + 1
        return np.diff(borders - before), np.diff(before), np.diff(ends, prepend=0), at, names

    def row(self, ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
        """One row: the documents as places of their chunks, the chunks as places of their groups, and the distinct groups."""
        place: dict[str, int] = {}
        refs = [[place.setdefault(c, len(place)) for c in chunks_of(t)] if t else [] for t in texts]
        known = self.ids(list(place))
        if None in known:  # texts that hold such a chunk have no tokens
            lost = {k for k, v in enumerate(known) if v is None}
            return self.row(ids, [None if lost.intersection(own) else t for own, t in zip(refs, texts, strict=True)])
        n_a, n_b, n, at, names = self.cut(known)
        ends, spelled = np.cumsum(n), list(map(names.__getitem__, at.tolist()))
        spelled = [";".join(spelled[i:j]) for i, j in zip((ends - n).tolist(), ends.tolist(), strict=True)]
        sha = [hashlib.sha256(";".join(map(spelled.__getitem__, own)).encode()).hexdigest() if own else "" for own in refs]
        flat = np.fromiter(chain.from_iterable(refs), np.int32)
        borders = np.concatenate([[0], np.cumsum([len(own) for own in refs])]).astype(np.int32)
        total = lambda sizes: pa.array(np.diff(np.concatenate([[0], np.cumsum(sizes[flat], dtype=np.int64)])[borders]))
        times = np.repeat(np.bincount(flat, minlength=len(known)), n)
        held = np.bincount(at, times, minlength=len(names)).astype(np.int64)
        one = lambda values: pa.ListArray.from_arrays(np.array([0, len(values)], np.int32), values)
        docs = {"doc_id": pa.array(ids, pa.int64()), "n_a": total(n_a), "n_b": total(n_b), "n_groups": total(n), "groups_sha256": pa.array(sha, pa.string()), "refs": pa.ListArray.from_arrays(borders, flat)}
        chunks = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), at.astype(np.int32))
        columns = [pa.StructArray.from_arrays(list(docs.values()), names=list(docs)), chunks, pa.StructArray.from_arrays([pa.array(names, pa.string()), held], names=["g", "n"])]
        return pa.RecordBatch.from_arrays(list(map(one, columns)), names=["docs", "chunks", "groups"])


_pairs: dict[tuple[str, str], Pair] = {}


def pair(a: str, b: str) -> Pair:
    if (a, b) not in _pairs:
        _pairs[a, b] = Pair(a, b)
    return _pairs[a, b]


_ROW = "docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, groups_sha256: string, refs: array<int>>>, chunks array<array<int>>, groups array<struct<g: string, n: long>>"


def encoded(docs: DataFrame, a: str, b: str, batch: int = BATCH) -> DataFrame:
    """docs(doc_id, n_a, n_b, n_groups, groups_sha256, refs), chunks and groups(g, n), about a megabyte of texts a row."""

    def run(batches):
        both = pair(a, b)
        for own in batches:
            ids, size = own.column(0).to_pylist(), own.column(2).to_pylist()
            first = held = 0
            for k, n in enumerate([*size, batch]):
                if held and held + n > batch or k == len(size) > first:
                    yield both.row(ids[first:k], own.column(1).slice(first, k - first).to_pylist())
                    first = k
                    held = 0
                held += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    return rows.mapInArrow(run, _ROW)


def digests(coded: DataFrame) -> DataFrame:
    """The documents' rows, from known(count_sum, n_best) of each distinct group of a row."""
    chunk = "transform(chunks, k -> aggregate(k, 0L, (t, g) -> t + known[g].{0})) as {0}".format  # noqa: UP032
    own = coded.selectExpr("docs", chunk("count_sum"), chunk("n_best"))
    total = lambda c: f"'{c}', aggregate(d.refs, 0L, (t, r) -> t + {c}[r])"
    plain = ", ".join(f"'{c}', d.{c}" for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256"))
    rows = own.select(F.expr(f"inline(transform(docs, d -> named_struct({plain}, {total('count_sum')}, {total('n_best')})))"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), "n_best", "count_sum", "groups_sha256")


#: A group's links over the pieces that the ends of both sides cut it into; with one token on a side they are a sequence.
LINKS = """case when size(l) = 1 or size(r) = 1 then transform(sequence(1, greatest(size(l), size(r))), i -> named_struct('a', l[least(i, size(l)) - 1], 'b', r[least(i, size(r)) - 1]))
 else transform(array_sort(array_union(le, re)), c -> named_struct('a', l[size(filter(le, y -> y < c))], 'b', r[size(filter(re, y -> y < c))])) end"""


def linked(groups: DataFrame, sizes: tuple[Sequence[int], Sequence[int]]) -> DataFrame:
    """groups(g, ...) -> the same with a row (a, b) for each link; sizes are the tokens' bytes by id."""
    half = lambda k: F.split(F.split("g", r"\|")[k], ",").cast("array<int>")
    ends = lambda c, own: F.when((F.size("l") > 1) & (F.size("r") > 1), F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.aggregate(F.slice(c, 1, i), F.lit(0), lambda t, x: t + own[x])))
    left, right = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>") for x in sizes)  # folded to constants
    parts = groups.select("*", half(0).alias("l"), half(1).alias("r"))
    return parts.select("*", ends("l", left).alias("le"), ends("r", right).alias("re")).select(*groups.columns, F.inline(F.expr(LINKS)))


def meet(left: DataFrame, right: DataFrame, on: list[str], few: int = FEW) -> list[DataFrame]:
    """left joined with right(on, rows, ...), in two parts.

    Keys that hold a ``few``-th of left's ``rows`` - at most ``few`` - are broadcast, the others are shuffled."""
    total = right.agg(F.sum("rows").alias("n")).first().n or 0
    hot = F.col("rows") * few >= total
    often, seldom = F.broadcast(right.where(hot).drop("rows")), right.where(~hot).drop("rows")
    return [left.join(often, on), left.join(often.select(*on), on, "left_anti").join(seldom, on)]


def summed(parts: list[DataFrame], *by: str) -> DataFrame:
    """count_sum and n_best of the parts' rows by key."""
    both = [p.groupBy(*by).agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")) for p in parts]
    return both[0].unionByName(both[1]).groupBy(*by).agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))


def align(docs: DataFrame, a: str, b: str, batch: int = BATCH, few: int = FEW) -> DataFrame:
    """The digest of every document's alignment, and its counts in the whole corpus."""
    both = pair(a, b)
    sizes = both.a_sizes.tolist(), both.b_sizes.tolist()
    coded = materialise(encoded(docs, a, b, batch).select(F.monotonically_increasing_id().alias("batch"), "*"), **{"parquet.block.size": BLOCK, "parquet.page.size.row.check.min": 1})
    named = F.when(F.length("g") > LONG, F.sha2("g", 256)).otherwise(F.col("g")).alias("group")  # short keys for joins
    held = coded.select("batch", F.posexplode("groups").alias("i", "k")).select("batch", "i", "k.g", "k.n")
    groups = materialise(held.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).withColumn("group", named))
    links = materialise(linked(groups.select("group", "g", "n"), sizes).drop("g"))
    pairs = materialise(links.groupBy("a", "b").agg(F.sum("n").alias("links"), F.count("*").alias("rows")))
    best = pairs.groupBy("b").agg(F.max("links").alias("most"))
    judged = pairs.join(best, "b").select("a", "b", "rows", F.col("links").alias("count_sum"), (F.col("links") == F.col("most")).cast("long").alias("n_best"))
    known = materialise(groups.select("group", "rows").join(summed(meet(links.drop("n"), judged, ["a", "b"], few), "group"), "group"))
    for done in (groups, links, pairs):
        discard(done)
    back = [p.select("batch", "i", "count_sum", "n_best") for p in meet(held.select("batch", "i", named), known, ["group"], few)]
    dealt = back[0].unionByName(back[1]).repartition("batch")
    per = dealt.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("i", "count_sum", "n_best"))).alias("known"))
    return digests(coded.drop("groups").join(per, "batch", "left"))


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *default_tokenizers())
