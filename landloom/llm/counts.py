"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

Texts are encoded in batches of about ``BATCH`` bytes whatever their number, so memory and the time of a call hardly vary.
A text of more than ``LONG`` bytes is split where its tokenizer never joins (a space between two visible characters, for
vocabularies that are found to treat it so), and its parts are dealt over all tasks; a part ends at the first such place
after ``PART`` characters, so text without one stays whole.  Everything is read once: counts of short texts and parts of long ones
are written together, then the parts are counted and summed by row.

Rows: null text counts as empty (no bytes, no tokens); null and repeated ids stay, one result per row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hashed_parts, materialise, table

BATCH, LONG, PART, LIMIT = 1 << 20, 1 << 20, 1 << 16, 4096
#: Parts to a task.
TASK_PARTS = 256
#: The space goes with what follows it; pieces never hold it after a visible character.
_PLACE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class Counter:
    """How many tokens a library makes of texts: tokenizers for ``.json``, sentencepiece for ``.model``, none added."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = (self.model.id_to_piece(k) for k in range(self.model.get_piece_size()))
            # a part without its space gets it back as the prefix that every text gets
            kept = self.model.encode("a") != self.model.encode(" a") and self.model.decode(self.model.encode("a  b")) == "a  b"
            self.divisible, self.drop = kept and all("▁" not in p.lstrip("▁") for p in pieces), 1
            self.lengths = lambda texts: [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task is the unit of parallelism
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            before = self.model.pre_tokenizer
            words = [w for w, _ in before.pre_tokenize_str("ab, cd 12 ef")] if before else ["b c"]
            self.divisible, self.drop = not any(re.search(r"[^ Ġ][ Ġ]", w) for w in words), 0
            self.lengths = lambda texts: [len(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, text: str, size: int) -> Iterator[str]:
        """The text in parts of at least ``size`` characters whose counts add up to its own."""
        at = 0
        while self.divisible and (place := _PLACE.search(text, at + size)):
            yield text[at : place.start()]
            at = place.start() + self.drop
        yield text[at:]

    def batched(self, texts: list[str], sizes: list[int], most: int) -> list[int]:
        """The count of each text, encoded in batches of about ``most`` bytes."""
        out: list[int] = []
        first = held = 0
        for k, n in enumerate(sizes):
            if held and held + n > most:
                out += self.lengths(texts[first:k])
                first, held = k, 0
            held += n
        return out + (self.lengths(texts[first:]) if first < len(texts) else [])


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


_COLUMNS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "row": pa.string(), "part": pa.string()}
_SCHEMA = "doc_id long, n_bytes long, n_tokens long, row string, part string"


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COLUMNS.values(), strict=True)], names=list(_COLUMNS))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, long: int = LONG, part: int = PART, batch: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def first(batches):
        """Counts of the short texts, parts of the long ones under a name of the row's own."""
        count = counter(tokenizer)
        for own in batches:
            ids, sizes = own.column(0).to_pylist(), own.column(2).to_pylist()
            short = [k for k, n in enumerate(sizes) if n <= long]
            texts = [own.column(1)[k].as_py() for k in short]
            n = count.batched(texts, [sizes[k] for k in short], batch)
            yield _batch([[ids[k] for k in short], [sizes[k] for k in short], n, [None] * len(n), [None] * len(n)])
            for k in (k for k, n in enumerate(sizes) if n > long):
                cut = list(count.parts(own.column(1)[k].as_py(), part))
                yield _batch([[ids[k]] * len(cut), [sizes[k]] * len(cut), [None] * len(cut), [uuid.uuid4().hex] * len(cut), cut])

    def rest(batches):
        count = counter(tokenizer)
        for own in batches:
            texts = own.column(4).to_pylist()
            n = count.batched(texts, [len(t) for t in texts], batch)
            yield pa.RecordBatch.from_arrays([*own.columns[:2], pa.array(n, pa.int64()), own.column(3)], names=list(_COLUMNS)[:4])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    seen = materialise(rows.mapInArrow(first, _SCHEMA))
    whole = seen.where("row is null").select("doc_id", "n_bytes", "n_tokens")
    apart = seen.where("row is not null")
    tasks = hashed_parts(docs.sparkSession, apart.count(), TASK_PARTS)
    dealt = apart.repartition(tasks).mapInArrow(rest, _SCHEMA.rsplit(",", 1)[0])
    joined = dealt.groupBy("row", "doc_id", "n_bytes").agg(F.sum("n_tokens").alias("n_tokens"))
    out = whole.unionByName(joined.select("doc_id", "n_bytes", "n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_tokenizer())
