"""Secret scans with a recursive decoding worklist.

A text is the first layer.  Each layer is scanned with the patterns below, then its URL-escaped, Unicode-escaped, base64
and compressed parts are decoded into layers of their own, which join the worklist until none is new: a layer whose
content was already seen at the same place is not decoded again, so the work ends also on texts that decode to
themselves.  Each layer carries the place of its characters in the original text, and findings are reported there: exactly
for escapes, by groups of four characters for base64, by the whole part for compressed data.  Escapes are decoded where
they stand in the whole layer; bytes that are not UTF-8 stay as they are.  Base64 may continue over line breaks and begin
anywhere in a run of its letters (after a path, say): all four alignments are decoded, and whatever is readable or
compressed in them, at any byte, is a layer.  Decoded bytes that hold the head of compressed data are a layer of bytes too
(one character each), so compression inside compression is unwrapped by the same worklist, as are compressed bytes that
are percent-escaped or written as ``\\x`` escapes.

The worklist is a stack of generators: layers are made one at a time, the innermost first, so that memory is bounded by the
depth of nesting and not by the number of layers.  Compressed data is read in windows of ``WINDOW`` characters; a window
takes the end of the one before it along, a whole run of base64 letters where it ends in one that is shorter than a window.

Rows: null text counts as empty; null ids stay; repeated rows get equal results; an empty table gives an empty result;
other columns are ignored.  Data that does not decode is left alone.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)+")
_STANDARD = str.maketrans("-_", "+/")
#: Readable stretches of decoded bytes: UTF-8 without control characters, and UTF-16 of plain characters.
_UTF8 = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){8,}")
_UTF16 = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){8,}")
#: How gzip, bzip2 and zlib data begins.
_SQUEEZED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\x78[\x01\x5e\x9c\xda]")
_SQUEEZED_CHARS = re.compile("\x1f\x8b\x08|BZh[1-9]|\x78[\x01\x5e\x9c\xda]")
_BYTES = re.compile("[\x00-\xff]+")
#: Percent-escaped bytes with the letters beside them that need no escape.
_URL_RUN = re.compile(r"[A-Za-z0-9_.~/-]*%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/-])*")
_URL_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|.")
_TAIL = re.compile(rb"[A-Za-z0-9+/_-]+\Z")
OVERLAP = 4096
#: A compressed part may grow to so many bytes in one layer; what is longer is read in windows of this size.
WINDOW = 1 << 22


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, leftmost and non-overlapping per kind, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """Decoded text and where each of its characters starts and ends in the original text."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts, ends):
        self.text, self.starts, self.ends = text, starts, ends

    def place(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (self.starts[a], max(self.ends[a:b]))


def _chars(data: bytes, first, last) -> Layer | None:
    """Bytes with their places to text with its places; None unless they are UTF-8."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    if text.isascii():
        return Layer(text, first, last)
    starts, ends, at = array("q"), array("q"), 0
    for c in text:
        n = len(c.encode())
        starts.append(first[at])
        ends.append(last[at + n - 1])
        at += n
    return Layer(text, starts, ends)


def _url_parts(layer: Layer) -> Iterator[tuple[int, int, str]]:
    """(from, to, character) of the escapes that make UTF-8 characters; other bytes stay as they are."""
    for m in _URL.finditer(layer.text):
        data, at = bytes.fromhex(m.group().replace("%", "")), 0
        while at < len(data):
            try:
                fine, bad = data[at:].decode(), len(data)
            except UnicodeDecodeError as e:
                fine, bad = data[at : at + e.start].decode(), at + e.end
            for c in fine:
                n = len(c.encode())
                yield m.start() + 3 * at, m.start() + 3 * (at + n), c
                at += n
            at = bad


def _unicode_parts(layer: Layer) -> Iterator[tuple[int, int, str]]:
    for m in _UNICODE.finditer(layer.text):
        n = m.group().strip("\\uUx{}&#;X")
        code = int(n, 10 if m.group().startswith("&#") and m.group()[2] not in "xX" else 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            yield m.start(), m.end(), chr(code)


def _replaced(layer: Layer, parts: Iterator[tuple[int, int, str]]) -> Iterator[Layer]:
    """The whole layer with these parts decoded where they stand, as what is beside them matters to the patterns."""
    out, starts, ends, at = [], array("q"), array("q"), 0
    one_place = isinstance(layer.starts, _Same)

    def plain(a: int, b: int) -> None:
        out.append(layer.text[a:b])
        if not one_place:
            starts.extend(range(a, b) if layer.starts is None else layer.starts[a:b])
            ends.extend(range(a + 1, b + 1) if layer.ends is None else layer.ends[a:b])

    for a, b, c in parts:
        plain(at, a)
        out.append(c)
        if not one_place:
            first, last = layer.place(a, b)
            starts.append(first)
            ends.append(last)
        at = b
    if at:
        plain(at, len(layer.text))
        text = "".join(out)
        yield Layer(text, _Same(layer.starts.value, len(text)), _Same(layer.ends.value, len(text))) if one_place else Layer(text, starts, ends)


def _escapes(layer: Layer) -> Iterator[Layer]:
    if "%" in layer.text:
        yield from _replaced(layer, _url_parts(layer))
    if "\\" in layer.text or "&#" in layer.text:
        yield from _replaced(layer, _unicode_parts(layer))


class _Inflated:
    """The content of compressed data in overlapping windows; ``used`` is how many bytes of the data it took so far."""

    def __init__(self, data: bytes):
        self.data, self.used = data, 0

    def __iter__(self) -> Iterator[bytes]:
        head, data = bytes(self.data[:3]), self.data
        machine = zlib.decompressobj(31) if head[:2] == b"\x1f\x8b" else bz2.BZ2Decompressor() if head == b"BZh" else zlib.decompressobj(15 if head[:1] == b"\x78" else -15)
        kept, at, ended = b"", 0, False
        while not machine.eof:
            feed = getattr(machine, "unconsumed_tail", b"")
            if not feed and getattr(machine, "needs_input", True):
                feed, at = data[at : at + (1 << 16)], at + (1 << 16)
                ended = not feed
            try:
                got = machine.decompress(feed, WINDOW)
            except (zlib.error, OSError, EOFError, ValueError):
                return
            self.used = min(at, len(data)) - len(machine.unused_data)
            if not got and ended:
                return
            if got:
                yield kept + got
                run = _TAIL.search(got, max(0, len(got) - WINDOW // 2))
                kept = got[min(len(got) - OVERLAP, run.start()) if run and run.start() > 0 else -OVERLAP :]


def _payloads(layer: Layer, body: str, at) -> Iterator[Layer]:
    """What base64 letters, which stand at ``at`` in the layer, hold in each of their four alignments."""
    for shift in range(4):
        whole = (len(body) - shift) // 4 * 4
        rest = (len(body) - shift) % 4
        if whole < 8:
            continue
        data = binascii.a2b_base64(body[shift:] + "=" * (4 - rest) if rest > 1 else body[shift : shift + whole])

        def place(a: int, b: int, shift=shift) -> tuple[int, int]:
            """Of bytes a to b, by the groups of four letters that hold them."""
            first, last = shift + 4 * (a // 3), min(shift + 4 * ((b - 1) // 3) + 4, len(body))
            return layer.place(at[first], at[last - 1] + 1)

        done = 0
        for m in _SQUEEZED.finditer(data):
            if m.start() < done:
                continue
            content = _Inflated(memoryview(data)[m.start() :])
            for part in content:
                yield from _anywhere(part, *place(m.start(), max(m.start() + 1, m.start() + content.used)))
                done = m.start() + content.used
        if not done and shift == 0 and not _UTF8.fullmatch(data):
            content = _Inflated(memoryview(data))  # deflated without a head
            for part in content:
                if not _UTF8.match(part):
                    break
                yield from _anywhere(part, *place(0, max(1, content.used)))
        for m in _UTF8.finditer(data):
            spots = [place(k, k + 1) for k in range(*m.span())]
            if found := _chars(m.group(), array("q", (a for a, _ in spots)), array("q", (b for _, b in spots))):
                yield found
        for m in _UTF16.finditer(data):
            spots = [place(k, k + 2) for k in range(m.start(), m.end(), 2)]
            yield Layer(m.group()[::2].decode(), array("q", (a for a, _ in spots)), array("q", (b for _, b in spots)))


def _anywhere(part: bytes, a: int, b: int) -> Iterator[Layer]:
    """Inflated bytes, all of whose characters stand at a to b: as text, as UTF-16, and as bytes where compressed data may begin."""

    def layer(text: str) -> Layer:
        return Layer(text, _Same(a, len(text)), _Same(b, len(text)))

    yield layer(part.decode("utf-8", "replace"))
    for m in _UTF16.finditer(part):
        yield layer(m.group()[::2].decode())
    if _SQUEEZED.search(part):
        yield layer(part.decode("latin-1"))


def _inflated(layer: Layer) -> Iterator[Layer]:
    """What compressed bytes hold that stand in the layer one character a byte."""
    done = 0
    for m in _SQUEEZED_CHARS.finditer(layer.text):
        if m.start() < done:
            continue
        data = _BYTES.match(layer.text, m.start()).group().encode("latin-1")
        content = _Inflated(memoryview(data))
        for part in content:
            done = m.start() + max(1, content.used)
            yield from _anywhere(part, *layer.place(m.start(), done))


def _escaped_bytes(layer: Layer) -> Iterator[Layer]:
    """What percent-escaped compressed bytes hold."""
    if "%" not in layer.text:
        return
    for run in _URL_RUN.finditer(layer.text):
        spots = [m.span() for m in _URL_BYTE.finditer(layer.text, *run.span())]
        data, done = bytes(int(layer.text[a + 1 : b], 16) if b - a == 3 else ord(layer.text[a]) for a, b in spots), 0
        for m in _SQUEEZED.finditer(data):
            if m.start() < done:
                continue
            content = _Inflated(memoryview(data)[m.start() :])
            for part in content:
                done = m.start() + max(1, content.used)
                yield from _anywhere(part, *layer.place(spots[m.start()][0], spots[done - 1][1]))


def _decoded(layer: Layer) -> Iterator[Layer]:
    return chain(_escapes(layer), _encoded(layer), _wrapped(layer), _inflated(layer), _escaped_bytes(layer))


def _encoded(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        yield from _payloads(layer, m.group().translate(_STANDARD), range(m.start(), m.end()))


def _wrapped(layer: Layer) -> Iterator[Layer]:
    """Base64 that continues over line breaks; the words beside it look like lines of it."""
    if "\n" not in layer.text:
        return
    for m in _WRAPPED.finditer(layer.text):
        lines = [(x.start(), x.end()) for x in _LINE.finditer(layer.text, m.start(), m.end())]
        if sum(b - a for a, b in lines) >= 12:
            yield from _payloads(layer, "".join(layer.text[a:b] for a, b in lines).translate(_STANDARD), array("q", (p for a, b in lines for p in range(a, b))))


class _Same:
    """The same place for every character."""

    def __init__(self, value: int, n: int):
        self.value, self.n = value, n

    def __getitem__(self, k):
        return [self.value] * len(range(*k.indices(self.n))) if isinstance(k, slice) else self.value


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The patterns' spans of the text itself, and all spans with those of its decoded layers: (start, kind, end), in order."""
    base = base_spans(text)
    spans = set(base)
    seen, first = set(), Layer(text, None, None)
    work = [_decoded(first)]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        key = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.starts[0] if layer.text else 0
        if layer.text and key not in seen:
            seen.add(key)
            for a, kind, b in base_spans(layer.text):
                at, end = layer.place(a, b)
                spans.add((at, kind, end))
            work.append(_decoded(layer))
    return base, sorted(spans)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the plain patterns, digest of their spans, and all spans."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, spans = scan(text.as_py() or "")
                n = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                out.append((doc, *n, hashlib.sha256(said(base).encode()).hexdigest(), said(spans)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 4 + (pa.string(),) * 2, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = "[secret]"


def redact(text: str | None) -> str | None:
    """The text with every found span, decoded ones too, replaced by a mark; overlapping spans make one mark."""
    if not text:
        return text
    out, at = [], 0
    for a, _, b in scan(text)[1]:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with its secrets masked; all rows and other columns stay as they are."""
    k = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.set_column(k, batch.schema.field(k), pa.array([redact(t.as_py()) for t in batch.column(k)], batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
