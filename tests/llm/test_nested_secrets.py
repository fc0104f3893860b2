"""Secrets in random nestings, against what wrapped them; memory of large inflated data."""

import base64
import bz2
import gzip
import random
import subprocess
import sys
import textwrap
import urllib.parse
import zlib
from pathlib import Path

import pytest

from test_texts import documents

from landloom.llm import secrets

SAID = "password = hunter2secret99"


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def raw_deflate(text):
    machine = zlib.compressobj(9, zlib.DEFLATED, -15)
    return machine.compress(text.encode()) + machine.flush()


WRAPS = [
    b64,
    lambda t: base64.urlsafe_b64encode(t.encode()).decode(),
    lambda t: b64(gzip.compress(t.encode())),
    lambda t: b64(zlib.compress(t.encode())),
    lambda t: b64(bz2.compress(t.encode())),
    lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    lambda t: "".join(f"\\U{ord(c):08x}" for c in t),
    lambda t: "".join(f"&#x{ord(c):x};" for c in t),
    lambda t: "\n".join(textwrap.wrap(b64(t), 40)),
]


@pytest.mark.parametrize("seed", range(60))
def test_random_nestings_are_found_where_they_stand(seed):
    rng = random.Random(seed)
    inner = "".join(rng.choice("xyz ") for _ in range(rng.randrange(9))) + " " + SAID
    for _ in range(rng.randrange(1, 4)):
        inner = rng.choice(WRAPS)(inner)
    before = rng.choice(["", "see ", "https://host/path/", "é: ", "ab", "line\n"])
    text = before + inner + rng.choice(["", " after", "\nmore words here"])
    base, spans = secrets.scan(text)
    own = [(a, b) for a, kind, b in spans if kind == 0 and len(before) <= a and b <= len(before) + len(inner) + 20]
    assert own, text
    assert set(base) <= set(spans)
    again = secrets.scan(secrets.redact(text))[1]
    assert not [s for s in again if s[1] == 0], (text, secrets.redact(text))


PACKS = [
    gzip.compress, zlib.compress, bz2.compress, lambda d: zlib.compress(d, 1), lambda d: b"\x00\x01\xfe" + d, lambda d: b"\xff" + d + b"\x80\x81",
    lambda d: b64(d).encode(), lambda d: d + b" and so on",
]
WRITTEN = [b64, lambda d: urllib.parse.quote(d), lambda d: "".join(f"%{x:02x}" for x in d), lambda d: "".join(f"\\x{x:02x}" for x in d)]


@pytest.mark.parametrize("seed", range(80))
def test_layers_of_bytes_reach_the_fixpoint(seed):
    rng = random.Random(seed)
    data = (f"note {SAID} ." if rng.random() < 0.8 else f"note {SAID} .".encode("utf-16-le").decode("latin-1")).encode("latin-1")
    data = rng.choice(PACKS[:3])(data)
    for _ in range(rng.randrange(1, 5)):
        data = rng.choice(PACKS)(data)
    written = rng.choice(WRITTEN)(data)
    text = f"see {written} end"
    spans = [(a, b) for a, kind, b in secrets.scan(text)[1] if kind == 0]
    assert spans and all(4 <= a < b <= 4 + len(written) for a, b in spans)


def test_compressed_data_at_every_byte():
    for squeeze in (gzip.compress, zlib.compress, bz2.compress):
        for n in range(7):
            assert [s for s in secrets.scan("x " + b64(bytes(n) + squeeze(SAID.encode())))[1] if s[1] == 0], (squeeze, n)


def test_layers_that_hold_themselves_end():
    layer = secrets.Layer("", None, None)
    assert list(secrets._decoded(layer)) == []
    data = gzip.compress(gzip.compress(b"word " * 50) * 30)
    assert secrets.scan(b64(data))[1] == []


@pytest.mark.parametrize("before", ["https://h/x/", "ab", "/", "key_", "a-b-c_", "x" * 7])
@pytest.mark.parametrize("data", [SAID.encode(), SAID.encode("utf-16-le"), gzip.compress(SAID.encode()), b"\x00\x01\xff" + SAID.encode() + b"\x00\xfe"])
def test_payloads_begin_anywhere_in_a_run(before, data):
    text = f"see {before}{b64(data)} ok"
    spans = [s for s in secrets.scan(text)[1] if s[1] == 0]
    assert spans and all(4 + len(before) - 4 <= a < b <= len(text) - 3 for a, _, b in spans)


def test_deflated_without_a_head():
    text = "see " + b64(raw_deflate(SAID + " and so on, and so on")) + " ok"
    assert secrets.scan(text)[1]


def test_plain_texts_have_no_spans():
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    text = "\n".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 90))) for _ in range(2000))
    assert [s for s in secrets.scan(text)[1] if s[1] != 2] == []


def test_large_inflated_data_in_bounded_memory():
    code = """
import base64, resource, sys, zlib
from landloom.llm import secrets
machine = zlib.compressobj(9)
part = b"abc def ghi jkl\\n" * (1 << 16)
data = b"".join(machine.compress(part) for _ in range(100)) + machine.compress(b" password = hunter2secret99 ") + machine.flush()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert any(kind == 0 for _, kind, _ in secrets.scan("x " + base64.b64encode(data).decode())[1])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(out.stdout.split()[-1]) < 100  # of 100 MB


def test_long_runs_inside_compressed_data(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 1 << 14)
    inner = b64(gzip.compress(random.Random(1).randbytes(5000) + b" " + SAID.encode() + b" "))
    text = b64(zlib.compress(("word " * 3000 + inner + " end").encode()))
    assert [s for s in secrets.scan(text)[1] if s[1] == 0]


def test_empty_tables_and_repeated_rows(spark):
    none = documents(spark, []).limit(0)
    assert secrets.find_secrets(none).count() == 0 and secrets.redacted(none).count() == 0
    got = secrets.find_secrets(documents(spark, [(1, "x " + b64(SAID))] * 3 + [(None, None), (2, "")])).collect()
    assert len(got) == 5 and len({r.spans for r in got if r.doc_id == 1}) == 1
    assert sorted((r.doc_id is None, r.spans == "") for r in got) == [(False, False)] * 3 + [(False, True), (True, True)]


def test_quoted_paths_and_words_stay_clean():
    assert secrets.scan(urllib.parse.quote("a plain sentence, with commas and signs: 100 %"))[1] == []
