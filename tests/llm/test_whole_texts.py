"""Texts in crowded places: everything that belongs together is found."""

import base64
import gzip
import random
import textwrap
import urllib.parse

import pytest

from test_texts import brute_components, documents

from landloom.llm import secrets, simhash


def shingles(text):
    return set(simhash.shingle_hashes(text, 5).tolist())


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def drifting(rng, n, fixed, loose):
    """Texts that share a passage and change word by word in the rest."""
    passage = [f"w{rng.getrandbits(40):x}" for _ in range(fixed)]
    rest = [f"w{rng.getrandbits(40):x}" for _ in range(loose)]
    out = []
    for _ in range(n):
        out.append(" ".join(passage + rest))
        rest[rng.randrange(loose)] = f"w{rng.getrandbits(40):x}"
    rng.shuffle(out)
    return out


def test_crowded_buckets_are_compared_completely(spark):
    rng = random.Random(4)
    # one group that drifts, and pairs that share little more than a passage: 0.79 similar to all, 0.84 to each other
    texts = drifting(rng, 200, 60, 40)
    passage = " ".join(f"p{rng.getrandbits(40):x}" for _ in range(104))
    for _ in range(120):
        own = [f"q{rng.getrandbits(40):x}" for _ in range(3)]
        for _ in range(2):
            texts.append(" ".join([passage, *own, *(f"q{rng.getrandbits(40):x}" for _ in range(10))]))
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    tables = [set(zip(range(simhash.SKETCHES), simhash.partial_fingerprints(simhash.shingle_hashes(t, 5)), strict=True)) for t in texts]
    roots = brute_components(len(texts), lambda i, j: bool(tables[i] & tables[j]) and alike(sets[i], sets[j]))
    kept = sorted(r.doc_id for r in simhash.one_of_each(documents(spark, list(enumerate(texts)))).collect())
    assert kept == sorted(set(roots))


def test_shared_counts_equal_set_intersections(monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "WIDTH", 7)
    rng = random.Random(2)
    own = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(30))], np.uint64)) for _ in range(20)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in own] for a in own[:8]]
    got = simhash._shared(own, 8)
    assert all(got[i][j] == want[i][j] for i in range(8) for j in range(20) if i != j)


def escaped(text):
    return "".join(f"%{b:02x}" for b in text.encode())


@pytest.mark.parametrize(
    "text",
    [
        f"see password: {escaped('hunter22secret')} ok",
        "see password = hun%74er2secret99 ok",
        "see password = hun\\u0074er2secret99 ok",
        "x%E9y&password%3Dhunter2secret%ff99 ok",
        "caf%E9%41KIA" + "Z" * 20,
        "token%20=%20" + urllib.parse.quote("päss") + "%20password%3D%3d12345678",
    ],
)
def test_escapes_are_read_in_their_place(text):
    _, spans = secrets.scan(text)
    assert spans and "hunter2" not in secrets.redact(text) and "er2secret" not in secrets.redact(text)


def test_places_in_the_whole_text():
    text = "see password = hun%74er2secret99 ok"
    assert secrets.said(secrets.scan(text)[1]) == f"assign:4:{len(text) - 3}"
    assert secrets.redact(text) == f"see {secrets.MASK} ok"


@pytest.mark.parametrize("width", [20, 64, 76])
@pytest.mark.parametrize("break_", ["\n", "\r\n", "\n  "])
def test_base64_over_line_breaks(width, break_):
    said = "the line before; password = hunter2secret99; and what follows it for a while, until the line is long"
    for data in (said.encode(), gzip.compress(said.encode() * 3)):
        text = f"this is the blob{break_}{break_.join(textwrap.wrap(base64.b64encode(data).decode(), width))}{break_}and more"
        kinds = secrets.said(secrets.scan(text)[1])
        assert "assign" in kinds
        _, kind, end = secrets.scan(text)[1][0]
        assert kind == 0 and end <= len(text)
    assert secrets.scan("one\nword\na\nline\nfrom\nhere\non")[1] == []
