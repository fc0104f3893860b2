"""A group of more than a thousand near copies, against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from test_texts import documents

from landloom.llm import simhash


def brute_groups(texts, similarity=0.8):
    """The smallest index that links of at least this similarity reach, by the full matrix of intersections."""
    own = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    _, at = np.unique(np.concatenate(own), return_inverse=True)
    has = np.zeros((len(own), int(at.max()) + 1), np.float32)
    has[np.repeat(np.arange(len(own)), [len(x) for x in own]), at] = 1
    n, both = has.sum(1), has @ has.T
    linked = both >= similarity * (n[:, None] + n[None, :] - both)
    root = np.arange(len(own))
    while True:
        after = np.where(linked, root[None, :], len(own)).min(1)
        if (after == root).all():
            return root
        root = np.minimum(after, root)


def words(rng, n):
    return [f"w{rng.getrandbits(32):x}" for _ in range(n)]


def test_more_than_a_thousand_near_copies(spark):
    rng = random.Random(11)
    first, second = words(rng, 100), words(rng, 100)
    texts = [" ".join(first)]
    for _ in range(1100):  # similar to the first text, mostly not to each other
        own = list(first)
        for k in rng.sample(range(100), 2):
            own[k] = f"x{rng.getrandbits(32):x}"
        texts.append(" ".join(own))
    chain = list(second)
    for _ in range(150):  # each similar to its neighbours only
        chain[rng.randrange(100)] = f"y{rng.getrandbits(32):x}"
        texts.append(" ".join(chain))
    texts += [" ".join(first[:50] + words(rng, 50)) for _ in range(60)] + [" ".join(words(rng, 60)) for _ in range(60)]
    texts += texts[:40]
    rng.shuffle(texts)
    want = sorted(set(brute_groups(texts).tolist()))
    assert 120 < len(want) < 200
    kept = simhash.one_of_each(documents(spark, list(enumerate(texts))).repartition(7))
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_columns_and_ids_of_any_kind(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 1, 2), (3, "a b c d e f", 3, 4), (3, None, 5, 6)], "doc_id long, text string, `dedup row` int, `group` int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.group) for r in kept.collect()) == [(3, 4), (3, 6)]
    long_text = " ".join(words(random.Random(1), 40_000))
    many = spark.createDataFrame([(1, long_text), (2, long_text + " more"), (3, "x" * 200_000)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.one_of_each(many).orderBy("doc_id").select("doc_id").collect()] == [1, 3]
    assert many.where(F.lit(False)).transform(simhash.one_of_each).count() == 0
