"""The collision index: recall, how much it verifies, and each row a query of its own."""

import os

import numpy as np
import pytest

from landloom.llm import collision

AT = "/root/testdata/sf0.1/embeddings.parquet"


def brute(x, k, n=10):
    d = np.sqrt(((x - x[k]) ** 2).sum(1))
    d[k] = np.inf
    return np.argsort(d, kind="stable")[:n], d


def test_few_of_many_directions_are_verified():
    x = np.random.default_rng(5).standard_normal((32_768, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    asked, hit, verified = np.arange(0, 32_768, 1024), 0, 0
    for own, near, distance, n in collision.search(x, np.arange(len(x)), x[asked], asked, 10):
        want, d = brute(x, own)
        assert np.allclose(distance, d[near]) and own not in near
        hit += len(set(near[np.argsort(distance)[:10]].tolist()) & set(want.tolist()))
        verified += n
    assert hit >= 0.9 * 10 * len(asked)
    assert verified < 0.1 * len(x) * len(asked)


def test_windows_are_those_of_a_sorted_array():
    x = np.random.default_rng(6).standard_normal((300, 8))
    x[40:60] = x[40]
    index = collision.Index(x)
    projected, at = x @ index.lines, x[41] @ index.lines
    for radius in (0.0, 0.3, 1.0, np.inf):
        inside = (np.abs(projected - at) < radius * collision.WIDTH / 2).sum(1) >= index.enough
        inside |= (projected == at).sum(1) * (radius > 0) >= index.enough
        assert set(np.flatnonzero(inside)) == set(index.colliding(*index.windows(at, radius)).tolist())


def test_only_the_own_row_is_left_out(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [3.0, 0.0]), (None, [1.0, 0.0])]
    got = collision.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), collision.F.col("vec_id") == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted([(0, 1, 0, 0.1), (0, 2, 1, 2.0), (0, 1, 0, 0.1), (0, 2, 1, round(float(np.hypot(2, 0.1)), 9))])


@pytest.mark.skipif(not os.path.exists(AT), reason="needs the sf0.1 table")
def test_recall_on_the_whole_table(spark):
    vectors = spark.read.parquet(AT)
    x = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    ids, all_ = np.array(sorted(x)), np.array([x[k] for k in sorted(x)])
    found = {}
    for r in collision.nearest(vectors, collision.F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(found[ids[k]] & set(ids[brute(all_, k)[0]].tolist())) for k in np.flatnonzero(ids % 100 == 0))
    assert set(found) == set(ids[ids % 100 == 0].tolist()) and hit >= 0.9 * 10 * len(found)
