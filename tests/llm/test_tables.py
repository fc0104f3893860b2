"""Operators over embeddings and pages, the pipeline and the registry."""

import hashlib
import importlib
import math

import numpy as np
import pytest

from landloom.llm import collision, nndescent, urls

VECTORS = "vec_id long, embedding array<float>, label int, kept string"


def cloud(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16))
    x[:40] = x[0] + 0.05 * rng.standard_normal((40, 16))  # a crowded group
    for k in range(50, 90, 2):
        x[k + 1] = x[k] + 0.05 * rng.standard_normal(16)
    x[95] = x[94]
    return x.astype(np.float32)


def table(spark, x, extra=()):
    rows = [(k, [float(v) for v in row], k % 2 if k >= 100 else 0, "x") for k, row in enumerate(x)]
    return spark.createDataFrame(rows + list(extra), VECTORS)


ODD = [(900, None, 0, "x"), (901, [0.0] * 16, 0, "x"), (902, [float("nan")] + [1.0] * 15, 0, "x"), (903, [None] + [1.0] * 15, 0, "x"), (904, [1.0] * 16, None, "x"), (None, [1.0] * 16, 0, "x"), (905, [1.0] * 3, 0, "x"), (906, [float("inf")] * 16, 0, "x")]


def test_nndescent_equals_brute_force(spark):
    x = cloud(400)
    got = {r.vec_id: r for r in nndescent.near_duplicates(table(spark, x, ODD)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    label = np.array([k % 2 if k >= 100 else 0 for k in range(400)])
    linked = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    root = np.arange(400)
    for _ in range(400):
        new = np.minimum(root, np.where(linked, root[None, :], 400).min(1))
        if (new == root).all():
            break
        root = new
    for k in range(400):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (linked[k].sum(), root[k], root[k] == k), k
    for v, *_ in ODD:
        assert got[v].n_links == 0 and got[v].component_id == v and got[v].kept == (v is not None)
    assert nndescent.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_repeated_vectors_count_each_other(spark):
    got = nndescent.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1, "x")] * 3 + [(2, [0.0, 1.0], 1, "x")], VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == [(1, 2), (1, 2), (1, 2), (2, 0)]


def test_nearest_recall_and_order(spark):
    x = cloud(600, 3)
    rows = collision.nearest(table(spark, x, ODD), (collision.F.col("vec_id") % 20 == 0)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    hit = total = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        own = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(math.isclose(r.score, d[r.vec_id]) for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hit += len({r.vec_id for r in own} & set(want.tolist()))
        total += 10
    assert hit >= 0.9 * total
    assert not {r.vec_id for r in rows} & {900, 901, 902, 903, 906, None}
    assert collision.nearest(spark.createDataFrame([], VECTORS), collision.F.col("vec_id") % 2 == 0).count() == 0


def test_nearest_with_few_candidates_and_ties(spark):
    rows = [(0, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], 1, "x"), (3, [0.0, 5.0], 1, "x"), (3, [0.0, 5.0], 1, "x")]
    got = collision.nearest(spark.createDataFrame(rows, VECTORS), collision.F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2), (3, 3), (4, 3)]


# ---------------------------------------------------------------- URLs

PAGES = "page_id long, url string, html string, verdict string"


def test_hosts_paths_and_rules(spark):
    cases = [
        (1, "https://A.Example.ORG/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"), (2, "http://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "x://foo.org/", "foo.org", "/", "org/", "allow"), (4, "http://a.com/fr/1", "a.com", "/fr/1", "com/fr/", "allow"), (5, "http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
        (6, "http://notorg/", "notorg", "/", None, None), (7, "http://foo.org?x", "foo.org", "", None, None), (8, None, "", "", None, None), (9, "no scheme/de/", "", "", None, None),
        (10, "", "", "", None, None), (11, "http://" + "a" * 5000 + ".com/de/", "a" * 5000 + ".com", "/de/", "com/de/", "block"), (None, "http://É.com/DE/", "É.com", "/DE/", None, None),
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u, *_ in cases], PAGES)
    got = {r.page_id: r for r in urls.judge(pages, spark.createDataFrame(urls.labelled_urls(), "label int, url string")).collect()}
    for i, _, host, path, rule, verdict in cases:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], PAGES), spark.createDataFrame([], "label int, url string")).count() == 0


def test_the_model_equals_descent_in_numpy(spark):
    import hashlib

    def features(url):
        host, path = url.split("://")[1].split("?")[0].split("#")[0].split("/", 1)
        out = np.zeros(urls.BUCKETS)
        for text in ("h^^^" + host + "$$$", "p^^^/" + path + "$$$"):
            for n in urls.GRAMS:
                for k in range(len(text) - n + 1):
                    out[int(hashlib.md5(text[k : k + n].encode()).hexdigest()[:3], 16)] += 1
        return np.append(out / np.sqrt(out.sum()), 1)

    x, y = np.array([features(u) for _, u in urls.labelled_urls()]), np.array([v for v, _ in urls.labelled_urls()], float)
    w, speed = np.zeros((2, urls.BUCKETS + 1))
    for _ in range(urls.STEPS):
        speed = urls.MOMENTUM * speed + urls.RATE * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) / len(y) - urls.RIDGE * w)
        w = w + speed
    got = urls.train(spark.createDataFrame(urls.labelled_urls(), "label int, url string"))
    assert np.allclose(got, w, atol=1e-8)
    asked = [("https://www.ththin.example.net/en/77?x=1", ""), ("http://aaaaaaaaaaaa.test/aaaa/aaaa", ""), ("http://m.casino-win.test/de/4", ""), ("http://a/", "")]
    scored = urls.judge(spark.createDataFrame([(k, u, "", "") for k, (u, _) in enumerate(asked)], PAGES), spark.createDataFrame(urls.labelled_urls(), "label int, url string")).orderBy("page_id").collect()
    for r, (u, _) in zip(scored, asked, strict=True):
        assert math.isclose(r.score, 1 / (1 + np.exp(-features(u) @ w)), abs_tol=1e-6), u
    seen = spark.createDataFrame([(1, "http://m.casino-jackpot.net/en/9", "", ""), (2, "http://www.library-news.net/en/9", "", "")], PAGES)
    assert [r.verdict for r in urls.judge(seen, spark.createDataFrame(urls.labelled_urls(), "label int, url string")).orderBy("page_id").collect()] == ["block", "allow"]


def test_names_that_training_never_saw(spark):
    rows = urls.labelled_urls()
    assert len(rows) <= urls.LABELLED and len(set(rows)) == len(rows)
    held = [hashlib.md5(u.encode()).digest()[0] % 4 == 0 for _, u in rows]
    out = [r for r, h in zip(rows, held, strict=True) if h]
    train = spark.createDataFrame([r for r, h in zip(rows, held, strict=True) if not h], "label int, url string")
    got = urls.judge(spark.createDataFrame([(k, u, "", "") for k, (_, u) in enumerate(out)] * 2, PAGES), train, rules=()).collect()
    assert len(got) == 2 * len(out)
    for label in (0, 1):
        own = [(r.verdict == "block") == label for r in got if out[r.page_id][0] == label]
        assert sum(own) >= 0.85 * len(own)


# ---------------------------------------------------------------- whole


def test_registry_has_all_operators():
    names = importlib.import_module("landloom.llm.registry").QUERIES
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


def test_pipeline_runs_and_keeps_columns(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in p.STAGES[:-1]:
        after = p.materialise(stage(spark, before, sf))
        assert sorted(after.columns) == sorted(docs.columns), name
        assert 0 < after.count() <= before.count()
        before = after
    packed = p.STAGES[-1][1](spark, before, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    assert p.run(spark, sf).count() == packed.count()


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_an_empty_table(spark, stage):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    empty = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0")
    assert p.STAGES[stage][1](spark, empty, sf).count() == 0
