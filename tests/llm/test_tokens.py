"""Token counts, tokenizer alignment and centroid clustering against plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from landloom.llm import alignment, counts, kdtrees

SCHEMA = "doc_id long, text string, row long, n long, batch string"
WORDS = "the of and thing tion er on ouen bleth ndhan stonre É日本 don't 12ab x's 🙂🙃 AAAAAAA ﬁn éa <s> <|endoftext|> naïve--so ___ ####".split()
ODD = ["", " ", "  ", "\n", "a\n\n b", " \n x", "x ▁y", "▁", "a\tb", "tail ", " lead", "one", "a\x00b", "​ ​", "a\xa0 b", "b \xa0c", "<0x0A>", "\x1c x\x1d y", "end.\nNext  two   three", "x▁ y z"]


def prose(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", " ", "\n", "  ", ", "]) for _ in range(n)).rstrip()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    own = [*ODD, None, None, *(prose(rng, rng.randint(1, 60)) for _ in range(60)), prose(rng, 6000), "ab" * 4000]
    own += own[:25] + [own[30]] * 20
    return [(None if k % 17 == 0 else k // 2, t) for k, t in enumerate(own)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, 3, 4, "x") for d, t in rows], SCHEMA).repartition(3)


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


# ---------------------------------------------------------------- counts


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("long", [1 << 20, 64])
def test_counts_equal_the_library_for_whole_and_divided_texts(docs, rows, name, long):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    got = counts.token_counts(docs, path, limit=40, long=long, part=9, batch=200)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(d, len((t or "").encode()), n := count(t or ""), n > 40) for d, t in rows]
    assert order(tuple(r) for r in got.collect()) == order(want)


def test_long_texts_are_divided():
    count = counts.counter(counts.default_tokenizer())
    assert len(list(count.parts("abc def " * 100, 50))) > 10
    assert list(count.parts("x" * 1000, 50)) == ["x" * 1000]


def test_counts_of_an_empty_table(spark):
    assert counts.token_counts(spark.createDataFrame([], SCHEMA), counts.default_tokenizer()).count() == 0


# ---------------------------------------------------------------- alignment


def letters():
    """The byte of each letter of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def plain_alignment(texts):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte, coded = letters(), []
    for t in texts:
        if not t:
            coded.append(([], []))
            continue
        left = [(k, bytes(byte[c] for c in a.id_to_token(k))) for k in a.encode(" " + t, add_special_tokens=False).ids]
        right = [(k, bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()) for k, p in ((k, b.id_to_piece(k)) for k in b.encode(t))]
        same = b"".join(x for _, x in left) == (" " + t).encode() == b"".join(x for _, x in right)
        coded.append((left, right) if same else ([], []))
    links, groups = [], []
    for left, right in coded:
        spans = []
        for side in (left, right):
            at, own = 0, []
            for k, x in side:
                own.append((k, at, at + len(x)))
                at += len(x)
            spans.append(own)
        links.append([(k, m) for k, s, e in spans[0] for m, t, f in spans[1] if max(s, t) < min(e, f)] if len(left) < 2000 else None)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        cut, was = [], 0
        for e in ends:
            cut.append("|".join(",".join(str(k) for k, _, f in side if was < f <= e) for side in spans) if len(left) < 2000 else None)
            was = e
        groups.append(cut)
    return coded, links, groups


def test_alignment_equals_plain_loops(docs, rows):
    short = [(d, t) for d, t in rows if not t or len(t) < 3000]
    coded, links, groups = plain_alignment([t for _, t in short])
    n = Counter(x for own in links for x in own)
    best = {}
    for (_, b), c in n.items():
        best[b] = max(best.get(b, 0), c)
    want = [
        (d, len(c[0]), len(c[1]), len(g), len(own), sum(n[x] == best[x[1]] for x in own), sum(n[x] for x in own), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for (d, _), c, own, g in zip(short, coded, links, groups, strict=True)
    ]
    assert any(len(x.split("|")[0].split(",")) > 1 < len(x.split("|")[1].split(",")) for g in groups for x in g)
    own = docs.where("text is null or length(text) < 3000")
    for batch, few in ((1 << 22, 1 << 16), (500, 3)):
        got = alignment.align(own, *alignment.default_tokenizers(), batch=batch, few=few)
        assert order(tuple(r) for r in got.collect()) == order(want)


def test_chunks_are_encoded_as_inside_their_text(rows):
    pair = alignment.Pair(*alignment.default_tokenizers())
    coded, _, _ = plain_alignment([t for _, t in rows])
    for (_, t), (left, right) in zip(rows, coded, strict=True):
        if t:
            ids = [np.frombuffer(v, np.int32).tolist() if v is not None else None for v in pair.ids(alignment.chunks_of(t))]
            if None in ids:
                assert left == right == []
            else:
                flat = [k for own in ids for k in own]
                assert [k for k in flat if k < alignment._B] == [k for k, _ in left] and [k - alignment._B for k in flat if k >= alignment._B] == [k for k, _ in right]


def test_a_row_of_texts_holds_each_group_once(spark):
    texts = ["the ouen of thing don't stonre"] * 50 + ["thing the bleth É日本 <s> naïve--so"] * 30
    docs = spark.createDataFrame([(k, t, 0, 0, "") for k, t in enumerate(texts)], SCHEMA).coalesce(1)
    (row,) = alignment.encoded(docs, *alignment.default_tokenizers()).collect()
    _, _, groups = plain_alignment(texts)
    want = Counter(g for own in groups for g in own)
    assert len(row.groups) == len(want) < sum(want.values())
    assert {g.g: g.n for g in row.groups} == want
    assert [[row.groups[g].g for r in d.refs for g in row.chunks[r]] for d in row.docs] == groups


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), *alignment.default_tokenizers()).count() == 0


# ---------------------------------------------------------------- clustering

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, x int"


def lloyd(vectors, k, rounds, width, seed="2"):
    own = [(i, np.array([int(np.floor(float(np.float32(v)) * 256)) for v in e], object)) for i, e in vectors if e is not None and len(e) == width and all(v is not None and np.isfinite(v) for v in e)]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), list(x)) for i, x in own if i is not None)[:k]
    z = [np.array(x, object) for _, x in starts]
    near = lambda x: min((int(((x - c) ** 2).sum()), j) for j, c in enumerate(z))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in own]
        for j in range(len(z)):
            mine = [x for (_, x), a in zip(own, at, strict=True) if a == j]
            if mine:
                z[j] = sum(mine) // len(mine)
    last = [near(x) for _, x in own]
    each, digest = Counter(), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    for d, j in last:
        each[j] += d
    return [(i, j, d, each[j], sum(each.values()), digest[j]) for (i, _), (d, j) in zip(own, last, strict=True)]


@pytest.mark.parametrize("spread", [0.02, 1.0, 3000.0])
def test_clusters_equal_plain_rounds(spark, spread):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(9, 4))
    rows = [(i, [float(np.float32(v)) for v in middle[i % 9] + spread * rng.normal(size=4)]) for i in range(700)]
    rows += rows[:40] + [(None, rows[5][1]), (900, [0.0] * 4), (901, [0.0] * 4), (902, [0.0] * 4), (903, None), (904, []), (905, [1.0] * 3), (906, [None] * 4), (907, [float("nan")] * 4), (908, [float("inf")] * 4)]
    table = spark.createDataFrame([(i, e, 1, 2, 3) for i, e in rows], VECTORS).repartition(3)
    got = kdtrees.cluster(table, k=12, rounds=4, width=4, block=100)
    assert order(tuple(r) for r in got.collect()) == order(lloyd(rows, 12, 4, 4))


def test_trees_drop_centroids_and_keep_ties():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 50, (400, 3)), rng.integers(4000, 4050, (400, 3)), np.full((100, 3), 1000)])
    z = np.array([[20, 20, 20], [4020, 4020, 4020], [500, 1000, 1000], [1500, 1000, 1000], [20, 20, 20]])
    order_, nodes = kdtrees.tree(x, 16)
    assert sorted(order_) == list(range(len(x)))
    cover, whole = np.full(len(x), -1), 0
    for a, b, at in kdtrees.filtered(x[order_], nodes, z):
        assert (cover[a:b] == -1).all()
        cover[a:b] = at
        whole += isinstance(at, int) * (b - a)
    d = ((x[order_][:, None] - z[None]) ** 2).sum(2)
    assert (cover == d.argmin(1)).all() and whole >= 300


def test_few_none_and_too_large_vectors(spark):
    few = spark.createDataFrame([(1, [0.5, 0.25], 1, 1, 1)], VECTORS)
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in kdtrees.cluster(few, width=2).collect()] == [(1, 0, 0, 0)]
    assert kdtrees.cluster(few.limit(0), width=2).collect() == []
    with pytest.raises(Exception, match="or more in size"):
        kdtrees.cluster(spark.createDataFrame([(1, [1e30, 0.0], 1, 1, 1)], VECTORS), width=2).collect()


def test_given_vectors_have_the_width():
    assert len(pq.read_table("/root/testdata/sf0.001/embeddings.parquet")["embedding"][0]) == kdtrees.WIDTH


from landloom.llm._common import materialise as _write  # noqa: E402


def test_encoded_rows_lie_in_small_row_groups(spark, monkeypatch):
    """A reader holds a row group whole, so its bytes must not grow with the rows of a task."""
    import glob

    import pyarrow.parquet as pq
    from landloom.llm import alignment

    kept = []
    monkeypatch.setattr(alignment, "materialise", lambda df, *a, **k: kept.append(_write(df, *a, **k)) or kept[-1])
    monkeypatch.setattr(alignment, "BLOCK", 1 << 12)
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(400))) for k in range(30)], "doc_id long, text string").coalesce(1)
    alignment.align(docs, *alignment.default_tokenizers(), batch=1 << 12).collect()
    files = [pq.ParquetFile(f).metadata for f in glob.glob(kept[0]._landloom_path.removeprefix("file:") + "/*.parquet")]
    assert sum(m.num_rows for m in files) > 20 and max(m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)) <= 4
