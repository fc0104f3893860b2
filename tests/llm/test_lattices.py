"""Restored words against all paths of their lattices, and disguises of known words."""

import itertools
import random

import numpy as np
import pytest

from landloom.llm import toxicity as T

TEXT = "the stupid moron is scum and the rapid idiots are stupid scum the little letter will tell a class all too well stupor " * 20


@pytest.fixture(scope="module")
def model():
    c = T.encode("  " + TEXT + "  ").astype(np.int64)
    return T.log_model(np.bincount((c[:-2] << 12) + (c[1:-1] << 6) + c[2:], minlength=T.CODES**3).astype(float))


def flat(model):
    return model.ravel().tolist()


def every_path(token, model):
    out = []
    for path in itertools.product(*T.lattice(token)):
        word = "".join(letters for letters, _ in path)
        out.append((T.spelling(word, flat(model)) - sum(cost for _, cost in path), word))
    return sorted(out, reverse=True)


@pytest.mark.parametrize("seed", range(40))
def test_viterbi_finds_the_best_of_all_paths(model, seed):
    rng = random.Random(seed)
    token = "".join(rng.choice("stupidmoron013@$!*.-é") * rng.choice((1, 1, 2, 3)) for _ in range(rng.randrange(1, 8)))
    paths = every_path(token, model)
    scores = {}
    for s, w in paths[: T.BEST]:
        if w and s > paths[0][0] - T.BEHIND:
            scores.setdefault(w, s)
    cut = paths[T.BEST - 1][0] if len(paths) >= T.BEST else -np.inf
    got = T.restore(token, flat(model))
    assert {w for w, s in scores.items() if s > cut + 1e-5} <= set(got)
    assert all(any(abs(s - max(x for x, v in paths if v == w)) < 1e-4 or s >= cut - 1e-4 for s, v in paths if v == w) for w in got)
    if paths[0][1] and paths[0][0] > paths[1][0] + 1e-4 if len(paths) > 1 else paths[0][1]:
        assert got[0] == paths[0][1]


DISGUISES = ["stupid", "5tup1d", "$tup!d", "stuuupid", "stuupid", "s.t.u.p.i.d", "s-t-u-p-i-d", "St*pid", "s t u p i d", "s  t  u  p  i  d", "s\nt\nu\np\ni\nd", "stu pid", "STUPID!!", "(stupid)", "s_t_u_p_i_d", "5 t u p 1 d"]


@pytest.mark.parametrize("said", DISGUISES)
def test_disguises_are_read(model, said):
    known = {"stupid": 0, "stup+": 1, "scum": 2}
    assert 0 in T.Readings(model, known).text(f"you are {said} so")


def test_clean_words_stay_clean(model):
    known = {"stupid": 0, "scum": 1, "moron": 2}
    readings = T.Readings(model, known)
    assert readings.text("the stupor of a class, a rapid letter; 57 1,000 me@stupid.org http://stupid.org a b") == set()
    assert readings.text("") == set()
    assert "ass" in T.Readings(model, None).words("a$$") and "scum" in T.Readings(model, None).words("scuum")


def test_very_long_tokens(model):
    rng = random.Random(1)
    token = "".join(rng.choice("stupid013@$!*") for _ in range(20_000))
    assert T.restore(token, flat(model))


def test_sparse_newton_equals_dense():
    rng = np.random.default_rng(2)
    rows = [sorted(rng.choice(30, rng.integers(0, 6), replace=False).tolist()) for _ in range(300)]
    y, times = rng.integers(0, 2, 300).astype(float), rng.integers(1, 4, 300).astype(float)
    x = np.zeros((300, 31))
    x[:, -1] = 1
    for k, own in enumerate(rows):
        x[k, own] = 1
    w, penalty = np.zeros(31), np.append(np.ones(30), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (times * (y - p)) - penalty * w)
    assert np.allclose(T._logistic(T.Sparse(rows, 30), y, times), w, atol=1e-5)
