"""Baum-Welch counts against all paths of the states."""

import itertools

import numpy as np
import pytest

from landloom.llm import hmm


def every_path(model, s):
    out = np.zeros((1 + hmm.STATES + hmm.CLASSES + 1, hmm.STATES))
    total = 0.0
    for path in itertools.product(range(hmm.STATES), repeat=len(s)):
        p = model.start[path[0]] * model.emits[s[0], path[0]]
        for a, b, c in zip(path, path[1:], s[1:], strict=False):
            p *= model.moves[a, b] * model.emits[c, b]
        total += p
        out[0, path[0]] += p
        for a, b in itertools.pairwise(path):
            out[1 + a, b] += p
        for a, c in zip(path, s, strict=True):
            out[1 + hmm.STATES + c, a] += p
    return out / total


@pytest.mark.parametrize("segment", [1, 2, 3, 100])
def test_counts_equal_enumeration(monkeypatch, segment):
    monkeypatch.setattr(hmm, "STATES", 3)
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "CHUNK", 9)
    rng = np.random.default_rng(segment)
    emits = rng.random((hmm.CLASSES + 1, 3)) + 0.01
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), emits / emits.sum(0))
    sequences = [np.array([*rng.integers(0, 6, n), hmm.END], np.uint16) for n in (0, 1, 2, 5, 6, 7, 3, 5)]
    want = sum(every_path(model, s) for s in sequences)
    assert np.allclose(hmm.expect(model, sequences), want, atol=2e-4)


def test_segments_change_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    emits = rng.random((hmm.CLASSES + 1, hmm.STATES)) ** 4 + 1e-6
    model = hmm.Model(rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.full(hmm.STATES, 0.2), hmm.STATES), emits / emits.sum(0))
    sequences = [np.append(rng.integers(0, 300, n), hmm.END).astype(np.uint16) for n in (5000, 300, 40, 0, 3000)]
    whole = []
    for segment in (10_000, 128, 1):
        monkeypatch.setattr(hmm, "SEGMENT", segment)
        whole.append(hmm.expect(model, sequences))
    assert np.allclose(whole[0], whole[1], atol=0.02) and np.allclose(whole[0], whole[2], atol=0.02)
    assert abs(whole[0][1 + hmm.STATES :].sum() - sum(map(len, sequences))) < 0.1
