"""Links beyond the last place of a list."""

import numpy as np

from landloom.llm import nndescent


def test_groups_linked_past_full_lists(spark):
    rng = np.random.default_rng(3)
    # two groups of 12, each closer inside (0.99) than across (0.94)
    a = np.zeros(64)
    a[0] = 1
    b = np.zeros(64)
    b[0], b[1] = 0.945, np.sqrt(1 - 0.945**2)
    noise = rng.standard_normal((24, 64)) * 0.005
    noise[:, :2] = 0
    x = np.vstack([np.tile(a, (12, 1)), np.tile(b, (12, 1))]) + noise
    x = x.astype(np.float32)
    rows = [(k, 0, v.tolist()) for k, v in enumerate(x)]
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    linked = u @ u.T >= 0.93
    np.fill_diagonal(linked, False)
    assert linked[:12, 12:].all()
    out = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {k: (int(linked[k].sum()), 0) for k in range(24)}


def brute(x, label):
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    linked = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        after = np.minimum(root, np.where(linked, root[None, :], len(x)).min(1))
        if (after == root).all():
            return linked.sum(1), root
        root = after


def noisy(n=6000, groups=250, dim=32, seed=9):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.sqrt((x * x).sum(1))[:, None]
    label = np.arange(n) % 3
    for g in range(groups):
        at = rng.choice(n, rng.integers(2, 14), replace=False)
        x[at] = x[at[0]] + rng.uniform(0.02, 0.3) * rng.standard_normal((len(at), dim)) / np.sqrt(dim)
        label[at] = label[at[0]]
    at = np.arange(min(n // 3, 700))  # one group that is larger than a block
    x[at] = x[0] + 0.2 * rng.standard_normal((len(at), dim)) / np.sqrt(dim)
    label[at] = 0
    return x, label


def test_links_of_noisy_groups_equal_brute_force(spark):
    x, label = noisy()
    rows = [(k, f"label {label[k]}", [float(c) for c in v]) for k, v in enumerate(x)]
    out = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    n_links, root = brute(x, label)
    assert n_links.max() > 100
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {k: (int(n_links[k]), int(root[k])) for k in range(len(x))}


def test_a_failed_audit_ends_in_full_comparison(spark, monkeypatch):
    x, label = noisy(400, 30, seed=2)
    monkeypatch.setattr(nndescent, "TRIES", 1)
    monkeypatch.setattr(nndescent, "_audit", lambda *_: 0.5)
    monkeypatch.setattr(nndescent, "_begin", lambda classes, *_: classes.selectExpr("id as v", "id as u", "0d as sim").limit(0))
    rows = [(k, int(label[k]), [float(c) for c in v]) for k, v in enumerate(x)]
    import warnings

    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        out = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert any("recall" in str(w.message) for w in said)
    n_links, root = brute(x.astype(np.float32), label)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {k: (int(n_links[k]), int(root[k])) for k in range(len(x))}
