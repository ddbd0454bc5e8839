import math
from collections import Counter

import numpy as np

from quarry.llm.whitening import Spectrum, secular_roots, whiten

SCHEMA = "vec_id long, embedding array<double>, label int, x array<long>, component string, n string, slot string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, [1], "c", "n", "s") for i, v in rows], SCHEMA)


def brute(rows, k=4):
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in fine), default=0)
    whole = [(i, tuple(math.floor(256 * c) for c in v) + (0,) * (d - len(v))) for i, v in fine]
    fit = sorted({x for _, x in whole})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array(fit, dtype=float) - np.array([t / n for t in s])
    e, u = np.linalg.eigh(a.T @ a / n)
    e, u = e[::-1], u[:, ::-1]
    deviations = [sum((n * c - t) ** 2 for c, t in zip(x, s)) for _, x in whole]
    white = (np.array([x for _, x in whole], dtype=float) - np.array([t / n for t in s])) @ u / np.sqrt(np.maximum(e, 1e-300))
    return n, [i for i, _ in whole], deviations, white[:, :k], (e / e.sum())[:k]


def vectors(n, d, seed=3):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((d, d)) * np.linspace(0.05, 0.4, d)
    return [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((n, d)) @ mix)]


def check(spark, rows, k):
    n, ids, deviations, white, explained = brute(rows)
    got = whiten(frame(spark, rows).repartition(5)).collect()
    assert len(got) == len(ids) * k
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter(zip(ids, deviations))
    for c in range(k):
        mine = [r for r in got if r.component == c + 1]
        assert all(r.n == n and r.identity_error <= 1e-9 for r in mine)
        np.testing.assert_allclose({r.explained for r in mine}.pop(), explained[c], rtol=1e-9)
        have = np.array(sorted(r.whitened for r in mine))
        want = [np.sort(s * white[:, c]) for s in (1, -1)]
        assert min(np.abs(have - w).max() for w in want) < 1e-9


def test_rank_one_updates_against_dense_eigh():
    rng = np.random.default_rng(1)
    for d, n in ((1, 9), (2, 30), (6, 40), (33, 20), (33, 200)):
        x = np.floor(rng.standard_normal((n, d)) * np.linspace(1, 90, d))
        x[n // 2:n // 2 + 3] = x[0]
        if d > 4:
            x[:, 2] = x[:, 1]  # equal poles and directions without variance
        whole, a, b = Spectrum(d), Spectrum(d), Spectrum(d)
        whole.add(x)
        a.add(x[:n // 3])
        b.add(x[n // 3:])
        centred = x - x.mean(axis=0)
        scatter = centred.T @ centred
        for found in (whole, a.merge(b), Spectrum(d).merge(whole).merge(Spectrum(d))):
            assert found.n == n
            np.testing.assert_allclose(found.mean, x.mean(axis=0), atol=1e-9)
            np.testing.assert_allclose(found.vectors @ np.diag(found.values) @ found.vectors.T, scatter,
                                       atol=1e-11 * np.abs(scatter).max())
            np.testing.assert_allclose(found.vectors.T @ found.vectors, np.eye(d), atol=1e-11)


def test_secular_roots_interlace():
    poles, weights = np.array([0.0, 1e-9, 1.0, 5.0]), np.array([1e-8, 0.3, 1e-12, 0.2])
    delta, roots = secular_roots(poles, weights, 2.0)
    assert (np.diag(delta) < 0).all() and (np.diag(delta, 1) > 0).all() and roots[-1] <= 5.0 + 2.0 * weights.sum()
    assert np.abs(1 + 2.0 * (weights / delta).sum(axis=1)).max() < 1e-6 * np.abs(2.0 * weights / delta).max()


def test_against_eigh(spark):
    check(spark, vectors(700, 12), 4)


def test_copies_weigh_once_and_bad_vectors_go(spark):
    rows = vectors(60, 5)
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a hot vector
    rows += [(None, rows[3][1]), (5, rows[5][1]), (6, [0.0] * 5), (7, [-0.0] * 5), (8, [0.1, 0.2]), (9, [])]
    rows += [(20, None), (21, [None] * 5), (22, [float("nan")] * 5), (23, [float("inf")] * 5), (24, [1.0, None, 1.0, 1.0, 1.0])]
    check(spark, rows, 4)


def test_fewer_components(spark):
    check(spark, [(i, [float(i % 7), 2.0 * (i % 7), 1.0]) for i in range(50)], 1)  # one direction varies
    check(spark, [(i, [float(i * i % 11) / 10, float(i % 5)]) for i in range(50)], 2)


def test_no_variance_no_rows(spark):
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten(frame(spark, [(1, []), (2, None)])).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2 ** 30 + 7 * i), float(-i)]) for i in range(40)]
    check(spark, rows, 1)
    huge = whiten(frame(spark, [(1, [1e16]), (2, [-1e16])])).collect()
    assert all(r.deviation is None and abs(abs(r.whitened) - 1) < 1e-12 for r in huge) and len(huge) == 2


def test_wide_vectors_refined_on_a_trial_space(spark, monkeypatch):
    import quarry.llm.whitening as w

    monkeypatch.setattr(w, "TRIAL", 6)
    check(spark, vectors(300, 20), 4)
