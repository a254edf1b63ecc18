"""Blocked Gibbs sweeps of the language model."""

import numpy as np
import pytest

from corvane.llm import language_model as m


def law(c, w, d):
    """Probabilities of 0 .. c tables, from the recurrence of the generalised Stirling numbers."""
    n, t = np.zeros(c + 1), np.arange(1, c + 1)
    n[1] = 1
    for j in range(1, c):
        n[1:] = w * n[:-1] + np.maximum(j - t * d, 0) * n[1:]
        n /= n.max()
    return n / n.sum()


@pytest.mark.parametrize("c", [2, 5, 64, 65, 300, 3000])
@pytest.mark.parametrize("d", [0.1, 0.6, 0.92])
def test_all_customers_of_a_dish_are_seated_by_the_exact_law(c, d):
    for w in (1e-12, 0.01, 1.0, 30.0, 1e3, 1e9):
        p = law(c, w, d)
        t, slope = m.tables(np.full(4000, c), np.full(4000, w), d, np.random.default_rng(c))
        got = np.bincount(t, minlength=c + 1) / len(t)
        assert abs(got - p).sum() / 2 < 0.6 * np.sqrt((p * len(t) > 1).sum() / len(t)) + 0.005
        assert np.isfinite(slope) and slope < 1e-6


def test_slopes_are_those_of_the_stirling_numbers():
    e = 1e-6
    few = (m.stirling(0.6 + e)[0][50, 1:51] - m.stirling(0.6 - e)[0][50, 1:51]) / (2 * e)
    assert m.stirling(0.6)[1][50, 1:51] == pytest.approx(few, rel=1e-3, abs=1e-4)
    t, slope = m._large(np.array([50.0]), np.array([5.0]), 0.6, np.random.default_rng(0))
    assert slope == pytest.approx(m.stirling(0.6)[1][50, t[0]], rel=1e-6)


def test_odd_dishes():
    t, slope = m.tables(np.array([0, 1, 10**9, 100]), np.array([1.0, 1.0, 0.0, 1e12]), 0.5, np.random.default_rng(0))
    assert t.tolist() == [0, 1, 1, 100] and np.isfinite(slope)


def test_letters_and_all_customers_of_frequent_pairs_move_in_every_sweep(spark, documents, monkeypatch):
    sent, swept = [], []
    monkeypatch.setattr(m, "_sweep", lambda s, keep, f=m._sweep: sent.append(s.value) or f(s, keep))
    monkeypatch.setattr(m, "dropped", lambda df: None)
    monkeypatch.setattr(m, "written", lambda df, name, f=m.written: swept.append((name, w := f(df, name))) or w)
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice(["aa", "bb", "cc", "dd"], 200)) + " " + " ".join(f"x{i}y{k}" for k in range(5)) for i in range(60)]
    assert m.score(documents(*texts)).count() == 60
    spellings = [a.spelling.p3 for a, _ in sent]
    assert all(len(x) != len(y) or (x != y).any() for x, y in zip(spellings, spellings[1:], strict=False))
    # a pair of about 600 customers: its tables are few, not those of a sequential seating, and change from sweep to sweep
    seen = []
    for _, w in [x for x in swept if x[0] == "sweep"]:
        row = [(m.Bucket(x["bucket"], [x[c] for c in m._PARTS]), x) for x in w.where("bucket is not null").collect()]
        seen.append(np.concatenate([m.unpack(x["t2"], np.int64)[b.count[b.live] > 400] for b, x in row]))
    assert len(seen[0]) >= 16 and all((x != y).any() for x, y in zip(seen, seen[1:], strict=False))
    assert max(x.max() for x in seen) < 40
