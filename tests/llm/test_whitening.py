"""Whitening against exact integers and numpy."""

import math

import numpy as np
import pytest

from gleanwright.llm import whitening

NAN, INF = float("nan"), float("inf")


def plain(rows, k, scale=1024, shift=100_000):
    """By Python's integers: n, deviations, scatter, and whitened components up to sign."""
    x = [[math.floor(scale * c) + shift for c in v] for v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = [[n * c - t for c, t in zip(v, s, strict=True)] for v in x]
    scatter = [[sum(r[i] * r[j] for r in d) for j in range(len(s))] for i in range(len(s))]
    e, u = np.linalg.eigh(np.array([[c / n**3 for c in r] for r in scatter]))
    w = np.array([[c / n for c in r] for r in d]) @ u[:, ::-1][:, :k] / np.sqrt(e[::-1][:k])
    return n, [sum(c * c for c in r) for r in d], scatter, w, e[::-1][:k] / e.sum()


def test_remainders_give_the_integer_back():
    p = whitening.primes(1 << 90)
    assert all(x < 1 << whitening.BITS and all(x % d for d in range(2, int(x**0.5) + 1)) for x in p) and math.prod(p) >= 1 << 90
    for v in (0, 1, -1, 12345678901234567890, -(2**88) - 7):
        assert whitening.chinese([v % q for q in p], p) == v


@pytest.mark.parametrize("big", [1.0, 1e6, 1e12])
def test_whitening_is_exact(spark, big):
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(300, 6)) * big * [5, 4, 3, 2, 1.5, 1]).tolist()
    df = spark.createDataFrame([(i, v, 7) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n int").repartition(5)
    n, deviation, scatter, w, share = plain(rows, 3)
    good = df.selectExpr("vec_id AS id", "embedding AS v")
    known = whitening.totals(good, 1024, 100_000)
    got = {(r.i, r.j): int(r.scatter) for r in whitening.scatter(good, known, 1024, 100_000).collect()}
    assert got == {(i, j): scatter[i][j] for i in range(6) for j in range(i, 6)}
    out = whitening.whiten(df, 3).collect()
    assert len(out) == 900 and all(r.n == n and r.identity_error < 1e-9 for r in out)
    assert all(r.deviation == deviation[r.vec_id] if deviation[r.vec_id] < 10**38 else r.deviation is None for r in out)
    mine = np.zeros((300, 3))
    for r in out:
        mine[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
    assert np.abs(mine * np.sign((mine * w).sum(0)) - w).max() < 1e-9


def test_whitening_of_odd_rows(spark):
    kind = "vec_id long, embedding array<double>, component string"
    bad = [(1, None, "a"), (2, [1.0, None], "b"), (3, [NAN, 1.0], "c"), (4, [1.0, INF], "d")]
    good = [(5, [1.0, 2.0], None), (5, [1.0, 2.0], None), (None, [3.0, 1.0], "x"), (6, [0.0, 0.5], "x")]
    other = [(7, [1.0, 2.0, 3.0], "y"), (8, [], "z")]
    out = whitening.whiten(spark.createDataFrame(bad + good + other, kind)).collect()
    two = [r for r in out if r.n == 4]
    assert len(two) == 8 and sorted((str(r.vec_id), r.component) for r in two) == sorted((str(i), c) for i in (5, 5, None, 6) for c in (1, 2))
    assert all(r.identity_error < 1e-9 for r in two)
    one = [r for r in out if r.n == 1]  # a single row has no variance
    assert [(r.vec_id, r.component, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(7, c, 0, None, None, None) for c in (1, 2, 3)]
    assert len(out) == 11
    assert whitening.whiten(spark.createDataFrame(bad, kind)).count() == 0
    far = [(1, [1e300, 1.0], ""), (2, [-1e300, 2.0], ""), (3, [0.0, 4.0], "")]
    assert whitening.whiten(spark.createDataFrame(far, kind)).filter("whitened IS NULL OR isnan(whitened)").count() <= 3
