"""Whitening beside exact fractions and a plain eigensolver."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tablescope.llm import whitening
from tablescope.llm.queries import op11_whitening

SF = "/root/testdata/sf0.001"


def plain_scatter(rows):
    n, d = len(rows), len(rows[0])
    sums = [sum(r[i] for r in rows) for i in range(d)]
    return n, sums, np.array([[n * sum(r[i] * r[j] for r in rows) - sums[i] * sums[j] for j in range(d)] for i in range(d)], object)


def plain_polynomial(matrix):
    """Faddeev and LeVerrier's recursion in integers, constant term first."""
    d = len(matrix)
    one = np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
    m, out = one * 0, [1]
    for k in range(1, d + 1):
        m = matrix.dot(m) + out[-1] * one
        out.append(-int(np.trace(matrix.dot(m))) // k)
    return out[::-1]


def integers(rng, d, rank, size):
    rows = [[rng.randint(-size, size) for _ in range(rank)] for _ in range(d)]
    return np.array([[sum(a * b for a, b in zip(x, y, strict=True)) for y in rows] for x in rows], object)


@pytest.mark.parametrize("d, rank, size", [(1, 1, 9), (2, 2, 5), (5, 5, 1000), (6, 3, 10**9), (7, 7, 1), (9, 4, 3), (12, 12, 10**6)])
def test_polynomial(spark, d, rank, size):
    matrix = integers(random.Random(d), d, rank, size)
    assert whitening.polynomial(spark, matrix) == plain_polynomial(matrix)


def test_primes_and_remainders():
    found = whitening.primes(200)
    assert math.prod(found) > 1 << 200 and all(all(p % q for q in range(2, 1000)) for p in found)
    values = [0, 1, -1, 10**50, -(10**55)]
    assert whitening.remaindered({p: [v % p for v in values] for p in found}) == values


def test_blocks_and_permutations():
    """Zero entries where a pivot is wanted."""
    for matrix in ([[0, 0, 1], [0, 2, 0], [1, 0, 0]], [[4, 0, 0, 0], [0, 4, 0, 0], [0, 0, 1, 1], [0, 0, 1, 1]], np.diag([3] * 5).tolist()):
        m = np.array(matrix, object)
        p = 2**31 - 1
        assert whitening.characteristic(m, p) == [c % p for c in plain_polynomial(m)]


def with_roots(roots):
    out = [Fraction(1)]
    for r in roots:
        out = [a - r * b for a, b in zip([Fraction(0), *out], [*out, Fraction(0)], strict=True)]
    scale = math.lcm(*[c.denominator for c in out])
    return [int(c * scale) for c in out]


def test_roots_are_counted_and_isolated():
    close = Fraction(7) + Fraction(1, 10**25)
    found = whitening.Roots(with_roots([0, 0, 3, 3, 3, 7, close, 12, Fraction(1, 3)])).largest(9)
    want = [(12, 1), (close, 1), (7, 1), (3, 3), (Fraction(1, 3), 1)]
    assert [m for _, m in found] == [m for _, m in want]
    for (got, _), (value, _) in zip(found, want, strict=True):
        assert abs(got - value) <= Fraction(value) / 2**155
    assert [m for _, m in whitening.Roots(with_roots([5, 5, 2])).largest(1)] == [2]
    assert whitening.Roots([0, 0, 1]).largest(3) == []


@pytest.mark.parametrize(
    "matrix",
    [
        np.diag([10**12 + 1, 10**12, 10**12 - 1, 5]),
        [[2, 1, 0, 0], [1, 2, 0, 0], [0, 0, 2, 1], [0, 0, 1, 2]],
        [[10**20, 1, 0], [1, 10**20, 1], [0, 1, 10**20]],
        [[1, 1, 1], [1, 1, 1], [1, 1, 1]],
        [[7]],
    ],
)
def test_components_are_unit_null_vectors(spark, matrix):
    m = np.array(np.array(matrix).tolist(), object)
    found = whitening.components(spark, m, len(m))
    values = [float(e) for e, _ in found]
    assert values == sorted(values, reverse=True)
    for k, (e, v) in enumerate(found):
        exact = [Fraction(x) for x in v]
        assert abs(float(sum(x * x for x in exact)) - 1) < 1e-15
        residue = max(abs(sum(int(a) * x for a, x in zip(row, exact, strict=True)) - e * x0) for row, x0 in zip(m, exact, strict=True))
        assert residue < Fraction(e) / 2**50
        for _, w in found[:k]:
            assert abs(float(sum(x * Fraction(y) for x, y in zip(exact, w, strict=True)))) < 1e-15
    assert len(found) == np.linalg.matrix_rank(m.astype(float))


def test_close_eigenvalues_keep_their_vectors(spark):
    """Gaps of 1e-13 of the eigenvalue: a plain solver in doubles mixes such vectors."""
    m = np.array([[10**20, 10**7, 0], [10**7, 10**20, 10**7], [0, 10**7, 10**20]], object)
    vectors = [v for _, v in whitening.components(spark, m, 3)]
    half = math.sqrt(0.5)
    for got, want in zip(vectors, [[0.5, half, 0.5], [half, 0, -half], [0.5, -half, 0.5]], strict=True):
        assert min(max(abs(a - s * b) for a, b in zip(got, want, strict=True)) for s in (1, -1)) < 1e-15


def plain_whitening(rows, count):
    n, sums, matrix = plain_scatter(rows)
    values, vectors = np.linalg.eigh(matrix.astype(float) / n**2)
    out = []
    for row in rows:
        near = np.array([n * x - s for x, s in zip(row, sums, strict=True)], object)
        projected = [float((near / n).astype(float) @ vectors[:, -1 - k] / math.sqrt(values[-1 - k])) for k in range(count)]
        out.append((int((near * near).sum()), projected, [values[-1 - k] / values.sum() for k in range(count)]))
    return out


def grid(vector):
    return [math.floor(1024 * c) + 100000 for c in vector]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], "vec_id long, embedding array<float>, whitened double, at string")


def as_floats(rows):
    return [(i, [float(np.float32(c)) for c in v]) for i, v in rows]


def test_rows_beside_plain_version(spark):
    rng = random.Random(4)
    rows = as_floats([(n, [rng.gauss(0, 1 + k) for k in range(6)]) for n in range(200)] + [(7, [1.0] * 6)] * 3 + [(None, [0.5] * 6)])
    bad = [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, [math.nan] * 6), (305, [math.inf] + [0.0] * 5), (306, [1e30] + [0.0] * 5)]
    found = whitening.whiten(frame(spark, rows + bad).repartition(7), count=4)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = defaultdict(list)
    for r in found.collect():
        assert r.n == len(rows) and r.identity_error < 1e-12
        got[r.vec_id].append(r)
    want = plain_whitening([grid(v) for _, v in rows], 4)
    signs = {}
    by_id = defaultdict(list)
    for (i, _), w in zip(rows, want, strict=True):
        by_id[i].append(w)
    assert set(got) == set(by_id)
    for i, expected in by_id.items():
        assert len(got[i]) == 4 * len(expected)
        deviation, values, shares = expected[0]
        if len({e[0] for e in expected}) > 1:
            continue  # an id with different vectors
        for r in got[i]:
            k = r.component - 1
            assert int(r.deviation) == deviation and r.explained == pytest.approx(shares[k], rel=1e-9)
            if abs(values[k]) > 1e-3:
                sign = signs.setdefault(k, math.copysign(1, r.whitened * values[k]))
                assert r.whitened * sign == pytest.approx(values[k], rel=1e-8, abs=1e-9)


def test_large_entries_stay_exact(spark):
    rows = as_floats([(0, [1e12, 3.0]), (1, [-1e12, 4.0]), (2, [5e11, -7.25])])
    found = {r.vec_id: r for r in whitening.whiten(frame(spark, rows)).filter("component = 1").collect()}
    for (i, _), (deviation, _, _) in zip(rows, plain_whitening([grid(v) for _, v in rows], 1), strict=True):
        assert int(found[i].deviation) == deviation


def test_tables_without_spread(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None), (2, [])]):
        assert whitening.whiten(frame(spark, rows)).count() == 0
    flat = whitening.whiten(frame(spark, [(n, [float(n % 3), 2.0, float(n % 3)]) for n in range(9)])).collect()
    assert {r.component for r in flat} == {1} and max(r.identity_error for r in flat) < 1e-12


def test_query(spark):
    found = op11_whitening(spark, SF).collect()
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = dict(zip([i for i, _ in rows], plain_whitening([grid(v) for _, v in rows], 8), strict=True))
    assert len(found) == 8 * len(rows)
    signs = {}
    for r in found:
        deviation, values, shares = want[r.vec_id]
        k = r.component - 1
        assert (r.n, r.deviation) == (len(rows), deviation) and r.identity_error < 1e-12
        assert r.explained == pytest.approx(shares[k], rel=1e-9)
        if abs(values[k]) > 1e-3:
            sign = signs.setdefault(k, math.copysign(1, r.whitened * values[k]))
            assert r.whitened * sign == pytest.approx(values[k], rel=1e-6)
