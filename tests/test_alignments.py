"""Alignments beyond chains in order, on turned, permuted and reassembled chains."""

import numpy as np
import pytest

from helixframe.operators import alignments


def chain(seed, n):
    r = np.random.default_rng(seed)
    steps = r.normal(size=(n, 3))
    return np.cumsum(3.8 * steps / np.linalg.norm(steps, axis=1)[:, None], axis=0)


def turn(x, seed=0):
    r = np.random.default_rng(seed)
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    return x @ q.T + r.normal(size=3) * 20


def test_circular_permutation():
    a = chain(1, 40)
    score, cut, pairs = alignments.permuted_align(np.r_[a[25:], a[:25]], turn(a))
    assert score > 0.99 and cut == 15 and sorted(pairs) == sorted([(i, i + 25) for i in range(15)] + [(i + 15, i) for i in range(25)])
    score, cut, pairs = alignments.permuted_align(a, turn(a))
    assert score > 0.99 and cut == 0 and pairs == [(i, i) for i in range(40)]


def test_any_order():
    a = chain(2, 36)
    b = turn(np.r_[a[24:], a[:24]])
    score, pairs, r, t = alignments.unordered_align(a, b)
    assert score > 0.99 and len(pairs) == 36 and all((i + 12) % 36 == j for i, j in pairs)
    assert np.allclose(a @ r.T + t, np.r_[b[12:], b[:12]], atol=1e-3)


def test_complexes():
    one = {"A": chain(3, 25), "B": chain(4, 30) + 15, "C": chain(5, 20) - 12}
    whole = turn(np.concatenate([one["B"], one["C"], one["A"]]), 7)
    two = {"x": whole[:30], "y": whole[30:50], "z": whole[50:]}
    score, assigned, _, _ = alignments.complex_align(one, two)
    assert assigned == {"A": "z", "B": "x", "C": "y"} and score == pytest.approx(1.0, abs=1e-3)


def test_hinge():
    a = chain(6, 60)
    b = np.r_[a[:30], turn(a[30:] - a[29], 3) * 1.0]
    b[30:] += b[29] - b[30] + 3.8
    pieces = alignments.hinged_align(a, a)
    assert [(lo, hi) for lo, hi, *_ in pieces] == [(0, 60)] and pieces[0][2] < 1e-6
    both = alignments.hinged_align(a, b)
    assert all(hi - lo >= 5 or len(both) == 1 for lo, hi, *_ in both)
