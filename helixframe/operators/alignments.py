"""Structural alignment beyond chains in order: circular permutations, pairs in any order, and complexes of several chains."""

from __future__ import annotations

import numpy as np

from .kernels import kabsch, tm_align, tm_d0, tm_score


def permuted_align(a: np.ndarray, b: np.ndarray) -> tuple[float, int, list[tuple[int, int]]]:
    """TM-score by the length of b, place where a is cut, and pairs, of the best alignment of a or of a circular permutation of it.

    The chain set behind itself holds every permutation; of its alignment the stretch of one length of a with the most pairs gives the
    cut, and the permuted chain is aligned anew. A permutation counts only if it is better than the chain as it is.
    """
    plain, pairs, _, _ = tm_align(a, b)
    best = plain, 0, pairs
    n = len(a)
    twice = tm_align(np.concatenate([a, a]), b)[1]
    if twice and n > 2:
        rows = np.array([i for i, _ in twice])
        cut = max(range(n + 1), key=lambda k: (int(((rows >= k) & (rows < k + n)).sum()), -k)) % n
        if cut:
            order = np.r_[cut:n, 0:cut]
            score, found, _, _ = tm_align(a[order], b)
            if score > best[0] + 1e-9:
                best = score, cut, sorted((int(order[i]), j) for i, j in found)
    return best


def _matched(near: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Pairs by growing distance, each row and column once."""
    i, j = np.nonzero(near <= reach)
    order = np.lexsort((j, i, near[i, j]))
    rows, columns, out = set(), set(), []
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if x not in rows and y not in columns:
            rows.add(x)
            columns.add(y)
            out.append((x, y))
    return sorted(out)


def unordered_align(a: np.ndarray, b: np.ndarray, rounds: int = 20) -> tuple[float, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """TM-score by the length of b, pairs in any order, rotation and shift: from the alignment in order, partners are the nearest points of each
    superposition, each once, until the score no longer grows."""
    score, pairs, r, t = tm_align(a, b)
    best = score, pairs, r, t
    reach = max(tm_d0(len(b)) * 2, 4.0)
    for _ in range(rounds):
        distance = np.sqrt(np.square((a @ r.T + t)[:, None] - b[None]).sum(axis=2))
        pairs = _matched(distance, reach)
        if len(pairs) < 3:
            break
        i, j = (np.array(x) for x in zip(*pairs, strict=True))
        score, r, t = tm_score(a[i], b[j], len(b))
        if score <= best[0] + 1e-9:
            break
        best = score, pairs, r, t
    return best


def complex_align(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> tuple[float, dict[str, str], np.ndarray, np.ndarray]:
    """TM-score by the length of b, chains assigned, rotation and shift, of two complexes under one superposition.

    Each pair of chains is aligned by itself; a start is the superposition of one such pair, under which the other chains are assigned by
    their own pairs' mean closeness, the best first and each once; all pairs of the assigned chains then give one superposition.
    """
    length = sum(map(len, b.values()))
    own = {(p, q): tm_align(x, y) for p, x in a.items() for q, y in b.items()}
    best: tuple[float, dict[str, str], np.ndarray, np.ndarray] = (0.0, {}, np.eye(3), np.zeros(3))
    for _, _, r, t in (v for _, v in sorted(own.items(), key=lambda x: -x[1][0])[: 4 * len(b)]):
        closeness = []
        for (p, q), (_, pairs, _, _) in own.items():
            if len(pairs) > 2:
                i, j = (np.array(x) for x in zip(*pairs, strict=True))
                d = np.square(a[p][i] @ r.T + t - b[q][j]).sum(axis=1)
                closeness.append((float((1 / (1 + d / tm_d0(length) ** 2)).sum()), p, q))
        assigned: dict[str, str] = {}
        for _, p, q in sorted(closeness, key=lambda x: (-x[0], x[1], x[2])):
            if p not in assigned and q not in assigned.values():
                assigned[p] = q
        if not assigned:
            continue
        x = np.concatenate([a[p][[i for i, _ in own[p, q][1]]] for p, q in sorted(assigned.items())])
        y = np.concatenate([b[q][[j for _, j in own[p, q][1]]] for p, q in sorted(assigned.items())])
        score, r, t = tm_score(x, y, length)
        if score > best[0] + 1e-9:
            best = score, assigned, r, t
    return best


def hinged_align(a: np.ndarray, b: np.ndarray, most: int = 3, least: int = 5) -> list[tuple[int, int, float, np.ndarray, np.ndarray]]:
    """Rigid pieces of a's alignment with b: (first pair, behind the last, RMSD, rotation, shift), cut at most so often where that lowers the deviation most."""
    pairs = tm_align(a, b)[1]
    if len(pairs) < 3:
        return []
    i, j = (np.array(x) for x in zip(*pairs, strict=True))
    fit = lambda lo, hi: kabsch(a[i[lo:hi]], b[j[lo:hi]])
    square = lambda lo, hi: fit(lo, hi)[0] ** 2 * (hi - lo)
    cuts = [0, len(pairs)]
    for _ in range(most):
        gains = [(square(lo, hi) - square(lo, k) - square(k, hi), -k) for lo, hi in zip(cuts, cuts[1:], strict=False) for k in range(lo + least, hi - least + 1)]
        if not gains or max(gains)[0] < 0.5 * sum(square(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False)) or max(gains)[0] < 1.0:
            break
        cuts = sorted([*cuts, -max(gains)[1]])
    return [(lo, hi, *fit(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
