"""Energies, minimisation and dynamics of one structure with given parameters.

A topology lists bonds, angles, torsions and excluded or scaled pairs with their constants; it comes from tables, not from code.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterator

import numpy as np

#: Coulomb constant in kcal Å / (mol e²), gas constant in kcal / (mol K), kcal/mol/Å/u in Å/ps².
COULOMB, GAS, FORCE_TO_ACCELERATION = 332.0637, 0.0019872041, 418.4


@dataclasses.dataclass
class Topology:
    """bonds (i, j, k, r0): k (r - r0)²; angles (i, j, k, c, t0): c (t - t0)²; torsions (i, j, k, l, v, n, phase): v (1 + cos(n p - phase));
    radius and depth of each atom (minimum distance halved, well depth), charges, and a factor for the pairs that aren't free."""

    bonds: np.ndarray
    angles: np.ndarray
    torsions: np.ndarray
    radius: np.ndarray
    depth: np.ndarray
    charge: np.ndarray
    mass: np.ndarray
    scaled: dict[tuple[int, int], tuple[float, float]]
    cutoff: float = 12.0

    def pairs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs within the cutoff with their factors for van der Waals and charges."""
        i, j = near_pairs(x, self.cutoff)
        vdw, coulomb = np.ones(len(i)), np.ones(len(i))
        if self.scaled:
            (a, b), factors = np.array(list(self.scaled)).T, np.array(list(self.scaled.values()))
            code = a * len(x) + b
            order = np.argsort(code)
            own = i * len(x) + j
            at = np.minimum(np.searchsorted(code[order], own), len(code) - 1)
            hit = code[order][at] == own
            vdw[hit], coulomb[hit] = factors[order][at[hit]].T
        return i, j, vdw, coulomb


def near_pairs(x: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j nearer than the cutoff, in order: each point is compared with those of its own and half of the neighbouring cells."""
    if len(x) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cell = np.floor((x - x.min(axis=0)) / cutoff).astype(np.int64) + 1
    width = cell.max(axis=0) + 2
    key = (cell[:, 0] * width[1] + cell[:, 1]) * width[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    keys = key[order]
    found = []
    for dx, dy, dz in itertools.product((-1, 0, 1), repeat=3):
        step = (dx * width[1] + dy) * width[2] + dz
        if step < 0:
            continue
        low, high = np.searchsorted(keys, key + step, "left"), np.searchsorted(keys, key + step, "right")
        n = high - low
        first = np.repeat(np.arange(len(x)), n)
        other = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        if step == 0:
            first, other = first[first < other], other[first < other]
        near = np.square(x[first] - x[other]).sum(axis=1) < cutoff**2
        found.append((first[near], other[near]))
    a, b = (np.concatenate(c) for c in zip(*found, strict=True))
    i, j = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((j, i))
    return i[order], j[order]


def _cols(table: np.ndarray, n: int) -> tuple:
    table = np.asarray(table, float).reshape(-1, n + 2 if n < 4 else n + 3)
    return (*[table[:, k].astype(int) for k in range(n)], *[table[:, k] for k in range(n, table.shape[1])])


def energy(x: np.ndarray, top: Topology) -> tuple[dict[str, float], np.ndarray]:
    """Energy by component with its total, and forces."""
    force = np.zeros_like(x)
    out = {}
    i, j, k, r0 = _cols(top.bonds, 2)
    d = x[i] - x[j]
    r = np.sqrt(np.square(d).sum(axis=1))
    out["bond_stretch"] = float((k * (r - r0) ** 2).sum())
    f = (-2 * k * (r - r0) / np.maximum(r, 1e-12))[:, None] * d
    np.add.at(force, i, f)
    np.add.at(force, j, -f)

    i, j, l, k, t0 = _cols(top.angles, 3)
    u, v = x[i] - x[j], x[l] - x[j]
    nu, nv = np.linalg.norm(u, axis=1), np.linalg.norm(v, axis=1)
    cos = np.clip((u * v).sum(axis=1) / np.maximum(nu * nv, 1e-12), -1, 1)
    t = np.arccos(cos)
    out["angle_bend"] = float((k * (t - t0) ** 2).sum())
    slope = (2 * k * (t - t0) / np.maximum(np.sqrt(1 - cos**2), 1e-8))[:, None]
    fi = slope * (v / (nu * nv)[:, None] - cos[:, None] * u / (nu**2)[:, None])
    fl = slope * (u / (nu * nv)[:, None] - cos[:, None] * v / (nv**2)[:, None])
    for at, f in ((i, fi), (l, fl), (j, -fi - fl)):
        np.add.at(force, at, f)

    a, b, c, d4, v, n, phase = _cols(top.torsions, 4)
    b1, b2, b3 = x[b] - x[a], x[c] - x[b], x[d4] - x[c]
    m, q = np.cross(b1, b2), np.cross(b2, b3)
    length = np.linalg.norm(b2, axis=1)
    p = np.arctan2((b1 * q).sum(axis=1) * length, (m * q).sum(axis=1))
    out["torsion"] = float((v * (1 + np.cos(n * p - phase))).sum())
    slope = v * n * np.sin(n * p - phase)  # minus the derivative
    mm, qq = np.maximum(np.square(m).sum(axis=1), 1e-12), np.maximum(np.square(q).sum(axis=1), 1e-12)
    fa = (-slope * length / mm)[:, None] * m
    fd = (slope * length / qq)[:, None] * q
    s, w = ((b1 * b2).sum(axis=1) / length**2)[:, None], ((b3 * b2).sum(axis=1) / length**2)[:, None]
    fb = -fa - s * fa + w * fd
    for at, f in ((a, fa), (d4, fd), (b, fb), (c, -fa - fb - fd)):
        np.add.at(force, at, f)

    i, j, by_vdw, by_charge = top.pairs(x)
    d = x[i] - x[j]
    r2 = np.square(d).sum(axis=1)
    r = np.sqrt(r2)
    ratio = ((top.radius[i] + top.radius[j]) / r) ** 6
    well = by_vdw * np.sqrt(top.depth[i] * top.depth[j])
    out["vdw"] = float((well * (ratio**2 - 2 * ratio)).sum())
    charge = by_charge * COULOMB * top.charge[i] * top.charge[j] / r
    out["electrostatic"] = float(charge.sum())
    f = ((12 * well * (ratio**2 - ratio) + charge) / r2)[:, None] * d
    np.add.at(force, i, f)
    np.add.at(force, j, -f)
    out["total"] = sum(out.values())
    return out, force


def minimise(x: np.ndarray, top: Topology, method: str = "cg", steps: int = 200, tolerance: float = 0.1) -> tuple[np.ndarray, dict[str, float], int, bool]:
    """Places, energy, steps and whether the greatest force fell below tolerance. method: sd (steepest descent), cg or lbfgs."""
    x = x.copy()
    e, f = energy(x, top)
    direction, step, memory = f.copy(), 0.01, []
    for k in range(steps):
        if np.abs(f).max() < tolerance:
            return x, e, k, True
        if (direction * f).sum() <= 0:
            direction, memory = f.copy(), []
        size = min(step, 0.2 / max(np.abs(direction).max(), 1e-12)) if method != "lbfgs" or not memory else min(1.0, 0.2 / max(np.abs(direction).max(), 1e-12))
        while True:
            new = x + size * direction
            ne, nf = energy(new, top)
            if ne["total"] <= e["total"] - 1e-4 * size * (direction * f).sum() or size < 1e-12:
                break
            size /= 2
        if size < 1e-12:
            return x, e, k, False
        if method == "cg":
            beta = max(0.0, float((nf * (nf - f)).sum() / max((f * f).sum(), 1e-30)))
            direction = nf + beta * direction
        elif method == "lbfgs":
            s, y = new - x, f - nf
            if (s * y).sum() > 1e-12:
                memory = [*memory, (s, y)][-8:]
            q, alphas = nf.copy(), []
            for s, y in reversed(memory):
                a = (s * q).sum() / (s * y).sum()
                alphas.append(a)
                q -= a * y
            if memory:
                s, y = memory[-1]
                q *= (s * y).sum() / (y * y).sum()
            for (s, y), a in zip(memory, reversed(alphas), strict=True):
                q += s * (a - (y * q).sum() / (s * y).sum())
            direction = q
        else:
            direction = nf.copy()
        step = size * 2
        x, e, f = new, ne, nf
    return x, e, steps, bool(np.abs(f).max() < tolerance)


def dynamics(x: np.ndarray, top: Topology, steps: int, dt: float = 0.001, temperature: float = 300.0, every: int = 10, coupling: float | None = None, seed: int = 0) -> Iterator[dict]:
    """Frames (step, time in ps, kinetic, potential and total energy, temperature, places) of velocity-Verlet dynamics; coupling: time of a weak thermostat in ps."""
    r, mass = np.random.default_rng(seed), top.mass[:, None]
    v = r.normal(size=x.shape) * np.sqrt(GAS * temperature / mass * FORCE_TO_ACCELERATION)
    v -= (mass * v).sum(axis=0) / mass.sum()
    x, (e, f) = x.copy(), energy(x, top)
    for k in range(steps + 1):
        kinetic = float(0.5 * (mass * v * v).sum() / FORCE_TO_ACCELERATION)
        now = 2 * kinetic / (3 * len(x) * GAS)
        if k % every == 0:
            yield {"step": k, "time_ps": k * dt, "kinetic": kinetic, "potential": e["total"], "total": kinetic + e["total"], "temperature": now, "places": x.copy()}
        if k == steps:
            return
        v += 0.5 * dt * f / mass * FORCE_TO_ACCELERATION
        x += dt * v
        e, f = energy(x, top)
        v += 0.5 * dt * f / mass * FORCE_TO_ACCELERATION
        if coupling and now > 0:
            v *= np.sqrt(max(0.0, 1 + dt / coupling * (temperature / now - 1)))
