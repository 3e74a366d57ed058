"""Geometry as column expressions: points are three double columns, so every formula stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(prefix: str = "", suffix: str = "") -> Vector:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def angle(a: Vector, b: Vector) -> Column:
    """Degrees between two directions; null if one has no length."""
    length = norm(a) * norm(b)
    ratio = dot(a, b) / F.when(length > 0, length)
    ratio = F.when(ratio > 1, 1.0).when(ratio < -1, -1.0).otherwise(ratio)
    return F.degrees(F.acos(ratio))


def dihedral(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """Signed degrees about b-c; 0 where three points lie in a line."""
    u, v, w = minus(b, a), minus(c, b), minus(d, c)
    m, n = cross(u, v), cross(v, w)
    flat = (norm(m) < 1e-12) | (norm(n) < 1e-12)
    y = dot(u, n) * norm(v)
    return F.when(flat, F.lit(0.0)).otherwise(F.degrees(F.atan2(y, dot(m, n))))


def tm_d0(length: Column, least: float = 0.5) -> Column:
    """Distance scale of the TM-score for chains of a length; 0.5 at least."""
    return F.when(length > 21, F.greatest(F.lit(least), 1.24 * F.pow(length - 15, F.lit(1.0 / 3.0)) - 1.8)).otherwise(F.lit(least))


def transformed(p: Vector, rotation: list[list[float]], shift: list[float]) -> Vector:
    return tuple(sum((F.lit(float(r)) * c for r, c in zip(row, p, strict=True)), F.lit(float(t))) for row, t in zip(rotation, shift, strict=True))


def hbond_energy(n: Vector, h: Vector, c: Vector, o: Vector) -> Column:
    """Electrostatic energy (kcal/mol) between an amide N-H and a carbonyl C=O; 0 if two atoms coincide."""
    on, ch, oh, cn = distance(o, n), distance(c, h), distance(o, h), distance(c, n)
    near = F.least(on, ch, oh, cn) < 0.01
    return F.when(near, F.lit(0.0)).otherwise(27.888 * (1 / on + 1 / ch - 1 / oh - 1 / cn))
