"""Windows along chains: rows (structure_id, chain_id, ord, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import geometry as g

BREAK = 4.5
KEY = ["structure_id", "chain_id"]


def along(key: list[str] = KEY) -> WindowSpec:
    return Window.partitionBy(*key).orderBy("ord")


def shifted(n: int, w: WindowSpec, prefix: str = "", suffix: str = "") -> g.Vector:
    """The point n places on (negative: before)."""
    move = F.lead if n > 0 else F.lag
    return tuple(move(F.col(f"{prefix}{c}{suffix}"), abs(n)).over(w) if n else F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def segments(trace: DataFrame, limit: float = BREAK, key: list[str] = KEY) -> DataFrame:
    """is_break: the step from the point before is longer than limit; segment: breaks so far in the chain."""
    w = along(key)
    step = g.distance(g.vector(), shifted(-1, w))
    out = trace.withColumn("is_break", F.coalesce((step > limit).cast("int"), F.lit(0)))
    return out.withColumn("segment", F.sum("is_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def trace_dihedrals(trace: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Dihedral of four points in a row, at the second; null at the ends."""
    w = along(key)
    return trace.withColumn("dihedral", g.dihedral(shifted(-1, w), g.vector(), shifted(1, w), shifted(2, w)))


def _whole(*columns: Column) -> Column:
    out = columns[0].isNotNull()
    for c in columns[1:]:
        out = out & c.isNotNull()
    return out


def backbone_dihedrals(residues: DataFrame, limit: float = BREAK) -> DataFrame:
    """phi, psi and omega in degrees of residues with N, CA and C; null at chain ends and where CA-CA passes limit.

    residues: structure_id, chain_id, ord and nx..cz columns (n, ca, c).
    """
    w = along()
    at = lambda atom, n: tuple((F.lead if n > 0 else F.lag)(f"{atom}{c}", abs(n)).over(w) if n else F.col(f"{atom}{c}") for c in "xyz")
    kept = residues.where(_whole(*[F.col(f"{a}{c}") for a in ("n", "ca", "c") for c in "xyz"]))
    before, after = g.distance(at("ca", 0), at("ca", -1)) <= limit, g.distance(at("ca", 0), at("ca", 1)) <= limit
    return kept.select(
        *KEY, "ord",
        F.when(before, g.dihedral(at("c", -1), at("n", 0), at("ca", 0), at("c", 0))).alias("phi"),
        F.when(after, g.dihedral(at("n", 0), at("ca", 0), at("c", 0), at("n", 1))).alias("psi"),
        F.when(before, g.dihedral(at("ca", -1), at("c", -1), at("n", 0), at("ca", 0))).alias("omega"),
    )


def supervision_torsions(residues: DataFrame) -> DataFrame:
    """phi, psi, omega in radians with masks: 0 and mask 0 where an atom is missing. Breaks are not looked for."""
    w = along()
    at = lambda atom, n: tuple((F.lead if n > 0 else F.lag)(f"{atom}{c}", abs(n)).over(w) if n else F.col(f"{atom}{c}") for c in "xyz")
    quads = {"phi": (at("c", -1), at("n", 0), at("ca", 0), at("c", 0)), "psi": (at("n", 0), at("ca", 0), at("c", 0), at("n", 1)), "omega": (at("ca", -1), at("c", -1), at("n", 0), at("ca", 0))}
    out = [F.col(c) for c in [*KEY, "ord"]]
    for name, quad in quads.items():
        there = _whole(*[c for p in quad for c in p])
        out += [F.when(there, F.radians(g.dihedral(*quad))).otherwise(0.0).alias(name), there.cast("double").alias(f"{name}_mask")]
    return residues.select(*out)


def bends(trace: DataFrame, limit: float = 70.0, key: list[str] = KEY) -> DataFrame:
    """kappa: angle between the steps from two before and to two after; is_bend above limit."""
    w = along(key)
    kappa = g.angle(g.minus(g.vector(), shifted(-2, w)), g.minus(shifted(2, w), g.vector()))
    return trace.withColumn("kappa", kappa).withColumn("is_bend", F.coalesce((F.col("kappa") > limit).cast("int"), F.lit(0)))


def trace_structure(trace: DataFrame, key: list[str] = KEY, smooth: bool = True) -> DataFrame:
    """Secondary structure from six distances among five CA in a row: H, E, T or C; smooth: see smoothed().

    Fixed values: ideal helix 5.45 (d13, d24, d35), 5.18 (d14, d25), 6.37 (d15) within 2.1;
    ideal strand 6.1, 10.4, 13.0 within 1.42; a turn has d15 below 8.
    """
    w = along(key)
    p = {n: shifted(n, w) for n in (-2, -1, 0, 1, 2)}
    d = {(i, j): g.distance(p[i], p[j]) for i, j in ((-2, 0), (-1, 1), (0, 2), (-2, 1), (-1, 2), (-2, 2))}

    def near(three: float, four: float, five: float, by: float) -> Column:
        ideal = {(-2, 0): three, (-1, 1): three, (0, 2): three, (-2, 1): four, (-1, 2): four, (-2, 2): five}
        out = F.lit(True)
        for k, v in ideal.items():
            out = out & (F.abs(d[k] - v) < by)
        return out

    five = _whole(p[-2][0], p[2][0])
    state = F.when(~five, "C").when(near(5.45, 5.18, 6.37, 2.1), "H").when(near(6.1, 10.4, 13.0, 1.42), "E").when(d[-2, 2] < 8.0, "T").otherwise("C")
    out = trace.withColumn("state", state)
    return smoothed(out, key) if smooth else out


def smoothed(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Helix and strand states without single ones and lone pairs (both become C), then with gaps of one filled from both sides.

    A state counts as single, or two as a pair, only with two others on each side within the chain. Gaps are filled from the front, so
    that where helix and strand alternate every second place is filled: the odd ones of the alternating run, but for its last.
    """
    w = along(key)
    s = F.col("state")
    core = s.isin("H", "E")

    def other(*steps: int) -> Column:
        out = F.lit(True)
        for n in steps:
            out = out & F.coalesce(F.lag("state", -n).over(w) != s, F.lit(False))
        return out

    same = lambda n: F.lag("state", -n).over(w) == s
    rows = rows.withColumn("state", F.when(core & other(-2, -1, 1, 2), "C").otherwise(s))
    pair = same(1) & other(-2, -1, 2, 3) | same(-1) & other(-3, -2, 1, 2)
    rows = rows.withColumn("state", F.when(core & F.coalesce(pair, F.lit(False)), "C").otherwise(s))
    before, after = F.lag("state").over(w), F.lead("state").over(w)
    turns = core & before.isin("H", "E") & (before != s)
    rows = rows.withColumn("_start", F.when(F.coalesce(turns, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key, "_run").orderBy("ord")) - 1)
    between = (before == after) & before.isin("H", "E") & (before != s)
    fill = between & (~core | (F.col("_place") % 2 == 1))
    length = F.count("*").over(Window.partitionBy(*key))
    return rows.withColumn("state", F.when(F.coalesce(fill, F.lit(False)) & (length >= 5), before).otherwise(s)).drop("_start", "_run", "_place")


def amide_hydrogens(residues: DataFrame) -> DataFrame:
    """hx, hy, hz: 1.01 from N, along the bisector away from the C before and the CA; null for the first residue of a chain and PRO."""
    w = along()
    n, ca = g.vector("n"), g.vector("ca")
    before = tuple(F.lag(f"c{c}").over(w) for c in "xyz")
    unit = lambda v: tuple(c / F.when(g.norm(v) > 0, g.norm(v)) for c in v)
    a, b = unit(g.minus(n, before)), unit(g.minus(n, ca))
    both = unit(tuple(p + q for p, q in zip(a, b, strict=True)))
    there = F.col("residue_name") != "PRO"
    return residues.withColumns({f"h{c}": F.when(there, p + 1.01 * u) for c, p, u in zip("xyz", n, both, strict=True)})


def islands(rows: DataFrame, value: str, key: list[str] = KEY) -> DataFrame:
    """Runs of equal neighbours: chain, value, first and last ord, and length."""
    w = along(key)
    runs = rows.withColumn("changed", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, "run", value).agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count("*").alias("length")).drop("run")
