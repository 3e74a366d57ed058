"""Bonds, angles and torsions of a small chain by hand."""

import math
import random

from pyspark.sql import functions as F

from helixframe.operators import kernels, points, topology


def test_chain_of_four(spark):
    rows = [("m", 0, "C", 0.0, 0.0, 0.0, 0), ("m", 1, "C", 1.5, 0.0, 0.0, 0), ("m", 2, "S", 1.5, 2.1, 0.0, 0), ("m", 3, "H", 1.5, 2.1, 1.2, 0), ("m", 4, "H", 1.5, 2.1, 1.4 + 1.2, 0), ("m", 5, "C", 0.0, 0.0, 0.3, 0), ("m", 6, "N", 1.5, 0.0, 1.8, 1)]
    atoms = spark.createDataFrame(rows, "structure_id string, ord int, element string, x double, y double, z double, residue_ord int")
    bond = topology.bonds(atoms.where("ord < 4"))
    assert sorted((r.i, r.j) for r in bond.collect()) == [(0, 1), (1, 2), (2, 3)]
    assert sorted((r.i, r.j, r.k) for r in topology.angles(bond).collect()) == [(0, 1, 2), (1, 2, 3)]
    assert [(r.i, r.j, r.k, r.l) for r in topology.torsions(bond).collect()] == [(0, 1, 2, 3)]
    assert {(r.i, r.j): r.apart for r in topology.bound_pairs(bond).collect()} == {(0, 1): 1, (1, 2): 1, (2, 3): 1, (0, 2): 2, (1, 3): 2, (0, 3): 3}
    every = {(r.i, r.j) for r in topology.bonds(atoms, inside=None).collect()}
    assert (0, 5) not in every and (3, 4) not in every and (1, 6) in every  # too near; too far for hydrogen; another residue
    assert (1, 6) not in {(r.i, r.j) for r in topology.bonds(atoms).collect()}
    assert topology.bonds(atoms.limit(0)).count() == 0


def test_structures_in_pairs(spark):
    rows = [(k, i, 3.8 * i, float(i % 3), float(i * i % 5)) for k in (1, 2) for i in range(12)]
    a = spark.createDataFrame(rows, "pair_id int, ord int, x double, y double, z double")
    turned = a.select("pair_id", "ord", F.col("y").alias("x"), (F.col("z") + 5).alias("y"), (F.col("x") - 1).alias("z"))
    got = kernels.align_structures(a, turned).collect()
    assert sorted(r.pair_id for r in got) == [1, 2] and all(r.n_aligned == 12 and r.tm > 0.999 and r.rmsd < 1e-6 for r in got)


def test_pairs_of_small_and_large_structures(spark, monkeypatch):
    """Small structures are not copied into cells; both ways give every pair, also at cell borders and without a place."""
    r = random.Random(5)
    places = [[r.choice((r.uniform(-9, 9), float(r.randint(-9, 9)))) for _ in "xyz"] for _ in range(300)]
    rows = [(k, i, *p) for k, n in ((1, 300), (2, 20), (2, 20)) for i, p in enumerate(places[:n])] + [(2, 50, None, 0.0, 0.0), (2, 51, float("nan"), 0.0, 0.0)]
    a = spark.createDataFrame(rows, "structure_id int, ord int, x double, y double, z double")
    want = sorted((p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and None not in p + q and math.dist(p[2:], q[2:]) <= 3)
    for few, edge in ((256, None), (0, None), (0, 6.0), (10**6, None)):
        monkeypatch.setattr(points, "FEW", few)
        assert sorted(map(tuple, points.within(a, a, 3.0, edge=edge).select("structure_id", "ord_a", "ord_b").collect())) == want
    monkeypatch.setattr(points, "FEW", 256)
    assert points.cells(a.where("structure_id = 2"), a, 3.0)[0].count() == 42 and points.cells(a.where("structure_id = 1"), a, 3.0)[0].count() > 300 * 20


def _bonds_of_ring(spark):
    rows = [("m", i, (i + 1) % 6) for i in range(6)] + [("m", 0, 6), ("m", 0, 6), ("n", 0, 1)]  # one bond is given twice
    return spark.createDataFrame([(s, min(i, j), max(i, j)) for s, i, j in rows], "structure_id string, i int, j int")


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_angles_take_one_pass_over_the_bonds(spark):
    bond = _bonds_of_ring(spark)
    ends = [(r.structure_id, a, b) for r in bond.collect() for a, b in ((r.i, r.j), (r.j, r.i))]
    want = sorted((s, i, j, k) for s, j, i in ends for u, at, k in ends if (s, j) == (u, at) and i < k)
    assert sorted(map(tuple, topology.angles(bond).collect())) == want and _joins(topology.angles(bond)) == 0


def test_torsions_take_one_pass_over_the_bonds(spark):
    bond = _bonds_of_ring(spark)
    ends = [(r.structure_id, a, b) for r in bond.collect() for a, b in ((r.i, r.j), (r.j, r.i))]
    want = sorted((s, i, j, k, n) for s, j, k in map(tuple, bond.collect()) for u, at, i in ends if (u, at) == (s, j) and i != k for v, end, n in ends if (v, end) == (s, k) and n != j and n != i)
    assert sorted(map(tuple, topology.torsions(bond).collect())) == want and _joins(topology.torsions(bond)) == 0


def test_bound_pairs_take_one_pass_over_the_bonds(spark):
    bond = _bonds_of_ring(spark)
    found = {(r.structure_id, r.i, r.j): r.apart for r in topology.bound_pairs(bond).collect()}
    want = {("n", 0, 1): 1} | {("m", i, j): min(j - i, 6 - j + i) for i in range(6) for j in range(i + 1, 6)}
    want |= {("m", i, 6): n + 1 for i, n in ((0, 0), (1, 1), (5, 1), (2, 2), (4, 2))}
    assert found == want and _joins(topology.bound_pairs(bond)) == 0


def test_energies_shuffle_no_pairs(spark):
    """Bound pairs are known to the atoms before pairs are formed; nothing is joined to pairs."""
    rows = [("m", i, 1.5 * i, 0.0, 0.0, 1.5, 0.1, 0.25) for i in range(5)]
    atoms = spark.createDataFrame(rows, "structure_id string, ord int, x double, y double, z double, radius double, depth double, charge double")
    bound = spark.createDataFrame([("m", 0, 1, 1), ("m", 0, 2, 2), ("m", 0, 3, 3)], "structure_id string, i int, j int, apart int")
    out = topology.pair_energies(atoms, bound, 5.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join Inner") < plan.index("Join LeftOuter")
    (r,) = out.collect()
    apart = [(4.5, 0.5, 1 / 1.2), *[(1.5, 1, 1)] * 3, *[(3.0, 1, 1)] * 2, (4.5, 1, 1)]
    assert r.n_pairs == 7
    assert abs(r.vdw - sum(f * 0.1 * ((3 / d) ** 12 - 2 * (3 / d) ** 6) for d, f, _ in apart)) < 1e-6
    assert abs(r.electrostatic - sum(f * 332.0637 * 0.0625 / d for d, _, f in apart)) < 1e-9
