"""Tensors of residues, frames and energies against plain rules."""

import numpy as np
import pytest

from helixframe.operators import atoms as at
from helixframe.operators import physics
from helixframe.operators import supervision as s
from helixframe.sources import structures
from tests.test_structures import small_pdb


def test_tables():
    assert len(s.ATOM37) == 37 and all(len(x) <= 14 for x in s._ATOM14.values()) and s.AATYPE["ALA"] == 0 and s.AATYPE["VAL"] == 17
    assert [s.AATYPE[x] for x in ("CYS", "GLY", "LYS", "ARG", "TYR")] == [1, 5, 8, 14, 19] and s._ATOM14["UNK"] == [] and len(s._ATOM14) == 21
    assert s._CHI["LYS"][3] == ["CG", "CD", "CE", "NZ"] and s._CHI["SER"] == [["N", "CA", "CB", "OG"]]


def test_residue_tensors():
    r = np.random.default_rng(1)
    placed = {a: r.normal(size=3) for a in s._ATOM14["ASP"]} | {"XX": np.zeros(3)}
    t = s.residue_tensors("ASP", placed)
    assert t["atom37_mask"].sum() == 8 and t["atom14_mask"].sum() == 8 and t["chi_mask"].tolist() == [1, 1, 0, 0]
    i, j = s._ATOM14["ASP"].index("OD1"), s._ATOM14["ASP"].index("OD2")
    assert (t["atom14_alt_positions"][i] == placed["OD2"]).all() and t["atom14_ambiguous"].sum() == 2 and t["atom14_ambiguous"][j] == 1
    assert t["rigidgroups_exists"].tolist() == [1, 0, 0, 1, 1, 1, 0, 0] and t["rigidgroups_ambiguous"].argmax() == 5
    for f in t["rigidgroups_frames"]:
        assert np.allclose(f[:3, :3] @ f[:3, :3].T, np.eye(3)) and np.linalg.det(f[:3, :3]) == pytest.approx(1)
    back = t["rigidgroups_frames"][0]
    assert np.allclose(back[:3, 3], placed["CA"]) and np.allclose(back[:3, 0] * np.linalg.norm(placed["C"] - placed["CA"]), placed["C"] - placed["CA"])
    unknown = s.residue_tensors("XYZ", placed)
    assert unknown["atom14_mask"].sum() == 0 and unknown["atom37_mask"].sum() == 8


def test_examples(spark, tmp_path):
    (tmp_path / "one.pdb").write_text(small_pdb())
    a = at.primary(structures.atoms(structures.read(spark, f"{tmp_path}/one.pdb")))
    rows = s.examples(a).collect()
    assert len(rows) == 1 and rows[0].chain_id == "A"
    first = rows[0]
    assert first.length == len(first.atom37_mask) and first.sequence[1:3] == "AG" and sum(first.atom37_mask[1]) == 4


def test_forces():
    r = np.random.default_rng(2)
    n = 7
    x = np.cumsum(r.normal(size=(n, 3)) * 0.5 + [1.2, 0, 0], axis=0)
    top = physics.Topology(
        bonds=np.array([[i, i + 1, 50.0, 1.4] for i in range(n - 1)]), angles=np.array([[i, i + 1, i + 2, 20.0, 1.9] for i in range(n - 2)]), torsions=np.array([[i, i + 1, i + 2, i + 3, 1.5, 3, 0.4] for i in range(n - 3)]),
        radius=np.full(n, 1.5), depth=np.full(n, 0.1), charge=r.normal(size=n) * 0.2, mass=np.full(n, 12.0),
        scaled={(i, j): (0.0, 0.0) if j - i < 3 else (0.5, 0.8) for i in range(n) for j in range(i + 1, n) if j - i <= 3},
    )
    e, f = physics.energy(x, top)
    for i in range(n):
        for c in range(3):
            up, down = x.copy(), x.copy()
            up[i, c] += 1e-5
            down[i, c] -= 1e-5
            slope = (physics.energy(up, top)[0]["total"] - physics.energy(down, top)[0]["total"]) / 2e-5
            assert f[i, c] == pytest.approx(-slope, rel=1e-3, abs=1e-3)
    for method in ("sd", "cg", "lbfgs"):
        got, low, steps, ok = physics.minimise(x, top, method, steps=3000, tolerance=0.05)
        assert low["total"] < e["total"] and (ok or method == "sd")
    frames = list(physics.dynamics(got, top, 200, dt=0.0005, temperature=100, every=50))
    assert len(frames) == 5 and abs(frames[-1]["total"] - frames[0]["total"]) < 0.05 * abs(frames[0]["kinetic"]) + 0.05


def test_near_pairs_equal_all_pairs():
    r = np.random.default_rng(4)
    for spread in (3, 10, 30):
        for n in (0, 1, 2, 150):
            x = r.normal(0, spread, (n, 3))
            i, j = np.triu_indices(n, 1)
            near = np.square(x[i] - x[j]).sum(axis=1) < 25
            a, b = physics.near_pairs(x, 5.0)
            assert (a == i[near]).all() and (b == j[near]).all()
