"""Readers, hierarchy, selection and chain windows on small hand-written structures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import atoms as at
from helixframe.operators import chains, points, selection
from helixframe.sources import sequences, sinks, structures


def atom_line(serial, name, res, chain, number, xyz, record="ATOM", alt=" ", icode=" ", element="C"):
    padded = f" {name:<3}" if len(name) < 4 else name
    return f"{record:<6}{serial:>5} {padded}{alt}{res:>3} {chain}{number:>4}{icode}   {xyz[0]:8.3f}{xyz[1]:8.3f}{xyz[2]:8.3f}{1.0:6.2f}{20.0:6.2f}          {element:>2}"


def small_pdb():
    lines, s = ["HEADER    TEST"], 1
    for i in range(6):
        base = 3.8 * i + (12 if i >= 4 else 0)
        for name, off, el in (("N", (0, 0.5, 0), "N"), ("CA", (1.2, 0.1 * i, 0.2), "C"), ("C", (2.4, 0.4, -0.1 * i), "C"), ("O", (2.4, 1.6, 0), "O")):
            lines.append(atom_line(s, name, "GLY" if i == 2 else "ALA", "A", i + 1, (base + off[0], off[1], off[2]), element=el))
            s += 1
    for alt, dx in (("B", 0.5), ("A", 0.0)):
        lines.append(atom_line(s, "CB", "ALA", "A", 1, (1 + dx, -1, 0), alt=alt))
        s += 1
    lines.append(atom_line(s, "H", "ALA", "A", 1, (0, 1.4, 0), element="H"))
    lines.append(atom_line(s + 1, "O", "HOH", "B", 101, (0, 30, 0), record="HETATM", element="O"))
    lines.append(atom_line(s + 2, "ZN", "ZN", "B", 102, (0, 33, 0), record="HETATM", element="ZN"))
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "one.pdb").write_text(small_pdb())
    (d / "two.pdb").write_text("MODEL        1\n" + small_pdb() + "ENDMDL\nMODEL        2\n" + small_pdb() + "ENDMDL\n")
    (d / "bad.pdb").write_text("ATOM      1  N   ALA A   x       0.000   0.000   0.000\n")
    (d / "none.pdb").write_text("HEADER only\n")
    cif = "data_x\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.type_symbol\n_atom_site.auth_atom_id\n_atom_site.label_alt_id\n_atom_site.auth_comp_id\n_atom_site.auth_asym_id\n_atom_site.auth_seq_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\n_atom_site.pdbx_PDB_model_num\n"
    cif += "ATOM 1 N N . ALA A 1 0.0 0.5 0.0 1\nATOM 2 C CA . ALA A 1 1.2 0.0 0.2 1\nHETATM 3 O \"O5'\" . LIG B 7 4 5 6 1\n#\n"
    (d / "three.cif").write_text(cif)
    return structures.read(spark, [str(d)]).cache()


def test_read(table):
    a = structures.atoms(table)
    n = {r.structure_id: r["count"] for r in a.groupBy("structure_id").count().collect()}
    assert n == {"one": 29, "two": 58, "three": 3}
    assert {r.path.rsplit("/", 1)[1] for r in structures.failures(table).collect()} == {"bad.pdb", "none.pdb"}
    with pytest.raises(Exception, match="bad.pdb|none.pdb"):
        structures.atoms(table, strict=True).count()
    assert a.where("structure_id = 'three' and is_hetero").first().atom_name == "O5'"
    cat = {r.structure_id: r for r in at.catalog(a).collect()}
    assert (cat["one"].atom_count, cat["one"].residue_count, cat["one"].chain_count, cat["one"].chains, cat["two"].model_count, cat["two"].atom_count) == (29, 9, 2, "A,B", 2, 29)


def test_primary_conformer(table):
    a = structures.atoms(table)
    p = at.primary(a.where("structure_id = 'two'"))
    assert p.where("conformer_id is not null").count() == 0 or {r.conformer_id for r in p.where("atom_name = 'CB'").collect()} <= {"A", None}
    assert p.select("model").distinct().count() == 1


def test_selection(table):
    a = structures.atoms(table).where("structure_id = 'one'").cache()
    rows = a.collect()

    def count(q):
        return a.where(selection.select(q)).count()

    assert count("") == count("all") == len(rows)
    assert count("CA and chain A") == 6 and count("name CA and resid 2-4") == 3 and count("resid 101") == 1
    assert count("(chain A or chain B) and not hydrogen and resid 1-3") == sum(r.residue_serial in (1, 2, 3) and r.element != "H" for r in rows)
    assert count("water") == 1 and count("hetero") == 1 and count("hydrogen") == 1 and count("not protein") == 2 and count("resname gly") == 4
    assert count("chain A and backbone or chain B and water") == 25
    for bad in ("resid -5", "resid x", "(chain A", "chain", "chain A chain B", "and"):
        with pytest.raises(selection.SelectionError):
            selection.select(bad)


def test_chain_windows(table):
    a = at.primary(structures.atoms(table).where("structure_id = 'one'"))
    ca = at.trace(a)
    seg = [r.segment for r in chains.segments(ca).orderBy("ord").collect()]
    assert seg == [0, 0, 0, 0, 1, 1]
    d = chains.backbone_dihedrals(at.residues(a)).orderBy("ord").collect()
    assert d[0].phi is None and d[3].psi is None and d[4].phi is None and d[5].psi is None and d[1].phi is not None
    s = chains.supervision_torsions(at.residues(a)).where("chain_id = 'A'").orderBy("ord").collect()
    assert s[0].phi == 0 and s[0].phi_mask == 0 and s[4].phi_mask == 1
    assert s[1].phi == pytest.approx(math.radians(d[1].phi))
    b = {r.ord: r for r in at.pseudo_beta(at.residues(a)).collect()}
    assert b[2].beta_mask == 1 and b[1].beta_mask == 0


def test_known_dihedrals(spark):
    rows = [("t", "A", i, *p) for i, p in enumerate([(0, 1, 0), (0, 0, 0), (1, 0, 0), (1, -1, 0)])] + [("c", "A", i, *p) for i, p in enumerate([(0, 1, 0), (0, 0, 0), (1, 0, 0), (1, 1, 0)])] + [("r", "A", i, *p) for i, p in enumerate([(0, 1, 0), (0, 0, 0), (1, 0, 0), (1, 0, 1)])]
    df = spark.createDataFrame([(s, c, i, *map(float, p)) for s, c, i, *p in rows], "structure_id string, chain_id string, ord int, x double, y double, z double")
    got = {r.structure_id: r.dihedral for r in chains.trace_dihedrals(df).where("ord = 1").collect()}
    assert abs(got["t"]) == pytest.approx(180) and got["c"] == pytest.approx(0) and abs(got["r"]) == pytest.approx(90)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_contacts(spark, parts):
    p = np.random.default_rng(1).uniform(-15, 15, (60, 3))
    p[1] = p[0] + [8, 0, 0]
    df = spark.createDataFrame([("s", i, *map(float, x)) for i, x in enumerate(p)], "structure_id string, ord int, x double, y double, z double").repartition(parts)
    d = np.sqrt(np.square(p[:, None] - p[None]).sum(axis=2))
    got = {(r.i, r.j) for r in points.contact_map(df, 8.0).collect()}
    assert got == {tuple(x) for x in np.argwhere(d <= 8.0).tolist()}
    strict = points.within(df, df, 8.0, strict=True)
    assert strict.count() == int((d < 8.0).sum())
    rg = points.radius_of_gyration(df).first().rg
    assert rg == pytest.approx(np.sqrt(np.square(p - p.mean(axis=0)).sum(axis=1).mean()))


def test_ideal_helix(spark):
    t = np.radians(100 * np.arange(20))
    rows = [("h", "A", i, 2.3 * math.cos(a), 2.3 * math.sin(a), 1.5 * i) for i, a in enumerate(t)]
    df = spark.createDataFrame(rows, "structure_id string, chain_id string, ord int, x double, y double, z double")
    states = [r.state for r in chains.trace_structure(df).orderBy("ord").collect()]
    assert set(states[2:-2]) == {"H"} and states[0] == "C"


def test_round_trip(spark, table, tmp_path):
    a = structures.atoms(table).where("structure_id = 'one'")
    sinks.write_pdb(a, f"{tmp_path}/pdb")
    import glob

    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/pdb/structure_id=one/part*")))
    again = list(structures.parse_pdb(text))
    want = [r.asDict() for r in a.orderBy("atom_ord").collect()]
    keys = ("chain_id", "residue_name", "residue_serial", "atom_name", "atom_serial", "x", "y", "z", "is_hetero", "conformer_id")
    assert [[r[k] for k in keys] for r in again] == [[r[k] for k in keys] for r in want]


def test_release(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i}", "train" if i % 3 else "val") for i in range(9)], "record_id string, split string")
    m = sinks.write_release(df, f"{tmp_path}/r", "v1")
    assert m["count"] == 9 and m["split_counts"] == {"train": 6, "val": 3}
    assert sinks.read_release(spark, f"{tmp_path}/r", "val").count() == 3
    import glob

    f = glob.glob(f"{tmp_path}/r/data/*.parquet")[0]
    df.limit(1).coalesce(1).write.parquet(f"{tmp_path}/x")
    open(f, "wb").write(open(glob.glob(f"{tmp_path}/x/*.parquet")[0], "rb").read())
    import os

    os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
    with pytest.raises(ValueError, match="manifest"):
        sinks.read_release(spark, f"{tmp_path}/r")


def test_sequences(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a first one\nACD\nEF\n>b\nGG\n")
    got = {(r.accession, r.description, r.seq) for r in sequences.read_fasta(spark, f"{tmp_path}/x.fasta").collect()}
    assert got == {("a", "first one", "ACDEF"), ("b", "", "GG")}
    assert sequences.parse_a3m(">q\nACD\n>h\nAacC-e\n") == (["ACD", "AC-"], [[0, 0, 0], [0, 2, 0]])
    for bad in ("", ">q\nAcD\n", ">q\nACD\n>h\nAC\n"):
        with pytest.raises(ValueError):
            sequences.parse_a3m(bad)
    (tmp_path / "m.a3m").write_text(">q\nACD\n>h\nAacC-e\n")
    cells = sequences.msa_cells(sequences.read_a3m(spark, f"{tmp_path}/m.a3m")).orderBy("row", "column").collect()
    assert [(c["class"], c.deletion) for c in cells] == [(0, 0), (1, 0), (2, 0), (0, 0), (1, 2), (20, 0)]
    assert sequences.parse_matrix("# c\n  A B\nA 4 -1\nB -1 5\n")["A", "B"] == -1
    assert sequences.integer_matrix({("A", "A"): 100.0}, 2.0) == {("A", "A"): 127}
    assert structures.repair("SEQADV x\nATOM y", "seqadv_invalid_field") == "ATOM y"


def test_hydrogens_and_bonds(spark, table):
    r = at.residues(at.primary(structures.atoms(table).where("structure_id = 'one'")))
    h = chains.amide_hydrogens(r.where("chain_id = 'A'")).orderBy("ord").collect()
    assert h[0].hx is None and h[1].hx is not None
    assert math.dist((h[1].hx, h[1].hy, h[1].hz), (h[1].nx, h[1].ny, h[1].nz)) == pytest.approx(1.01)
    a = structures.atoms(table).where("structure_id = 'one'").withColumn("ord", F.col("atom_ord"))
    rows = a.collect()
    want = sum(p.element in "NO" and q.element in ("O", "S") and p.residue_ord != q.residue_ord and math.dist((p.x, p.y, p.z), (q.x, q.y, q.z)) < 3.5 for p in rows for q in rows)
    assert points.geometric_hbonds(a).count() == want


def test_smoothing(spark):
    """Against the passes in order on each chain, position by position."""
    r = random.Random(3)
    texts = ["HHHH", "CCHCC", "CCHHCC", "CHHCC", "HCHCC", "HEHEH", "EHEHEHEHCC", "CCEECCHHHCHHECECC", *["".join(r.choice("HHECT") for _ in range(r.randint(1, 24))) for _ in range(150)]]

    def plain(text):
        s, n = list(text), len(text)
        if n < 5:
            return text
        far = lambda i, *steps: all(s[i + d] != s[i] for d in steps)
        for i in range(2, n - 2):
            if s[i] in "HE" and far(i, -2, -1, 1, 2):
                s[i] = "C"
        for i in range(2, n - 3):
            if s[i] in "HE" and s[i] == s[i + 1] and far(i, -2, -1, 2, 3):
                s[i] = s[i + 1] = "C"
        for i in range(1, n - 1):
            if s[i - 1] in "HE" and s[i - 1] == s[i + 1]:
                s[i] = s[i - 1]
        return "".join(s)

    rows = [(k, i, c) for k, t in enumerate(texts) for i, c in enumerate(t)]
    got = chains.smoothed(spark.createDataFrame(rows, "structure_id int, ord int, state string"), ["structure_id"])
    joined = got.groupBy("structure_id").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("ord", "state"))), lambda x: x.state)).alias("t"))
    assert {x.structure_id: x.t for x in joined.collect()} == {k: plain(t) for k, t in enumerate(texts)}
