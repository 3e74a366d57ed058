"""Readers of structure files (PDB, mmCIF) into the atom table.

Files come through Spark's binaryFile source, so any store that Spark reads will do; a task parses its files one by one. A file
that can't be read gives one row with its error, so that failures are data: see atoms() and failures().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.atoms import ONE_LETTER
from ..schemas import READ, names

BACKBONE = frozenset(("N", "CA", "C", "O"))


class ParseError(ValueError):
    pass


def _number(line: str, a: int, b: int, what: str, kind=float, empty=None):
    text = line[a:b].strip()
    if not text and empty is not None:
        return empty
    try:
        return kind(text)
    except ValueError:
        raise ParseError(f"invalid pdb: {what} {text!r} in {line[:30]!r}") from None


def _element(text: str, name: str) -> str | None:
    if text:
        return text.capitalize() if len(text) > 1 else text
    letters = re.sub(r"[^A-Za-z]", "", name)
    return letters[:1].upper() or None


def parse_pdb(text: str) -> Iterator[dict]:
    """Atoms of a PDB file. Only coordinate and model records are read; every model and conformer is kept."""
    model, seen = 0, False
    for line in text.splitlines():
        record = line[:6].strip()
        if record == "MODEL":
            model += seen
            seen = True
        elif record in ("ATOM", "HETATM"):
            if len(line) < 54:
                raise ParseError(f"malformed line {line!r}")
            name = line[12:16].strip()
            yield {
                "model": max(0, model), "chain_id": line[21:22].strip(), "residue_name": line[17:20].strip() or "UNK", "residue_serial": _number(line, 22, 26, "residue number", int),
                "insertion_code": line[26:27].strip() or None, "conformer_id": line[16:17].strip() or None, "atom_name": name, "atom_serial": _number(line, 6, 11, "serial", int),
                "element": _element(line[76:78].strip(), name), "x": _number(line, 30, 38, "x"), "y": _number(line, 38, 46, "y"), "z": _number(line, 46, 54, "z"),
                "occupancy": _number(line, 54, 60, "occupancy", float, 1.0), "b_factor": _number(line, 60, 66, "B factor", float, 0.0), "is_hetero": record == "HETATM",
            }


_CIF_TOKEN = re.compile(r"""(?:^|(?<=\s))(?:'((?:[^']|'(?!\s|$))*)'|"((?:[^"]|"(?!\s|$))*)"|(#.*)|(\S+))""")


def _cif_words(line: str) -> list[str]:
    return [m[1] if m[1] is not None else m[2] if m[2] is not None else m[4] for m in _CIF_TOKEN.finditer(line) if m[3] is None]


def parse_mmcif(text: str) -> Iterator[dict]:
    """Atoms of the _atom_site loop. Author names and numbers go before label ones."""
    lines = iter(text.splitlines())
    columns: list[str] = []
    found = False
    models: dict[str, int] = {}
    values: list[str] = []
    for line in lines:
        if line.startswith("_atom_site."):
            columns.append(line.split()[0][len("_atom_site.") :])
        elif columns:
            if not line.strip() or line.startswith(("#", "loop_", "_", "data_")):
                if found:
                    break
                continue
            values += _cif_words(line)
            while len(values) >= len(columns):
                found = True
                yield _cif_atom(dict(zip(columns, values, strict=False)), models)
                del values[: len(columns)]
    if values:
        raise ParseError("mmcif parse: a row of _atom_site is incomplete")
    if not found:
        raise ParseError("mmcif parse: no atoms")


def _cif_atom(row: dict[str, str], models: dict[str, int]) -> dict:
    def get(*keys: str) -> str | None:
        return next((row[k] for k in keys if row.get(k) not in (None, "?", ".")), None)

    name = get("auth_atom_id", "label_atom_id") or ""
    try:
        return {
            "model": models.setdefault(row.get("pdbx_PDB_model_num", "1"), len(models)), "chain_id": get("auth_asym_id", "label_asym_id") or "", "residue_name": get("auth_comp_id", "label_comp_id") or "UNK",
            "residue_serial": int(get("auth_seq_id", "label_seq_id") or 0), "insertion_code": get("pdbx_PDB_ins_code"), "conformer_id": get("label_alt_id"), "atom_name": name, "atom_serial": int(get("id") or 0),
            "element": _element(get("type_symbol") or "", name), "x": float(row["Cartn_x"]), "y": float(row["Cartn_y"]), "z": float(row["Cartn_z"]), "occupancy": float(get("occupancy") or 1.0),
            "b_factor": float(get("B_iso_or_equiv") or 0.0), "is_hetero": row.get("group_PDB") == "HETATM",
        }
    except (KeyError, ValueError) as e:
        raise ParseError(f"mmcif parse: {e}") from None


#: Text repairs of PDB files that strict readers reject: (bucket, pattern of lines that go).
REPAIRS = {"seqadv_invalid_field": r"^SEQADV", "solitary_dbref1_definition": r"^DBREF[12]", "seqres_total_invalid": r"^(?:SEQRES|DBREF )", "seqres_multiple_residues": r"^(?:SEQRES|DBREF )", "ssbond_missing_partner": r"^SSBOND"}


def repair(text: str, bucket: str) -> str:
    """The text without the records that a failure bucket is about; charges of atoms go for their bucket."""
    lines = text.splitlines()
    if bucket == "atom_charge_suffix":
        return "\n".join([x[:78] + "  " + x[80:] if x.startswith(("ATOM", "HETATM")) and len(x) >= 79 else x for x in lines])
    if pattern := REPAIRS.get(bucket):
        lines = [x for x in lines if not re.match(pattern, x)]
    return "\n".join(lines)


def parse(path: str, data: bytes, kind: str | None = None) -> list[dict]:
    text = data.decode("utf-8", "replace")
    name = path.rsplit("/", 1)[-1]
    kind = kind or ("mmcif" if name.endswith((".cif", ".mmcif")) else "pdb")
    rows = list(parse_mmcif(text) if kind == "mmcif" else parse_pdb(text))
    if not rows:
        raise ParseError("invalid pdb: no atoms")
    stem, residue, key = name.rsplit(".", 1)[0], -1, None
    for i, r in enumerate(rows):
        now = (r["model"], r["chain_id"], r["residue_serial"], r["insertion_code"])
        if now != key:
            residue, key = residue + 1, now
        r |= {"path": path, "structure_id": stem, "atom_ord": i, "residue_ord": residue, "is_backbone": r["atom_name"] in BACKBONE}
    return rows


def parsed(files: DataFrame, kind: str | None = None) -> DataFrame:
    """(path, content) -> the READ table."""
    schema = to_arrow_schema(StructType.fromDDL(READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = parse(path, data, kind)
                except ValueError as e:
                    rows = [{"path": path, "error": str(e)}]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names(READ)} for r in rows], schema=schema)

    return files.mapInArrow(run, READ)


def read(spark: SparkSession, paths: str | list[str], kind: str | None = None) -> DataFrame:
    """The READ table of files, a folder or a pattern. structure_id is the file's name without its ending."""
    return parsed(spark.read.format("binaryFile").load(paths).select("path", "content"), kind)


def atoms(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Atoms of the files that could be read. strict: the query fails at the first that couldn't."""
    if strict:
        rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "error"))))
    return rows.where("error is null").drop("path", "error")


def failures(rows: DataFrame) -> DataFrame:
    return rows.where("error is not null").select("path", "error")


def with_options(table: DataFrame, chain: str | None = None, hetero: bool = True, name: str | None = None, model: int | None = None, mirror: bool = False) -> DataFrame:
    """Choices of a loader as filters that Spark pushes down; mirror turns z around."""
    out = table
    for column, value in (("chain_id", chain), ("atom_name", name), ("model", model)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if not hetero:
        out = out.where("not is_hetero")
    return out.withColumn("z", -F.col("z")) if mirror else out


def parse_points(text: str, named: bool) -> list[tuple[str, float, float, float]]:
    """(letter, x, y, z) of a file of a number, with names a line of description, and so many lines of coordinates (named: after a name)."""
    lines = text.splitlines()
    try:
        n = int(lines[0].strip()) if lines else 0
    except ValueError:
        n = 0
    if n <= 0:
        raise ParseError("invalid count of points")
    out = []
    for i in range(n):
        at = i + 1 + named
        parts = lines[at].split() if at < len(lines) else []
        if len(parts) < 3 + named:
            raise ParseError(f"invalid line of coordinates: {i + 1}")
        letter = "A" if not named else ONE_LETTER.get(parts[0].upper(), "X") if len(parts[0]) == 3 else parts[0][0]
        try:
            out.append((letter, *map(float, parts[named : 3 + named])))
        except ValueError as e:
            raise ParseError(f"invalid line of coordinates: {e}") from None
    return out


def read_points(spark: SparkSession, path: str, named: bool = True) -> DataFrame:
    """(path, ord, letter, x, y, z) of XYZ files, or of traces without names (named=False)."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = parse_points(data.decode("utf-8", "replace"), named)
                letters, x, y, z = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array(letters), *[pa.array(c, pa.float64()) for c in (x, y, z)]], names=["path", "ord", "letter", "x", "y", "z"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, ord int, letter string, x double, y double, z double")


def to_pandas(atoms: DataFrame, structure_id: str):
    """One structure's atoms as a pandas table, in order."""
    return atoms.where(F.col("structure_id") == structure_id).orderBy("atom_ord").toPandas()


def to_arrow(atoms: DataFrame, structure_id: str):
    """One structure's atoms as an Arrow table, in order."""
    return atoms.where(F.col("structure_id") == structure_id).orderBy("atom_ord").toArrow()
