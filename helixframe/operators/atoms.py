"""The structure hierarchy on the atom table: first model, primary conformer, residues, chains and catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Three-letter to one-letter codes of the standard residues, and three more that the search tables know.
ONE_LETTER = dict(zip("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split(), "ARNDCQEGHILKMFPSTWYV", strict=True))
SEARCH_ONE_LETTER = ONE_LETTER | {"MSE": "M", "SEC": "U", "PYL": "O"}


def one_letter(residue_name: Column, table: dict[str, str] = ONE_LETTER) -> Column:
    """Code of a residue, X if the table has none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.trim(residue_name)), F.lit("X"))


def first_per_group(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_model(atoms: DataFrame) -> DataFrame:
    """Atoms of each structure's model of the smallest index."""
    least = atoms.groupBy("structure_id").agg(F.min("model").alias("model"))
    return atoms.join(least, ["structure_id", "model"], "left_semi")


RESIDUE = ["structure_id", "model", "chain_id", "residue_serial", "insertion_code"]


def primary(atoms: DataFrame) -> DataFrame:
    """First model; of each residue the blank conformer, else A, else the first: atoms common to all conformers stay."""
    rows = first_model(atoms)
    w = Window.partitionBy("structure_id", "chain_id", "residue_serial", F.coalesce("insertion_code", F.lit(""))).orderBy(F.col("conformer_id").isNotNull(), F.coalesce(F.col("conformer_id") != "A", F.lit(False)), "atom_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("__best", F.first("conformer_id").over(w)).where(F.col("conformer_id").eqNullSafe(F.col("__best"))).drop("__best")


def residues(atoms: DataFrame) -> DataFrame:
    """A row for each residue with its backbone atoms' places: n, ca, c, o and cb, null where missing."""
    key = ["structure_id", "chain_id", "residue_ord"]
    at = lambda name: F.min(F.when(F.trim("atom_name") == name, F.struct("atom_ord", "x", "y", "z"))).alias(name.lower())
    names = ["N", "CA", "C", "O", "CB"]
    out = atoms.groupBy(*key).agg(F.first("residue_name").alias("residue_name"), F.min("residue_serial").alias("residue_serial"), *[at(n) for n in names])
    places = [F.col(f"{n.lower()}.{c}").alias(f"{n.lower()}{c}") for n in names for c in "xyz"]
    return out.select("structure_id", "chain_id", F.col("residue_ord").alias("ord"), "residue_name", "residue_serial", *places)


def pseudo_beta(residue_rows: DataFrame) -> DataFrame:
    """CB, or CA of glycine; 0 with mask 0 where it is missing."""
    gly = F.trim("residue_name") == "GLY"
    p = {c: F.when(gly, F.col(f"ca{c}")).otherwise(F.col(f"cb{c}")) for c in "xyz"}
    return residue_rows.select("structure_id", "chain_id", "ord", *[F.coalesce(v, F.lit(0.0)).alias(f"beta_{c}") for c, v in p.items()], p["x"].isNotNull().cast("double").alias("beta_mask"))


def trace(atoms: DataFrame, name: str = "CA") -> DataFrame:
    kept = first_per_group(atoms.where(F.trim("atom_name") == name), ["structure_id", "chain_id", "residue_ord"], ["atom_ord"])
    return kept.select("structure_id", "chain_id", F.col("residue_ord").alias("ord"), "residue_name", "x", "y", "z")


def catalog(atoms: DataFrame) -> DataFrame:
    """structure_id, atom_count, residue_count, chain_count, model_count and the first model's chains in order, by commas."""
    every = atoms.groupBy("structure_id").agg(F.countDistinct("model").alias("model_count"))
    first = first_model(atoms)
    chains = first.groupBy("structure_id", "chain_id").agg(F.min("atom_ord").alias("o"), F.countDistinct("residue_ord").alias("residues"), F.count("*").alias("n"))
    out = chains.groupBy("structure_id").agg(F.sum("n").alias("atom_count"), F.sum("residues").alias("residue_count"), F.count("*").alias("chain_count"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "chain_id"))), lambda s: s.chain_id), ",").alias("chains"))
    return out.join(every, "structure_id")


def without_hydrogens(atoms: DataFrame) -> DataFrame:
    return atoms.where(~F.coalesce(F.trim("element").isin("H", "D"), F.lit(False)))
