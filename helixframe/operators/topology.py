"""Bonded topology of structures as joins: bonds by distance, angles, torsions, pairs that don't interact freely, and energies over pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .physics import COULOMB
from .points import within

#: The longest bond with hydrogen, with sulfur, and of any others; two atoms nearer than the least distance are not bonded.
HYDROGEN, SULFUR, OTHER, LEAST = 1.3, 2.2, 1.9, 0.4


def longest_bond(a: Column, b: Column) -> Column:
    return F.when((a == "H") | (b == "H"), HYDROGEN).when((a == "S") | (b == "S"), SULFUR).otherwise(OTHER)


def bonds(atoms: DataFrame, inside: str | None = "residue_ord") -> DataFrame:
    """(structure_id, i, j), i < j: atoms near enough for their elements; inside: only of one residue, None for all."""
    cols = ["structure_id", "ord", "element", "x", "y", "z", *([inside] if inside else [])]
    most = max(HYDROGEN, SULFUR, OTHER)
    pairs = within(atoms.select(*cols), atoms.select(*cols), most, edge=2 * most).where("ord_a < ord_b")
    if inside:
        pairs = pairs.where(F.col(f"{inside}_a") == F.col(f"{inside}_b"))
    near = (F.col("dist") < longest_bond(F.col("element_a"), F.col("element_b"))) & (F.col("dist") > LEAST)
    return pairs.where(near).select("structure_id", F.col("ord_a").alias("i"), F.col("ord_b").alias("j"))


def _lists(bond: DataFrame) -> DataFrame:
    """(structure_id, at, to): each atom with the list of those it is bonded to, from one pass over the bonds."""
    both = F.explode(F.array(F.struct(F.col("i").alias("at"), F.col("j").alias("to")), F.struct(F.col("j").alias("at"), F.col("i").alias("to"))))
    return bond.select("structure_id", both.alias("e")).groupBy("structure_id", F.col("e.at").alias("at")).agg(F.collect_list("e.to").alias("to"))


def _middles(bond: DataFrame) -> DataFrame:
    """(structure_id, j, k, of_j, of_k, times): each bond, j < k, with the lists of both its atoms; a bond that is given many times is one row."""
    lists = _lists(bond).select("structure_id", "at", "to", F.explode("to").alias("other"))
    low = F.col("at") < F.col("other")
    ends = [F.max(F.when(low, F.col("to"))).alias("of_j"), F.max(F.when(~low, F.col("to"))).alias("of_k"), F.count_if(low).alias("times")]
    return lists.groupBy("structure_id", F.least("at", "other").alias("j"), F.greatest("at", "other").alias("k")).agg(*ends)


def angles(bond: DataFrame) -> DataFrame:
    """(structure_id, i, j, k): two bonds of atom j, i < k."""
    first = _lists(bond).select("structure_id", F.col("at").alias("j"), "to", F.explode("to").alias("i"))
    return first.select("structure_id", "i", "j", F.explode("to").alias("k")).where("i < k")


def torsions(bond: DataFrame) -> DataFrame:
    """(structure_id, i, j, k, l): a bond j-k, j < k, with a further bond of each, to different atoms."""
    first = _middles(bond).select("structure_id", "j", "k", "of_k", "times", F.explode("of_j").alias("i")).where("i <> k")
    last = first.select("structure_id", "i", "j", "k", "times", F.explode("of_k").alias("l")).where("l <> j and i <> l")
    return last.select("structure_id", "i", "j", "k", "l", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).drop("col")


def bound_pairs(bond: DataFrame) -> DataFrame:
    """(structure_id, i, j, apart), i < j: pairs one, two or three bonds apart, by the least."""
    pair = lambda a, b, n: F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), F.lit(n).alias("apart"))
    j, k = F.col("j"), F.col("k")
    two = F.concat(F.transform("of_j", lambda x: pair(x, k, 2)), F.transform("of_k", lambda x: pair(j, x, 2)))
    three = F.flatten(F.transform("of_j", lambda x: F.transform("of_k", lambda y: pair(x, y, 3))))
    every = _middles(bond).withColumns({"of_j": F.array_distinct("of_j"), "of_k": F.array_distinct("of_k")}).select("structure_id", F.explode(F.concat(F.array(pair(j, k, 1)), two, three)).alias("p"))
    return every.select("structure_id", "p.*").where("i < j").groupBy("structure_id", "i", "j").agg(F.min("apart").alias("apart"))


def pair_energies(atoms: DataFrame, bound: DataFrame, cutoff: float = 12.0, vdw_of_three: float = 0.5, charge_of_three: float = 1 / 1.2, least: float = 0.0) -> DataFrame:
    """(structure_id, vdw, electrostatic, n_pairs) over pairs within the cutoff, without those one or two bonds apart and scaled at three.

    Pairs at least or nearer don't count. atoms: structure_id, ord, x, y, z, radius (half the distance of least energy), depth, charge.
    """
    cols = ["structure_id", "ord", "x", "y", "z", "radius", "depth", "charge"]
    # Each atom takes along which later ones it is bound to, so that no pair within the cutoff is shuffled.
    known = bound.groupBy("structure_id", F.col("i").alias("ord")).agg(F.map_from_entries(F.collect_list(F.struct("j", "apart"))).alias("bound"))
    left = atoms.select(*cols).join(known, ["structure_id", "ord"], "left")
    pairs = within(left, atoms.select(*cols), cutoff, strict=True).where((F.col("ord_a") < F.col("ord_b")) & (F.col("dist") > least))
    marked = pairs.withColumn("apart", F.try_element_at("bound_a", F.col("ord_b"))).where("apart is null or apart = 3")
    three = F.col("apart").isNotNull()
    ratio = F.pow((F.col("radius_a") + F.col("radius_b")) / F.col("dist"), 6)
    vdw = F.when(three, vdw_of_three).otherwise(1.0) * F.sqrt(F.col("depth_a") * F.col("depth_b")) * (ratio * ratio - 2 * ratio)
    charge = F.when(three, charge_of_three).otherwise(1.0) * COULOMB * F.col("charge_a") * F.col("charge_b") / F.col("dist")
    return marked.groupBy("structure_id").agg(F.sum(vdw).alias("vdw"), F.sum(charge).alias("electrostatic"), F.count("*").alias("n_pairs"))
