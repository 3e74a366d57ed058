"""Operators on points of structures: rows (structure_id, ord, x, y, z, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

#: Structures of so many points at most are not cut in cells.
FEW = 256


def centroid(points: DataFrame, by: str = "structure_id") -> DataFrame:
    return points.groupBy(by).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"], F.count("*").alias("n_points"))


def radius_of_gyration(points: DataFrame, by: str = "structure_id") -> DataFrame:
    """Root mean square distance from the centroid, in one pass: the sum of the three population variances."""
    return points.groupBy(by).agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rg"))


def _sides(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    left = a.select(F.col(key), *[F.col(c).alias(f"{c}_a") for c in a.columns if c != key])
    right = b.select(F.col(key), *[F.col(c).alias(f"{c}_b") for c in b.columns if c != key])
    return left, right


def distances(points: DataFrame, key: str = "structure_id", others: DataFrame | None = None) -> DataFrame:
    """Every ordered pair of points of a structure (of points and others) with its distance."""
    a, b = _sides(points, points if others is None else others, key)
    return a.join(b, key).withColumn("dist", g.distance(g.vector(suffix="_a"), g.vector(suffix="_b")))


def cells(a: DataFrame, b: DataFrame, cutoff: float, key: str = "structure_id", edge: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of within() with their cells gx, gy, gz: a row of a for each cell it is looked for in, one of b for its own."""
    left, right = _sides(a, b, key)
    edge, reach = float(edge or cutoff), float(cutoff) * (1 + 1e-9)  # a rounded distance may be the cutoff where the true one is a little more
    cell = lambda c: F.when(F.col("few"), F.lit(0).cast("bigint")).otherwise(F.floor(c / F.lit(edge)))
    few = b.groupBy(key).agg((F.count("*") <= FEW).alias("few"))
    left = left.join(few, key)
    for n in "xyz":
        left = left.withColumn(f"g{n}", F.explode(F.sequence(cell(F.col(f"{n}_a") - reach), cell(F.col(f"{n}_a") + reach))))
    right = right.join(few, key).select(*right.columns, *[cell(F.col(f"{n}_b")).alias(f"g{n}") for n in "xyz"])
    return left.drop("few"), right


def within(a: DataFrame, b: DataFrame, cutoff: float, key: str = "structure_id", strict: bool = False, edge: float | None = None) -> DataFrame:
    """Pairs of points of the same structure at most (strict: less than) cutoff apart, with dist.

    Space is cut in cells of the given edge (the cutoff, if not given). Each point of a is looked for in every cell that a cube of twice the cutoff
    around it touches, so that pairs meet in an equi-join on structure and cell, which Spark shuffles and splits as any other. An edge of the
    cutoff gives 27 copies of a point, one of twice the cutoff 8, but more pairs to compare where points lie close. A structure with at most
    FEW points of b is one cell: to compare a point with them costs less than its copies.
    """
    left, right = cells(a, b, cutoff, key, edge)
    dist = g.distance(g.vector(suffix="_a"), g.vector(suffix="_b"))
    pairs = left.join(right, [key, "gx", "gy", "gz"]).drop("gx", "gy", "gz").withColumn("dist", dist)
    return pairs.where(F.col("dist") < cutoff if strict else F.col("dist") <= cutoff)


def contact_map(points: DataFrame, cutoff: float = 8.0, key: str = "structure_id") -> DataFrame:
    """Contacts at the cutoff count; a point touches itself."""
    return within(points, points, cutoff, key).select(key, F.col("ord_a").alias("i"), F.col("ord_b").alias("j"), "dist")


def interface(points: DataFrame, cutoff: float, key: str = "structure_id", chain: str = "chain_id") -> DataFrame:
    """Points with a point of another chain nearer than cutoff."""
    pairs = within(points, points, cutoff, key, strict=True).where(F.col(f"{chain}_a") != F.col(f"{chain}_b"))
    return pairs.select(key, F.col(f"{chain}_a").alias(chain), F.col("ord_a").alias("ord")).distinct()


def nearest(points: DataFrame, key: str = "structure_id", reach: float = 8.0) -> DataFrame:
    """The nearest other point of each; of equally near ones the first.

    A point with another one within reach has its nearest there; only points that have none are compared with all of their structure.
    """
    best = F.min(F.struct("dist", "ord_b")).alias("m")

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.where("ord_a <> ord_b").groupBy(key, "ord_a").agg(best).select(key, F.col("ord_a").alias("ord"), F.col("m.ord_b").alias("partner"), F.col("m.dist").alias("dist"))

    near = least(within(points, points, reach, key))
    alone = points.join(near.select(key, "ord"), [key, "ord"], "left_anti")
    return near.unionByName(least(distances(alone, key, points)))


def hbonds(residues: DataFrame, cutoff: float = -0.5, reach: float = 5.2) -> DataFrame:
    """Backbone hydrogen bonds: donor and acceptor two or more apart in one chain, N-O at most reach, energy below cutoff.

    residues: structure_id, chain_id, ord and x, y, z of n, ca, c, o, with hx, hy, hz null where the residue has no amide hydrogen.
    """
    donors = residues.where("hx is not null").select("structure_id", "chain_id", "ord", F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"), "hx", "hy", "hz")
    acceptors = residues.select("structure_id", "chain_id", "ord", F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("oz").alias("z"), "cx", "cy", "cz")
    pairs = within(acceptors, donors, reach).where((F.col("chain_id_a") == F.col("chain_id_b")) & (F.abs(F.col("ord_a") - F.col("ord_b")) >= 2))
    v = lambda *n: tuple(F.col(c) for c in n)
    energy = g.hbond_energy(v("x_b", "y_b", "z_b"), v("hx_b", "hy_b", "hz_b"), v("cx_a", "cy_a", "cz_a"), v("x_a", "y_a", "z_a"))
    return pairs.withColumn("energy", energy).where(F.col("energy") < cutoff).select("structure_id", F.col("chain_id_a").alias("chain_id"), F.col("ord_a").alias("acceptor"), F.col("ord_b").alias("donor"), F.col("dist").alias("r_on"), "energy")


def geometric_hbonds(atoms: DataFrame, cutoff: float = 3.5) -> DataFrame:
    """N or O donors and O or S acceptors of different residues nearer than cutoff: every ordered pair."""
    cols = ["structure_id", "ord", "residue_ord", "element", "x", "y", "z"]
    donors, acceptors = atoms.where("element in ('N', 'O')").select(*cols), atoms.where("element in ('O', 'S')").select(*cols)
    pairs = within(donors, acceptors, cutoff, strict=True).where("ord_a <> ord_b and residue_ord_a <> residue_ord_b")
    return pairs.select("structure_id", F.col("ord_a").alias("donor"), F.col("ord_b").alias("acceptor"), "dist")


def hbond_count(bonds: DataFrame, residues: DataFrame) -> DataFrame:
    """Bonds of each residue, as acceptor and as donor."""
    ends = bonds.select("structure_id", F.col("acceptor").alias("ord")).unionAll(bonds.select("structure_id", F.col("donor").alias("ord")))
    counts = ends.groupBy("structure_id", "ord").agg(F.count("*").alias("n_hbonds"))
    return residues.select("structure_id", "ord").join(counts, ["structure_id", "ord"], "left").select("structure_id", "ord", F.coalesce("n_hbonds", F.lit(0)).cast("bigint").alias("n_hbonds"))


def rmsd_in_place(a: DataFrame, b: DataFrame, key: str = "pair_id") -> DataFrame:
    """Root mean square distance of points with equal ord, without superposition."""
    left, right = _sides(a, b, key)
    joined = left.join(right.withColumnRenamed("ord_b", "ord_a"), [key, "ord_a"])
    d = g.minus(g.vector(suffix="_a"), g.vector(suffix="_b"))
    return joined.groupBy(key).agg(F.sqrt(F.avg(g.dot(d, d))).alias("rmsd"), F.count("*").alias("n_points"))


def standard_scores(rows: DataFrame, value: str, by: str = "structure_id") -> DataFrame:
    """Value less its mean over the structure, by the population deviation; 0 without deviation."""
    w = Window.partitionBy(by)
    spread = F.stddev_pop(value).over(w)
    return rows.withColumn("z_score", F.when(spread > 0, (F.col(value) - F.avg(value).over(w)) / spread).otherwise(0.0))
