"""Named queries over the analytics tables, each with the SQL that an independent engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import atoms as at
from ..operators import chains, engine, failures, hits, kernels, kmers, points, releases, selection, topology
from ..sources import sinks, structures
from ..streaming import ingest
from . import adapters as ad
from .adapters import LINES_SQL, ORDERS_SQL, POINTS_SQL, QUERIES_SQL, TARGETS_SQL, kmers_sql, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
K = 6


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Selections and projections


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE (p_brand = 'Brand#1' OR p_size BETWEEN 5 AND 9) AND NOT trim(p_type) = 'ECONOMY'")
def select_boolean_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"chain_id": "p_brand", "residue_serial": "p_size", "residue_name": "p_name", "element": "p_type", "atom_name": "p_type"}
    p = table(spark, sf_dir, "part")
    return p.where(selection.select("(chain Brand#1 or resid 5-9) and not element ECONOMY", names)).select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query(f"WITH {LINES_SQL} SELECT l_orderkey, l_partkey, l_suppkey, ord FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'A', ord) AS n FROM li) WHERE n = 1")
def primary_row_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ad.lines(spark, sf_dir)
    return at.first_per_group(x, ["l_orderkey"], [F.col("l_returnflag") != "A", "ord"]).select("l_orderkey", "l_partkey", "l_suppkey", "ord")


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) IN (SELECT conv_id, min(turn) FROM conversations GROUP BY conv_id)")
def first_model_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("structure_id"), F.col("turn").alias("model"), "role")
    return at.first_model(x).select(F.col("structure_id").alias("conv_id"), F.col("model").alias("turn"), "role")


@query(f"WITH {TARGETS_SQL} SELECT seq_id, seq, length(seq)::BIGINT AS n FROM t")
def code_fold_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.sequences(spark, sf_dir).select("seq_id", "seq", F.length("seq").cast("bigint").alias("n"))


#: Residue names of parts, by key.
_NAMES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL MSE SEC PYL UNK HOH"


@query(f"SELECT p_partkey, string_split('{_NAMES}', ' ')[p_partkey % 25 + 1] AS residue_name, substr('ARNDCQEGHILKMFPSTWYVXXXXX', (p_partkey % 25 + 1)::INTEGER, 1) AS letter, substr('ARNDCQEGHILKMFPSTWYVMUOXX', (p_partkey % 25 + 1)::INTEGER, 1) AS search_letter FROM part")
def one_letter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.split(F.lit(_NAMES), " "), (F.col("p_partkey") % 25 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", name.alias("residue_name"))
    return p.select("p_partkey", "residue_name", at.one_letter(F.col("residue_name")).alias("letter"), at.one_letter(F.col("residue_name"), at.SEARCH_ONE_LETTER).alias("search_letter"))


@query(f"WITH {LINES_SQL} SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY o) AS chains, count(*) AS chain_count, sum(n)::BIGINT AS atom_count FROM (SELECT l_orderkey, l_returnflag, min(ord) AS o, count(*) AS n FROM li GROUP BY ALL) GROUP BY l_orderkey")
def structure_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.order_points(spark, sf_dir).withColumns({"model": F.lit(0), "atom_ord": F.col("ord"), "residue_ord": F.col("ord")})
    return at.catalog(p).select(F.col("structure_id").alias("l_orderkey"), "chains", "chain_count", "atom_count")


# Points


@query(f"WITH {POINTS_SQL} SELECT structure_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, count(*) AS n_points FROM pts GROUP BY structure_id")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(points.centroid(ad.vector_points(spark, sf_dir)), "cx", "cy", "cz")


@query(f"WITH {POINTS_SQL} SELECT structure_id, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rg FROM pts GROUP BY structure_id")
def radius_of_gyration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(points.radius_of_gyration(ad.vector_points(spark, sf_dir)), "rg")


_DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


@query(f"WITH {POINTS_SQL} SELECT a.structure_id, a.ord AS i, b.ord AS j, round({_DIST}, 6) AS dist FROM pts a JOIN pts b USING (structure_id)")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = points.distances(ad.vector_points(spark, sf_dir))
    return d.select("structure_id", F.col("ord_a").alias("i"), F.col("ord_b").alias("j"), F.round("dist", 6).alias("dist"))


@query(f"WITH {POINTS_SQL} SELECT a.structure_id, a.ord AS i, b.ord AS j, round({_DIST}, 6) AS dist FROM pts a JOIN pts b ON a.structure_id = b.structure_id AND {_DIST} <= 3.0")
def contact_map_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(points.contact_map(ad.vector_points(spark, sf_dir), 3.0), "dist")


@query(f"WITH {ORDERS_SQL} SELECT DISTINCT a.structure_id, a.chain_id, a.ord FROM pts a JOIN pts b ON a.structure_id = b.structure_id AND a.chain_id <> b.chain_id AND {_DIST} < 10.0")
def interface_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.interface(ad.order_points(spark, sf_dir), 10.0)


@query(f"WITH {ORDERS_SQL} SELECT a.structure_id, a.ord AS ord_a, b.ord AS ord_b, round({_DIST}, 6) AS dist FROM pts a JOIN pts b ON a.structure_id = b.structure_id AND a.chain_id = 'A' AND b.chain_id = 'N' AND {_DIST} < 12.0")
def cross_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.order_points(spark, sf_dir)
    out = points.within(p.where("chain_id = 'A'"), p.where("chain_id = 'N'"), 12.0, strict=True)
    return out.select("structure_id", "ord_a", "ord_b", F.round("dist", 6).alias("dist"))


@query(f"WITH {POINTS_SQL} SELECT structure_id, i AS ord, j AS partner, round(d, 6) AS dist FROM (SELECT a.structure_id, a.ord AS i, b.ord AS j, {_DIST} AS d, row_number() OVER (PARTITION BY a.structure_id, a.ord ORDER BY {_DIST}, b.ord) AS n FROM pts a JOIN pts b ON a.structure_id = b.structure_id AND a.ord <> b.ord) WHERE n = 1")
def neighbor_min_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(points.nearest(ad.vector_points(spark, sf_dir)), "dist")


_RES = f"{POINTS_SQL}, res AS (SELECT structure_id, ord // 5 AS r, max(CASE WHEN ord % 5 = 0 THEN x END) AS nx, max(CASE WHEN ord % 5 = 0 THEN y END) AS ny, max(CASE WHEN ord % 5 = 0 THEN z END) AS nz, max(CASE WHEN ord % 5 = 1 THEN x END) AS hx, max(CASE WHEN ord % 5 = 1 THEN y END) AS hy, max(CASE WHEN ord % 5 = 1 THEN z END) AS hz, max(CASE WHEN ord % 5 = 2 THEN x END) AS cx, max(CASE WHEN ord % 5 = 2 THEN y END) AS cy, max(CASE WHEN ord % 5 = 2 THEN z END) AS cz, max(CASE WHEN ord % 5 = 3 THEN x END) AS ox, max(CASE WHEN ord % 5 = 3 THEN y END) AS oy, max(CASE WHEN ord % 5 = 3 THEN z END) AS oz FROM pts WHERE ord < 20 GROUP BY ALL)"


def _d(a: str, p: str, b: str, q: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{p}{c}-{b}.{q}{c})*({a}.{p}{c}-{b}.{q}{c})" for c in "xyz") + ")"


_BONDS = f"{_RES}, b AS (SELECT a.structure_id, a.r AS acceptor, d.r AS donor, {_d('d', 'n', 'a', 'o')} AS r_on, {_d('a', 'c', 'd', 'h')} AS ch, {_d('a', 'o', 'd', 'h')} AS oh, {_d('a', 'c', 'd', 'n')} AS cn FROM res a JOIN res d ON a.structure_id = d.structure_id AND abs(a.r - d.r) >= 2), e AS (SELECT structure_id, acceptor, donor, r_on, CASE WHEN least(r_on, ch, oh, cn) < 0.01 THEN 0.0 ELSE 27.888 * (1 / r_on + 1 / ch - 1 / oh - 1 / cn) END AS energy FROM b WHERE r_on <= 5.2), hb AS (SELECT * FROM e WHERE energy < -0.5)"


def _residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.vector_points(spark, sf_dir).where("ord < 20").withColumn("r", F.floor(F.col("ord") / 5).cast("int"))
    cell = lambda k, n: [F.max(F.when(F.col("ord") % 5 == k, F.col(c))).alias(f"{n}{c}") for c in "xyz"]
    return p.groupBy("structure_id", F.col("r").alias("ord")).agg(*cell(0, "n"), *cell(1, "h"), *cell(2, "c"), *cell(3, "o")).withColumn("chain_id", F.lit("A"))


@query(f"WITH {_BONDS} SELECT structure_id, acceptor, donor, round(r_on, 6) AS r_on, round(energy, 5) AS energy FROM hb")
def hbond_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = points.hbonds(_residues(spark, sf_dir))
    return out.select("structure_id", F.col("acceptor").cast("bigint").alias("acceptor"), F.col("donor").cast("bigint").alias("donor"), F.round("r_on", 6).alias("r_on"), F.round("energy", 5).alias("energy"))


@query(f"WITH {_BONDS}, u AS (SELECT structure_id, acceptor AS r FROM hb UNION ALL SELECT structure_id, donor FROM hb), c AS (SELECT structure_id, r, count(*) AS n FROM u GROUP BY ALL) SELECT res.structure_id, res.r AS ord, coalesce(n, 0)::BIGINT AS n_hbonds FROM res LEFT JOIN c ON res.structure_id = c.structure_id AND res.r = c.r")
def hbond_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _residues(spark, sf_dir)
    return points.hbond_count(points.hbonds(r), r).withColumn("ord", F.col("ord").cast("bigint"))


@query(f"WITH {POINTS_SQL}, p AS (SELECT structure_id, lead(structure_id) OVER (PARTITION BY label ORDER BY structure_id) AS other FROM (SELECT DISTINCT structure_id, label FROM pts)) SELECT p.structure_id AS pair_id, round(sqrt(avg((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))), 6) AS rmsd, count(*) AS n_points FROM p JOIN pts a ON a.structure_id = p.structure_id JOIN pts b ON b.structure_id = p.other AND a.ord = b.ord GROUP BY p.structure_id")
def group_rmsd_nosuper(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = vector_pairs(spark, sf_dir)
    return _rounded(points.rmsd_in_place(a, b), "rmsd")


def vector_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each vector and the next of its label, as points under the first one's id."""
    p = ad.vector_points(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("other")).where("other is not null")
    cols = ["ord", "x", "y", "z"]
    a = p.join(e, p.structure_id == e.vec_id).select(F.col("vec_id").alias("pair_id"), *cols)
    b = p.join(e, p.structure_id == e.other).select(F.col("vec_id").alias("pair_id"), *cols)
    return a, b


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN s > 0 THEN (l_quantity - m) / s ELSE 0 END, 6) AS z_score FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_orderkey) AS m, stddev_pop(l_quantity) OVER (PARTITION BY l_orderkey) AS s FROM lineitem)")
def standard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = points.standard_scores(table(spark, sf_dir, "lineitem"), "l_quantity", "l_orderkey")
    return out.select("l_orderkey", "l_linenumber", F.round("z_score", 6).alias("z_score"))


# Windows along chains


def _lag(n: int) -> str:
    f = "lag" if n < 0 else "lead"
    return ", ".join(f"{f}({c}, {abs(n)}) OVER w AS {c}{'m' if n < 0 else 'p'}{abs(n)}" for c in "xyz")


@query(f"""WITH {POINTS_SQL}, l AS (SELECT *, {_lag(-1)}, {_lag(1)}, {_lag(2)} FROM pts WINDOW w AS (PARTITION BY structure_id ORDER BY ord)),
v AS (SELECT *, x-xm1 AS ux, y-ym1 AS uy, z-zm1 AS uz, xp1-x AS vx, yp1-y AS vy, zp1-z AS vz, xp2-xp1 AS wx, yp2-yp1 AS wy, zp2-zp1 AS wz FROM l),
n AS (SELECT *, uy*vz-uz*vy AS mx, uz*vx-ux*vz AS my, ux*vy-uy*vx AS mz, vy*wz-vz*wy AS nx, vz*wx-vx*wz AS ny, vx*wy-vy*wx AS nz FROM v)
SELECT structure_id, ord, round(CASE WHEN sqrt(mx*mx+my*my+mz*mz) < 1e-12 OR sqrt(nx*nx+ny*ny+nz*nz) < 1e-12 THEN 0.0 ELSE degrees(atan2((ux*nx+uy*ny+uz*nz)*sqrt(vx*vx+vy*vy+vz*vz), mx*nx+my*ny+mz*nz)) END, 6) AS dihedral FROM n""")
def dihedral_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(chains.trace_dihedrals(ad.vector_points(spark, sf_dir), ["structure_id"]).select("structure_id", "ord", "dihedral"), "dihedral")


@query(f"WITH {POINTS_SQL}, l AS (SELECT *, {_lag(-1)} FROM pts WINDOW w AS (PARTITION BY structure_id ORDER BY ord)), b AS (SELECT *, CASE WHEN sqrt((x-xm1)*(x-xm1)+(y-ym1)*(y-ym1)+(z-zm1)*(z-zm1)) > 4.5 THEN 1 ELSE 0 END AS is_break FROM l) SELECT structure_id, ord, is_break, (sum(is_break) OVER (PARTITION BY structure_id ORDER BY ord))::BIGINT AS segment FROM b")
def chain_break_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.segments(ad.vector_points(spark, sf_dir), key=["structure_id"]).select("structure_id", "ord", "is_break", "segment")


@query(f"""WITH {POINTS_SQL}, l AS (SELECT *, {_lag(-2)}, {_lag(2)} FROM pts WINDOW w AS (PARTITION BY structure_id ORDER BY ord)),
v AS (SELECT *, x-xm2 AS ax, y-ym2 AS ay, z-zm2 AS az, xp2-x AS bx, yp2-y AS by_, zp2-z AS bz FROM l),
k AS (SELECT *, degrees(acos(CASE WHEN q > 1 THEN 1.0 WHEN q < -1 THEN -1.0 ELSE q END)) AS kappa FROM (SELECT *, (ax*bx+ay*by_+az*bz) / nullif(sqrt(ax*ax+ay*ay+az*az)*sqrt(bx*bx+by_*by_+bz*bz), 0) AS q FROM v))
SELECT structure_id, ord, round(kappa, 5) AS kappa, CASE WHEN kappa > 70 THEN 1 ELSE 0 END AS is_bend FROM k""")
def bend_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chains.bends(ad.vector_points(spark, sf_dir), key=["structure_id"])
    return out.select("structure_id", "ord", F.round("kappa", 5).alias("kappa"), "is_bend")


def _near(three: float, four: float, five: float, by: float) -> str:
    return " AND ".join([*[f"abs({d} - {three}) < {by}" for d in ("d13", "d24", "d35")], *[f"abs({d} - {four}) < {by}" for d in ("d14", "d25")], f"abs(d15 - {five}) < {by}"])


def _dd(a: str, b: str) -> str:
    return "sqrt(" + "+".join(f"({c}{a}-{c}{b})*({c}{a}-{c}{b})" for c in "xyz") + ")"


@query(f"""WITH {POINTS_SQL}, l AS (SELECT *, {_lag(-2)}, {_lag(-1)}, {_lag(1)}, {_lag(2)} FROM pts WINDOW w AS (PARTITION BY structure_id ORDER BY ord)),
d AS (SELECT *, {_dd('m2', '')} AS d13, {_dd('m1', 'p1')} AS d24, {_dd('', 'p2')} AS d35, {_dd('m2', 'p1')} AS d14, {_dd('m1', 'p2')} AS d25, {_dd('m2', 'p2')} AS d15 FROM l),
a AS (SELECT structure_id, ord, CASE WHEN xm2 IS NULL OR xp2 IS NULL THEN 'C' WHEN {_near(5.45, 5.18, 6.37, 2.1)} THEN 'H' WHEN {_near(6.1, 10.4, 13.0, 1.42)} THEN 'E' WHEN d15 < 8.0 THEN 'T' ELSE 'C' END AS s FROM d),
b AS (SELECT structure_id, ord, CASE WHEN s IN ('H', 'E') AND lag(s, 2) OVER w <> s AND lag(s) OVER w <> s AND lead(s) OVER w <> s AND lead(s, 2) OVER w <> s THEN 'C' ELSE s END AS s FROM a WINDOW w AS (PARTITION BY structure_id ORDER BY ord)),
c AS (SELECT structure_id, ord, CASE WHEN s IN ('H', 'E') AND (
  lead(s) OVER w = s AND lag(s, 2) OVER w <> s AND lag(s) OVER w <> s AND lead(s, 2) OVER w <> s AND lead(s, 3) OVER w <> s
  OR lag(s) OVER w = s AND lag(s, 3) OVER w <> s AND lag(s, 2) OVER w <> s AND lead(s) OVER w <> s AND lead(s, 2) OVER w <> s) THEN 'C' ELSE s END AS s FROM b WINDOW w AS (PARTITION BY structure_id ORDER BY ord)),
t AS (SELECT structure_id, string_agg(s, '' ORDER BY ord) AS t FROM c GROUP BY structure_id),
r AS (SELECT structure_id, list_reduce(list_concat([substr(t, 1, 1)], list_transform(range(2, length(t) + 1), lambda i: substr(t, i::INTEGER, 2))),
  lambda done, e: done || CASE WHEN length(e) = 2 AND right(done, 1) IN ('H', 'E') AND right(done, 1) = right(e, 1) THEN right(e, 1) ELSE left(e, 1) END) AS r FROM t)
SELECT c.structure_id, c.ord, substr(r, c.ord + 1, 1) AS state FROM c JOIN r ON c.structure_id = r.structure_id""")
def ca_ss_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.trace_structure(ad.vector_points(spark, sf_dir), ["structure_id"]).select("structure_id", "ord", "state")


@query(f"WITH {LINES_SQL}, l AS (SELECT l_orderkey, ord, l_returnflag, CASE WHEN l_returnflag <> lag(l_returnflag) OVER w THEN 1 WHEN lag(l_returnflag) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY ord)), r AS (SELECT *, sum(c) OVER (PARTITION BY l_orderkey ORDER BY ord) AS run FROM l) SELECT l_orderkey AS structure_id, l_returnflag AS flag, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS length FROM r GROUP BY l_orderkey, run, l_returnflag")
def run_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.order_points(spark, sf_dir).withColumnRenamed("chain_id", "flag")
    return chains.islands(p, "flag", ["structure_id"]).select("structure_id", "flag", "first_ord", "last_ord", "length")


# Retrieval


@query(f"WITH {TARGETS_SQL} SELECT seq_id, pos, kmer FROM ({kmers_sql('t', K)})")
def kmer_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.positions(ad.sequences(spark, sf_dir), K)


@query(f"WITH {TARGETS_SQL} SELECT DISTINCT kmer, seq_id FROM ({kmers_sql('t', K)})")
def kmer_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.postings(ad.sequences(spark, sf_dir), K).select("kmer", "seq_id")


@query(f"WITH {QUERIES_SQL} SELECT kmer, seq_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS places, count(*)::INTEGER AS n FROM ({kmers_sql('q', K)}) GROUP BY ALL")
def positional_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kmers.positional_postings(ad.query_sequences(spark, sf_dir), K)
    return p.select("kmer", "seq_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("places"), F.size("positions").alias("n"))


@query(f"WITH {TARGETS_SQL} SELECT kmer, count(DISTINCT seq_id) AS df FROM ({kmers_sql('t', K)}) GROUP BY kmer")
def kmer_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.document_frequency(kmers.postings(ad.sequences(spark, sf_dir), K))


_WEIGHTS = f"""{TARGETS_SQL}, {QUERIES_SQL}, qk AS (SELECT DISTINCT seq_id AS query_id, kmer FROM ({kmers_sql('q', K)})), tk AS (SELECT DISTINCT seq_id AS target_id, kmer FROM ({kmers_sql('t', K)})),
df AS (SELECT kmer, count(*) AS df FROM tk GROUP BY kmer), w AS (SELECT query_id, qk.kmer, ln(1 + ((SELECT count(*) FROM t) + 1) / (coalesce(df, 0) + 1)) AS weight FROM qk LEFT JOIN df ON qk.kmer = df.kmer)"""


@query(f"WITH {_WEIGHTS} SELECT query_id, kmer, round(weight, 6) AS weight FROM w")
def idf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(kmers.query_weights(ad.query_sequences(spark, sf_dir), ad.sequences(spark, sf_dir), K)[0], "weight")


@query(f"WITH {_WEIGHTS} SELECT query_id, target_id, count(*) AS shared FROM qk JOIN tk ON qk.kmer = tk.kmer GROUP BY ALL")
def shared_kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.shared_kmers(ad.query_sequences(spark, sf_dir), ad.sequences(spark, sf_dir), K)


_COVERAGE = f"{_WEIGHTS}, tot AS (SELECT query_id, sum(weight) AS total FROM w GROUP BY query_id), cov AS (SELECT w.query_id, target_id, count(*) AS shared, round(sum(weight) / any_value(total), 6) AS score FROM w JOIN tk ON w.kmer = tk.kmer JOIN tot ON tot.query_id = w.query_id GROUP BY w.query_id, target_id)"


@query(f"WITH {_COVERAGE} SELECT query_id, target_id, shared, score FROM cov")
def weighted_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.coverage(ad.query_sequences(spark, sf_dir), ad.sequences(spark, sf_dir), K)


@query(f"WITH {_COVERAGE} SELECT query_id, target_id, shared, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shared DESC, target_id)::INTEGER AS rank FROM cov) WHERE rank <= 10")
def search_topk_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.search(ad.query_sequences(spark, sf_dir), ad.sequences(spark, sf_dir), K)


flagship = search_topk_prefilter

_DIAG = f"{TARGETS_SQL}, {QUERIES_SQL}, dg AS (SELECT a.seq_id AS query_id, b.seq_id AS target_id, a.pos - b.pos AS diagonal, count(*) AS votes FROM ({kmers_sql('q', 10)}) a JOIN ({kmers_sql('t', 10)}) b ON a.kmer = b.kmer GROUP BY ALL)"


@query(f"WITH {_DIAG} SELECT query_id, target_id, diagonal, votes FROM dg")
def diagonal_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.diagonals(ad.query_sequences(spark, sf_dir), ad.sequences(spark, sf_dir), 10)


_BEST = f"{_DIAG}, best AS (SELECT query_id, target_id, -diagonal AS diagonal, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id, target_id ORDER BY votes DESC, -diagonal) AS n FROM dg) WHERE n = 1)"


@query(f"WITH {_BEST} SELECT query_id, target_id, diagonal, votes FROM best")
def best_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.best_diagonals(ad.query_sequences(spark, sf_dir), ad.sequences(spark, sf_dir), 10)


@query(f"WITH {_BEST} SELECT query_id, target_id, diagonal, votes, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, target_id)::INTEGER AS rank FROM best) WHERE rank <= 20")
def mmseqs_prefilter_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = kmers.best_diagonals(ad.query_sequences(spark, sf_dir), ad.sequences(spark, sf_dir), 10)
    return kmers.ranked(best, "query_id", [F.desc("votes"), "target_id"], 20)


@query(f"""WITH {_COVERAGE}, dg AS (SELECT a.seq_id AS query_id, b.seq_id AS target_id, a.pos - b.pos AS diagonal, count(*) AS votes FROM ({kmers_sql('q', 10)}) a JOIN ({kmers_sql('t', 10)}) b ON a.kmer = b.kmer GROUP BY ALL),
mv AS (SELECT query_id, target_id, max(votes) AS votes FROM dg GROUP BY ALL),
j AS (SELECT cov.*, coalesce(votes, 0) AS votes, coalesce(votes, 0) >= 3 AS ok FROM cov LEFT JOIN mv ON cov.query_id = mv.query_id AND cov.target_id = mv.target_id),
r AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY query_id) AS n_ok, row_number() OVER (PARTITION BY query_id ORDER BY ok DESC, CASE WHEN ok THEN votes ELSE 0 END DESC, shared DESC, target_id)::INTEGER AS rank FROM j)
SELECT query_id, rank, target_id, votes, shared, score FROM r WHERE ok OR n_ok = 0 OR rank <= 5""")
def diagonal_prefilter_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = ad.query_sequences(spark, sf_dir), ad.sequences(spark, sf_dir)
    votes = kmers.diagonals(q, t, 10).groupBy("query_id", "target_id").agg(F.max("votes").alias("votes"))
    return kmers.diagonal_rerank(kmers.coverage(q, t, K), votes, least=3, backfill=5)


@query(f"WITH {LINES_SQL}, v AS (SELECT l_orderkey, ord, l_quantity - 25 AS v FROM li), r AS (SELECT a.l_orderkey, a.ord AS a, b.ord + 1 AS b, (SELECT sum(v) FROM v c WHERE c.l_orderkey = a.l_orderkey AND c.ord BETWEEN a.ord AND b.ord) AS best FROM v a JOIN v b ON a.l_orderkey = b.l_orderkey AND a.ord <= b.ord), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY best DESC, b, a) AS n FROM r) SELECT l_orderkey, round(best, 6) AS best, a AS start, b AS \"end\" FROM n WHERE n = 1 AND best > 0")
def ungapped_kadane(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ad.lines(spark, sf_dir).withColumn("score", F.col("l_quantity") - 25)
    return _rounded(kmers.best_run(x, ["l_orderkey"], "ord", "score"), "best")


@query("WITH c AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS s, list_sort(list(DISTINCT l_partkey)) AS p FROM lineitem GROUP BY l_orderkey) SELECT k AS l_orderkey, round(len(list_intersect(s, p)) / len(list_distinct(s || p)), 6) AS jaccard FROM c")
def jaccard_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"), F.collect_set("l_partkey").alias("p"))
    return x.select("l_orderkey", F.round(kmers.jaccard(F.col("s"), F.col("p")), 6).alias("jaccard"))


@query("WITH h AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS s FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY s DESC, l_suppkey)::INTEGER AS rank, max(s) OVER (PARTITION BY l_partkey) AS m FROM h) SELECT l_partkey, l_suppkey, rank, round(s / m, 6) AS score FROM r WHERE rank <= 4")
def template_norm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("s"))
    w = Window.partitionBy("l_partkey")
    r = h.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("s"), "l_suppkey")), "m": F.max("s").over(w)}).where("rank <= 4")
    return r.select("l_partkey", "l_suppkey", "rank", F.round(F.col("s") / F.col("m"), 6).alias("score"))


# Sets


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dropped_inputs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def id_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("id")).union(x.where("l_returnflag = 'R'").select("l_suppkey")).distinct()


# Releases and failures


@query("SELECT d.doc_id AS record_id, coalesce(d.source, 'labels') AS source_id, n_chars, quality, CASE WHEN b.item_id IS NULL THEN 'train' ELSE 'test' END AS split, CASE WHEN b.item_id IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM documents d JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def training_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("source_id"), "n_chars")
    s = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_id"), F.lit("labels").alias("source_id"), "quality")
    splits = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("record_id"), F.lit("test").alias("split"), F.lit(0.5).alias("weight"))
    return releases.training_join(d, s, splits).select("record_id", "source_id", "n_chars", "quality", "split", "weight")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query()
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLAKE2b has no SQL form: checked in the tests."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", releases.hash_split(F.col("source"), {"train": 0.8, "val": 0.1, "test": 0.1}).alias("split"))


@query("SELECT count(*) AS n, coalesce(min(n_chars)::DOUBLE, 0.0) AS min_length, coalesce(max(n_chars)::DOUBLE, 0.0) AS max_length, round(coalesce(avg(n_chars), 0.0), 6) AS mean_length FROM documents")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(releases.length_summary(table(spark, sf_dir, "documents"), "n_chars"), "mean_length")


@query("SELECT sum(toxic)::DOUBLE AS present, (sum(quality) * 8)::DOUBLE AS possible, round(sum(toxic) / (sum(quality) * 8), 6) AS fraction FROM labels")
def completeness_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(releases.completeness(table(spark, sf_dir, "labels"), "toxic", "quality", 8), "fraction")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.duplicates(table(spark, sf_dir, "documents"), "text")


@query("WITH c AS (SELECT l_orderkey, l_returnflag, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem)) SELECT CASE WHEN n > 1 THEN l_orderkey || '_' || l_returnflag ELSE l_orderkey::VARCHAR END AS record_id, l_orderkey AS parent_id, l_returnflag AS chain_id FROM c")
def chain_expand_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.expand_chains(ad.order_points(spark, sf_dir))


@query("WITH o AS (SELECT s.o_orderkey FROM orders s), m AS (SELECT (SELECT count(*) FROM o) AS n_orders, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_with_lines) SELECT n_orders, n_with_lines, n_with_lines > n_orders AS exceeds FROM m")
def count_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("n_orders"))
    m = table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_orderkey").alias("n_with_lines"))
    return n.join(F.broadcast(m)).select("n_orders", "n_with_lines", (F.col("n_with_lines") > F.col("n_orders")).alias("exceeds"))  # one row each


#: Failure messages of the documents, by id; the last stands for any other.
_SAID = [
    "Atom charge is not correct in line 12", "SOLITARY DBREF1 definition found", "Atoms in models not corresponding between 1 and 2", "Could not find a bond partner named in SSBOND 3", "Multiple residues in SEQRES validation at 7",
    "SEQRES residue total invalid for chain B", "Invalid data in field 4 of SEQADV", "Invalid data in field 2: the text presented is not of the right kind (isize)", "Invalid data in field 9 of CRYST1", "Malformed line after END",
    "Missing backbone at residue 5", "Input requires a protein chain", "Unknown residue QQQ", "Hydrogen could be placed nowhere, failed", "No parameters: force field lookup", "Minimization did not converge in 50 steps",
    "Energy is NaN", "Quality check rejected the model", "Unsupported ligand", "Something else went wrong",
]
_MESSAGES = f"m AS (SELECT doc_id, source, {_SAID!r}[doc_id % {len(_SAID)} + 1] AS message FROM documents)"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*[F.lit(x) for x in _SAID])
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.element_at(said, (F.col("doc_id") % len(_SAID) + 1).cast("int")).alias("message"))


_BUCKETS = """CASE doc_id % 20 WHEN 0 THEN 'atom_charge_suffix' WHEN 1 THEN 'solitary_dbref1_definition' WHEN 2 THEN 'model_atom_correspondence' WHEN 3 THEN 'ssbond_missing_partner' WHEN 4 THEN 'seqres_multiple_residues'
WHEN 5 THEN 'seqres_total_invalid' WHEN 6 THEN 'seqadv_invalid_field' WHEN 7 THEN 'seqadv_invalid_field' WHEN 8 THEN 'invalid_data_field_other' ELSE 'other_load_error' END"""


@query(f"WITH {_MESSAGES} SELECT doc_id, message, {_BUCKETS} AS bucket FROM m")
def loader_failure_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("doc_id", "message", failures.loader_bucket(F.col("message")).alias("bucket"))


_CLASSES = """CASE doc_id % 20 WHEN 9 THEN 'parse_error' WHEN 10 THEN 'missing_required_atoms' WHEN 11 THEN 'missing_required_atoms' WHEN 12 THEN 'residue_mapping_error' WHEN 13 THEN 'hydrogen_placement_error'
WHEN 14 THEN 'forcefield_parameterization_error' WHEN 15 THEN 'minimization_nonconvergence' WHEN 16 THEN 'numerical_instability' WHEN 17 THEN 'postprep_quality_failure' WHEN 18 THEN 'unsupported_chemistry' ELSE 'internal_pipeline_error' END"""


@query(f"WITH {_MESSAGES} SELECT doc_id, {_CLASSES} AS failure FROM m")
def failure_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("doc_id", failures.failure_class(F.col("message")).alias("failure"))


@query(f"WITH {_MESSAGES}, c AS (SELECT doc_id, source, {_CLASSES} AS failure FROM m), f AS (SELECT failure, source, min(doc_id) AS o FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY failure ORDER BY o, source) AS r FROM f) SELECT failure, (SELECT count(*) FROM c WHERE c.failure = r.failure) AS n, string_agg(source, ',' ORDER BY r) AS examples FROM r WHERE r <= 5 GROUP BY failure")
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).withColumn("failure", failures.failure_class(F.col("message")))
    return failures.summary(rows, "failure", "source", "doc_id")


@query("WITH c AS (SELECT l_linenumber AS \"column\", l_suppkey % 22 AS class, 1.0::DOUBLE - l_discount AS mask FROM lineitem), t AS (SELECT \"column\", sum(mask) AS total FROM c GROUP BY ALL), o AS (SELECT \"column\", class, sum(mask) AS w FROM c GROUP BY ALL) SELECT o.\"column\", o.class, round(w / total, 6) AS freq FROM o JOIN t ON o.\"column\" = t.\"column\"")
def msa_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    cells = x.select(F.col("l_linenumber").alias("column"), (F.col("l_suppkey") % 22).alias("class"), (1.0 - F.col("l_discount")).alias("mask"))
    return _rounded(releases.msa_profile(cells), "freq")


@query("SELECT vec_id, round(CASE WHEN n > 21 THEN greatest(0.5, 1.24 * pow(n - 15, 1.0::DOUBLE / 3.0::DOUBLE) - 1.8) ELSE 0.5 END, 6) AS d0 FROM (SELECT vec_id, 10 + vec_id % 300 AS n FROM embeddings)")
def tm_distance_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(g.tm_d0(10 + F.col("vec_id") % 300), 6).alias("d0"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _rounded(ingest.windowed_counts(table(spark, sf_dir, "events"), "1 hour"), "total")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# Kernels: iterative numerics without an SQL form, held against plain formulas in the tests


@query()
def kabsch_tm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = vector_pairs(spark, sf_dir)
    return kernels.superpose(a, b).select("pair_id", F.round("rmsd", 6).alias("rmsd"), F.round("tm", 6).alias("tm"), "n_points")


@query()
def sasa_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.vector_points(spark, sf_dir)
    atoms = p.select(F.col("structure_id").cast("string").alias("structure_id"), F.col("ord").cast("bigint").alias("atom_ord"), F.lit("CA").alias("atom_name"), F.lit("ALA").alias("residue_name"), F.lit("C").alias("element"), "x", "y", "z")
    return kernels.sasa(atoms).withColumn("sasa", F.round("sasa", 6))


@query()
def dssp_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _residues(spark, sf_dir)
    ca = [((F.col(f"n{c}") + F.col(f"c{c}")) / 2).alias(f"ca{c}") for c in "xyz"]
    return kernels.secondary_structure(r.select(F.col("structure_id").cast("string").alias("structure_id"), "chain_id", "ord", *[f"{a}{c}" for a in "nhco" for c in "xyz"], *ca))


@query()
def smith_waterman_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target that shares a 10-mer with a query, both aligned as a whole with gaps, ranked by score."""
    q, t = ad.query_sequences(spark, sf_dir), ad.sequences(spark, sf_dir)
    found = hits.aligned(q, t, 10)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("votes"), "target_id")
    return found.select("query_id", "target_id", F.row_number().over(w).alias("rank"), "votes", "score", "query_start", "target_start", "cigar")


# Sequence engine

_LETTERS = engine.PROTEIN
_SHORT = f"""n AS (SELECT n_nationkey AS query_id, regexp_replace(upper(n_name), '[^{_LETTERS}]', 'X', 'g') AS q FROM nation), r AS (SELECT s_suppkey AS target_id, regexp_replace(upper(s_name), '[^{_LETTERS}]', 'X', 'g') AS t FROM supplier)"""


def _short_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations beside those of their suppliers, as short sequences."""
    fold = lambda c: F.regexp_replace(F.upper(c), f"[^{_LETTERS}]", "X")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), "n_nationkey", fold("n_name").alias("query_seq"))
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target_id"), "s_nationkey", fold("s_name").alias("target_seq"))
    return n.join(r, n.n_nationkey == r.s_nationkey).select("query_id", "target_id", "query_seq", "target_seq")


@query(f"WITH {_SHORT} SELECT query_id::BIGINT AS seq_id, (i - 1)::INTEGER AS pos, l.letter, CASE WHEN substr(q, i::INTEGER, 1) = l.letter THEN 5.0::DOUBLE ELSE -4.0::DOUBLE END AS score FROM n, (SELECT unnest(string_split('{_LETTERS}', '')) AS letter) l, range(1, 30) t(i) WHERE i <= length(q)")
def position_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("seq_id"), F.regexp_replace(F.upper("n_name"), f"[^{_LETTERS}]", "X").alias("seq"))
    return engine.position_scores(q, engine.score_rows(spark, engine.simple_scores()))


@query(f"""WITH {_SHORT}, p AS (SELECT query_id::BIGINT AS query_id, target_id, q, t FROM n JOIN supplier ON s_nationkey = query_id JOIN r ON target_id = s_suppkey),
c AS (SELECT query_id, target_id, i, j, CASE WHEN substr(q, i::INTEGER, 1) = substr(t, j::INTEGER, 1) THEN 5.0::DOUBLE ELSE -4.0::DOUBLE END AS s FROM p, range(1, 60) a(i), range(1, 60) b(j) WHERE i <= length(q) AND j <= length(t)),
u AS (SELECT *, sum(s) OVER (PARTITION BY query_id, target_id, i - j ORDER BY i) AS u FROM c),
m AS (SELECT *, u - least(0, coalesce(min(u) OVER (PARTITION BY query_id, target_id, i - j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS run FROM u)
SELECT p.query_id, p.target_id, greatest(0, max(run)) AS best, round(greatest(0, max(run)) / greatest(any_value(length(q)), any_value(length(t))), 6) AS rescored FROM p JOIN m ON m.query_id = p.query_id AND m.target_id = p.target_id GROUP BY p.query_id, p.target_id""")
def diagonal_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(engine.rescore(_short_pairs(spark, sf_dir), engine.simple_scores()), "rescored")


#: Classes of the protein letters by a rule: every third letter together, the unknown one alone.
_CLASSES_OF = [i % 3 for i in range(len(_LETTERS) - 1)] + [3]


@query(f"WITH {TARGETS_SQL} SELECT seq_id, translate(seq, '{_LETTERS}', '{''.join('ACDX'[c] for c in _CLASSES_OF)}') AS seq FROM t")
def reduced_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.sequences(spark, sf_dir).select("seq_id", engine.reduced(F.col("seq"), _CLASSES_OF).alias("seq"))


@query(f"WITH {QUERIES_SQL} SELECT DISTINCT k, kmer, seq_id FROM (SELECT 5 AS k, kmer, seq_id FROM ({kmers_sql('q', 5)}) UNION ALL SELECT 8, kmer, seq_id FROM ({kmers_sql('q', 8)}))")
def multi_length_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.kmers_of_lengths(ad.query_sequences(spark, sf_dir), [8, 5, 5])


@query("SELECT vec_id, CASE WHEN phi > -160 AND phi < -20 AND psi > -80 AND psi < 0 THEN 'alpha_R' WHEN phi >= -180 AND phi < -20 AND (psi > 50 AND psi <= 180 OR psi >= -180 AND psi < -100) THEN 'beta' WHEN phi > 0 AND phi < 120 AND psi > -60 AND psi < 60 THEN 'alpha_L' ELSE 'other' END AS region FROM (SELECT vec_id, embedding[1]::DOUBLE * 600 AS phi, embedding[2]::DOUBLE * 600 AS psi FROM embeddings)")
def ramachandran_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 600).alias("phi"), (F.col("embedding")[1].cast("double") * 600).alias("psi"))
    return e.select("vec_id", engine.ramachandran(F.col("phi"), F.col("psi")).alias("region"))


@query("SELECT l_orderkey, CASE WHEN max(l_discount) > 0 THEN round((max(l_discount) - min(l_discount)) / max(l_discount), 6) ELSE 0 END AS degree FROM lineitem GROUP BY l_orderkey")
def heteromer_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(engine.heteromer_degree(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_discount"), "degree")


@query("SELECT doc_id, string_agg(CASE WHEN c BETWEEN 'a' AND 'm' THEN c END, '' ORDER BY i) AS kept FROM (SELECT doc_id, i, substr(lang || source, i::INTEGER, 1) AS c FROM documents, range(1, 40) t(i) WHERE i <= length(lang || source)) GROUP BY doc_id")
def masked_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", "source").alias("s"))
    mask = F.transform(F.filter(F.split("s", ""), lambda c: c != ""), lambda c: c.between("a", "m"))
    out = engine.masked(F.col("s"), mask)
    return d.select("doc_id", F.when(out != "", out).alias("kept"))


@query()
def msa_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of suppliers aligned to those of their nations, as rows in the nation's frame."""
    pairs = _short_pairs(spark, sf_dir)
    found = engine.matrix_alignments(pairs, engine.simple_scores()).where("score > 0").join(pairs.select("query_id", "target_id", "target_seq"), ["query_id", "target_id"])
    own = pairs.select(F.col("query_id").alias("seq_id"), F.col("query_seq").alias("seq")).distinct()
    return engine.assemble(own, found)


@query("SELECT o_orderpriority AS split, count(*) AS n, min(length(o_orderstatus || o_orderpriority))::DOUBLE AS min_length, max(length(o_orderstatus || o_orderpriority))::DOUBLE AS max_length FROM orders GROUP BY o_orderpriority")
def corpus_manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split counts of a release's manifest, with the lengths of each split's rows."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), F.length(F.concat("o_orderstatus", "o_orderpriority")).alias("length"))
    splits = releases.corpus_manifest("r", training=rows)["split_counts"]
    counts = spark.createDataFrame(list(splits.items()), "split string, n bigint")
    return counts.join(rows.groupBy("split").agg(F.min("length").cast("double").alias("min_length"), F.max("length").cast("double").alias("max_length")), "split")


# Structures as files and residues


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as structures of 21 atoms of seven residues, in the columns of the atom table."""
    p = ad.vector_points(spark, sf_dir)
    element = F.element_at(F.array(*[F.lit(e) for e in "NOSCH"]), (F.col("ord") % 5 + 1).cast("int"))
    return p.select(
        F.col("structure_id").cast("string").alias("structure_id"), F.lit(0).alias("model"), F.lit("A").alias("chain_id"), F.when(F.floor(F.col("ord") / 3) % 2 == 0, "GLY").otherwise("ALA").alias("residue_name"),
        (F.floor(F.col("ord") / 3) + 1).cast("int").alias("residue_serial"), F.lit(None).cast("string").alias("insertion_code"), F.lit(None).cast("string").alias("conformer_id"), element.alias("atom_name"), (F.col("ord") + 1).alias("atom_serial"),
        element.alias("element"), "x", "y", "z", F.lit(1.0).alias("occupancy"), F.lit(20.0).alias("b_factor"), F.lit(False).alias("is_hetero"), F.col("ord").cast("bigint").alias("atom_ord"), F.col("ord"), F.floor(F.col("ord") / 3).cast("int").alias("residue_ord"),
    )


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): the structures as PDB files; every seventh is cut inside its first line."""
    lines = sinks.pdb_lines(_atoms(spark, sf_dir)).groupBy("structure_id").agg(F.sort_array(F.collect_list(F.struct("atom_ord", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x.line), "\n")
    text = F.when(F.col("structure_id").cast("bigint") % 7 == 0, F.substring(text, 1, 40)).otherwise(text)
    return lines.select(F.concat("structure_id", F.lit(".pdb")).alias("path"), F.encode(text, "UTF-8").alias("content"))


@query(f"WITH {POINTS_SQL} SELECT structure_id::VARCHAR AS structure_id, ord::BIGINT AS atom_ord, CASE WHEN ord // 3 % 2 = 0 THEN 'GLY' ELSE 'ALA' END AS residue_name, (ord // 3 + 1)::BIGINT AS residue_serial, substr('NOSCH', ord % 5 + 1, 1) AS element, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z FROM pts WHERE structure_id % 7 <> 0")
def pdb_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms written as PDB lines and read again; files that can't be read are left out."""
    a = structures.atoms(structures.parsed(_files(spark, sf_dir)))
    return a.select("structure_id", F.col("atom_ord").cast("bigint").alias("atom_ord"), "residue_name", F.col("residue_serial").cast("bigint").alias("residue_serial"), "element", *[(F.col(c).cast("double") + 0.0).alias(c) for c in "xyz"])


@query("SELECT vec_id::VARCHAR || '.pdb' AS path, true AS has_error FROM embeddings WHERE vec_id % 7 = 0")
def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.failures(structures.parsed(_files(spark, sf_dir))).select("path", (F.length("error") > 0).alias("has_error"))


@query(f"WITH {POINTS_SQL} SELECT structure_id::VARCHAR AS structure_id, count(*) AS n FROM pts WHERE ord % 5 <> 4 GROUP BY structure_id")
def heavy_atom_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.without_hydrogens(_atoms(spark, sf_dir)).groupBy("structure_id").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS_SQL}, e AS (SELECT *, substr('NOSCH', ord % 5 + 1, 1) AS e FROM pts) SELECT a.structure_id::VARCHAR AS structure_id, a.ord::BIGINT AS donor, b.ord::BIGINT AS acceptor, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS dist FROM e a JOIN e b ON a.structure_id = b.structure_id AND a.ord <> b.ord AND a.ord // 3 <> b.ord // 3 AND a.e IN ('N', 'O') AND b.e IN ('O', 'S') WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 3.5")
def geometric_hbonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = points.geometric_hbonds(_atoms(spark, sf_dir))
    return out.select("structure_id", F.col("donor").cast("bigint").alias("donor"), F.col("acceptor").cast("bigint").alias("acceptor"), F.round("dist", 6).alias("dist"))


_WHOLE = f"{POINTS_SQL}, rs AS (SELECT structure_id, ord // 5 AS r, " + ", ".join(f"max(CASE WHEN ord % 5 = {k} THEN {c} END) AS {n}{c}" for k, n in enumerate(("n", "ca", "c", "o", "cb")) for c in "xyz") + " FROM pts WHERE ord < 20 GROUP BY ALL)"


def _whole_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as four residues of five atoms; every second is a glycine, and every third vector's second residue a proline."""
    p = ad.vector_points(spark, sf_dir).where("ord < 20").withColumn("r", F.floor(F.col("ord") / 5).cast("int"))
    cells = [F.max(F.when(F.col("ord") % 5 == k, F.col(c))).alias(f"{n}{c}") for k, n in enumerate(("n", "ca", "c", "o", "cb")) for c in "xyz"]
    name = F.when((F.col("structure_id") % 3 == 0) & (F.col("ord") == 1), "PRO").when(F.col("ord") % 2 == 0, "GLY").otherwise("ALA")
    return p.groupBy("structure_id", F.col("r").alias("ord")).agg(*cells).withColumns({"chain_id": F.lit("A"), "residue_name": name, "residue_serial": F.col("ord") + 1})


@query(f"WITH {_WHOLE} SELECT structure_id, r::BIGINT AS ord, " + ", ".join(f"round(CASE WHEN r % 2 = 0 THEN ca{c} ELSE cb{c} END, 6) AS beta_{c}" for c in "xyz") + ", 1.0::DOUBLE AS beta_mask FROM rs")
def pseudo_beta_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _whole_residues(spark, sf_dir).withColumn("residue_name", F.when(F.col("ord") % 2 == 0, "GLY").otherwise("ALA"))
    return at.pseudo_beta(r).select("structure_id", F.col("ord").cast("bigint").alias("ord"), *[F.round(f"beta_{c}", 6).alias(f"beta_{c}") for c in "xyz"], "beta_mask")


@query(f"""WITH {_WHOLE}, l AS (SELECT *, {', '.join(f'n{c} - lag(c{c}) OVER (PARTITION BY structure_id ORDER BY r) AS p{c}, n{c} - ca{c} AS m{c}' for c in 'xyz')} FROM rs),
u AS (SELECT *, sqrt(px*px+py*py+pz*pz) AS la, sqrt(mx*mx+my*my+mz*mz) AS lb FROM l), v AS (SELECT *, {', '.join(f'p{c}/la + m{c}/lb AS s{c}' for c in 'xyz')} FROM u), w AS (SELECT *, sqrt(sx*sx+sy*sy+sz*sz) AS ls FROM v)
SELECT structure_id, r::BIGINT AS ord, {', '.join(f"round(CASE WHEN structure_id % 3 = 0 AND r = 1 THEN NULL ELSE n{c} + 1.01 * s{c} / ls END, 6) AS h{c}" for c in 'xyz')} FROM w""")
def amide_hydrogen_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chains.amide_hydrogens(_whole_residues(spark, sf_dir))
    return out.select("structure_id", F.col("ord").cast("bigint").alias("ord"), *[F.round(f"h{c}", 6).alias(f"h{c}") for c in "xyz"])


@query(f"WITH {QUERIES_SQL}, w AS (SELECT seq_id, unnest(range(0, length(seq) - 3)) AS pos, seq FROM q WHERE length(seq) >= 4) SELECT seq_id, pos::INTEGER AS pos, (" + " + ".join(f"(instr('{_LETTERS}', substr(seq, pos::INTEGER + {i + 1}, 1)) - 1) * {21**i}" for i in range(4)) + ")::BIGINT AS hash FROM w WHERE NOT contains(substr(seq, pos::INTEGER + 1, 4), 'X')")
def hashed_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.hashed_positions(ad.query_sequences(spark, sf_dir), 4, _LETTERS)


@query(f"WITH {_SHORT}, k AS (SELECT DISTINCT substr(q, 1, 2) AS kmer FROM n WHERE length(q) >= 2), l AS (SELECT unnest(string_split('ACDEX', '')) AS b) SELECT kmer, x.b || y.b AS similar, (CASE WHEN substr(kmer, 1, 1) = x.b THEN 5 ELSE -1 END + CASE WHEN substr(kmer, 2, 1) = y.b THEN 5 ELSE -1 END)::BIGINT AS score FROM k, l x, l y WHERE (CASE WHEN substr(kmer, 1, 1) = x.b THEN 5 ELSE -1 END + CASE WHEN substr(kmer, 2, 1) = y.b THEN 5 ELSE -1 END) >= 4")
def similar_kmer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two letters of nations' names, against strings of five letters."""
    seq = F.regexp_replace(F.upper("n_name"), f"[^{_LETTERS}]", "X")
    k = table(spark, sf_dir, "nation").select(F.substring(seq, 1, 2).alias("kmer")).where("length(kmer) = 2").distinct()
    scores = spark.createDataFrame([(a, b, 5 if a == b else -1) for a in _LETTERS for b in "ACDEX"], "a string, b string, score long")
    return kmers.similar_kmers(k, scores, 2, 4).withColumn("score", F.col("score").cast("bigint"))


@query("SELECT x.c AS class_a, y.c AS class_b, avg(abs(x.i - y.i)::DOUBLE) AS score FROM (SELECT i, i % 4 AS c FROM range(0, 21) t(i)) x, (SELECT i, i % 4 AS c FROM range(0, 21) t(i)) y GROUP BY x.c, y.c")
def reduced_matrix_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = spark.createDataFrame([(a, b, float(abs(i - j))) for i, a in enumerate(_LETTERS) for j, b in enumerate(_LETTERS)], "a string, b string, score double")
    classes = spark.createDataFrame([(a, i % 4) for i, a in enumerate(_LETTERS)], "letter string, class long")
    return kmers.reduced_matrix(scores, classes)


# Topology

_BONDED = f"""{POINTS_SQL}, e AS (SELECT *, substr('NOSCH', ord % 5 + 1, 1) AS e, 1.5 + (ord % 3) * 0.1 AS rad, 0.05 + (ord % 2) * 0.05 AS dep, CASE WHEN ord % 2 = 0 THEN 0.25::DOUBLE ELSE -0.25::DOUBLE END AS chg FROM pts),
pr AS (SELECT a.structure_id, a.ord AS i, b.ord AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d, CASE WHEN a.e = 'H' OR b.e = 'H' THEN 1.3 WHEN a.e = 'S' OR b.e = 'S' THEN 2.2 ELSE 1.9 END AS most,
  a.rad + b.rad AS rad, sqrt((a.dep * b.dep)::DOUBLE) AS dep, a.chg * b.chg AS chg FROM e a JOIN e b ON a.structure_id = b.structure_id AND a.ord < b.ord),
bo AS (SELECT structure_id, i, j FROM pr WHERE d < most AND d > 0.4), en AS (SELECT structure_id, i AS a, j AS b FROM bo UNION ALL SELECT structure_id, j, i FROM bo)"""
_ANGLES = f"{_BONDED}, an AS (SELECT x.structure_id, x.b AS i, x.a AS j, y.b AS k FROM en x JOIN en y ON x.structure_id = y.structure_id AND x.a = y.a AND x.b < y.b)"
_TORSIONS = f"{_ANGLES}, tr AS (SELECT m.structure_id, x.b AS i, m.i AS j, m.j AS k, y.b AS l FROM bo m JOIN en x ON x.structure_id = m.structure_id AND x.a = m.i AND x.b <> m.j JOIN en y ON y.structure_id = m.structure_id AND y.a = m.j AND y.b <> m.i AND y.b <> x.b)"
_APART = f"{_TORSIONS}, ap AS (SELECT structure_id, i, j, min(n) AS apart FROM (SELECT structure_id, i, j, 1 AS n FROM bo UNION ALL SELECT structure_id, i, k, 2 FROM an UNION ALL SELECT structure_id, least(i, l), greatest(i, l), 3 FROM tr) GROUP BY ALL)"


def _bonded(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ad.vector_points(spark, sf_dir).withColumn("element", F.element_at(F.array(*[F.lit(e) for e in "NOSCH"]), (F.col("ord") % 5 + 1).cast("int")))
    return a.withColumns({"radius": 1.5 + (F.col("ord") % 3) * 0.1, "depth": 0.05 + (F.col("ord") % 2) * 0.05, "charge": F.when(F.col("ord") % 2 == 0, 0.25).otherwise(-0.25)})


@query(f"WITH {_BONDED} SELECT structure_id, i, j FROM bo")
def bonds_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.bonds(_bonded(spark, sf_dir), inside=None)


@query(f"WITH {_ANGLES} SELECT structure_id, i, j, k FROM an")
def bond_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.angles(topology.bonds(_bonded(spark, sf_dir), inside=None))


@query(f"WITH {_TORSIONS} SELECT structure_id, i, j, k, l FROM tr")
def bond_torsions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.torsions(topology.bonds(_bonded(spark, sf_dir), inside=None))


@query(f"WITH {_APART} SELECT structure_id, i, j, apart FROM ap")
def bound_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.bound_pairs(topology.bonds(_bonded(spark, sf_dir), inside=None))


@query(f"""WITH {_APART}, nb AS (SELECT pr.*, apart, pow(rad / d, 6) AS q FROM pr LEFT JOIN ap ON ap.structure_id = pr.structure_id AND ap.i = pr.i AND ap.j = pr.j WHERE d < 6.0 AND d > 0.4 AND (apart IS NULL OR apart = 3))
SELECT structure_id, round(sum(CASE WHEN apart = 3 THEN 0.5 ELSE 1.0 END * dep * (q * q - 2 * q)), 3) AS vdw, round(sum(CASE WHEN apart = 3 THEN 1.0 / 1.2::DOUBLE ELSE 1.0 END * 332.0637 * chg / d), 4) AS electrostatic, count(*) AS n_pairs FROM nb GROUP BY structure_id""")
def pair_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _bonded(spark, sf_dir)
    out = topology.pair_energies(a, topology.bound_pairs(topology.bonds(a, inside=None)), 6.0, least=0.4)
    return out.select("structure_id", F.round("vdw", 3).alias("vdw"), F.round("electrostatic", 4).alias("electrostatic"), "n_pairs")


@query()
def tm_align_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the next of its label as chains, aligned by structure."""
    a, b = vector_pairs(spark, sf_dir)
    return kernels.align_structures(a, b).select("pair_id", F.round("tm", 6).alias("tm"), "n_aligned", F.round("rmsd", 6).alias("rmsd"))
