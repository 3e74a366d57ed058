"""Views of general tables in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import kmers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_points(spark: SparkSession, sf_dir: str, scale: float = 20.0) -> DataFrame:
    """Embeddings as chains of 21 points: (structure_id, label, ord, x, y, z)."""
    e = F.col("embedding")
    place = lambda i, k: F.element_at(e, 3 * i + k).cast("double") * scale
    points = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(place(i, 1).alias("x"), place(i, 2).alias("y"), place(i, 3).alias("z")))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("structure_id"), "label", F.posexplode(points).alias("ord", "p"))
    return rows.select("structure_id", "label", "ord", "p.x", "p.y", "p.z")


#: The same in SQL.
POINTS_SQL = (
    "pts AS (SELECT vec_id AS structure_id, label, i AS ord, embedding[3*i+1]::DOUBLE * 20.0 AS x, embedding[3*i+2]::DOUBLE * 20.0 AS y, embedding[3*i+3]::DOUBLE * 20.0 AS z "
    "FROM embeddings, (SELECT unnest(range(0, 21))::INTEGER AS i) r)"
)


#: Line numbers repeat within an order, so lines are numbered anew in an order without ties.
_LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
LINES_SQL = f"li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINES)})::INTEGER AS ord FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINES)))


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chains of their lines: (structure_id, chain_id, ord, x, y, z)."""
    x = lines(spark, sf_dir)
    return x.select(F.col("l_orderkey").alias("structure_id"), F.col("l_returnflag").alias("chain_id"), "ord", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))


ORDERS_SQL = f"{LINES_SQL}, pts AS (SELECT l_orderkey AS structure_id, l_returnflag AS chain_id, ord, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM li)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq_id"), kmers.fold_protein(kmers.letters(F.col("text"))).alias("seq"))


def query_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("seq_id"), kmers.fold_protein(kmers.letters(F.col("text"))).alias("seq"))


_FOLD = "regexp_replace(translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'BZJUO', 'DELXX'), '[^ACDEFGHIKLMNPQRSTVWYX]', 'X', 'g')"
TARGETS_SQL = f"t AS (SELECT doc_id AS seq_id, {_FOLD} AS seq FROM documents)"
QUERIES_SQL = f"q AS (SELECT item_id AS seq_id, {_FOLD} AS seq FROM benchmark)"


def kmers_sql(source: str, k: int) -> str:
    """(seq_id, pos, kmer) of all windows; a shorter sequence is one k-mer."""
    return (
        f"SELECT seq_id, i AS pos, substr(seq, i + 1, {k}) AS kmer FROM (SELECT seq_id, seq, unnest(range(0, greatest(length(seq) - {k - 1}, 1)))::INTEGER AS i FROM {source} WHERE seq <> '')"
    )
