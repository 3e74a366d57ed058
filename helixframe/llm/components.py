"""Connected components by alternating large-star and small-star steps on edge tables.

Every step is a grouped minimum (combined before its shuffle) and a join, so no neighbourhood is gathered in one place.
Each round is written to the shared folder, from which a lost executor's work is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Edges here have a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    near = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) bigint edges in either direction -> (a, b): each node that isn't the smallest of its component, and that smallest."""
    spark = edges.sparkSession

    def write(df: DataFrame) -> tuple[str, DataFrame, tuple]:
        path = scratch(spark, "edges")
        df.write.parquet(path)
        got = spark.read.schema("a bigint, b bigint").parquet(path)
        mark = got.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return path, got, tuple(mark)

    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path, e, mark = write(start)
    while mark[0]:
        newer = write(_small_star(_large_star(e).distinct()).distinct())
        if newer[2] == mark:
            forget(spark, newer[0])
            break
        forget(spark, path)
        path, e, mark = newer
    return e
