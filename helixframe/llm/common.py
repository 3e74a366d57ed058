"""Shared helpers of the corpus operators: shared folders, id handling and batch iteration."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent, a local session (one machine, as in tests) gets a temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    at = sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="helixframe-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage starts at the files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns that an operator reads, so that extra or clashing ones can't get in its way."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """The texts of a batch, one at a time; null is the empty text."""
    for x in batch.column(batch.schema.get_field_index(column)):
        yield x.as_py() or ""


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
