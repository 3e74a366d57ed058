"""Readers of sequence files: FASTA, aligned a3m, substitution matrices and failure logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, description, seq): one row for each record, split by Spark at the record mark."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(record, r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\r\n]*", ""), r"[\s>]", "")
    return rows.where(F.trim("value") != "").select(F.regexp_extract(head, r"^(\S*)", 1).alias("accession"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), body.alias("seq"))


def write_fasta(rows: DataFrame, path: str) -> None:
    rows.select(F.concat(F.lit(">"), F.concat_ws(" ", "accession", F.when(F.col("description") != "", F.col("description"))), F.lit("\n"), F.col("seq")).alias("value")).write.text(path)


def parse_a3m(text: str) -> tuple[list[str], list[list[int]]]:
    """Aligned rows and deletions. Lower-case letters are insertions: their number stands at the next column; those at the end are dropped."""
    names, rows = [], []
    for line in text.splitlines():
        if line.startswith(">"):
            names.append(line[1:].strip())
            rows.append("")
        elif rows and line.strip():
            rows[-1] += line.strip()
    if not rows:
        raise ValueError("a3m: no sequence")
    if any(c.islower() for c in rows[0]):
        raise ValueError("a3m: the query has insertions")
    aligned, deletions = [], []
    for r in rows:
        cells, gone, n = [], [], 0
        for c in r:
            if c.islower():
                n += 1
            else:
                cells.append(c)
                gone.append(n)
                n = 0
        if len(cells) != len(rows[0]):
            raise ValueError("a3m: rows of different length")
        aligned.append("".join(cells))
        deletions.append(gone)
    return aligned, deletions


def read_a3m(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, row, aligned, deletions): a row for each sequence of each file; a file that can't be read fails or is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    aligned, deletions = parse_a3m(data.decode("utf-8", "replace"))
                except ValueError:
                    if strict:
                        raise
                    continue
                n = len(aligned)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array(aligned), pa.array(deletions, pa.list_(pa.int32()))], names=["path", "row", "aligned", "deletions"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row int, aligned string, deletions array<int>")


def msa_cells(rows: DataFrame, alphabet: str = "ACDEFGHIKLMNPQRSTVWYX") -> DataFrame:
    """(path, row, column, class, deletion, mask): aligned rows as cells; what the alphabet lacks, gaps too, is X."""
    cells = rows.select("path", "row", F.posexplode(F.arrays_zip(F.filter(F.split("aligned", ""), lambda c: c != "").alias("c"), F.col("deletions").alias("d"))).alias("column", "cell"))
    code = F.instr(F.lit(alphabet), F.col("cell.c")) - 1
    return cells.select("path", "row", "column", F.when(code < 0, alphabet.index("X")).otherwise(code).alias("class"), F.col("cell.d").alias("deletion"), F.lit(1.0).alias("mask"))


def parse_matrix(text: str) -> dict[tuple[str, str], float]:
    """Scores of letter pairs from a text table: the first line that isn't a comment names the columns."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    if not lines or any(len(r) < len(lines[0]) + 1 for r in lines[1:]):
        raise ValueError("a matrix row is incomplete")
    return {(r[0], c): float(v) for r in lines[1:] for c, v in zip(lines[0], r[1:], strict=False)}


def integer_matrix(scores: dict, factor: float = 1.0, bias: float = 0.0) -> dict:
    return {k: max(-128, min(127, round(v * factor + bias))) for k, v in scores.items()}


def load_failures(spark: SparkSession, path: str) -> DataFrame:
    """(pdb, exception) of a failure log's load errors."""
    rows = spark.read.schema("pdb string, path string, status string, exception string").json(path)
    return rows.where("status = 'load_error' and exception is not null").select(F.coalesce("pdb", "path", F.lit("unknown")).alias("pdb"), "exception")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(path, first, second): the first two sequences of each alignment file, gaps as -; they must be two, and equally long."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    parts = F.split(F.array_join(F.transform(lines, lambda x: F.when(x.startswith(">"), ">").otherwise(x)), ""), ">")
    rows = text.select("path", F.filter(parts, lambda x: x != "").alias("s"))
    checked = F.when(F.size("s") < 2, F.raise_error(F.lit("an alignment needs two sequences"))).when(F.length(F.col("s")[0]) != F.length(F.col("s")[1]), F.raise_error(F.lit("aligned sequences differ in length")))
    return rows.select("path", F.coalesce(checked.cast("string"), F.col("s")[0]).alias("first"), F.col("s")[1].alias("second"))


def read_chain_list(spark: SparkSession, path: str, folder: str = "", suffix: str = "") -> DataFrame:
    """(path): folder, entry and suffix of each line that isn't empty."""
    entry = F.trim("value")
    return spark.read.text(path).where(entry != "").select(F.concat(F.lit(folder), entry, F.lit(suffix)).alias("path"))


def file_list(spark: SparkSession, path: str, pattern: str, most: int | None = None) -> DataFrame:
    """Paths of the files of a folder in order, the first most of them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path").orderBy("path")
    return found if most is None else found.limit(most)
