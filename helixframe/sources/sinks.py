"""Writers: atom and result tables, PDB text, releases with checksums, and the search tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmers, releases


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """(structure_id, atom_ord, line): each atom as a PDB record."""
    name = F.when((F.length("atom_name") < 4) & (F.length(F.coalesce("element", F.lit(""))) < 2), F.concat(F.lit(" "), F.rpad("atom_name", 3, " "))).otherwise(F.rpad("atom_name", 4, " "))
    number = lambda c, w, d: F.lpad(F.format_string(f"%.{d}f", F.col(c)), w, " ")
    line = F.concat(
        F.when(F.col("is_hetero"), "HETATM").otherwise("ATOM  "), F.lpad(F.col("atom_serial").cast("string"), 5, " "), F.lit(" "), name, F.rpad(F.coalesce("conformer_id", F.lit(" ")), 1, " "), F.lpad("residue_name", 3, " "), F.lit(" "),
        F.rpad("chain_id", 1, " "), F.lpad(F.col("residue_serial").cast("string"), 4, " "), F.rpad(F.coalesce("insertion_code", F.lit(" ")), 1, " "), F.lit("   "), number("x", 8, 3), number("y", 8, 3), number("z", 8, 3), number("occupancy", 6, 2), number("b_factor", 6, 2), F.lit(" " * 10), F.lpad(F.upper(F.coalesce("element", F.lit(""))), 2, " "),
    )
    return atoms.select("structure_id", "atom_ord", line.alias("line"))


def write_pdb(atoms: DataFrame, path: str) -> None:
    """A folder for each structure with its lines in order."""
    lines = pdb_lines(atoms).repartition("structure_id").sortWithinPartitions("structure_id", "atom_ord")
    lines.select("structure_id", F.col("line").alias("value")).write.partitionBy("structure_id").text(path)


def write_release(df: DataFrame, path: str, release_id: str, split: str | None = "split") -> dict:
    """Rows as Parquet beside a manifest with counts and a SHA-256 of every data file; gives the manifest."""
    spark = df.sparkSession
    write_table(df, f"{path}/data")
    back = spark.read.schema(df.schema).parquet(f"{path}/data")
    counts = {str(r[0]): r[1] for r in back.groupBy(split).count().collect()} if split in df.columns else {}
    manifest = {"release_id": release_id, "count": back.count(), "split_counts": counts, "files": _checksums(spark, f"{path}/data")}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def write_examples(examples: DataFrame, failures: DataFrame | None, path: str, release_id: str) -> dict:
    """Examples (with a column length) as Parquet, failures as JSON lines, and a manifest with counts, lengths and checksums; gives the manifest."""
    spark = examples.sparkSession
    manifest = write_release(examples, path, release_id)
    broken = 0
    if failures is not None:
        failures.write.json(f"{path}/failures")
        broken = spark.read.schema(failures.schema).json(f"{path}/failures").count()
    back = spark.read.schema(examples.schema).parquet(f"{path}/data")
    manifest |= {"count_examples": manifest.pop("count"), "count_failures": broken, "lengths": releases.length_summary(back, "length").first().asDict()}
    return manifest


def build_corpus(spark: SparkSession, path: str, release_id: str, sequences: DataFrame, structures: DataFrame, ratios: dict[str, float], failures: DataFrame | None = None) -> tuple[dict, DataFrame]:
    """A whole corpus release below path: sequence, structure and training releases, a manifest over them, and what the checks find.

    sequences, structures: (record_id, source_id, length, ...), structures with their masks where these are to be checked; failures: (failure_class, ...).
    Splits go by the hash of source_id, so that the chains of one source stay together. Each layer is read back from its files by the next.
    """
    read = lambda df, name: spark.read.schema(df.schema).parquet(f"{path}/{name}/data")
    write_examples(sequences, failures, f"{path}/sequence", f"{release_id}-sequence")
    write_examples(structures, None, f"{path}/structure", f"{release_id}-structure")
    sequences, structures = read(sequences, "sequence"), read(structures, "structure")
    splits = sequences.select("record_id", releases.hash_split(F.col("source_id"), ratios).alias("split"), F.lit(1.0).alias("weight"), F.lit(None).cast("int").alias("crop_start"), F.lit(None).cast("int").alias("crop_stop"))
    training = releases.training_join(sequences, structures, splits)
    write_release(training, f"{path}/training", f"{release_id}-training")
    training = read(training, "training")
    manifest = releases.corpus_manifest(release_id, sequences, structures, training, [failures] if failures is not None else None)
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/corpus/manifest")
    checked = {"seq_mask", "pseudo_beta_mask", "rigidgroups_exists", "chi_mask"} <= set(structures.columns)
    issues = releases.validate(training, manifest, structures if checked else "unchecked")
    issues.coalesce(1).write.json(f"{path}/corpus/issues")
    return manifest, issues


def _checksums(spark: SparkSession, path: str) -> dict[str, str]:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return {r.name: r.sum for r in files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sum")).collect()}


def read_release(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Rows of a release whose files match its manifest; split is pushed down to the files."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if _checksums(spark, f"{path}/data") != manifest["files"]:
        raise ValueError(f"{path}: files don't match the manifest")
    rows = spark.read.parquet(f"{path}/data")
    return rows if split is None else rows.where(F.col("split") == split)


def write_search_tables(seqs: DataFrame, path: str, k: int) -> None:
    """Entries, and postings with places sorted by k-mer, so that a look-up reads few row groups."""
    write_table(seqs, f"{path}/entries")
    posts = kmers.positional_postings(seqs, k)
    write_table(posts.repartitionByRange("kmer").sortWithinPartitions("kmer", "seq_id"), f"{path}/postings")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/postings")
