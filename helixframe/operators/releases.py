"""Dataset releases: joins, splits, completeness and validation."""

from __future__ import annotations

from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .atoms import first_per_group


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal key the last by order."""
    return first_per_group(rows, [key], [F.desc(order)])


def training_join(sequences: DataFrame, structures: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Records in both tables, with the split (train), weight (1.0) and crop that a lookup gives or their defaults.

    sequences, structures: (record_id, source_id, ...); splits: (record_id, split, weight, crop_start, crop_stop). Columns of one
    name come from sequences unless null.
    """
    s = structures.select("record_id", F.col("source_id").alias("__source"), *[c for c in structures.columns if c not in sequences.columns])
    out = sequences.join(s, "record_id").withColumn("source_id", F.coalesce("source_id", "__source")).drop("__source")
    if splits is None:
        return out.withColumns({"split": F.lit("train"), "weight": F.lit(1.0), "crop_start": F.lit(None).cast("int"), "crop_stop": F.lit(None).cast("int")})
    out = out.join(splits, "record_id", "left")
    return out.withColumns({"split": F.coalesce("split", F.lit("train")), "weight": F.coalesce("weight", F.lit(1.0))})


def hash_split(key: Column, ratios: dict[str, float]) -> Column:
    """Split of a grouping key: its BLAKE2b hash as a fraction, against the ratios in order of name."""
    total = sum(ratios.values())
    if not ratios or total <= 0 or min(ratios.values()) < 0:
        raise ValueError(f"ratios must be non-negative and sum to more than 0: {ratios}")

    @F.pandas_udf("double")
    def fraction(keys: pd.Series) -> pd.Series:
        return pd.Series([int.from_bytes(blake2b(k.encode(), digest_size=8).digest(), "big") / 2**64 if k is not None else None for k in keys], dtype="float64")

    u, edge, out = fraction(key.cast("string")), 0.0, None
    *rest, (last, _) = sorted(ratios.items())
    for name, share in rest:
        edge += share / total
        out = (F if out is None else out).when(u < edge, name)
    return F.lit(last) if out is None else out.when(u.isNotNull(), last)


def expand_chains(chains: DataFrame) -> DataFrame:
    """(structure_id, chain_id, ord) -> a record for each chain, named structure_chain where there are several.

    parent_id keeps the chains of a structure in one split.
    """
    distinct = chains.groupBy("structure_id", "chain_id").agg(F.min("ord").alias("ord"))
    n = F.count("*").over(Window.partitionBy("structure_id"))
    name = F.when(n > 1, F.concat_ws("_", F.col("structure_id").cast("string"), F.when(F.col("chain_id") != "", F.col("chain_id")))).otherwise(F.col("structure_id").cast("string"))
    return distinct.select(name.alias("record_id"), F.col("structure_id").alias("parent_id"), "chain_id")


def length_summary(rows: DataFrame, length: str) -> DataFrame:
    """Least, greatest and mean length, 0 of no rows."""
    zero = F.lit(0.0)
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.min(length).cast("double"), zero).alias("min_length"), F.coalesce(F.max(length).cast("double"), zero).alias("max_length"), F.coalesce(F.avg(length), zero).alias("mean_length"))


def completeness(rows: DataFrame, mask: str, of: str, slots: int = 1) -> DataFrame:
    """Sum of a mask against the sum of another (times its slots)."""
    total = F.sum(of) * slots
    return rows.agg(F.sum(mask).cast("double").alias("present"), total.cast("double").alias("possible"), F.when(total > 0, F.sum(mask) / total).otherwise(0.0).alias("fraction"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


#: Code and severity of each check of a corpus release.
CHECKS = {
    "training_exceeds_sequence": "error",
    "training_exceeds_structure": "error",
    "structure_exceeds_prepared": "warning",
    "missing_training_release": "warning",
    "training_row_count_mismatch": "error",
    "duplicate_training_ids": "error",
    "split_count_mismatch": "error",
    "missing_structure_release": "warning",
    "no_structure_examples": "warning",
    "missing_structure_tensors": "error",
    "no_valid_structure_residues": "error",
    "low_pseudo_beta_fraction": "warning",
}


def _nested_sum(column: str, depth: int) -> Column:
    x = F.col(column)
    for _ in range(depth - 1):
        x = F.flatten(x)
    return F.sum(F.aggregate(x, F.lit(0.0), lambda a, v: a + v))


def tensor_completeness(tensors: DataFrame) -> DataFrame:
    """One row: valid residues, and the shares of them (and of their 8 frames and 4 side-chain torsions) that are there."""
    total = tensors.agg(
        F.coalesce(_nested_sum("seq_mask", 1), F.lit(0.0)).alias("valid"), _nested_sum("pseudo_beta_mask", 1).alias("beta"), _nested_sum("rigidgroups_exists", 2).alias("rigid"), _nested_sum("chi_mask", 2).alias("chi")
    )
    share = lambda c, n: F.when(F.col("valid") > 0, F.col(c) / (F.col("valid") * n)).otherwise(0.0)
    return total.select("valid", share("beta", 1).alias("pseudo_beta_fraction"), share("rigid", 8).alias("rigidgroup_frame_fraction"), share("chi", 4).alias("chi_angle_fraction"))


def validate(training: DataFrame | None, manifest: dict, structures: DataFrame | str | None = "unchecked") -> DataFrame:
    """(severity, code, detail) of what a corpus release's tables and its manifest disagree about.

    manifest: count_sequence_examples, count_training_examples, count_structure_examples, count_prepared, split_counts, and
    pseudo_beta_fraction if known. training: the training table, None if there is none. structures: the table of tensors, None if no release
    is linked, "missing" if it is linked without them. The training table is read once for counts by split and once for repeated ids.
    """
    from pyspark.sql import SparkSession

    spark = training.sparkSession if training is not None else SparkSession.getActiveSession()
    count, found = lambda of: manifest.get(f"count_{of}", 0), []
    for more, less, code in (("training_examples", "sequence_examples", "training_exceeds_sequence"), ("training_examples", "structure_examples", "training_exceeds_structure")):
        if f"count_{less}" in manifest and count(more) > count(less):
            found.append((code, f"{count(more)} > {count(less)}"))
    if count("prepared") and count("structure_examples") > count("prepared"):
        found.append(("structure_exceeds_prepared", str(count("structure_examples"))))
    if training is None:
        found.append(("missing_training_release", ""))
    else:
        by_split = {r.split: r.n for r in training.groupBy(F.coalesce("split", F.lit("train")).alias("split")).agg(F.count("*").alias("n")).collect()}
        repeated = [r.record_id for r in duplicates(training, "record_id").orderBy("record_id").limit(5).collect()]
        if sum(by_split.values()) != count("training_examples"):
            found.append(("training_row_count_mismatch", f"{sum(by_split.values())} rows"))
        if repeated:
            found.append(("duplicate_training_ids", ", ".join(map(str, repeated))))
        if by_split != manifest.get("split_counts", {}):
            found.append(("split_count_mismatch", ", ".join(f"{k}={v}" for k, v in sorted(by_split.items()))))
    beta = manifest.get("pseudo_beta_fraction", 1.0)
    if structures is None:
        found.append(("missing_structure_release", ""))
    elif not isinstance(structures, str) or structures == "missing":
        if not count("structure_examples"):
            found.append(("no_structure_examples", ""))
        elif isinstance(structures, str):
            found.append(("missing_structure_tensors", ""))
        else:
            whole = tensor_completeness(structures).first()
            beta = whole.pseudo_beta_fraction if whole.valid > 0 else 1.0
            if whole.valid <= 0:
                found.append(("no_valid_structure_residues", ""))
    if beta < 0.95:
        found.append(("low_pseudo_beta_fraction", str(beta)))
    return spark.createDataFrame([(CHECKS[c], c, d) for c, d in found], "severity string, code string, detail string")


def corpus_manifest(release_id: str, sequences: DataFrame | None = None, structures: DataFrame | None = None, training: DataFrame | None = None, failures: list[DataFrame] | None = None, prepared: DataFrame | None = None) -> dict:
    """Counts, lengths, splits and failures by class of the layers of a release. Layers that are absent count as empty.

    sequences, structures: with a column length; training: split; failures: failure_class. Only a line for each split and class reaches the driver.
    """
    count = lambda df: df.count() if df is not None else 0
    lengths = lambda df: length_summary(df, "length").first().asDict() if df is not None else {}
    broken: dict[str, int] = {}
    for df in failures or []:
        for r in df.groupBy("failure_class").count().collect():
            broken[r[0]] = broken.get(r[0], 0) + r[1]
    splits = {r[0]: r[1] for r in training.groupBy(F.coalesce("split", F.lit("train"))).count().collect()} if training is not None else {}
    return {
        "release_id": release_id, "count_prepared": count(prepared), "count_sequence_examples": count(sequences), "count_structure_examples": count(structures), "count_training_examples": sum(splits.values()),
        "split_counts": dict(sorted(splits.items())), "failure_breakdown": dict(sorted(broken.items())), "sequence_lengths": lengths(sequences), "structure_lengths": lengths(structures),
    }


def msa_profile(cells: DataFrame, classes: int = 22) -> DataFrame:
    """(column, class, freq): share of each class among a column's cells, weighted by mask. cells: (column, class, mask)."""
    kept = cells.where(F.col("class").between(0, classes - 1))
    total = cells.groupBy("column").agg(F.sum("mask").alias("total"))
    own = kept.groupBy("column", "class").agg(F.sum("mask").alias("w"))
    return own.join(total, "column").select("column", "class", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(0.0).alias("freq"))
