"""Failure messages to classes, as ordered conditions on a lower-cased message column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Loader buckets in order of precedence; each entry is (bucket, groups of substrings, one of each group must occur).
LOADER_BUCKETS = [
    ("atom_charge_suffix", [["atom charge is not correct"]]),
    ("solitary_dbref1_definition", [["solitary dbref1 definition"]]),
    ("model_atom_correspondence", [["atoms in models not corresponding"]]),
    ("ssbond_missing_partner", [["could not find a bond partner"], ["ssbond"]]),
    ("seqres_multiple_residues", [["multiple residues in seqres validation"]]),
    ("seqres_total_invalid", [["seqres residue total invalid"]]),
    ("seqadv_invalid_field", [["invalid data in field"], ["seqadv", "the text presented is not of the right kind (isize)"]]),
    ("invalid_data_field_other", [["invalid data in field"]]),
]
OTHER_BUCKET = "other_load_error"

#: Failure classes in order of precedence, in the same form; exception types that decide by themselves come with them.
FAILURE_CLASSES = [
    ("parse_error", [["malformed", "unexpected token", "invalid pdb", "failed to parse", "mmcif parse"]], None),
    ("missing_required_atoms", [["missing"], ["ca", "n", "c", "cb", "backbone", "atom"]], None),
    ("missing_required_atoms", [["requires a protein chain"]], None),
    ("residue_mapping_error", [["unknown residue", "residue name", "residue_mapping", "three-letter"]], "KeyError"),
    ("hydrogen_placement_error", [["hydrogen"], ["place", "failed"]], None),
    ("forcefield_parameterization_error", [["force field", "forcefield", "parameteriz"]], None),
    ("minimization_nonconvergence", [["minimization"], ["did not converge", "nonconvergence", "diverged"]], None),
    ("numerical_instability", [["nan", "inf", "overflow"]], "FloatingPointError"),
    ("postprep_quality_failure", [["quality"], ["rejected", "failure"]], None),
    ("unsupported_chemistry", [["unsupported", "non-standard", "modified residue"]], None),
]
OTHER_CLASS = "internal_pipeline_error"


def _has(message: Column, groups: list[list[str]]) -> Column:
    out = F.lit(True)
    for words in groups:
        one = F.lit(False)
        for w in words:
            one = one | message.contains(w)
        out = out & one
    return out


def loader_bucket(message: Column) -> Column:
    message, out = F.lower(F.coalesce(message, F.lit(""))), None
    for name, groups in LOADER_BUCKETS:
        out = (F if out is None else out).when(_has(message, groups), name)
    return out.otherwise(OTHER_BUCKET)


def failure_class(message: Column, kind: Column | None = None) -> Column:
    """kind: the exception's type name, if known."""
    message, out = F.lower(F.coalesce(message, F.lit(""))), None
    for name, groups, of_kind in FAILURE_CLASSES:
        test = _has(message, groups)
        if of_kind and kind is not None:
            test = test | F.coalesce(kind == of_kind, F.lit(False))
        out = (F if out is None else out).when(test, name)
    return out.otherwise(OTHER_CLASS)


def summary(rows: DataFrame, bucket: str, example: str, order: str, most: int = 5) -> DataFrame:
    """Count of each bucket with its first distinct examples.

    Examples are numbered by their first row before they are gathered, so no list grows past most.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    first = rows.groupBy(bucket, example).agg(F.min(order).alias("o"))
    w = Window.partitionBy(bucket).orderBy("o", example)
    kept = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    examples = kept.groupBy(bucket).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", F.col(example).cast("string").alias("e")))), lambda x: x.e), ",").alias("examples"))
    return counts.join(examples, bucket)


def markdown(summaries: DataFrame, bucket: str) -> str:
    """A table for people: one line for each of the few buckets, most frequent first."""
    rows = summaries.orderBy(F.desc("n"), bucket).collect()
    return "\n".join(["| bucket | count | examples |", "|---|---:|---|", *[f"| {r[bucket]} | {r.n} | {r.examples} |" for r in rows]])
