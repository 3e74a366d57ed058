"""The sequence engine, point files and release checks against plain rules."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import engine, releases
from helixframe.sources import sequences, sinks, structures


def test_reduced_alphabet():
    scores = np.array([[4, 1, 0, -1], [1, 4, 3, -1], [0, 3, 4, -1], [-1, -1, -1, 1]], float)
    assert engine.reduce_alphabet(scores, 4) == [0, 1, 2, 3]
    assert engine.reduce_alphabet(scores, 3, unknown=3) == [0, 1, 1, 2]
    assert engine.reduce_alphabet(scores, 2, unknown=3) == [0, 0, 0, 1]
    ties = np.zeros((4, 4))
    assert engine.reduce_alphabet(ties, 3) == [0, 0, 1, 2] and engine.reduce_alphabet(ties, 2, unknown=0) == [0, 1, 1, 1]
    for bad in (0, 5):
        with pytest.raises(ValueError):
            engine.reduce_alphabet(scores, bad)
    with pytest.raises(ValueError):
        engine.reduce_alphabet(scores, 1, unknown=3)


def test_best_over_diagonals():
    r = random.Random(2)
    scores = engine.simple_scores(2, -3, "ABC")
    for _ in range(60):
        a, b = (np.array([r.randrange(3) for _ in range(r.randint(0, 9))], int) for _ in "ab")
        best = 0
        for d in range(-len(a), len(b) + 1):
            row = [scores[a[i], b[i + d]] for i in range(len(a)) if 0 <= i + d < len(b)]
            best = max([best, *(sum(row[i:j]) for i, j in itertools.combinations(range(len(row) + 1), 2))])
        assert engine.best_over_diagonals(a, b, scores) == best


def test_assembly(spark):
    queries = spark.createDataFrame([(1, "ACDEFG"), (2, "AC")], "seq_id long, seq string")
    hits = spark.createDataFrame([(1, 7, "CDWEKK", 9.0, 1, 0, "2M1D1M2I"), (1, 5, "AC", 9.0, 0, 0, "2M"), (1, 6, "GG", 1.0, 5, 1, "1M")], "query_id long, target_id long, target_seq string, score double, query_start int, target_start int, cigar string")
    rows = {(r.query_id, r.row): r for r in engine.assemble(queries, hits, most=3).collect()}
    at = {c: i for i, c in enumerate(engine.PROTEIN)}
    assert sorted(rows) == [(1, 0), (1, 1), (1, 2), (2, 0)] and [rows[1, k].target_id for k in (0, 1, 2)] == [None, 5, 7]
    assert rows[1, 0].classes == [at[c] for c in "ACDEFG"] and rows[1, 0].mask == [1.0] * 6 and rows[1, 0].deletions == [0] * 6
    assert rows[1, 2].classes == [21, at["C"], at["D"], at["E"], 21, 21] and rows[1, 2].deletions == [0, 0, 0, 1, 0, 0] and rows[1, 2].mask == [0, 1, 1, 1, 1, 1]
    assert rows[1, 1].classes[:2] == [at["A"], at["C"]] and rows[1, 1].mask == [1, 1, 0, 0, 0, 0]
    assert engine.assemble(queries.limit(0), hits.limit(0)).count() == 0


def test_matrix_alignments(spark):
    pairs = spark.createDataFrame([(1, 2, "ACDEFG", "WWACDFGWW")], "query_id long, target_id long, query_seq string, target_seq string")
    got = engine.matrix_alignments(pairs, engine.simple_scores(5, -4), opening=3, extending=1).first()
    assert (got.score, got.query_start, got.target_start, got.cigar) == (22.0, 0, 2, "3M1I2M")


def test_columns(spark):
    df = spark.createDataFrame([("ABCD", [True, False, None, True]), ("", []), (None, None)], "s string, m array<boolean>")
    assert [r[0] for r in df.select(engine.masked(F.col("s"), F.col("m"))).collect()][:2] == ["AD", ""]
    angles = spark.createDataFrame([(-60.0, -45.0), (-120.0, 130.0), (-120.0, -150.0), (60.0, 30.0), (150.0, 0.0), (None, 1.0), (float("nan"), 1.0), (-20.0, -45.0), (-60.0, 0.0)], "a double, b double")
    assert [r[0] for r in angles.select(engine.ramachandran(F.col("a"), F.col("b"))).collect()] == ["alpha_R", "beta", "beta", "alpha_L", "other", "undefined", "undefined", "other", "other"]


def test_point_files(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("2\nany words\nALA 1 2 3\nG 4 5.5 -6 more\n")
    got = [(r.ord, r.letter, r.x, r.y, r.z) for r in structures.read_points(spark, f"{tmp_path}/a.xyz").orderBy("ord").collect()]
    assert got == [(0, "A", 1, 2, 3), (1, "G", 4, 5.5, -6)]
    assert structures.parse_points("1\n1 2 3", named=False) == [("A", 1, 2, 3)]
    for bad in ("", "x\n", "0\n", "2\nd\nA 1 2 3", "1\nd\nA 1 2", "1\nd\nA 1 2 z"):
        with pytest.raises(structures.ParseError):
            structures.parse_points(bad, named=True)


def test_lists_and_alignments(spark, tmp_path):
    (tmp_path / "list").write_text("one\n\n two \n")
    assert [r.path for r in sequences.read_chain_list(spark, f"{tmp_path}/list", "d/", ".pdb").collect()] == ["d/one.pdb", "d/two.pdb"]
    (tmp_path / "x.fa").write_text("# c\n>a b\nAC-\nD\n>c\nACED\n")
    row = sequences.read_alignment(spark, f"{tmp_path}/x.fa").first()
    assert (row.first, row.second) == ("AC-D", "ACED")
    for name, text in (("one.fa", ">a\nAC\n"), ("two.fa", ">a\nAC\n>b\nA\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):
            sequences.read_alignment(spark, f"{tmp_path}/{name}").collect()
    assert [r.path.rsplit("/", 1)[1] for r in sequences.file_list(spark, str(tmp_path), "*.fa", 2).collect()] == ["one.fa", "two.fa"]


def test_release_checks(spark):
    training = spark.createDataFrame([("a", "train"), ("a", None), ("b", "test")], "record_id string, split string")
    tensors = lambda seq, beta: spark.createDataFrame([(seq, beta, [[1.0] * 8] * len(seq), [[0.0] * 4] * len(seq))], "seq_mask array<double>, pseudo_beta_mask array<double>, rigidgroups_exists array<array<double>>, chi_mask array<array<double>>")
    codes = lambda *args: {r.code: r.severity for r in releases.validate(*args).collect()}
    good = {"count_training_examples": 3, "count_sequence_examples": 3, "count_structure_examples": 3, "split_counts": {"train": 2, "test": 1}}
    assert codes(training, good, tensors([1.0, 1.0], [1.0, 1.0])) == {"duplicate_training_ids": "error"}
    assert codes(training, good, tensors([1.0, 1.0], [1.0, 0.0])) == {"duplicate_training_ids": "error", "low_pseudo_beta_fraction": "warning"}
    assert codes(training, good, tensors([0.0], [0.0])) == {"duplicate_training_ids": "error", "no_valid_structure_residues": "error"}
    assert codes(training, good, "missing") == {"duplicate_training_ids": "error", "missing_structure_tensors": "error"}
    assert codes(None, good | {"count_structure_examples": 0}, "missing") == {"training_exceeds_structure": "error", "missing_training_release": "warning", "no_structure_examples": "warning"}
    assert codes(training, {"count_training_examples": 2, "count_sequence_examples": 1, "count_structure_examples": 4, "count_prepared": 3}, None) == {
        "training_exceeds_sequence": "error", "structure_exceeds_prepared": "warning", "training_row_count_mismatch": "error", "duplicate_training_ids": "error", "split_count_mismatch": "error", "missing_structure_release": "warning",
    }
    got = releases.corpus_manifest("r1", sequences=spark.createDataFrame([(3,), (5,)], "length int"), training=training, failures=[spark.createDataFrame([("x",), ("x",), ("y",)], "failure_class string")])
    assert got["split_counts"] == {"test": 1, "train": 2} and got["failure_breakdown"] == {"x": 2, "y": 1} and got["sequence_lengths"]["mean_length"] == 4.0 and got["count_prepared"] == 0


def test_whole_corpus(spark, tmp_path):
    masks = "seq_mask array<double>, pseudo_beta_mask array<double>, rigidgroups_exists array<array<double>>, chi_mask array<array<double>>"
    seqs = spark.createDataFrame([(f"r{i}", f"s{i // 2}", 10 + i, "ACD") for i in range(12)], "record_id string, source_id string, length int, sequence string")
    structs = spark.createDataFrame([(f"r{i}", f"s{i // 2}", 10 + i, [1.0], [1.0], [[1.0] * 8], [[1.0] * 4]) for i in range(2, 12)], f"record_id string, source_id string, length int, {masks}")
    broken = spark.createDataFrame([("r90", "parse_error"), ("r91", "parse_error"), ("r92", "numerical_instability")], "record_id string, failure_class string")
    manifest, issues = sinks.build_corpus(spark, str(tmp_path / "c"), "one", seqs, structs, {"train": 0.8, "val": 0.2}, broken)
    assert (manifest["count_sequence_examples"], manifest["count_structure_examples"], manifest["count_training_examples"]) == (12, 10, 10)
    assert manifest["failure_breakdown"] == {"numerical_instability": 1, "parse_error": 2} and sum(manifest["split_counts"].values()) == 10
    assert manifest["sequence_lengths"]["max_length"] == 21.0 and issues.count() == 0
    rows = sinks.read_release(spark, f"{tmp_path}/c/training").collect()
    assert len({(r.source_id, r.split) for r in rows}) == len({r.source_id for r in rows})
    assert spark.read.json(f"{tmp_path}/c/sequence/failures").count() == 3
