"""Retrieval, releases and failures on small fixtures worked by hand."""

import math
from hashlib import blake2b

import pytest
from pyspark.sql import functions as F

from helixframe.operators import failures, kmers, releases


def seqs(spark, rows):
    return spark.createDataFrame(rows, "seq_id bigint, seq string")


def test_kmer_windows(spark):
    df = seqs(spark, [(1, "ACGT"), (2, "AC"), (3, ""), (4, None)])
    got = [(r.seq_id, r.pos, r.kmer) for r in kmers.positions(df, 4).orderBy("seq_id", "pos").collect()]
    assert got == [(1, 0, "ACGT"), (2, 0, "AC")]
    assert [(r.seq_id, r.hash) for r in kmers.hashed_positions(seqs(spark, [(1, "ACXGT"), (2, "A")]), 2, "ACGTX").orderBy("pos").collect()] == [(1, 0 + 5 * 1), (1, 2 + 5 * 3)]
    folded = spark.createDataFrame([("abzJuo1ß",)], "s string").select(kmers.fold_protein(kmers.letters(F.col("s"))).alias("s")).first().s
    assert folded == "ADELXX"
    assert spark.createDataFrame([("acgun",)], "s string").select(kmers.fold_nucleotide(F.col("s")).alias("s")).first().s == "ACGTX"


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_diagonals(spark, parts):
    t = seqs(spark, [(10, "ACGT"), (20, "CGTA"), (30, "AAAA")]).repartition(parts)
    q = seqs(spark, [(1, "ACGT")])
    best = {r.target_id: (r.diagonal, r.votes) for r in kmers.best_diagonals(q, t, 2).collect()}
    assert best == {10: (0, 3), 20: (-1, 2)}
    tie = kmers.best_diagonals(seqs(spark, [(1, "ACXXXGG")]), seqs(spark, [(5, "GGXWACY")]), 2).first()
    assert tie.diagonal == -5 and tie.votes == 1


def test_coverage(spark):
    t = seqs(spark, [(1, "ABCD"), (2, "ABXX"), (3, "QQQQ")])
    got = {r.target_id: (r.shared, r.score, r.rank) for r in kmers.search(seqs(spark, [(9, "ABCD")]), t, 2, 2).collect()}
    w = {df: math.log1p(4 / (df + 1)) for df in (1, 2)}
    total = w[2] + 2 * w[1]
    assert got == {1: (3, 1.0, 1), 2: (1, round(w[2] / total, 6), 2)}


def test_rerank(spark):
    hits = spark.createDataFrame([(1, t, s, 0.5) for t, s in ((10, 5), (20, 9), (30, 7), (40, 1))], "query_id bigint, target_id bigint, shared bigint, score double")
    votes = spark.createDataFrame([(1, 10, 4), (1, 40, 8), (1, 20, 1)], "query_id bigint, target_id bigint, votes bigint")
    order = lambda least, fill: [r.target_id for r in kmers.diagonal_rerank(hits, votes, least, fill).orderBy("rank").collect()]
    assert order(3, 0) == [40, 10] and order(3, 3) == [40, 10, 20] and order(100, 0) == [20, 30, 10, 40]


def test_best_run(spark):
    rows = [("a", i, v) for i, v in enumerate([1, -3, 4, 2, -1])] + [("b", i, v) for i, v in enumerate([-1, -2])]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    assert {r.g: (r.best, r.start, r.end) for r in kmers.best_run(df, ["g"], "i", "v").collect()} == {"a": (6, 2, 4)}
    ties = spark.createDataFrame([("t", i, v) for i, v in enumerate([2, -2, 2, -3, 2])], "g string, i int, v int")
    assert [tuple(r) for r in kmers.best_run(ties, ["g"], "i", "v").collect()] == [("t", 2, 0, 1)]
    kept = spark.createDataFrame([("k", i, v) for i, v in enumerate([-1, 1, -1, 3])], "g string, i int, v int")
    assert [tuple(r) for r in kmers.best_run(kept, ["g"], "i", "v").collect()] == [("k", 3, 1, 4)]


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_few_and_many_queries_agree(spark, rows, monkeypatch):
    """Queries too many to be sent to every task are dealt by salt, with the same result."""
    monkeypatch.setattr(kmers, "BROADCAST_ROWS", rows)
    t = seqs(spark, [(1, "ABCDAB"), (2, "ABXX"), (3, "QQQQ"), (4, "ABAB")])
    q = seqs(spark, [(9, "ABCD"), (8, "ABAB")])
    assert {(r.query_id, r.target_id): r.shared for r in kmers.shared_kmers(q, t, 2).collect()} == {(9, 1): 3, (9, 2): 1, (9, 4): 1, (8, 1): 1, (8, 2): 1, (8, 4): 2}
    assert {(r.query_id, r.target_id, r.diagonal): r.votes for r in kmers.diagonals(q, t, 3).collect()} == {(9, 1, 0): 2, (8, 4, 0): 2}
    assert kmers.coverage(q, t, 2).count() == 6


def test_similar_kmers(spark):
    letters = "ABC"
    score = lambda a, b: 4 if a == b else (1 if {a, b} == {"A", "B"} else -2)
    table = spark.createDataFrame([(a, b, score(a, b)) for a in letters for b in letters], "a string, b string, score int")
    got = {(r.similar, r.score) for r in kmers.similar_kmers(spark.createDataFrame([("ABC",)], "kmer string"), table, 3, 6).collect()}
    want = {(a + b + c, s) for a in letters for b in letters for c in letters if (s := score("A", a) + score("B", b) + score("C", c)) >= 6}
    assert got == want
    reduced = kmers.reduced_matrix(table, spark.createDataFrame([("A", 0), ("B", 0), ("C", 1)], "letter string, class int"))
    assert {(r.class_a, r.class_b): r.score for r in reduced.collect()}[0, 0] == 2.5


def test_splits(spark):
    ratios = {"train": 0.8, "val": 0.1, "test": 0.1}

    def plain(key):
        u, edge = int.from_bytes(blake2b(key.encode(), digest_size=8).digest(), "big") / 2**64, 0.0
        for name, share in sorted(ratios.items()):
            edge += share
            if u < edge:
                return name
        return max(ratios)

    df = spark.createDataFrame([(f"p{i}_{c}", f"p{i}") for i in range(60) for c in "AB"], "id string, parent string")
    got = {r.id: r.split for r in df.repartition(7).select("id", releases.hash_split(F.col("parent"), ratios).alias("split")).collect()}
    assert all(got[f"p{i}_{c}"] == plain(f"p{i}") for i in range(60) for c in "AB") and len(set(got.values())) == 3
    for bad in ({}, {"a": 0.0}, {"a": -1.0, "b": 2.0}):
        with pytest.raises(ValueError):
            releases.hash_split(F.col("parent"), bad)


def test_training_join(spark):
    s = spark.createDataFrame([("a", None, "AC"), ("b", "s1", "GG"), ("x", "s1", "T")], "record_id string, source_id string, seq string")
    t = spark.createDataFrame([("a", "t0", 1.0), ("b", "t1", 2.0), ("y", "t2", 3.0)], "record_id string, source_id string, res double")
    splits = spark.createDataFrame([("b", "val", None, 3, 9)], "record_id string, split string, weight double, crop_start int, crop_stop int")
    got = {r.record_id: (r.source_id, r.split, r.weight, r.crop_start) for r in releases.training_join(s, t, splits).collect()}
    assert got == {"a": ("t0", "train", 1.0, None), "b": ("s1", "val", 1.0, 3)}
    last = releases.last_of(spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "record_id string, n int, v int"), "record_id", "n")
    assert last.first().v == 6


def test_validation(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", None)], "record_id string, split string")
    codes = lambda m: {r.code for r in releases.validate(rows, m).collect()}
    assert codes({"count_training_examples": 3, "count_sequence_examples": 2, "split_counts": {"train": 2}}) == {"training_exceeds_sequence", "duplicate_training_ids", "split_count_mismatch"}
    good = spark.createDataFrame([("a", "train"), ("b", "val")], "record_id string, split string")
    assert releases.validate(good, {"count_training_examples": 2, "count_sequence_examples": 2, "split_counts": {"train": 1, "val": 1}}).count() == 0


def test_failures(spark):
    rows = [("Atom charge is not correct", "atom_charge_suffix"), ("Invalid data in field SEQADV", "seqadv_invalid_field"), ("Invalid data in field x", "invalid_data_field_other"), ("Could not find a bond partner SSBOND", "ssbond_missing_partner"), ("?", "other_load_error"), (None, "other_load_error")]
    df = spark.createDataFrame([(i, m, w) for i, (m, w) in enumerate(rows)], "i int, m string, w string")
    assert df.select(failures.loader_bucket(F.col("m")).alias("got"), "w").where("got <> w").count() == 0
    kinds = [("missing CA", None, "missing_required_atoms"), ("boom", "KeyError", "residue_mapping_error"), ("boom", "FloatingPointError", "numerical_instability"), ("information", None, "numerical_instability"), ("failed to parse", "KeyError", "parse_error"), ("ok", None, "internal_pipeline_error")]
    df = spark.createDataFrame(kinds, "m string, k string, w string")
    assert df.select(failures.failure_class(F.col("m"), F.col("k")).alias("got"), "w").where("got <> w").count() == 0
    logs = spark.createDataFrame([(i, "A" if i < 8 else "B", f"p{i % 7}") for i in range(10)], "i int, bucket string, pdb string")
    s = failures.summary(logs, "bucket", "pdb", "i")
    assert {r.bucket: (r.n, r.examples) for r in s.collect()} == {"A": (8, "p0,p1,p2,p3,p4"), "B": (2, "p1,p2")}
    assert failures.markdown(s, "bucket").splitlines()[2].startswith("| A | 8 |")
