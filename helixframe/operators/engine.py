"""Sequence engine: substitution scores as rows, reduced alphabets, position scores, rescoring over all diagonals, and alignments in the query's frame."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import local_alignment, project

#: Letters of proteins with the unknown one last, the class of gaps in aligned rows, and rows of an alignment at most.
PROTEIN, GAP, MOST_ROWS = "ACDEFGHIKLMNPQRSTVWYX", 21, 256


def simple_scores(match: float = 5.0, mismatch: float = -4.0, alphabet: str = PROTEIN) -> np.ndarray:
    """A matrix of two scores, for tests and where no table of scores is at hand."""
    return np.where(np.eye(len(alphabet), dtype=bool), match, mismatch)


def score_rows(spark: SparkSession, scores: np.ndarray, alphabet: str = PROTEIN) -> DataFrame:
    """(a, b, score): a row for each pair of letters."""
    return spark.createDataFrame([(a, b, float(scores[i, j])) for i, a in enumerate(alphabet) for j, b in enumerate(alphabet)], "a string, b string, score double")


def reduce_alphabet(scores: np.ndarray, size: int, unknown: int | None = None) -> list[int]:
    """The class of each letter when the two classes with the greatest mean score between them are joined until size are left.

    The class of the unknown letter stays alone. Of equal means the pair with the smallest members first is joined; classes are numbered by their smallest member.
    """
    n = len(scores)
    if not (2 if unknown is not None else 1) <= size <= n:
        raise ValueError("a reduced alphabet has no such size")
    classes = [[i] for i in range(n)]
    while len(classes) > size:
        free = [c for c in classes if unknown not in c]
        best = max(((scores[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(free) for j, b in enumerate(free) if i < j))
        a, b = free[-best[1]], free[-best[2]]
        a += b
        classes.remove(b)
    order = sorted(map(sorted, classes))
    return [next(k for k, c in enumerate(order) if i in c) for i in range(n)]


def reduced(seq: Column, classes: list[int], alphabet: str = PROTEIN) -> Column:
    """Each letter replaced by the first letter of its class; others stay."""
    first = {c: alphabet[classes.index(c)] for c in classes}
    return F.translate(seq, alphabet, "".join(first[c] for c in classes))


def position_scores(queries: DataFrame, scores: DataFrame) -> DataFrame:
    """(seq_id, pos, letter, score) of each place of a query against each letter. scores: (a, b, score), an alphabet squared."""
    places = queries.select("seq_id", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("pos", "a"))
    return places.join(F.broadcast(scores), "a").select("seq_id", "pos", F.col("b").alias("letter"), "score")  # letters squared


def _codes(text: str, alphabet: str) -> np.ndarray:
    table = np.full(0x110000 if not text.isascii() else 128, len(alphabet) - 1, np.int64)
    table[[ord(c) for c in alphabet]] = range(len(alphabet))
    return table[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def best_over_diagonals(a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> float:
    """The best sum of a run along any diagonal, one row of all diagonals at a time."""
    run, best = np.zeros(len(b) + 1), 0.0
    for x in a:
        run[1:] = np.maximum(0, run[:-1] + scores[x, b])
        best = max(best, float(run.max(initial=0)))
    return best


def rescore(pairs: DataFrame, scores: np.ndarray, alphabet: str = PROTEIN) -> DataFrame:
    """(query_id, target_id, best, rescored) of pairs with both sequences: the best ungapped run over all diagonals, and it by the longer length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            best = [best_over_diagonals(_codes(q, alphabet), _codes(t, alphabet), scores) for q, t in zip(g.query_seq, g.target_seq, strict=True)]
            longest = [max(len(q), len(t), 1) for q, t in zip(g.query_seq, g.target_seq, strict=True)]
            yield pd.DataFrame({"query_id": g.query_id, "target_id": g.target_id, "best": best, "rescored": [x / n for x, n in zip(best, longest, strict=True)]})

    return pairs.select("query_id", "target_id", F.coalesce("query_seq", F.lit("")).alias("query_seq"), F.coalesce("target_seq", F.lit("")).alias("target_seq")).mapInPandas(run, "query_id bigint, target_id bigint, best double, rescored double")


def matrix_alignments(hits: DataFrame, scores: np.ndarray, alphabet: str = PROTEIN, opening: float = 11.0, extending: float = 1.0) -> DataFrame:
    """Gapped local alignments under a substitution matrix: (query_id, target_id, score, query_start, target_start, cigar); letters it lacks count as the last."""
    at = {c: i for i, c in enumerate(alphabet)}

    def score(x: str, y: str) -> float:
        return scores[at.get(x, len(at) - 1), at.get(y, len(at) - 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = [local_alignment(q, t, score, opening, extending) for q, t in zip(g.query_seq, g.target_seq, strict=True)]
            yield pd.DataFrame({"query_id": g.query_id, "target_id": g.target_id, **{c: [r[i] for r in rows] for i, c in enumerate(("score", "query_start", "target_start", "cigar"))}})

    return hits.select("query_id", "target_id", "query_seq", "target_seq").mapInPandas(run, "query_id bigint, target_id bigint, score double, query_start int, target_start int, cigar string")


def assemble(queries: DataFrame, hits: DataFrame, alphabet: str = PROTEIN, most: int = MOST_ROWS) -> DataFrame:
    """(query_id, row, target_id, classes, deletions, mask): row 0 is the query, then its hits by score, the smaller id first of equals.

    hits: (query_id, target_id, target_seq, score, query_start, target_start, cigar). No query's rows are gathered in one place.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "target_id")
    kept = hits.withColumn("row", F.row_number().over(order)).where(F.col("row") < most)
    own = queries.select(F.col("seq_id").alias("query_id"), F.length("seq").alias("n"), F.col("seq").alias("query_seq"))
    rows = kept.join(own.select("query_id", "n"), "query_id").select("query_id", "row", "target_id", "n", "target_seq", "query_start", "target_start", "cigar")
    first = own.select("query_id", F.lit(0).alias("row"), F.lit(None).cast("bigint").alias("target_id"), "n", F.col("query_seq").alias("target_seq"), F.lit(0).alias("query_start"), F.lit(0).alias("target_start"), F.concat(F.col("n").cast("string"), F.lit("M")).alias("cigar"))

    at = {c: i for i, c in enumerate(alphabet)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = []
            for n, t, c, qs, ts in zip(g.n, g.target_seq, g.cigar, g.query_start, g.target_start, strict=True):
                letters, deletions = project(c, qs, ts, t, n)
                end = qs + sum(int(k) for k, op in re.findall(r"(\d+)([MID])", c) if op != "D")
                out.append(([GAP if x == "-" else at.get(x, len(at) - 1) for x in letters], deletions, [float(qs <= i < end) for i in range(n)]))
            yield pd.DataFrame({"query_id": g.query_id, "row": g.row, "target_id": g.target_id.astype("Int64"), **{c: [x[i] for x in out] for i, c in enumerate(("classes", "deletions", "mask"))}})

    return first.unionByName(rows).mapInPandas(run, "query_id bigint, row int, target_id bigint, classes array<int>, deletions array<int>, mask array<double>")


def masked(letters: Column, mask: Column) -> Column:
    """The letters of a string where an array of booleans holds."""
    pairs = F.arrays_zip(F.filter(F.split(letters, ""), lambda c: c != "").alias("c"), mask.alias("m"))
    return F.array_join(F.transform(F.filter(pairs, lambda x: F.coalesce(x.m, F.lit(False))), lambda x: x.c), "")


def kmers_of_lengths(seqs: DataFrame, lengths: list[int]) -> DataFrame:
    """Distinct (k, kmer, seq_id) of several lengths at once."""
    from .kmers import postings

    out = None
    for k in sorted(set(lengths)):
        own = postings(seqs, k).select(F.lit(k).alias("k"), "kmer", "seq_id")
        out = own if out is None else out.unionByName(own)
    return out


def ramachandran(phi: Column, psi: Column) -> Column:
    """Region of a pair of backbone torsions in degrees. The regions and their borders."""
    known = phi.isNotNull() & psi.isNotNull() & ~F.isnan(phi) & ~F.isnan(psi)
    return (
        F.when(~known, "undefined")
        .when((phi > -160) & (phi < -20) & (psi > -80) & (psi < 0), "alpha_R")
        .when((phi >= -180) & (phi < -20) & (psi > 50) & (psi <= 180), "beta")
        .when((phi >= -180) & (phi < -20) & (psi >= -180) & (psi < -100), "beta")
        .when((phi > 0) & (phi < 120) & (psi > -60) & (psi < 60), "alpha_L")
        .otherwise("other")
    )


def heteromer_degree(scores: DataFrame, by: list[str], score: str) -> DataFrame:
    """How far the scores of all pairs of chains of two complexes lie apart, by the greatest; 0 where that isn't positive."""
    top, low = F.max(score), F.min(score)
    return scores.groupBy(*by).agg(F.when(top > 0, (top - low) / top).otherwise(0.0).alias("degree"))
