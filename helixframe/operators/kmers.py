"""Sequence retrieval: k-mers, postings, weights, votes and ranking, all as joins and grouped sums.

Sequences are rows (seq_id, seq) of upper-case ASCII letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def letters(text: Column) -> Column:
    """ASCII letters only, then upper case: engines differ on the case of others."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))


def fold_protein(seq: Column) -> Column:
    """The 21-letter alphabet: B as D, Z as E, J as L, U and O as X, and X for anything else."""
    return F.regexp_replace(F.translate(F.upper(seq), "BZJUO", "DELXX"), "[^ACDEFGHIKLMNPQRSTVWYX]", "X")


def fold_nucleotide(seq: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGTX]", "X")


def _windows(seq: Column, k: int) -> Column:
    """All substrings of length k. Of bytes: taking one from a long string then costs the same anywhere."""
    data = seq.cast("binary")
    return F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(data, i, F.lit(k)).cast("string"))


def kmer_array(seq: Column, k: int, short: bool = True) -> Column:
    """k-mers in order. short: a sequence shorter than k is itself one k-mer (an empty one has none)."""
    whole = F.when(F.length(seq) > 0, F.array(seq)).otherwise(F.array().cast("array<string>")) if short else F.array().cast("array<string>")
    return F.when(F.length(seq) >= k, _windows(seq, k)).otherwise(whole)


def positions(seqs: DataFrame, k: int, short: bool = True) -> DataFrame:
    """(seq_id, pos, kmer), pos from 0."""
    return seqs.select("seq_id", F.posexplode(kmer_array(F.col("seq"), k, short)).alias("pos", "kmer"))


def hashed_positions(seqs: DataFrame, k: int, alphabet: str) -> DataFrame:
    """(seq_id, pos, hash): windows without X, hash the sum of letter index times alphabet size to the power of its place; none if shorter."""
    n = len(alphabet)
    code = lambda i: F.instr(F.lit(alphabet), F.substring("kmer", i + 1, 1)) - 1
    value = sum((code(i).cast("bigint") * n**i for i in range(1, k)), code(0).cast("bigint"))
    return positions(seqs, k, short=False).where(~F.col("kmer").contains("X")).select("seq_id", "pos", value.alias("hash"))


def postings(seqs: DataFrame, k: int) -> DataFrame:
    """Distinct (kmer, seq_id)."""
    return seqs.select("seq_id", F.explode(F.array_distinct(kmer_array(F.col("seq"), k))).alias("kmer"))


def positional_postings(seqs: DataFrame, k: int) -> DataFrame:
    return positions(seqs, k).groupBy("kmer", "seq_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("kmer").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log1p((n + 1) / (df + 1))


#: Rows of the queries' side up to which it is sent whole to every task; beyond that, shares into which each k-mer's targets are dealt.
BROADCAST_ROWS, SALTS = 1_000_000, 16


def small(queries: DataFrame, k: int) -> bool:
    """Whether the queries' k-mers are few enough to be sent to every task, by their number at most."""
    n = queries.agg(F.sum(F.greatest(F.length("seq") - (k - 1), F.lit(1)))).first()[0]
    return (n or 0) <= BROADCAST_ROWS


def beside(rows: DataFrame, asked: DataFrame, few: bool, salt: str) -> DataFrame:
    """rows joined by k-mer with the queries' side. Few of these go to the rows, which then need no shuffle; else a frequent k-mer's rows are dealt by salt."""
    if few:
        return rows.join(F.broadcast(asked), "kmer")
    dealt = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(dealt, ["kmer", "salt"]).drop("salt")


def asked_postings(own: DataFrame, targets: DataFrame, k: int, few: bool) -> DataFrame:
    """The targets' distinct (kmer, seq_id) among the k-mers asked for, which filter before anything is shuffled."""
    return beside(positions(targets, k).select("kmer", "seq_id"), own.select("kmer").distinct(), few, "seq_id").select("kmer", "seq_id").distinct()


def query_weights(queries: DataFrame, targets: DataFrame, k: int) -> tuple[DataFrame, DataFrame, bool]:
    """(query_id, kmer, weight) of each query's k-mers, the targets' postings of those k-mers only, and whether the former are few."""
    own, few = postings(queries, k).withColumnRenamed("seq_id", "query_id"), small(queries, k)
    posts = asked_postings(own, targets, k, few)
    n = targets.agg(F.count("*").alias("n"))
    weights = own.join(document_frequency(posts), "kmer", "left").join(F.broadcast(n))  # one row
    return weights.select("query_id", "kmer", idf(F.coalesce("df", F.lit(0)), F.col("n")).alias("weight")), posts, few


def shared_kmers(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(query_id, target_id, shared)."""
    own, few = postings(queries, k).withColumnRenamed("seq_id", "query_id"), small(queries, k)
    return beside(asked_postings(own, targets, k, few), own, few, "seq_id").groupBy("query_id", F.col("seq_id").alias("target_id")).agg(F.count("*").alias("shared"))


def coverage(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(query_id, target_id, shared, score): shared weight as a part of the query's whole weight, 0 without weight."""
    weights, posts, few = query_weights(queries, targets, k)
    total = weights.groupBy("query_id").agg(F.sum("weight").alias("total"))
    found = beside(posts, weights, few, "seq_id").groupBy("query_id", F.col("seq_id").alias("target_id")).agg(F.count("*").alias("shared"), F.sum("weight").alias("got"))
    score = F.when(F.col("total") > 0, F.col("got") / F.col("total")).otherwise(0.0)
    return found.join(total, "query_id").select("query_id", "target_id", "shared", F.round(score, 6).alias("score"))


def ranked(hits: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first n of each group by the given order, with their rank from 1."""
    w = Window.partitionBy(by).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def search(queries: DataFrame, targets: DataFrame, k: int = 6, top_k: int = 10) -> DataFrame:
    """The best targets of each query: score, then shared k-mers, then the smaller id."""
    return ranked(coverage(queries, targets, k), "query_id", [F.desc("score"), F.desc("shared"), "target_id"], top_k)


def diagonals(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(query_id, target_id, diagonal, votes): equal k-mers by diagonal, query place less target place."""
    q = positions(queries, k).select(F.col("seq_id").alias("query_id"), F.col("pos").alias("q_pos"), "kmer")
    t = positions(targets, k).select(F.col("seq_id").alias("target_id"), F.col("pos").alias("t_pos"), "kmer")
    return beside(t, q, small(queries, k), "target_id").groupBy("query_id", "target_id", (F.col("q_pos") - F.col("t_pos")).alias("diagonal")).agg(F.count("*").alias("votes"))


def best_diagonals(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(query_id, target_id, diagonal, votes) by target place less query place: most votes, then the smaller diagonal."""
    d = diagonals(queries, targets, k).select("query_id", "target_id", (-F.col("diagonal")).alias("diagonal"), "votes")
    best = F.max(F.struct("votes", (-F.col("diagonal")).alias("back"))).alias("m")
    return d.groupBy("query_id", "target_id").agg(best).select("query_id", "target_id", (-F.col("m.back")).cast("int").alias("diagonal"), F.col("m.votes").alias("votes"))


def diagonal_rerank(hits: DataFrame, votes: DataFrame, least: int, backfill: int) -> DataFrame:
    """Keep hits with enough votes, best first; fill up to backfill with others; if none has enough keep all.

    hits: (query_id, target_id, shared, score); votes: (query_id, target_id, votes).
    """
    v = hits.join(votes.select("query_id", "target_id", "votes"), ["query_id", "target_id"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    v = v.withColumn("ok", F.col("votes") >= least)
    group = Window.partitionBy("query_id")
    v = v.withColumn("n_ok", F.sum(F.col("ok").cast("int")).over(group))
    order = group.orderBy(F.desc("ok"), F.desc(F.when(F.col("ok"), F.col("votes")).otherwise(0)), F.desc("shared"), "target_id")
    v = v.withColumn("rank", F.row_number().over(order))
    return v.where("ok or n_ok = 0 or rank <= {}".format(int(backfill))).select("query_id", "rank", "target_id", "votes", "shared", "score")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def best_run(rows: DataFrame, by: list[str], ord: str, value: str) -> DataFrame:
    """The greatest sum of neighbouring values of each group, and its first place and the one behind its last.

    Groups without a positive sum are left out. Of equal sums the one that ends first counts, and of its beginnings the earliest. It is a
    prefix sum less the least one before it.
    """
    w = Window.partitionBy(*by).orderBy(ord)
    p = rows.withColumn("p", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    none = F.struct((F.col("p") - F.col(value)).alias("p"), (F.col(ord) - 1).alias("o"))
    first = F.first(none).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.min(F.struct("p", F.col(ord).alias("o"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("low", F.least(first, F.coalesce(before, first)))
    best = F.max(F.struct((F.col("p") - F.col("low.p")).alias("best"), (-F.col(ord)).alias("last"), (F.col("low.o") + 1).alias("start"))).alias("x")
    return p.groupBy(*by).agg(best).where("x.best > 0").select(*by, "x.best", "x.start", (1 - F.col("x.last")).alias("end"))


def similar_kmers(kmers: DataFrame, scores: DataFrame, k: int, threshold: int) -> DataFrame:
    """(kmer, similar, score): strings whose substitution scores with kmer sum to threshold or more.

    scores: (a, b, score), a row for each pair of letters. Places are joined one by one; a prefix goes on only
    while the best that the places left can add may still reach the threshold.
    """
    best = scores.groupBy("a").agg(F.max("score").alias("best"))
    parts = kmers.select("kmer").distinct().withColumn("similar", F.lit("")).withColumn("score", F.lit(0))
    letters_of = kmers.select("kmer", F.posexplode(F.split("kmer", "")).alias("i", "a")).where("a <> ''").distinct().join(best, "a")
    for i in range(k):
        rest = letters_of.where(F.col("i") > i).groupBy("kmer").agg(F.sum("best").alias("rest"))
        step = parts.withColumn("a", F.substring("kmer", i + 1, 1)).join(scores.select("a", "b", F.col("score").alias("s")), "a")
        step = step.join(rest, "kmer", "left").withColumn("score", F.col("score") + F.col("s"))
        parts = step.where(F.col("score") + F.coalesce("rest", F.lit(0)) >= threshold).select("kmer", F.concat("similar", "b").alias("similar"), "score")
    return parts


def reduced_matrix(scores: DataFrame, classes: DataFrame) -> DataFrame:
    """Mean substitution score of each pair of letter classes. classes: (letter, class)."""
    a = classes.select(F.col("letter").alias("a"), F.col("class").alias("class_a"))
    b = classes.select(F.col("letter").alias("b"), F.col("class").alias("class_b"))
    return scores.join(F.broadcast(a), "a").join(F.broadcast(b), "b").groupBy("class_a", "class_b").agg(F.avg("score").alias("score"))  # alphabets
