"""Operator 7: exact top-k inner products by norm-bucketed retrieval.

Vectors of whole numbers are grouped by length into geometric buckets, and a bucket into blocks of bounded size; queries form
blocks of their own. A first pass over a block of the longest vectors gives each query a score that its k-th answer can't be below. A query
then skips every bucket whose longest vector can't reach it. In a block that is left, the score becomes a threshold on the cosine, from
which the query chooses: coordinate pruning over as many of its heaviest coordinates as that threshold needs (the product over these, and the
lengths of what is left of both vectors, bound the whole product), or, if too few would go, length pruning alone. What is kept is
verified by exact products. Bounds have a margin for rounding.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without an id, take no part; rows
with equal ids are different rows and answer each other; vectors of another dimension don't answer a query; an empty table gives an
empty result; other columns are not read. Products are exact below 2**53; beyond that 64-bit integers are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K, SCALE, EVERY = 20, 64, 20
#: Vectors of a candidate block and of a query block on average.
BLOCK, QUERY_BLOCK = 8192, 512


def quantized(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """rid, vec_id, q (whole components), dim and squared length of the vectors that take part."""
    e = F.col("`embedding`")
    whole = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & (F.size(e) > 0)
    rows = embeddings.where(whole & F.col("`vec_id`").isNotNull())
    rows = rows.select(F.col("`vec_id`").cast("bigint").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")).alias("q"))
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "q", F.size("q").alias("dim"), square.alias("square"))


def _blocks(rows: DataFrame, by: list[str], size: int) -> tuple[DataFrame, list]:
    """Rows in numbered blocks of about size, none over two groups; and (group, first number, blocks, rows, longest) of each group.

    Groups are dimensions and powers of the square root of two in length: their number is bounded by the range of doubles.
    """
    groups = sorted(rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("square").alias("top")).collect(), key=lambda r: tuple(r[c] for c in by))
    at, table = 0, []
    for g in groups:
        k = -(-g.n // size)
        table.append((*[g[c] for c in by], at, k, g.n, g.top))
        at += k
    if not table:
        return rows.limit(0).withColumn("block", F.lit(0)), []
    spark = rows.sparkSession
    kinds = ", ".join(f"{c} int" for c in by)
    numbers = spark.createDataFrame([t[: len(by) + 2] for t in table], f"{kinds}, first int, parts int")
    out = rows.join(F.broadcast(numbers), by).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("rid"), F.col("parts"))).cast("int"))
    return out.select("block", *[c for c in rows.columns]), table


def _packed(rows: DataFrame) -> DataFrame:
    """A row for each block: its ids and its vectors end to end. Blocks are of bounded size."""
    got = rows.groupBy("block", "dim").agg(F.collect_list(F.struct("square", "vec_id", "rid", "q")).alias("v"))
    return got.select("block", "dim", F.col("v.vec_id").alias("ids"), F.col("v.rid").alias("rids"), F.flatten("v.q").alias("data"))


class Block:
    """Vectors by falling length, with their coordinates as rows."""

    def __init__(self, vectors: np.ndarray):
        self.real = vectors.astype(float)
        self.squares = np.square(self.real).sum(axis=1)
        self.lengths = np.sqrt(self.squares)
        self.columns = np.ascontiguousarray(self.real.T)

    def focus(self, shares: np.ndarray, cosine: float) -> int:
        """How many of a query's heaviest coordinates to prune by, if what the others can add at most leaves a spread to the threshold; else none.

        shares: of the squared length of the query in its 1, 2, ... heaviest coordinates; cosine: that which a vector as long as the longest needs.
        """
        dim = len(shares)
        n = np.arange(1, dim + 1)
        left = np.sqrt(np.maximum(0.0, 1 - shares) * (1 - n / dim))
        enough = np.flatnonzero(cosine - left >= np.sqrt(shares / dim))
        return int(enough[0]) + 1 if len(enough) and enough[0] < dim - 1 else 0

    def top(self, q: np.ndarray, theta: float) -> tuple[np.ndarray, int]:
        """Indexes of the vectors that could score theta or more with q, and the coordinates that pruned."""
        n, energy = len(self.lengths), np.square(q.astype(float))
        length = float(np.sqrt(energy.sum()))
        if theta <= 0 or length == 0:
            return np.arange(n) if theta <= 0 else np.empty(0, np.int64), 0
        far = int(np.searchsorted(-self.lengths, -(theta / length) * (1 - 1e-9), "right"))
        if not far:
            return np.empty(0, np.int64), 0
        heavy = np.argsort(-energy, kind="stable")
        shares = np.cumsum(energy[heavy]) / energy.sum()
        used = self.focus(shares, theta / (length * float(self.lengths[0])))
        if not used:
            return np.arange(far), 0
        part = self.columns[heavy[:used], :far]
        product = q[heavy[:used]].astype(float) @ part
        rest = np.sqrt(np.maximum(0.0, self.squares[:far] - np.square(part, out=part).sum(axis=0)))
        other = float(np.sqrt(energy[heavy[used:]].sum()))
        return np.flatnonzero(product + other * rest * (1 + 1e-9) >= theta * (1 - 1e-9)), used


def _pairs(k: int, seed: bool):
    """Rows of a query block beside a candidate block -> the best k of each query there, if they can count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                dim = c["dim"][row].as_py()
                get = lambda n: c[n][row].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
                vectors, queries = get("data").reshape(-1, dim), get("q_data").reshape(-1, dim)
                ids, rids, q_ids, q_rids = get("ids"), get("rids"), get("q_ids"), get("q_rids")
                thetas = get("theta").astype(float) if not seed else np.full(len(q_ids), -np.inf)
                order = np.argsort(-np.square(vectors.astype(float)).sum(axis=1), kind="stable")
                vectors, ids, rids = vectors[order], ids[order], rids[order]
                block = Block(vectors)
                real = block.real
                exact = not len(queries) or float(np.abs(real).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dim < 2**53
                out: list[list[np.ndarray]] = []
                for q, q_id, q_rid, theta in zip(queries, q_ids, q_rids, thetas, strict=True):
                    at, _ = block.top(q, float(theta))
                    at = at[rids[at] != q_rid]
                    if not len(at):
                        continue
                    scores = (real[at] @ q.astype(float)).astype(np.int64) if exact else vectors[at] @ q
                    best = np.flatnonzero(scores >= theta)
                    if len(best) > k:
                        least = np.partition(scores[best], len(best) - k)[len(best) - k]
                        best = best[scores[best] >= least]
                        best = best[np.lexsort((rids[at[best]], ids[at[best]], -scores[best]))[:k]]
                    m = len(best)
                    out.append([np.full(m, q_rid), np.full(m, q_id), ids[at[best]], rids[at[best]], scores[best].astype(np.int64)])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["q_rid", "query_id", "vec_id", "rid", "score"])

    return run


_HIT = "q_rid bigint, query_id bigint, vec_id bigint, rid bigint, score bigint"


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose vec_id is divisible by every."""
    bucket = F.when(F.col("square") > 0, F.floor(2 * F.log2("square"))).otherwise(-1).cast("int")
    rows = stored(quantized(embeddings, scale).withColumn("bucket", bucket), "vectors")
    spark = rows.sparkSession
    blocks, table = _blocks(rows, ["dim", "bucket"], BLOCK)
    queries, q_table = _blocks(rows.where(F.col("vec_id") % every == 0), ["dim", "bucket"], QUERY_BLOCK)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not table or not q_table:
        return empty
    candidates = stored(_packed(blocks), "blocks")
    q_blocks = _packed(queries).select(F.col("block").alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("rids").alias("q_rids"), F.col("data").alias("q_data"))
    q_blocks = stored(q_blocks, "query-blocks")

    # A block of long vectors for each dimension: the first of the longest bucket with enough members, else of the fullest.
    first: dict[int, tuple] = {}
    for dim, b, at, parts, n, top in sorted(table, key=lambda t: (t[0], -t[1])):
        if dim not in first or first[dim][0] <= k < n:
            first[dim] = (n, at)
    seeds = spark.createDataFrame([(dim, at) for dim, (_, at) in first.items()], "dim int, block int")
    seed_pairs = q_blocks.join(F.broadcast(seeds), "dim").join(candidates.drop("dim"), "block")
    found = seed_pairs.repartition("q_block").mapInArrow(_pairs(k, True), _HIT)
    theta = found.groupBy("q_rid").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("q_rid", F.col("least").cast("double").alias("theta"))
    theta = stored(theta, "thresholds")

    # Queries with their thresholds, dealt to the buckets that their length times the longest there can reach.
    reach = spark.createDataFrame([(t[0], t[1], t[2], t[3], float(t[5])) for t in table], "dim int, bucket int, first int, parts int, top double")
    own = queries.join(theta.withColumnRenamed("q_rid", "rid"), "rid", "left").select(F.col("block").alias("q_block"), "dim", "vec_id", "rid", "q", "square", F.coalesce("theta", F.lit(float("-inf"))).alias("theta"))
    packed = own.groupBy("q_block", "dim").agg(F.collect_list(F.struct("vec_id", "rid", "theta", "q", "square")).alias("v"))
    packed = packed.select("q_block", "dim", "v", F.transform("v", lambda x: F.when(x.theta > 0, x.theta * x.theta / F.greatest(x.square, F.lit(1e-300))).otherwise(F.lit(0.0))).alias("needs"))
    alive = packed.join(F.broadcast(reach), "dim").where(F.array_min("needs") * (1 - 1e-9) <= F.col("top"))
    dealt = alive.select("dim", F.explode(F.expr("sequence(first, first + parts - 1)")).alias("block"), F.col("v.vec_id").alias("q_ids"), F.col("v.rid").alias("q_rids"), F.col("v.theta").alias("theta"), F.flatten("v.q").alias("q_data"))
    hits = dealt.join(candidates.drop("dim"), "block").mapInArrow(_pairs(k, False), _HIT)
    best = Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.rid AS q_rid, a.vec_id AS query_id, b.vec_id, b.rid, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.rid <> b.rid AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY q_rid ORDER BY score DESC, vec_id, rid) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
