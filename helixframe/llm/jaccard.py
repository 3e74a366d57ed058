"""Links between texts whose sets of word shingles have a Jaccard coefficient of at least a given fraction, without loss.

Two sets of sizes n and m that reach p/q share p/q of the larger one, so in any order of all shingles they share one of the first
n - ceil(p n / q) + 1 of each (prefix filter). The order is that of the hashes, with shingles that over HOT sets have in their prefix
put last, so that a common line brings no texts together. First each set is compared with two others behind it among those with the
same prefix shingle, in an order by chance that each shingle has for itself, which brings a group of near copies together; then
only pairs that are in different components by then. Shingles that over HOT sets still have in their prefix are dealt in
blocks, within and between which a kernel compares sketches and emits no more than the pairs that are close.

A pair is compared by parity sketches before its sets are: bit i of a sketch is the parity of the shingles whose hash ends in i, so
two sketches differ in no more bits than the sets differ in shingles. Only pairs within the allowed difference have their sets read.

Equal sets are compared once. Texts without words have no set and no link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, release, scratch, texts_of
from .components import components
from .repeats import BLOCK, mixed, powers

#: Sets with a shingle in their prefix from which on it is put last.
HOT = 64
#: Sets of a block of a hot shingle; words of sketches that a kernel compares at once.
BLOCK_SETS, AT_ONCE = 4096, 1 << 21
#: Such shingles up to which every worker gets their list (8 bytes each); of more, each set gets its own by a join.
LISTED = 1 << 20


_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_NEXT_WHITE = re.compile(rb"[\t-\r ]")


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word, between the white bytes of ASCII, computed for all words of a block at once."""
    out, at = [], 0
    while at < len(data):
        to = _NEXT_WHITE.search(data, at + BLOCK)
        to = to.start() if to else len(data)
        block = np.frombuffer(data, np.uint8, to - at, at)
        at = to
        inside = np.r_[False, ~_WHITE[block], False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        values, up, down = powers(len(block) + 1)
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(values[block] * up[: len(block)], out=total[1:])
        out.append(mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the runs of so many words (of A to Z in lower case; a shorter text is one run), each once."""
    h = word_hashes(text.encode().lower())
    count = len(h) - words + 1
    if count < 1:  # one run of another length: mixed with zeros, and its length
        h = np.r_[h, np.zeros(words - len(h), np.uint64)] + np.uint64(len(h)) if len(h) else h
        count = min(1, len(h))
    found = np.zeros(count, np.uint64)
    for k in range(words):
        found = (found ^ h[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    found = np.sort(mixed(found))
    return found[np.r_[True, found[1:] != found[:-1]]] if count else found


def prefix(tokens: np.ndarray, least: tuple[int, int], hot: np.ndarray) -> np.ndarray:
    """The shingles of which a set that reaches the coefficient shares one: hot ones (sorted) come last in the order."""
    n = len(tokens)
    size = n - -(-least[0] * n // least[1]) + 1 if n else 0
    if len(hot) and n:
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        last = hot[at] == tokens
        tokens = np.concatenate([tokens[~last], tokens[last]])
    return tokens[:size]


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the shingles by the low bits of their hashes, with two to four bits for each shingle and a power of two of at least 64 in all."""
    width = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches_differ(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ once the wider one is folded to the width of the other: at most the shingles in one set only."""
    if len(x) < len(y):
        x, y = y, x
    a, b, width = int.from_bytes(x, "little"), int.from_bytes(y, "little"), len(x) * 8
    while width > len(y) * 8:
        width //= 2
        a = a >> width ^ a & (1 << width) - 1
    return (a ^ b).bit_count()


def _sets(words: int, least: tuple[int, int], hot: np.ndarray, what: str):
    """what: prefixes (of a set that the task has met before: none), or whole sets. A column hot holds a row's own hot shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("hot")) if "hot" in batch.schema.names else None
            sids, sizes, lists, marks = [], [], [], []
            for i, text in enumerate(texts_of(batch, "text")):
                tokens = shingle_set(text, words)
                sid = xxhash.xxh64_intdigest(tokens.tobytes())
                mine = hot if own is None else np.sort(np.array(own[i].as_py() or [], np.int64).view(np.uint64))
                again = what == "prefixes" and sid in met
                sids.append(sid)
                sizes.append(len(tokens))
                marks.append(None if again or what != "prefixes" else sketch(tokens))
                lists.append((tokens[:0] if again else tokens if what == "whole" else prefix(tokens, least, mine)).view(np.int64))
                if len(met) < 1 << 20:
                    met.add(sid)
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            values = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64))
            columns = [batch.column(0), pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "sid", "n", "tokens", "sketch"])

    return run


def _allowed(n, m, least: tuple[int, int]):
    """How many shingles two sets that reach the coefficient may differ in."""
    p, q = least
    return n + m - 2 * -(-p * (n + m) // (p + q))


def _close(least: tuple[int, int]):
    """Pairs whose sketches differ in no more bits than their sets may differ in shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "n_a", "n_b", "x_a", "x_b"))
            left = [sketches_differ(u, v) <= _allowed(s, t, least) for s, t, u, v in zip(n, m, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(left, pa.bool_()))

    return run


def close_pairs(n: np.ndarray, root: np.ndarray, sketches: list[bytes], side: np.ndarray, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs of different roots whose sketches are close: of side 0 with side 1, or if there is but one side within it.

    Sets that can reach the coefficient have sketches of one width, or one of twice the other's, which is folded.
    """
    width = np.array([len(x) for x in sketches])
    one = not side.any()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    planes = {w: np.frombuffer(b"".join([sketches[i] for i in at]), "<u8").reshape(len(at), -1) for w, at in rows.items()}
    for w, at in rows.items():
        for v in (w, w // 2):
            if v not in rows:
                continue
            other, y = rows[v], planes[v]
            x = planes[w] if v == w else planes[w][:, : v // 8] ^ planes[w][:, v // 8 :]
            step = max(1, AT_ONCE // max(1, y.size))
            for k in range(0, len(at), step):
                mine = at[k : k + step]
                bits = np.zeros((len(mine), len(other)), np.int32)
                for c in range(x.shape[1]):
                    bits += np.bitwise_count(x[k : k + step, c, None] ^ y[None, :, c])
                good = (bits <= _allowed(n[mine][:, None], n[other][None], least)) & (root[mine][:, None] != root[other][None])
                if v == w:
                    good &= mine[:, None] < other[None]
                if not one:
                    good &= side[mine][:, None] != side[other][None]
                i, j = np.nonzero(good)
                found.append((mine[i], other[j]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _blocks(least: tuple[int, int]):
    """Rows sorted by shingle and pair of blocks -> close pairs of each, in order of their ids, that share no hot shingle before this one."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        token, low, _, sid, n, root, x, block, mine = zip(*rows, strict=True)
        ids = np.array(sid, np.int64)
        i, j = close_pairs(np.array(n, np.int64), np.array(root, np.int64), list(x), np.array(block) != low[0], least)
        before = {k: set(mine[k][: mine[k].index(token[0])]) for k in {*i.tolist(), *j.tolist()}}
        first = [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if sid[a] != sid[b] and before[a].isdisjoint(before[b])]
        a, b = (ids[[p[k] for p in first]] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and group[0][:3] != row[:3]:
                    yield solve(group)
                    group = []
                group.append(row)
        if group:
            yield solve(group)

    return run


def _hot_pairs(open_: DataFrame, heads: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Close pairs (a, b) among the sets of each hot shingle: its sets in blocks of about BLOCK_SETS, each pair of blocks a unit of work.

    A pair that shares several hot shingles is emitted for the first: each row carries its set's hot shingles, of which a prefix has few.
    """
    hot = open_.where(F.col("many") > HOT)
    mine = hot.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("mine")).select("sid", F.transform("mine", lambda x: x.token).alias("mine"))
    rows = hot.join(mine, "sid").join(heads.select("sid", "x"), "sid").withColumn("parts", F.ceil(F.col("many") / BLOCK_SETS).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select("token", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "sid", "n", "root", "x", "block", "mine")
    return rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high").mapInArrow(_blocks(least), "a bigint, b bigint")


def links(docs: DataFrame, row: Column, marked: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """Edges (a, b) of fingerprints and set ids that span the components of all links. marked: row and fp; row: the mark of a row of docs."""
    schema = "row bigint, sid bigint, n int, tokens array<bigint>, sketch binary"
    texts = docs.select(row.cast("bigint").alias("row"), F.col("`text`").alias("text"))
    spark, none = docs.sparkSession, np.empty(0, np.uint64)
    made = lambda df, hot, what: df.mapInArrow(_sets(words, least, hot, what), schema).where("n > 0")
    mine: dict[str, str] = {}

    def kept(df: DataFrame, name: str) -> DataFrame:
        mine[name] = path = scratch(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        release(spark)
        return spark.read.schema(df.schema).parquet(path)

    def drop(*names: str) -> None:
        for name in names:
            forget(spark, mine.pop(name))

    every = kept(made(texts, none, "prefixes"), "prefixes")
    counts = every.select(F.explode("tokens").alias("token")).groupBy("token").count()
    hot = kept(counts.where(F.col("count") > HOT).select("token"), "hot-shingles")
    many = hot.count()
    if many and many <= LISTED:
        drop("prefixes")
        every = kept(made(texts, np.sort(np.array([r[0] for r in hot.collect()], np.int64).view(np.uint64)), "prefixes"), "prefixes")
    elif many:
        of_row = made(texts, none, "whole").select("row", F.explode("tokens").alias("token")).join(hot, "token").groupBy("row").agg(F.collect_set("token").alias("hot"))
        drop("prefixes")
        every = kept(made(texts.join(kept(of_row, "hot-of-rows"), "row", "left"), none, "prefixes"), "prefixes")
    of = kept(every.select("row", "sid").distinct().join(marked.distinct(), "row").select("fp", "sid").distinct(), "set-prints")
    heads = kept(every.where("sketch is not null").groupBy("sid").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("sketch").alias("x")), "set-heads")
    # One exchange by shingle serves the removal of copies, the counts and the neighbours.
    posts = every.select("sid", "n", F.posexplode("tokens").alias("pos", "token")).repartition("token").dropDuplicates(["token", "sid"])
    shared = kept(posts.withColumn("many", F.count("*").over(Window.partitionBy("token"))).where("many > 1"), "postings")
    drop("prefixes")

    def near(n: str, i: str, m: str, j: str) -> Column:
        """What can follow the first common shingle is enough; a pair that reaches the coefficient passes at its first one."""
        left = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
        return left * (least[0] + least[1]) >= (F.col(n) + F.col(m)) * least[0]

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """pairs: distinct (a, b)."""
        side = lambda s: heads.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("x").alias(f"x_{s}"))
        ends = kept(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_close(least), "a bigint, b bigint"), f"{name}-close")
        ids = ends.select(F.col("a").alias("sid")).union(ends.select(F.col("b").alias("sid"))).distinct()
        rows = heads.join(ids, "sid", "left_semi").select("row")
        whole = kept(made(texts.join(rows, "row", "left_semi").dropDuplicates(["row"]), none, "whole").select("sid", "n", "tokens"), f"{name}-sets")
        full = lambda s: whole.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}"))
        both = F.size(F.array_intersect("t_a", "t_b"))
        reach = both * (least[0] + least[1]) >= (F.col("n_a") + F.col("n_b")) * least[0]
        out = kept(ends.join(full("a"), "a").join(full("b"), "b").where(reach).select("a", "b"), f"{name}-linked")
        drop(f"{name}-close", f"{name}-sets")
        return out

    by = Window.partitionBy("token").orderBy(F.xxhash64("token", "sid"), "sid")
    behind = F.array(*[F.struct(F.lag("sid", k).over(by).alias("a"), F.lag("n", k).over(by).alias("m"), F.lag("pos", k).over(by).alias("i")) for k in (1, 2)])
    chain = shared.select(F.col("sid").alias("b"), "n", "pos", behind.alias("behind")).select("b", "n", "pos", F.inline("behind"))
    chain = chain.where(F.col("a").isNotNull() & near("m", "i", "n", "pos")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    chain = kept(chain.distinct(), "neighbours")
    first = verified(chain, "first")
    roots = kept(components(first).select(F.col("a").alias("sid"), F.col("b").alias("root")), "set-roots")
    every_root = Window.partitionBy("token")
    rooted = shared.join(roots, "sid", "left").select("token", "many", "sid", "n", "pos", F.coalesce("root", "sid").alias("root"))
    open_ = kept(rooted.withColumns({"low": F.min("root").over(every_root), "high": F.max("root").over(every_root)}).where("low <> high").drop("low", "high"), "open")
    drop("postings")
    few = open_.where(F.col("many") <= HOT)
    other = few.select("token", F.col("sid").alias("b"), F.col("n").alias("m"), F.col("pos").alias("i"), F.col("root").alias("other"))
    pairs = few.withColumnRenamed("sid", "a").join(other, "token").where((F.col("a") < F.col("b")) & (F.col("root") != F.col("other")) & near("n", "pos", "m", "i"))
    pairs = pairs.select("a", "b").union(_hot_pairs(open_, heads, least))
    pairs = kept(pairs.distinct().join(chain, ["a", "b"], "left_anti"), "pairs")
    drop("open", "neighbours")
    linked = first.union(verified(pairs, "second"))
    ends = linked.select(F.col("a").alias("sid")).union(linked.select(F.col("b").alias("sid"))).distinct()
    several = of.groupBy("sid").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("sid")
    own = of.join(ends.union(several).distinct(), "sid", "left_semi").select(F.col("fp").alias("a"), F.col("sid").alias("b"))
    out = kept(linked.union(own), "jaccard-edges")
    drop(*[name for name in mine if name != "jaccard-edges"])
    return out
