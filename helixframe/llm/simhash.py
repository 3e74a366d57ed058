"""Operator 3: SimHash near-duplicates by bit-sliced comparison.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's three-word shingles. Two texts are linked if their
fingerprints differ in at most two bits. Of four 16-bit blocks two are then equal, so each distinct fingerprint enters six
buckets. A bucket's fingerprints are stored as vertical bit planes, 64 candidates to a word; one fingerprint is compared
with all lanes of a word at once by carry-save counters, and words whose lanes have all passed the radius are dropped.

A bucket above HOT members is split exactly: the 32 bits outside its key are cut in three, one of which is equal for any
link, and once more in the same way. Then 50 bits are fixed, so no bucket can have more than 2**14 distinct fingerprints.
Buckets give spanning forests, never all pairs; the components come from those by star contraction.

Defined cases: null and empty texts and texts of white space have fingerprint zero and are linked like any other; a null
doc_id stays in the result and counts for no component id (null if a component has no other); repeated rows stay; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import fresh, narrow, stored, texts_of
from .components import components

RADIUS, SEED, WORDS = 2, 42, 3
#: Members above which a bucket is split; (query, word) comparisons done at once.
HOT, ITEMS = 4096, 1 << 16


def shingle_hashes(text: str, n_words: int = WORDS) -> np.ndarray:
    words = text.encode().lower().split()  # of bytes: A to Z only, and the six white bytes of ASCII
    if not words:
        return np.empty(0, np.uint64)
    parts = [b" ".join(x) for x in zip(*[words[i:] for i in range(n_words)], strict=False)] or [b" ".join(words)]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(x, SEED) for x in parts), np.uint64, len(parts))


def fingerprint(text: str) -> int:
    """Bits set in over half of the hashes; 0 without words."""
    h = shingle_hashes(text)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(sum(1 << int(b) for b in np.flatnonzero(total * 2 > len(h))))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((fingerprint(t) for t in texts_of(batch, "text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, row (a mark that the caller gives each row) and fp as a signed 64-bit integer."""
    rows = docs.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), (F.lit(0) if row is None else row).cast("bigint").alias("row"), F.col("`text`").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, row bigint, fp bigint")


def _bits(c: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def _first_keys() -> Column:
    """(key, rest): which two blocks and their 32 bits; the other 32 bits."""
    out = []
    for k, (a, b) in enumerate((a, b) for a in range(4) for b in range(a)):
        c, d = (x for x in range(4) if x not in (a, b))
        blocks = [_bits(F.col("fp"), 16 * x, 16) for x in (a, b, c, d)]
        key = F.lit(k).cast("bigint") * (1 << 32) + blocks[0] * (1 << 16) + blocks[1]
        out.append(F.struct(key.alias("key"), (blocks[2] * (1 << 16) + blocks[3]).alias("rest")))
    return F.explode(F.array(*out))


def _longer_keys(sizes: tuple[int, int, int], width: int) -> Column:
    """Cut rest in three; each part in turn joins the key and the others are the new rest."""
    top, mid, low = sizes
    r = F.col("rest")
    parts = [_bits(r, mid + low, top), _bits(r, low, mid), _bits(r, 0, low)]
    rests = [_bits(r, 0, mid + low), parts[0] * (1 << low) + parts[2], _bits(r, low, top + mid)]
    return F.explode(F.array(*[F.struct(((F.col("key") * 4 + i) * (1 << width) + p).alias("key"), q.alias("rest")) for i, (p, q) in enumerate(zip(parts, rests, strict=True))]))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets that are small enough, and of the others."""
    hot = rows.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
    marked = rows.join(hot, "key", "left")
    return marked.where("hot is null").drop("hot"), marked.where("hot").drop("hot")


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after each pair has been given the smaller of its two, until nothing changes."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    return label


def bucket_forests(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the distinct fingerprints of each -> edges (fp, smallest linked fp by position) that span each bucket's links."""
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, n])
    position = np.arange(n) - np.repeat(starts, sizes)
    words = (sizes + 63) // 64
    word_at = np.r_[0, np.cumsum(words)]
    own = np.repeat(word_at[:-1], sizes) + position // 64
    lane = (position % 64).astype(np.uint64)
    first_of = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    planes = np.stack([np.bitwise_or.reduceat((fps >> np.uint64(b) & one) << lane, first_of) for b in range(64)])
    lanes = np.bitwise_or.reduceat(one << lane, first_of)
    todo = np.repeat(word_at[1:], sizes) - own  # words from a member's own to its bucket's last
    ends = np.cumsum(todo)
    label = np.arange(n)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ITEMS, "right")))
        q = np.repeat(np.arange(at, to), todo[at:to])
        w = own[q] + np.arange(len(q)) - np.repeat(ends[at:to] - todo[at:to] - (ends[at - 1] if at else 0), todo[at:to])
        # Lanes up to a member's own in its own word have been compared from the other side.
        passed = ~lanes[w] | np.where(w == own[q], (one << lane[q]) | ((one << lane[q]) - one), np.uint64(0))
        ones = twos = np.zeros(len(q), np.uint64)
        for b in range(64):
            x = planes[b][w] ^ (full * (fps[q] >> np.uint64(b) & one))
            carry = ones & x
            ones = ones ^ x
            passed = passed | (twos & carry) | ((twos | carry) & ones)
            twos = twos | carry
            if b % 8 == 7:
                left = passed != full
                q, w, ones, twos, passed = q[left], w[left], ones[left], twos[left], passed[left]
                if not len(q):
                    break
        if len(q):
            linked = np.unpackbits((~passed).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            item, bit = np.nonzero(linked)
            other = first_of[w[item]] + bit
            label = _roots(label, q[item], other)
        at = to
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last bucket of a batch waits for the next."""
    kept_k, kept_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def edges(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = k[1:] == k[:-1]
        many = np.r_[same, False] | np.r_[False, same]
        if many.any():
            a, b = bucket_forests(k[many], f[many])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        k = np.concatenate([kept_k, batch.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([kept_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1]))
        yield from edges(k[:last], f[:last])
        kept_k, kept_f = k[last:], f[last:]
    yield from edges(kept_k, kept_f)


def links(distinct: DataFrame) -> DataFrame:
    """Distinct fp -> edges (a, b) that span the components of all links within RADIUS bits."""
    rows = distinct.select("fp", _first_keys().alias("x")).select("fp", "x.key", "x.rest")
    small, hot = _split(rows)
    middle, hot = _split(_longer(hot, (11, 11, 10), 11))
    last = _longer(hot, (8, 7, 7), 8)
    level = lambda df, k: df.select(F.lit(k).alias("level"), "key", "fp")
    every = level(small, 0).union(level(middle, 1)).union(level(last, 2))
    key = (F.col("key") * 3 + F.col("level")).alias("key")  # below 2**62: 36 + 13 + 10 bits, and the level
    dealt = every.select(key, "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_compare, "a bigint, b bigint")


def _longer(rows: DataFrame, sizes: tuple[int, int, int], width: int) -> DataFrame:
    return rows.select("fp", _longer_keys(sizes, width).alias("x")).select("fp", "x.key", "x.rest")


def grouped(marked: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Rows with fp -> (fp, root): a row for each distinct fingerprint and the smallest of its component. more: further edges."""
    distinct = marked.select("fp").distinct()
    edges = links(distinct) if more is None else links(distinct).union(more)
    found = components(edges).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id of the component) of every row."""
    marked = stored(fingerprints(narrow(docs, "doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    heads = marked.groupBy("fp").agg(F.min("doc_id").alias("head"))
    roots = stored(grouped(heads), "roots").join(heads, "fp")
    best = roots.groupBy("root").agg(F.min("head").alias("component_id"))
    of = roots.select("fp", "root").join(best, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int | None = None, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null last), then the smallest hash of its columns.

    The columns are those of docs. Of rows that are alike in every column one stays. With words, texts are also linked if their
    sets of shingles of so many words have a Jaccard coefficient of least (a fraction) or more.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    marked = stored(fingerprints(docs, row), "fingerprints")
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    heads = marked.groupBy("fp").agg(F.min(mine).alias("head"))
    more = None if words is None else jaccard.links(docs, row, marked.select("row", "fp"), words, least)
    keep = stored(grouped(heads, more), "roots").join(heads, "fp").groupBy("root").agg(F.min("head").alias("head"))
    doc, none, mark = fresh(docs, "doc", "none", "row")
    keep = keep.select(F.coalesce("head.doc_id", F.lit(-1)).alias(doc), F.col("head.none").alias(none), F.col("head.row").alias(mark)).distinct()
    id_ = F.col("`doc_id`").cast("bigint")
    out = docs.withColumns({doc: F.coalesce(id_, F.lit(-1)), none: id_.isNull(), mark: row}).join(keep, [doc, none, mark], "left_semi")
    return out.dropDuplicates([doc, none, mark]).select(*[F.col(f"`{c}`") for c in docs.columns])
