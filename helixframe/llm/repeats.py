"""Operator 10: removal of long repeated strings, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every window of LENGTH bytes picks its smallest K-byte hash (the leftmost of equals); the windows of a text that pick the same
place form a stretch. Equal windows pick the same place inside them, so two equal windows always lie in stretches of one anchor.
1. Anchors that occur once are done. 2. Stretches whose whole strings are equal repeat as a whole; nothing more is read of them.
3. For the different stretches of a shared anchor, one string of each goes to a kernel: it builds the Burrows-Wheeler transform of
many such strings at once and expands intervals backwards, breadth first. At step l the right ends of new intervals have a
longest common prefix of l; expansion stops at LENGTH, and what has no value then is as long at least. These are the repeats.
Anchors with more than HOT different stretches are first halved, window by window range, under longer keys, so that no kernel
meets an unbounded group.

Defined cases: null and empty texts have nothing to remove; copies of a row count as other places; texts shorter than LENGTH
stay whole; a null doc_id stays; an empty table gives an empty result; other columns are not read (deduplicate() keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, release, scratch, texts_of

LENGTH, K = 400, 128
#: Different stretches of an anchor above which it is halved; bytes of one transform; bytes of a long text done at once.
HOT, KERNEL_BYTES, BLOCK = 1500, 1 << 19, 1 << 18
#: Bytes that one task transforms, as long as there are no more tasks than a driver can plan.
TASK_BYTES, MOST_TASKS = 8 << 20, 50_000

_POS = np.uint64((1 << 20) - 1)
_STATE: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of an odd base and of its inverse modulo 2**64."""
    if "up" not in _STATE or len(_STATE["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        for name, b in (("up", base), ("down", inverse)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _STATE[name] = np.multiply.accumulate(x)
        _STATE["bytes"] = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _STATE["bytes"], _STATE["up"], _STATE["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor place, anchor hash) of each stretch of a byte array of at least length bytes."""
    values, up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    h = mixed((total[k:] - total[:-k]) * down[: len(data) - k + 1])
    best = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    span, want = 1, length - k + 1
    while span * 2 <= want:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if want > span:
        best = np.minimum(best[: len(best) - (want - span)], best[want - span :])
    at = (best & _POS).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return first, last, at[first], h[at[first]].view(np.int64)


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two hashes with different seeds."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("other"), text).alias("t2")]


#: lead: the place of the first window among the length - k + 1 places that a window can have before its anchor.
STRETCH = "t1 bigint, t2 bigint, first int, last int, lead int, anchor bigint, h1 bigint, h2 bigint"
_HALF = 1 << 63


def _wide(data: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(data)
    return (x >> 64) - _HALF, (x & (1 << 64) - 1) - _HALF


def _stretches(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STRETCH.split(", ")]
        out: list[list[np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

        for batch in batches:
            for t1, t2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch, "text"), strict=True):
                data = text.encode()
                if len(data) < length:
                    continue
                whole = np.frombuffer(data, np.uint8)
                for at in range(0, len(data) - length + 1, BLOCK):
                    first, last, place, hashes = anchors(whole[at : at + BLOCK + length - 1], length, k)
                    marks = np.array([_wide(data[at + a : at + b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.int64)
                    n = len(first)
                    out.append([np.full(n, t1), np.full(n, t2), (first + at).astype(np.int32), (last + at).astype(np.int32), (first - place + length - k).astype(np.int32), hashes, marks[:, 0], marks[:, 1]])
                    held += n
                if held > 50_000:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    return run


def suffix_order(parts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the parts, each ended by a symbol of its own, and their suffixes sorted by depth symbols at least."""
    m = len(parts)
    sizes = np.array([len(p) for p in parts])
    n = int(sizes.sum()) + m
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(n, bool)
    inside[ends] = False
    symbols = np.empty(n, np.int64)
    symbols[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + m
    symbols[ends] = np.arange(m)
    width = int(m + 256).bit_length()
    at, key = 1, symbols.copy()
    while (at + 1) * width < 62:  # a few symbols at once
        shifted = np.zeros(n, np.int64)
        shifted[: n - at] = symbols[at:]
        key = key << width | shifted
        at += 1
    while True:
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        new = np.r_[False, s[1:] != s[:-1]]
        rank[order] = np.cumsum(new)
        if at >= depth or new[1:].all():
            return symbols, order
        key = rank << 32
        key[: n - at] |= rank[at:] + 1
        at *= 2


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, the starts whose string of that length occurs at another place in the parts too."""
    symbols, order = suffix_order(parts, length + 1)
    n = len(order)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")  # where a row's predecessor stands: rank in the first column -> row
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    column = bwt[by_symbol]
    starts_symbol = np.r_[True, column[1:] != column[:-1]]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lows, highs = np.array([0]), np.array([n])
    owner = np.empty(n, np.int64)
    reached = np.zeros(n, bool)
    for _ in range(length):
        sizes = highs - lows
        which = np.repeat(np.arange(len(lows)), sizes)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lows[which]
        to = step[rows]
        owner[to] = which
        reached[to] = True
        found = np.flatnonzero(reached)
        reached[found] = False
        mine = owner[found]
        cut = np.r_[True, (found[1:] != found[:-1] + 1) | (mine[1:] != mine[:-1]) | starts_symbol[found[1:]]]
        low = found[cut]
        high = np.r_[found[np.flatnonzero(cut)[1:] - 1], found[-1]] + 1
        new = ~known[high]
        lows, highs = low[new], high[new]
        if not len(lows):
            break
        known[highs] = True
    long = np.flatnonzero(~known[:n])
    marked = np.zeros(n, bool)
    marked[order[long]] = True
    marked[order[long - 1]] = True
    at, out = 0, []
    for p in parts:
        out.append(np.flatnonzero(marked[at : at + len(p)]))
        at += len(p) + 1
    return out


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of neighbouring numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return np.r_[starts[:1], starts[cut + 1]], np.r_[starts[cut], starts[-1:]]


#: off, lead: of the first window in data, from the whole stretch's first window and from the node's zero; low, high: the node's places.
PART = "key bigint, v1 bigint, v2 bigint, off int, lead int, low int, high int, data binary"
_PART = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_PART_NAMES = [x.split()[0] for x in PART.split(", ")]
RUN = "v1 bigint, v2 bigint, first int, last int"


def _kernel(length: int):
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        for (_, v1, v2, off, *_), starts in zip(rows, repeated_starts([r[-1] for r in rows], length), strict=True):
            if len(starts):
                out += [(v1, v2, off + int(a), off + int(b)) for a, b in zip(*runs(starts), strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["v1", "v2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and group[0][0] != row[0]:
                    held += group
                    group = []
                    if size > KERNEL_BYTES:
                        yield solve(held)
                        held, size = [], 0
                group.append(row)
                size += len(row[-1])
        if held or group:
            yield solve(held + group)

    return run


def _halves(length: int):
    """Two parts of each row's windows, split at the same place before the anchor, each under the hash of the bytes that all windows there share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for _, v1, v2, off, lead, low, high, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                last, mid = lead + len(data) - length, (low + high) // 2
                for a, b in ((low, mid), (mid + 1, high)):
                    first, to = max(a, lead), min(b, last)
                    if first <= to:
                        part = data[first - lead : to - lead + length]
                        out.append((_wide(data[b - lead : a - lead + length])[0], v1, v2, off + first - lead, first, a, b, part, *_wide(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([*_PART, pa.int64(), pa.int64()])], names=[*_PART_NAMES, "x1", "x2"])

    return run


def _cut_out(places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, wanted in zip(texts_of(batch, "text"), batch.column(batch.schema.get_field_index("wanted")).to_pylist(), strict=True):
                data = text.encode()
                out += [(w["anchor"], w["h1"], w["h2"], 0, w["lead"], 0, places, data[w["first"] : w["end"]]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_PART)], names=_PART_NAMES)

    return run


def _resolve(parts: DataFrame, length: int, stored) -> DataFrame:
    """Different strings under shared keys -> runs (v1, v2, first, last) of their windows that repeat among them.

    Counts are written before they are joined back, as joins of plain tables can be split on hot keys.
    """
    ready, full, rest = None, None, parts
    while True:
        counts = stored(rest.groupBy("key").count().where("count > 1"), large=False)
        shared = rest.join(counts, "key")
        few = shared.where(F.col("count") <= HOT).drop("count")
        ready = few if ready is None else ready.union(few)
        if not counts.where(F.col("count") > HOT).limit(1).count():
            break
        halves = stored(shared.where(F.col("count") > HOT).drop("count").mapInArrow(_halves(length), PART + ", x1 bigint, x2 bigint"))
        same = stored(halves.groupBy("x1", "x2").agg(F.count("*").alias("n"), F.min(F.struct("v1", "v2", "off")).alias("head")), large=False)
        marked = halves.join(same, ["x1", "x2"])
        whole = marked.where("n > 1").select("v1", "v2", F.col("off").alias("first"), (F.col("off") + F.length("data") - length).cast("int").alias("last"))
        full = whole if full is None else full.union(whole)
        rest = marked.where("n = 1 or (v1 = head.v1 and v2 = head.v2 and off = head.off)").select(*_PART_NAMES)
    # A number of its own, by bytes to transform: left to itself, the exchange would be coalesced by the bytes it moves, which say little of the work.
    total = parts.agg(F.sum(F.length("data"))).first()[0] or 0
    tasks = min(max(1, -(-total // TASK_BYTES)), MOST_TASKS)
    out = ready.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_kernel(length), RUN)
    return out if full is None else out.union(full)


def repeated_runs(docs: DataFrame, length: int = LENGTH, k: int = K, keep: list[str] | None = None) -> DataFrame:
    """docs -> (t1, t2, runs): for each text that has some, its runs of repeated windows as (first, last) starts.

    keep collects the paths of tables in the shared folder that the result reads.
    """
    spark = docs.sparkSession
    mine: list[str] = []

    def stored(df: DataFrame, large: bool = True) -> DataFrame:
        mine.append(path := scratch(spark, "repeats"))
        df.write.option("compression", "zstd").parquet(path)
        if large:
            release(spark)
        return spark.read.schema(df.schema).parquet(path)

    texts = docs.select(*text_key(F.col("`text`")), F.col("`text`").alias("text"))
    every = stored(texts.mapInArrow(_stretches(length, k), STRETCH))
    # Written first: a join of two plain tables can be split where one anchor holds a large part of all rows.
    counted = stored(every.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("h1") != F.max("h1")).alias("mixed")).where("n > 1").select("anchor", "mixed"), large=False)
    shared = stored(every.join(counted, "anchor"))
    forget(spark, mine.pop(0))
    strings = stored(shared.groupBy("anchor", "h1", "h2", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "first", "last", "lead")).alias("at")))
    wanted = strings.where("mixed").select("at.t1", "at.t2", F.struct("anchor", "h1", "h2", "at.first", "at.lead", (F.col("at.last") + length).alias("end")).alias("w")).groupBy("t1", "t2").agg(F.collect_list("w").alias("wanted"))
    parts = stored(_one_text(texts, wanted).mapInArrow(_cut_out(length - k), PART))
    partial = stored(_resolve(parts, length, stored))
    spans = shared.join(strings.where("n > 1").select("anchor", "h1", "h2"), ["anchor", "h1", "h2"]).select("t1", "t2", "first", "last")
    inner = shared.where("mixed").join(partial.select(F.col("v1").alias("h1"), F.col("v2").alias("h2"), F.col("first").alias("a"), F.col("last").alias("b")), ["h1", "h2"])
    spans = spans.union(inner.select("t1", "t2", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b")).alias("last")))
    out = stored(spans.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last")).alias("runs")))
    for path in mine[:-1]:
        forget(spark, path)
    if keep is not None:
        keep.append(mine[-1])
    return out


def _one_text(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of each wanted key, once. Copies are dropped before they are shuffled: a text may have any number."""
    return texts.dropDuplicates(["t1", "t2"]).join(wanted, ["t1", "t2"]).select("text", "wanted")


def spans_of(found: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Runs of window starts -> maximal removed byte ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["first"], r["last"] + length) for r in (() if found is None else found)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(data)]
    return b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def removed(docs: DataFrame, length: int = LENGTH, k: int = K, digests: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay (without digests: kept binary, and the spans)."""
    found = repeated_runs(docs, length, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cut, count, kept, where = [], [], [], [], []
            for text, rs in zip(texts_of(batch, "text"), batch.column(batch.schema.get_field_index("runs")).to_pylist(), strict=True):
                data, spans = text.encode(), spans_of(rs, length)
                n.append(len(data))
                cut.append(sum(b - a for a, b in spans))
                count.append(len(spans))
                rest = _kept(data, spans)
                kept.append(hashlib.sha256(rest).hexdigest() if digests else rest)
                where.append([{"start": a, "end": b} for a, b in spans])
            columns = [batch.column(batch.schema.get_field_index("doc_id")), *[pa.array(x, pa.int64()) for x in (n, cut, count)], pa.array(kept, pa.string() if digests else pa.binary())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept"]
            if not digests:
                columns.append(pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), *text_key(F.col("`text`")), F.col("`text`").alias("text"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, " + ("kept_sha256 string" if digests else "kept binary, spans array<struct<start:bigint,end:bigint>>")
    return rows.join(found, ["t1", "t2"], "left").select("doc_id", "text", "runs").mapInArrow(run, schema)


def deduplicate(docs: DataFrame, length: int = LENGTH, k: int = K, words: int | None = None, always: int = LENGTH) -> DataFrame:
    """The rows of docs with repeated strings cut out of text and, where there is such a column, n_chars counted anew.

    Every copy goes, the first too, so a text that consists of repeated strings becomes empty. With words, of the maximal runs only
    those of over so many words, or of always bytes or more, are cut. A character of which a byte is cut goes as a whole; a null text
    stays null.
    """
    one, two, where = fresh(docs, "t1", "t2", "runs")
    found = repeated_runs(docs, length, k).select(F.col("t1").alias(one), F.col("t2").alias(two), F.col("runs").alias(where))

    @F.pandas_udf("string")
    def cut(texts, all_runs):
        import pandas as pd

        def rest(text: str, runs) -> str:
            data = text.encode()
            spans = spans_of(runs, length)
            if words is not None:
                spans = [(a, b) for a, b in spans if b - a >= always or len(data[a:b].split()) > words]
            return _kept(data, spans).decode("utf-8", "ignore")

        return pd.Series([rest(t, r) if t and r is not None and len(r) else t for t, r in zip(texts, all_runs, strict=True)], dtype=object)

    a, b = text_key(F.col("`text`"))
    rows = docs.withColumns({one: a, two: b}).join(found, [one, two], "left")
    rows = rows.withColumn("text", cut(F.col("`text`"), F.col(where)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
