"""Operator 8: chroma audio fingerprints and their alignment.

A recording is cut into overlapping frames; the energy of each frame's spectrum is folded into twelve pitch classes. Sixteen
filters, differences of rectangle sums read from an integral image over time and pitch class, each give two Gray-coded bits, and so
every position gives a packed 32-bit integer. Two recordings are aligned by a histogram of the offsets at which the upper 20 bits of their integers
are equal (the first of equal neighbours stands for them), and scored by the share of different bits over the overlap.

A search compares blocks of queries with blocks of recordings, which hold a bounded number of integers unless a single recording has more;
each block keeps the best of each query, so that a recording with any number of copies gives no more than the asked number of answers.
Every offset with enough equal integers is verified. Enough is LEAST_EQUAL, or as many as the shorter recording can give.

Defined cases: recordings that are null, hold null or non-finite samples or are too short for an integer have no fingerprint and
answer nothing; rows without an id take no part; rows with equal ids are different rows; silence gives equal integers, and silent
recordings match each other; of equal bit errors the longer overlap, then the smaller id wins; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

RATE, FRAME, HOP, WIDTH = 2000, 512, 128, 16
LOWEST, HIGHEST = 100.0, 950.0
#: Equal integers at one offset and positions in common at least; share of different bits at most.
LEAST_EQUAL, LEAST_OVERLAP, MOST_ERROR, KEY_SHIFT = 3, 8, 0.35, 12
#: Answers; the divisor of the ids of queries; integers in a block of recordings and of queries.
K, EVERY, BLOCK, QUERY_BLOCK = 10, 100, 1 << 17, 1 << 13


def chroma(samples: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Frames x 12 pitch-class energies, each frame of length one (silence: zero)."""
    if len(samples) < frame:
        return np.zeros((0, 12))
    windows = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop] * np.hanning(frame)
    power = np.abs(np.fft.rfft(windows, axis=1)) ** 2
    f = np.fft.rfftfreq(frame, 1 / rate)
    used = (f >= LOWEST) & (f <= HIGHEST)
    note = np.mod(np.rint(12 * np.log2(f[used] / 440.0)), 12).astype(int)
    fold = np.zeros((int(used.sum()), 12))
    fold[np.arange(len(note)), note] = 1
    out = power[:, used] @ fold
    return out / np.maximum(np.sqrt(np.square(out).sum(axis=1, keepdims=True)), 1e-9)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, classes, positions) of the sixteen filters, by rule."""
    return [(i % 4, 5 * i % 8, 2 + i % 3, 4 + 4 * (i % 4)) for i in range(16)]


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Packed 32-bit integers, one for each position with WIDTH frames."""
    image = chroma(np.asarray(samples, float), rate)
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.empty(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[at + t1, p1] - total[at + t0, p1] - total[at + t1, p0] + total[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for i, (kind, p, high, wide) in enumerate(filters()):
        q, w, mid, half = min(12, p + high), wide, p + max(1, high // 2), wide // 2
        if kind == 0:  # earlier against later
            a, b = area(0, half, p, q), area(half, w, p, q)
        elif kind == 1:  # lower against higher classes
            a, b = area(0, w, p, mid), area(0, w, mid, q)
        elif kind == 2:  # chequered
            a, b = area(0, half, p, mid) + area(half, w, mid, q), area(half, w, p, mid) + area(0, half, mid, q)
        else:  # middle against both sides
            a, b = area(w // 4, w - w // 4, p, q), area(0, w // 4, p, q) + area(w - w // 4, w, p, q)
        v = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))
        level = (v > -0.25).astype(np.uint32) + (v > 0) + (v > 0.25)
        out |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * i)
    return out


def melody(values: np.ndarray, rate: int = RATE, note: int = 128) -> np.ndarray:
    """A test signal: each value in turn a tone, its pitch among 25 semitones from 220 Hz by rank of size; the phase runs on."""
    step = np.clip(np.floor((np.asarray(values, float) + 0.5) * 25), 0, 24)
    return np.sin(np.cumsum(np.repeat(2 * np.pi * 220.0 * 2 ** (step / 12) / rate, note)))


_PRINT = "rid bigint, id bigint, fp array<bigint>"


def retaken(samples: np.ndarray, seed: int, cut: int, noise: float) -> np.ndarray:
    """A recording as another device would give it: begun later, softer, and with noise."""
    rest = samples[cut:]
    return 0.5 * rest + np.random.default_rng(seed).normal(0, noise, len(rest))


def _fingerprints(as_melody: bool, rate: int, cut: int, noise: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = x.values.to_numpy(zero_copy_only=False)
                sound = melody(values, rate) if as_melody else values
                out.append(fingerprint(retaken(sound, abs(i), cut, noise) if cut or noise else sound, rate).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["rid", "id", "fp"])

    return run


def fingerprints(rows: DataFrame, id_column: str, samples: str, as_melody: bool = False, rate: int = RATE, cut: int = 0, noise: float = 0.0) -> DataFrame:
    """rid, id and fp of the rows whose samples (array of numbers) are whole. as_melody: the numbers are notes, not samples; cut, noise: of retaken()."""
    x = F.col(f"`{samples}`")
    whole = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v) != float("inf"))), F.lit(False))
    kept = rows.where(whole & F.col(f"`{id_column}`").isNotNull())
    kept = kept.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_column}`").cast("bigint").alias("id"), x.cast("array<double>").alias("x"))
    return kept.mapInArrow(_fingerprints(as_melody, rate, cut, noise), _PRINT)


def _starts(fp: np.ndarray) -> np.ndarray:
    """Positions whose key differs from the one before."""
    key = fp >> KEY_SHIFT
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)


def align(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Positions in common and share of different bits if b lies offset positions later than a."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 0, 1.0
    x = (a[lo:hi] ^ b[lo + offset : hi + offset]).astype(np.uint32)
    return hi - lo, int(np.bitwise_count(x).sum()) / (32 * (hi - lo))


def matches(queries: list[np.ndarray], others: list[np.ndarray]) -> list[tuple[int, int, int, int, int, float]]:
    """(query, other, offset, equal integers, overlap, error) of the best offset of each pair that has enough in common."""
    starts = [_starts(q) for q in queries]
    parts = [(np.full(len(s), i), s, q[s] >> KEY_SHIFT) for i, (q, s) in enumerate(zip(queries, starts, strict=True)) if len(s)]
    if not parts:
        return []
    q_of, q_at, q_key = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(q_key, kind="stable")
    q_of, q_at, q_key = q_of[order], q_at[order], q_key[order]
    q_runs = np.array([len(s) for s in starts])
    out = []
    for j, fp in enumerate(others):
        s = _starts(fp)
        key = fp[s] >> KEY_SHIFT
        low, high = np.searchsorted(q_key, key, "left"), np.searchsorted(q_key, key, "right")
        n = high - low
        if not n.any():
            continue
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code = q_of[at] << 32 | (np.repeat(s, n) - q_at[at] + (1 << 31))
        code, count = np.unique(code, return_counts=True)
        who, offset = code >> 32, (code & (1 << 32) - 1) - (1 << 31)
        good = count >= np.minimum(LEAST_EQUAL, np.minimum(q_runs[who], len(s)))
        best: dict[int, tuple] = {}
        for w, o, c in zip(who[good].tolist(), offset[good].tolist(), count[good].tolist(), strict=True):
            overlap, error = align(queries[w], fp, o)
            if overlap >= min(LEAST_OVERLAP, len(queries[w]), len(fp)) and error <= MOST_ERROR:
                best[w] = min(best.get(w, (2.0,)), (error, -overlap, abs(o), o, c))
        out += [(w, j, o, c, -overlap, error) for w, (error, overlap, _, o, c) in best.items()]
    return out


_HIT = "q_rid bigint, query_id bigint, rid bigint, vec_id bigint, offset int, n_equal int, overlap int, bit_error double"


def _search(k: int, others_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _HIT.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                queries, others = ([np.array(x["fp"], np.int64) for x in row[side]] for side in ("queries", "others"))
                rows: dict[int, list[tuple]] = {}
                for q, o, offset, equal, overlap, error in matches(queries, others):
                    a, b = row["queries"][q], row["others"][o]
                    if others_only or a["rid"] != b["rid"]:
                        rows.setdefault(q, []).append((error, -overlap, b["id"], b["rid"], a["rid"], a["id"], offset, equal))
                best = [x for r in rows.values() for x in sorted(r)[:k]]
                if best:
                    e, o, vid, rid, qrid, qid, off, eq = zip(*best, strict=True)
                    columns = [qrid, qid, rid, vid, off, eq, [-x for x in o], e]
                    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _dealt(rows: DataFrame, size: int, number: str, name: str) -> tuple[DataFrame, int]:
    """Recordings in blocks of about size integers; a longer recording is a block's one or among a few."""
    total = rows.agg(F.sum(F.size("fp"))).first()[0] or 0
    parts = max(1, -(-total // size))
    block = F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int").alias(number)
    return rows.groupBy(block).agg(F.collect_list(F.struct("rid", "id", "fp")).alias(name)), parts


def search(prints: DataFrame, k: int = K, every: int = EVERY, queries: DataFrame | None = None) -> DataFrame:
    """query_id, rank, vec_id, offset, n_equal, overlap, bit_error: the k best aligned recordings of each query.

    Queries are prints of their own, or else the recordings whose id is divisible by every, each against all others.
    """
    rows = stored(prints.where(F.size("fp") > 0), "prints")
    own = rows.where(F.col("id") % every == 0) if queries is None else stored(queries.where(F.size("fp") > 0), "query-prints")
    blocks, parts = _dealt(rows, BLOCK, "block", "others")
    others = stored(blocks, "print-blocks")
    asked, _ = _dealt(own, QUERY_BLOCK, "q_block", "queries")
    dealt = asked.select("queries", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block")).repartition("block")
    hits = dealt.join(others, "block").select("queries", "others").mapInArrow(_search(k, queries is not None), _HIT)
    order = Window.partitionBy("q_rid").orderBy("bit_error", F.desc("overlap"), "vec_id", "rid")
    ranked = hits.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "offset", "n_equal", "overlap", "bit_error")
