"""Operator 4: packing documents into token sequences by minimum bin slack.

Each task packs what it reads: no shuffle, and a pool of bounded size. A document's ids beyond whole sequences form its
remainder; from the pool of remainders the longest is taken and a bitset subset-sum over the other lengths (powers of two
of each count) finds the multiset that fills the window closest to its capacity; backtracking gives the counts. Slack that is left is
filled by cutting one remainder. What remains at the end of a task is cut at powers of two, which need no padding.

Defined cases: a null or empty text is the end id alone; null and repeated doc_ids are packed like any other; texts are packed whole,
whatever their length; of multisets that fill a window alike the one with the longer lengths is taken, and of equally long remainders
the one read last; an empty table gives no piece; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import narrow, texts_of
from .tokens import encoder

CAPACITY = 4096
#: Remainders that a task holds before it packs.
POOL = 512
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near to room as it can be without passing it.

    Bit s of a reach is set if some taken lengths sum to s. Counts are split into powers of two, so a length
    with count c adds about log2(c) shifts; the search stops once room itself is reached.
    """
    mask, reach, steps = (2 << room) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, take = counts[length], 1
        while left and not reach >> room & 1:
            take = min(take, left)
            if length * take > room:
                break
            steps.append((reach, length, take))
            reach |= reach << length * take & mask
            left, take = left - take, take * 2
    at, out = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] += take
    return dict(out)


class Packer:
    """Pieces with their sequences and offsets. first: the id of the first sequence."""

    def __init__(self, first: int, capacity: int = CAPACITY, pool: int = POOL):
        self.next, self.capacity, self.pool = first, capacity, pool
        self.by: dict[int, list] = defaultdict(list)
        self.held = 0

    def add(self, doc: tuple, n: int) -> Iterator[tuple]:
        """(doc, start, length, sequence, offset) of what a document's n ids make final."""
        at = 0
        while n - at >= self.capacity:
            yield doc, at, self.capacity, self.next, 0
            self.next += 1
            at += self.capacity
        if n > at:
            self.by[n - at].append((doc, at))
            self.held += 1
        while self.held > self.pool:
            yield from self._sequence()

    def _pop(self, length: int) -> tuple:
        held = self.by[length]
        out = held.pop()
        if not held:
            del self.by[length]
        self.held -= 1
        return out

    def _push(self, length: int, piece: tuple) -> None:
        self.by[length].append(piece)
        self.held += 1

    def _sequence(self) -> Iterator[tuple]:
        length = max(self.by)
        chosen = [(length, self._pop(length))]
        for n, k in fill({n: len(x) for n, x in self.by.items()}, self.capacity - length).items():
            chosen += [(n, self._pop(n)) for _ in range(k)]
        slack = self.capacity - sum(n for n, _ in chosen)
        while slack and self.by:
            n = max(self.by)
            doc, at = self._pop(n)
            take = min(n, slack)
            chosen.append((take, (doc, at)))
            if n > take:
                self._push(n - take, (doc, at + take))
            slack -= take
        yield from self._place(chosen)

    def _place(self, chosen: list) -> Iterator[tuple]:
        offset = 0
        for n, (doc, at) in chosen:
            yield doc, at, n, self.next, offset
            offset += n
        self.next += 1

    def end(self) -> Iterator[tuple]:
        """Full sequences while there is enough, then sequences of falling powers of two."""
        total = sum(n * len(x) for n, x in self.by.items())
        while total >= self.capacity:
            yield from self._sequence()
            total -= self.capacity
        rest = [(n, p) for n in sorted(self.by, reverse=True) for p in self.by[n]][::-1]
        self.by.clear()
        self.held = 0
        while total:
            room = 1 << total.bit_length() - 1
            total -= room
            chosen = []
            while room:
                n, (doc, at) = rest.pop()
                take = min(n, room)
                chosen.append((take, (doc, at)))
                if n > take:
                    rest.append((n - take, (doc, at + take)))
                room -= take
            yield from self._place(chosen)


def _run(path: str, end_id: int, kind: str, with_ids: bool, capacity: int, pool: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kind)
        dtype, end = f"<u{enc.width}", end_id.to_bytes(enc.width, "little")
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, pool)
        names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids
        out: list[tuple] = []

        def piece(doc: tuple, at: int, n: int, sequence: int, offset: int) -> tuple:
            doc_id, data = doc
            ids = np.frombuffer(data, dtype, n, at * enc.width).astype("<u4").tobytes()
            return (doc_id, at, n, zlib.crc32(ids), len(data) // enc.width, sequence, offset, *[ids] * with_ids)

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                data = enc.encode(text) + end
                out += [piece(*x) for x in packer.add((doc_id, data), len(data) // enc.width)]
                if len(out) > (500 if with_ids else 20_000):
                    yield pack()
                    out = []
        out += [piece(*x) for x in packer.end()]
        if out:
            yield pack()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, kind: str = "word", with_ids: bool = False, capacity: int = CAPACITY, pool: int = POOL) -> DataFrame:
    """One row for each piece of a document; with_ids adds the ids as little-endian unsigned 32-bit integers."""
    from pyspark.sql import functions as F

    rows = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(_run(tokenizer, end_id, kind, with_ids, capacity, pool), PIECE + ", ids binary" * with_ids)
