"""Operator 6: byte-level BPE as a monoid reduction.

A string's encoding is built from those of its halves, down to single bytes. Ids are the encoding of their bytes exactly if every two neighbours,
encoded together, give themselves back: merges in different parts do not disturb each other, so the first merge that crossed a
boundary of the whole would also cross it between the two neighbours alone. A join therefore encodes anew only a window around the
boundary and is done once the window's outer ids agree with the ids beside them; else the window doubles.
The matches of a text are joined up a balanced tree too (nothing merges across their borders), and decoding concatenates bytes up one.
Encodings of short strings are remembered, so that a half that has been met isn't reduced again.

Defined cases: null and empty texts have no ids and decode to nothing; repeated rows and null doc_ids stay; texts are encoded whole, whatever
their length; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import hashlib
import operator
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, texts_of
from .tokens import Cache

#: Entries of the caches of a worker, of all but the first in each of two halves.
MAX_PAIRS, MAX_NODES, MAX_PIECES, MAX_WORDS = 200_000, 200_000, 200_000, 300_000

_SPACES = regex.compile(r"[\s\x1c-\x1f] ").search


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes = ranks, [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        # White space by Unicode's property: other engines count the separators U+001C to U+001F too.
        self.find = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.nodes = Cache(self._node, MAX_NODES)
        self.pieces = Cache(self._piece, MAX_PIECES)
        self.words = Cache(self._word, MAX_WORDS)
        self.spaced = Cache(lambda w: self._word(" " + w), MAX_WORDS)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """Two ids encoded together; they are settled if that gives them back."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(self.bytes[a] + self.bytes[b])
        return got

    def settled(self, a: int, b: int) -> bool:
        return self.pair(a, b) == (a, b)

    def _node(self, data: bytes) -> tuple[int, ...]:
        """Encode the halves and join them."""
        if len(data) < 2:
            return (self.ranks[data],) if data else ()
        mid = len(data) // 2
        return self.join(self.nodes[data[:mid]], self.nodes[data[mid:]])

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        window, left, right = self.pair(a[-1], b[0]), 1, 1
        if window == (a[-1], b[0]):
            return a + b
        while True:
            fits_left = left == len(a) or self.settled(a[-left - 1], window[0])
            fits_right = right == len(b) or self.settled(window[-1], b[right])
            if fits_left and fits_right:
                return a[: len(a) - left] + window + b[right:]
            left, right = min(left if fits_left else 2 * left, len(a)), min(right if fits_right else 2 * right, len(b))
            window = self.merged(b"".join([self.bytes[i] for i in a[len(a) - left :] + b[:right]]))

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Encode the bytes of a window anew: the neighbours of lowest rank are merged first, from a queue over a linked list."""
        ranks, n = self.ranks, len(data)
        one = ranks.get(data)
        if one is not None and n <= 2:
            return (one,)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, to = heapq.heappop(queue)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != to:
                continue
            end[i], end[j], after[i] = to, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
                k = after[j]
                if (x := ranks.get(data[i : end[k]])) is not None:
                    heapq.heappush(queue, (x, i, end[k]))
            if (h := before[i]) >= 0 and (x := ranks.get(data[h:to])) is not None:
                heapq.heappush(queue, (x, h, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = after[i]
        return tuple(out)

    def _piece(self, text: str) -> tuple[int, ...]:
        """Ids of one match of the pattern. A match that is itself in the vocabulary is one id."""
        data = text.encode()
        one = self.ranks.get(data)
        if one is not None:
            return (one,)
        mid = len(data) // 2
        return self.join(self.nodes[data[:mid]], self.nodes[data[mid:]]) if mid else self.nodes[data]

    def _word(self, text: str) -> tuple[bytes, str]:
        """Ids as 32-bit integers, and in decimal. Bytes, as the collector would walk through hundreds of thousands of lists."""
        if text[:1] == " " and text[1:].isascii() and text[1:].isalpha():
            ids = self._piece(text)
        else:
            ids = [i for p in self.find(text) for i in self.pieces[p]]
        return array("I", ids).tobytes(), " ".join(map(str, ids))

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids of a text, and the same in decimal.

        It is cut at spaces that follow a character that is no space: no match of the pattern crosses such a place.
        """
        if not text:
            return [], ""
        if _SPACES(text):
            got = [self.words[w] for w in regex.split(r"(?<=[^\s\x1c-\x1f])(?= )", text, flags=regex.V1)]
        else:
            first, *rest = text.split(" ")
            got = [self._word(first), *map(self.spaced.__getitem__, rest)]
        parts, decimals = zip(*got, strict=True)
        return array("I", _up(parts)).tolist(), " ".join(filter(None, decimals))

    def decode(self, ids: list[int]) -> bytes:
        return _up([self.bytes[i] for i in ids])


def _up(level: Sequence[bytes]) -> bytes:
    """The concatenation of neighbours, and of those, until one is left."""
    while len(level) > 1:
        pairs = [*map(operator.add, level[::2], level[1::2])]
        level = [*pairs, level[-1]] if len(level) % 2 else pairs
    return level[0] if level else b""


_MADE: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = Codec.from_file(path, pattern)
    return _MADE[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and decoded bytes of each text; with digests, their SHA-256 in place of the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for text in texts_of(batch, "text"):
                ids, decimal = c.encode(text)
                decoded = c.decode(ids)
                n.append(len(ids))
                a.append(hashlib.sha256(decimal.encode()).hexdigest() if digests else ids)
                b.append(hashlib.sha256(decoded).hexdigest() if digests else decoded)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string() if digests else pa.list_(pa.int32())), pa.array(b, pa.string() if digests else pa.binary())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"],
            )

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, n_tokens bigint, {kinds}")
