"""Exact, cached use of the tokenizers library.

A text is cut at spaces, where neither tokenizer can form a token across the cut, and the ids of each piece are kept in a
bounded cache. Pieces of Latin-1 characters are split by the tokenizer's own pattern and handed to its BPE model;
anything else goes through the whole library. Both give the ids that encode() gives for the whole text (tested).
Columns of texts are cut at line feeds too, and each different piece of many texts is looked up once.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bound of the two halves of each cache of a Python worker, in entries, by kind of tokenizer: the second one's words come in fewer forms.
MOST = {"byte": 350_000, "word": 200_000}
#: Longer keys are not kept.
MAX_KEY = 200
#: Bytes of text that a column is encoded in at a time; a longer text is taken alone.
TOGETHER = 8_000_000

_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE_SPACE = re.compile(r"\s ")
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]").search#: Letters of Latin-1, then signs of ASCII: two matches of either pattern.
_LETTERS_SIGNS = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]+)").fullmatch
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_LETTERS = pa.array([c for c in map(chr, range(256)) if _LETTERS_SIGNS(c + ".")], pa.large_string())
_MADE: dict[tuple[str, str], Encoder] = {}


def byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary, by the rule: printable ones are themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {}, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


class Cache(dict):
    """A bounded memo: at its bound, the entries become the old half, and those used again come back."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

        self.old: dict = {}

    def __missing__(self, key):
        out = self.old.get(key) if self.old else None
        if out is None:
            out = self.make(key)
        if len(key) > MAX_KEY:
            return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


def _stems(words: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """Words without the signs of ASCII that follow their last letter, if that is of Latin-1, and those signs, which are a match of their own."""
    stems = pc.ascii_rtrim(words, characters=_SIGNS)
    stems = pc.if_else(pc.is_in(pc.utf8_slice_codeunits(stems, -1), value_set=_LETTERS), stems, words)
    size = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy()
    ends, to = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 :][: len(words)], np.cumsum(size)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[np.repeat(ends - to, size) + np.arange(to[-1] if len(to) else 0)]
    signs = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(np.append(0, to).astype(np.int64)), pa.py_buffer(data)])
    return stems.dictionary_encode(), signs.dictionary_encode()


class Encoder:
    """Ids of whole texts as little-endian 16-bit (or 32-bit) integers."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.kind = kind
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings are ordinary text
        self.model = self.tok.model
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.packed = [i.to_bytes(self.width, "little") for i in range(1 + max(self.tok.get_vocab().values()))]
        self.chars = byte_chars()
        if kind == "byte":
            from public_tokenizers import PATTERN

            self.find = regex.compile(PATTERN).findall
        else:
            self.find = regex.compile(_WORD_PATTERN).findall
        self.pieces, self.words, self.spaced = (Cache(make, MOST[kind]) for make in (self._piece, self._word, self._bare))
        self.parts, self.old_parts = {}, {}
        self.tokenize, self.space = self.model.tokenize, self.chars[32]

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _ids(self, mapped: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(mapped)])

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            mapped = piece.replace(" ", self.chars[32])
        else:
            mapped = piece.encode().decode("latin-1").translate(self.chars)
        return self._ids(mapped)

    def whole(self, text: str) -> bytes:
        return self._pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _bare(self, word: str) -> bytes:
        """A word of letters, or of letters and then signs, of ASCII or Latin-1; anything else goes through the pattern."""
        if word.isalpha() and (word.isascii() or not _OTHER(word)):
            return self._ids(self.space + (word if word.isascii() else word.encode().decode("latin-1").translate(self.chars)))
        if m := _LETTERS_SIGNS(word):
            return self.spaced[m[1]] + self.pieces[m[2]]
        return self._word(" " + word)

    def _part(self, part: str) -> bytes | None:
        """A word behind a single space, or a line feed and the word behind it; None if that has white space at an end, which may belong to a longer match."""
        word = part[1:] if part[:1] == "\n" else part
        if not word or word.strip() != word:
            return None
        return self._bare(word) if word is part else self.pieces["\n"] + self._word(word)

    def _looked_up(self, parts: list[str], counts: np.ndarray) -> list[bytes | None]:
        """Ids of different parts; those met more than once, as counted, are remembered, the older half of them until as many more are."""
        ids, old, most = list(map(self.parts.get, parts)), self.old_parts.get, MOST[self.kind]
        packed, tokenize, space = self.packed, self.tokenize, self.space
        for i, (part, known, keep) in enumerate(zip(parts, ids, (counts > 1).tolist(), strict=True)):
            if known is None and (known := old(part)) is None:
                if part.isalpha() and part.isascii():
                    known = b"".join([packed[t.id] for t in tokenize(space + part)])
                else:
                    known = self._part(part)
                if keep and len(part) <= MAX_KEY:
                    if len(self.parts) >= most:
                        self.parts, self.old_parts = {}, self.parts
                        old = self.old_parts.get
                    self.parts[part] = known
            ids[i] = known
        return ids

    def _word(self, word: str) -> bytes:
        if _OTHER(word) or len(word) > 2000:
            return self.whole(word)
        if self.kind == "word":
            word = word.lower() if word.isascii() else "".join([c.lower() for c in word])
            if word.isalpha():
                return self._piece(word)
            if m := _LETTERS_SIGNS(word):
                return self.words[m[1]] + self.pieces[m[2]]
        return b"".join([self.pieces[x] for x in self.find(word)])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.kind == "byte":
            if _SPACE_SPACE.search(text):
                return self.whole(text) if len(text) < 4000 else self._runs(text)
            first, *rest = text.split(" ")
            return self._word(first) + b"".join(map(self.spaced.__getitem__, rest))
        return b"".join(map(self.words.__getitem__, text.split(" ")))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """encode() of each text of a column of strings, in order; null is the empty text."""
        if self.kind != "byte":
            yield from (self.encode(x.as_py() or "") for x in texts)
            return
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            yield from self._together(texts.slice(at, to - at))
            at = to

    def _together(self, texts: pa.Array) -> Iterator[bytes]:
        """A line feed is set before each text, whose id is left out again, and a space before each line feed, where the texts are then cut."""
        string, feed = pa.large_string(), len(self.pieces["\n"])
        texts = texts.cast(string).fill_null("")
        marked = pc.binary_join_element_wise(pa.scalar("\n", string), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", string))
        cut = pc.split_pattern(marked, " ")
        parts = cut.values.dictionary_encode()
        of = parts.indices.to_numpy()
        stems, signs = _stems(parts.dictionary)
        counts = np.bincount(stems.indices.to_numpy()[of], minlength=len(stems.dictionary))
        ids = self._looked_up(stems.dictionary.to_pylist(), counts), list(map(self.pieces.__getitem__, signs.dictionary.to_pylist()))
        ids = [pa.array(x, pa.large_binary()).take(y.indices) for x, y in zip(ids, (stems, signs), strict=True)]
        joined = pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.large_binary())).take(parts.indices)
        at, data = np.frombuffer(joined.buffers()[1], np.int64, len(of) + 1), memoryview(joined.buffers()[2] or b"")
        firsts = cut.offsets.to_numpy()
        # Texts with a part that may not stand alone are encoded by themselves.
        odd = np.zeros(len(texts), bool)
        if joined.null_count:
            odd[np.searchsorted(firsts, np.flatnonzero(joined.is_null().to_numpy(zero_copy_only=False)), "right") - 1] = True
        for i, (alone, a, b) in enumerate(zip(odd.tolist(), at[firsts[:-1]].tolist(), at[firsts[1:]].tolist(), strict=True)):
            yield self.encode(texts[i].as_py()) if alone else bytes(data[a + feed : b])

    def _runs(self, text: str) -> bytes:
        """Cut only between a character that is no space of any kind and a single space."""
        return b"".join([self.words[w] if len(w) < 200 else self.whole(w) for w in re.split(r"(?<=[^\s\x1c-\x1f])(?= )", text)])


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per worker and file; its caches outlive the task."""
    if (path, kind) not in _MADE:
        _MADE[path, kind] = Encoder(path, kind)
    return _MADE[path, kind]
