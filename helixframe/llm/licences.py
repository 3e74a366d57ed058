"""Operator 5: licence scan by the Dice coefficient over word bigrams.

Lines and paragraphs (lines up to an empty one) are normalised: A-Z in lower case, anything but letters and digits of ASCII is space.
The set of a passage's word bigrams is compared with that of each template. A coefficient of t needs sizes within t / (2 - t)
of each other, so the sorted sizes of the templates give the candidates, and passages that fit none are not compared.

With inside, notices that are only a part of a line or paragraph, or run over the end of one, are found too: windows of the words of
the whole text, whose best for each template is taken first. A window counts unless it lies in a line or paragraph that has matched or
meets one that matched the same template; of windows that meet, that with more common bigrams counts.

Defined cases: null and empty texts match nothing; a passage of one word has no bigram and matches nothing; texts are read whole,
whatever their length; ties go to the first name; null doc_ids, repeated rows and empty tables are kept as they are; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, texts_of
from .licence_texts import TEXTS

THRESHOLD = 0.8

#: Short notices of public licences, the standard headers or grants of some, and whole texts.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    **TEXTS,
}

_LOWER = {c: c + 32 for c in range(65, 91)}
_OTHER = re.compile(r"[^a-z0-9\n]+")


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def normalised(text: str) -> str:
    return _OTHER.sub(" ", text.translate(_LOWER))


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        made = sorted((len(b), name, b) for name, t in templates.items() if (b := bigrams(normalised(t).split())))
        self.sizes, self.templates, self.threshold = [m[0] for m in made], made, threshold
        self.ratio = threshold / (2 - threshold)
        self.known = set().union(*[m[2] for m in made]) if made else set()

    def passage(self, words: list[str]) -> tuple[float, str] | None:
        """Score and name of the best template at or above the threshold."""
        if not self.sizes or len(words) - 1 < self.sizes[0] * self.ratio - 1e-9:
            return None
        own = bigrams(words)
        n = len(own)
        low, high = bisect.bisect_left(self.sizes, n * self.ratio - 1e-9), bisect.bisect_right(self.sizes, n / self.ratio + 1e-9)
        if low >= high or own.isdisjoint(self.known):
            return None
        best = min((-2.0 * len(own & b) / (n + size), name) for size, name, b in self.templates[low:high])
        return (-best[0], best[1]) if -best[0] >= self.threshold else None

    def text(self, text: str, inside: bool = False) -> list[tuple[float, str]]:
        out, lines, spans, every = [], [], [], []
        for line in [*normalised(text).split("\n"), ""]:
            words = line.split()
            if words:
                every += words
                if got := self.passage(words):
                    out.append(got)
                    spans.append((len(every) - len(words), len(every), got[1]))
                lines.append(words)
                continue
            if len(lines) > 1 and (got := self.passage([w for x in lines for w in x])):
                out.append(got)
                spans.append((len(every) - sum(map(len, lines)), len(every), got[1]))
            lines = []
        return out + self._inside(every, spans) if inside else out

    def _inside(self, words: list[str], spans: list[tuple[int, int, str]]) -> list[tuple[float, str]]:
        pairs = list(zip(words, words[1:], strict=False))
        known = self.known
        hits = [i for i, x in enumerate(pairs) if x in known]
        if not hits:
            return []
        present = {pairs[i] for i in hits}
        found = []
        for size, name, wanted in self.templates:
            if len(present & wanted) < size * self.ratio - 1e-9:
                continue
            free = _apart(sorted(self._windows(pairs, [i for i in hits if pairs[i] in wanted], wanted, size)), [x for x in spans if x[2] == name])
            found += [(common, score, start, end, name) for score, common, start, end in free if not any(a <= start and end <= b for a, b, _ in spans)]
        return [(-score, name) for _, score, _, _, name in _apart(sorted(found), [], 2)]

    def _windows(self, pairs: list[tuple[str, str]], hits: list[int], wanted: set[tuple[str, str]], size: int) -> Iterator[tuple[float, int, int, int]]:
        """(- score, - common bigrams, first word, end) of the best window from each place, if it reaches the threshold.

        Leaving off bigrams that aren't wanted, or a first one that comes again, makes no window worse.
        """
        most, least = size / self.ratio + 1e-9, size * self.ratio - 1e-9
        for first in hits:
            own, common, best = set(), 0, None
            for at in range(first, len(pairs)):
                x = pairs[at]
                if x in own:
                    if x == pairs[first]:
                        break
                    continue
                own.add(x)
                if len(own) > most:
                    break
                if x in wanted:
                    common += 1
                    if common >= least:
                        score = 2.0 * common / (len(own) + size)
                        if score >= self.threshold and (best is None or (-score, -common) < best[:2]):
                            best = (-score, -common, first, at + 2)
            if best:
                yield best


def _apart(windows: list[tuple], taken: list[tuple], start: int = 2) -> list[tuple]:
    """The windows, in order, that meet neither a taken span nor one before them."""
    out, used = [], sorted((a, b) for a, b, _ in taken)
    ends = [b for _, b in used]
    # Taken spans may nest (a line in its paragraph): the outer ones are enough.
    if any(x > y for x, y in zip(ends, ends[1:], strict=False)):
        outer = []
        for a, b in used:
            if not outer or b > outer[-1][1]:
                outer.append((a, b))
        used = outer
    for w in windows:
        a, b = w[start], w[start + 1]
        k = bisect.bisect_left(used, (b, 0))
        if k and used[k - 1][1] > a:
            continue
        bisect.insort(used, (a, b))
        out.append(w)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, inside: bool = False) -> DataFrame:
    """doc_id, n_matches (passages), licences (names in order, by commas), best_licence and best_score ("" and 0 if none) of every document."""
    wanted = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted, threshold)
        for batch in batches:
            n, names, best, score = [], [], [], []
            for text in texts_of(batch, "text"):
                got = scanner.text(text, inside)
                n.append(len(got))
                names.append(",".join(sorted({x for _, x in got})))
                top = min(((-s, x) for s, x in got), default=(0.0, ""))
                best.append(top[1])
                score.append(-top[0] if got else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "n_matches", "licences", "best_licence", "best_score"])

    rows = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_matches bigint, licences string, best_licence string, best_score double")


def _oracle() -> str:
    quoted = ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in item)) for item in TEMPLATES.items())
    words = "list_filter(string_split(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
WITH t AS (SELECT name, {words.format("body")} AS w FROM (VALUES {quoted}) v(name, body)),
tb AS (SELECT name, {pairs.format("w")} AS b FROM t),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, i, {words.format("lines[i]")} AS w FROM (SELECT rid, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT rid, string_split(text, chr(10)) AS lines FROM d))),
g AS (SELECT rid, i, w, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS para FROM l),
p AS (
  SELECT rid, w FROM g WHERE len(w) > 0
  UNION ALL
  SELECT rid, flatten(list(w ORDER BY i)) AS w FROM g WHERE len(w) > 0 GROUP BY rid, para HAVING count(*) > 1
),
pb AS (SELECT row_number() OVER () AS pid, rid, {pairs.format("w")} AS b FROM p),
s AS (SELECT pid, rid, name, 2.0::DOUBLE * len(list_intersect(pb.b, tb.b)) / (len(pb.b) + len(tb.b)) AS score FROM pb JOIN tb ON len(pb.b) BETWEEN len(tb.b) / 3 AND len(tb.b) * 3),
m AS (SELECT pid, rid, name, score FROM s WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY pid ORDER BY score DESC, name) = 1),
r AS (SELECT rid, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, arg_min(name, (-score, name)) AS best, max(score) AS score FROM m GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(names, '') AS licences, coalesce(best, '') AS best_licence, coalesce(score, 0.0)::DOUBLE AS best_score FROM d LEFT JOIN r USING (rid)
"""


ORACLE = _oracle()
