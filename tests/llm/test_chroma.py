"""Audio fingerprints: planted copies are found at their offsets, and the search equals a plain comparison of all pairs."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import chroma


def tones(r, n, note=256):
    f = np.repeat([220 * 2 ** (r.randrange(25) / 12) for _ in range(n)], note)
    return np.sin(np.cumsum(2 * np.pi * f / chroma.RATE))


def found(a, b_id, b):
    """The best offset of a pair by a dictionary of all, if any has enough in common."""
    counts = {}
    for p in chroma._starts(a):
        for s in chroma._starts(b):
            if a[p] >> 12 == b[s] >> 12:
                counts[int(s - p)] = counts.get(int(s - p), 0) + 1
    rows = []
    for o, c in counts.items():
        overlap, error = chroma.align(a, b, o)
        if c >= min(3, len(chroma._starts(a)), len(chroma._starts(b))) and overlap >= min(8, len(a), len(b)) and error <= 0.35:
            rows.append((error, -overlap, abs(o), o, c))
    return [(e, n, b_id, o, c) for e, n, _, o, c in sorted(rows)[:1]]


def plain(prints, k, every):
    """Offset histograms by dictionaries over all pairs."""
    out = []
    for i, (a_id, a) in enumerate(prints):
        if a_id % every:
            continue
        hits = []
        for j, (b_id, b) in enumerate(prints):
            if i == j:
                continue
            hits += found(a, b_id, b)
        out += [(a_id, rank + 1, h[2], h[3], h[4], -h[1], round(h[0], 9)) for rank, h in enumerate(sorted(hits)[:k])]
    return sorted(out)


def test_chroma_of_a_tone():
    t = np.arange(4096) / chroma.RATE
    image = chroma.chroma(np.sin(2 * np.pi * 440 * t))
    assert (image.argmax(axis=1) == 0).all()
    assert chroma.fingerprint(np.zeros(100)).size == 0 and len(set(chroma.fingerprint(np.zeros(9000)).tolist())) == 1


def test_shifted_noisy_copy():
    r = random.Random(1)
    a = tones(r, 60)
    noise = np.random.default_rng(1).normal(0, 0.02, len(a))
    b = (a + noise)[chroma.HOP * 10 :]
    got = chroma.matches([chroma.fingerprint(a).astype(np.int64)], [chroma.fingerprint(tones(r, 60)).astype(np.int64), chroma.fingerprint(b).astype(np.int64)])
    found = {o: (off, err) for _, o, off, _, _, err in got}
    assert found[1][0] == -10 and found[1][1] < 0.1
    assert 0 not in found or found[0][1] > 2 * found[1][1]


def test_search(spark, monkeypatch):
    monkeypatch.setattr(chroma, "BLOCK", 300)
    monkeypatch.setattr(chroma, "QUERY_BLOCK", 120)
    r = random.Random(2)
    base = [[r.random() - 0.5 for _ in range(64)] for _ in range(6)]
    rows = []
    for i in range(60):
        v = list(r.choice(base)) if i % 2 else [r.random() - 0.5 for _ in range(64)]
        shift = r.randrange(6)
        rows.append((i, v[shift:] + v[:shift]))
    rows += [(10, rows[1][1]), (None, rows[1][1]), (20, None), (30, []), (40, [float("nan")] * 64), (50, [0.1] * 3), (70, [0.2] * 24), (71, [0.2] * 26), (80, [0.0, 0.1] * 11)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = chroma.search(chroma.fingerprints(df, "vec_id", "embedding", as_melody=True), k=4, every=10).collect()
    kept = [(i, chroma.fingerprint(chroma.melody(np.array(v))).astype(np.int64)) for i, v in rows if i is not None and v and not np.isnan(v[0])]
    kept = [x for x in kept if len(x[1])]
    cut = lambda rows: sorted((x[0], x[1], x[2], x[3], x[4], x[5], x[6]) for x in rows)
    assert cut((x.query_id, x.rank, x.vec_id, x.offset, x.n_equal, x.overlap, round(x.bit_error, 9)) for x in got) == plain(kept, 4, 10)
    assert chroma.search(chroma.fingerprints(df.limit(0), "vec_id", "embedding", as_melody=True)).count() == 0


def test_retaken_recordings_are_found(spark):
    """Of the rows of a test table, recorded again later, softer and with noise, at least nine in ten are found, at their offset."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("vec_id", F.col("vec_id") * 5)
    prints = chroma.fingerprints(rows, "vec_id", "embedding", as_melody=True)
    again = chroma.fingerprints(rows.where("vec_id % 100 = 0"), "vec_id", "embedding", as_melody=True, cut=6 * 128 + 40, noise=0.05)
    best = chroma.search(prints, queries=again).where("rank = 1").collect()
    asked = rows.where("vec_id % 100 = 0").count()
    assert sum(x.query_id == x.vec_id and x.offset in (6, 7) for x in best) >= 0.9 * asked > 20


def test_silence_and_short_recordings():
    silent = [chroma.fingerprint(np.zeros(n)).astype(np.int64) for n in (4000, 9000)]
    got = chroma.matches(silent[:1], silent)
    assert [(o, e) for _, o, _, _, _, e in got] == [(0, 0.0), (1, 0.0)]
    short = chroma.fingerprint(tones(random.Random(4), 12)).astype(np.int64)[:5]
    assert chroma.matches([short], [short])[0][4:] == (5, 0.0)
