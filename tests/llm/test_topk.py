"""Top-k search against all products."""

import os
import random

import numpy as np
import pytest

from helixframe.llm import topk


def plain(rows, k=20, every=20):
    kept = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i % every == 0:
            scores = sorted((-int(q @ v), j) for b, (j, v) in enumerate(kept) if a != b and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, query_block, spread", [(4096, 512, 1.0), (16, 4, 3.0)])
def test_all_products(spark, block, query_block, spread, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", query_block)
    r = random.Random(1)
    centre = [[r.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = []
    for i in range(400):
        c = r.choice(centre)
        size = r.random() ** spread
        rows.append((i, [float(np.float32(size * (x + r.gauss(0, 0.2)))) for x in c]))
    rows += [(20, rows[3][1]), (20, rows[3][1]), (40, [0.0] * 8), (60, [-x for x in centre[0]]), (None, [1.0] * 8), (80, None), (100, []), (120, [1.0, None] * 4), (140, [float("nan")] * 8), (160, [float("inf")] * 8), (180, [1.0, 2.0]), (181, [1.0, 2.0]), (200, [1.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double").repartition(4)
    got = sorted(tuple(x) for x in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect())
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == plain(f32)


def kept_share(v, queries, k):
    """Checks that nothing which counts is pruned -> the share of vectors kept, and of queries that pruned by coordinates."""
    block = topk.Block(v[np.argsort(-np.square(v).sum(axis=1), kind="stable")])
    kept = by_coordinates = 0
    for q in queries:
        scores = block.real @ q
        theta = float(np.sort(scores)[-k])
        at, used = block.top(q, theta)
        assert set(np.flatnonzero(scores >= theta)) <= set(at.tolist())
        kept += len(at)
        by_coordinates += used > 0
    return kept / len(v) / len(queries), by_coordinates / len(queries)


def test_pruning_keeps_all_that_count():
    r = np.random.default_rng(2)
    flat = r.integers(-50, 50, (500, 6))
    share, used = kept_share(flat, r.integers(-50, 50, (200, 6)), 7)
    assert share < 0.7 and used > 0.5
    block, shares = topk.Block(flat), np.arange(1, 7) / 6
    assert block.focus(shares, 0.05) == 0 < block.focus(shares, 0.9) < 6
    centres = r.normal(0, 60, (20, 64))
    near = np.rint(centres[r.integers(0, 20, 3000)] + r.normal(0, 15, (3000, 64))).astype(np.int64)
    share, used = kept_share(near, near[:100], 20)
    assert share < 0.2 and used == 1
    long = np.rint(r.normal(0, 1, (2000, 64)) * r.lognormal(2, 1, (2000, 1))).astype(np.int64)
    assert kept_share(long, long[:100], 20)[0] < 0.5


def test_pruning_on_the_test_vectors(spark):
    """The test vectors have nearly equal lengths and lie by chance, so that it is coordinates that prune."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    v = np.floor(64 * np.array([x.embedding for x in rows], float)).astype(np.int64)
    share, used = kept_share(v, v[::20], 21)
    assert share < 0.5 and used > 0.9


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0
