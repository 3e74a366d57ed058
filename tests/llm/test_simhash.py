"""SimHash against brute force over all pairs of small tables."""

import random

import numpy as np
import pytest
import xxhash

from helixframe.llm import simhash


def plain_fingerprint(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """Smallest index reachable over links of at most two bits."""
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_plain_and_spark(spark):
    r = random.Random(1)
    texts = ["", None, "One", "one TWO", "a b c", "É é\x85x\xa0y z\x1cq", *[" ".join(r.choice(["Alpha", "beta", "Γ", "d\te", "f\n"]) for _ in range(r.randint(1, 80))) for _ in range(50)]]
    for t in texts:
        assert simhash.fingerprint(t or "") == plain_fingerprint(t)
    df = spark.createDataFrame([("x yé z",)], "s string").selectExpr("xxhash64(s) h").first().h
    assert df % (1 << 64) == simhash.shingle_hashes("x yé z")[0]


def near(r, base, most):
    for b in r.sample(range(64), r.randint(0, most)):
        base ^= 1 << b
    return base


def fingerprint_rows(seed, n):
    r = random.Random(seed)
    fps = [r.getrandbits(64) for _ in range(n // 2)]
    while len(fps) < n:
        fps.append(near(r, r.choice(fps), 4))
    return [0, 1, 3, 7, 15, *fps]


@pytest.mark.parametrize("hot", [4096, 8])
def test_links_give_all_components(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    fps = fingerprint_rows(2, 300)
    r = random.Random(5)
    base = r.getrandbits(64)
    fps += [near(r, base, 3) for _ in range(200)]  # a crowded bucket
    fps = sorted(set(fps))
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {r.fp: r.root for r in simhash.grouped(df).collect()}
    want = classes(fps)
    for i in range(len(fps)):
        for j in range(i):
            assert (got[signed[i]] == got[signed[j]]) == (want[i] == want[j])


def test_bucket_forests_large():
    r = random.Random(6)
    base = r.getrandbits(64)
    fps = np.array(sorted({near(r, base, 5) for _ in range(700)}), np.uint64)
    keys = np.repeat(np.arange(2), [300, len(fps) - 300])
    a, b = simhash.bucket_forests(keys, fps)
    where = {int(x): i for i, x in enumerate(fps)}
    for part in (slice(0, 300), slice(300, len(fps))):
        own = [int(x) for x in fps[part]]
        edges = [(int(x), int(y)) for x, y in zip(a, b) if int(x) in own]
        label = {x: x for x in own}
        for x, y in edges:
            label[x] = y
        want = classes(own)
        for i in range(len(own)):
            assert label[own[i]] == own[want[i]], where


def test_documents(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    long = [r.choice(words) for _ in range(400)]
    rows, texts = [], []
    for i in range(120):
        t = list(long) if i % 3 == 0 else [r.choice(words) for _ in range(r.randint(1, 60))]
        if i % 6 == 0:
            t[r.randrange(len(t))] = "changed"
        texts.append(" ".join(t))
    texts += ["", None, "   ", "\n", texts[0], texts[0]]
    for i, t in enumerate(texts):
        rows.append((i + 10, t, "x", 5))
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int").repartition(4)
    got = {x.doc_id: x for x in simhash.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    want = classes(fps)
    assert len(got) == len(rows)
    for i in range(len(rows)):
        assert got[i + 10].fingerprint == f"{fps[i]:016x}" and got[i + 10].component_id == want[i] + 10
    kept = sorted(x.doc_id for x in simhash.deduplicate(df).collect())
    assert kept == sorted({w + 10 for w in want})
    assert simhash.deduplicate(df).columns == df.columns


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "x y z w"), (3, "x y z w"), (3, "q r s t u v")], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 5 and sorted((x.component_id is None) for x in got) == [False] * 3 + [True] * 2
    assert simhash.deduplicate(df).count() == 3
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0
