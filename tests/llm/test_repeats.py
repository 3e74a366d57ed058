"""Repeated strings against a dictionary of all windows."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import queries, repeats


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cut = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                cut[i + 1 : i + length + 1] = True
        out.append((len(d), int(cut.sum()), int((cut[1:] & ~cut[:-1]).sum()), bytes(b for b, c in zip(d, cut[1:]) if not c)))
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé日") for _ in range(r.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(150), text(90), text(300)]
    out = [None, "", "short", "a" * 1500, "ab" * 700, text(2500)]
    for _ in range(n):
        parts = [text(r.randint(0, 200))]
        if r.random() < 0.6:
            s = r.choice(shared)
            at = r.randrange(len(s) // 3)
            parts.insert(r.randint(0, 1), s[at:])
        out.append(" ".join(parts))
    base = text(400)
    for _ in range(12):  # near copies
        at = r.randrange(len(base))
        out.append(base[:at] + "#" + base[at + 1 :])
    out += [base, base, shared[2] + text(30) + shared[2]]
    return out


def test_kernel_small():
    r = random.Random(1)
    for _ in range(60):
        parts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 5))]
        length = r.randint(1, 12)
        count = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if count[p[i : i + length]] > 1] for p in parts]
        assert [x.tolist() for x in repeats.repeated_starts(parts, length)] == want


def test_anchors_follow_content():
    r = random.Random(2)
    data = np.array([r.randrange(256) for _ in range(3000)], np.uint8)
    first, last, at, h = repeats.anchors(data)
    assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all()
    assert (at >= last).all() and (at + repeats.K <= first + 400).all()
    shifted = repeats.anchors(np.r_[data[1000:], data[:10]])
    assert set(h[first >= 1000].tolist()) <= set(shifted[3].tolist()) | {h[-1]}


@pytest.mark.parametrize("hot, block, kernel", [(1500, 1 << 18, 1 << 19), (3, 500, 5000)])
def test_documents(spark, hot, block, kernel, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "KERNEL_BYTES", kernel)
    monkeypatch.setattr(repeats, "TASK_BYTES", 4 * kernel)
    texts = corpus(3)
    rows = [(i if i % 9 else None, t, "x", 1, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, first int, n_chars int").repartition(5)
    got = sorted(((-1 if x.doc_id is None else x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.removed(df).collect())
    want = plain(texts, 400)
    assert got == sorted((i if i % 9 else -1, n, c, s, hashlib.sha256(k).hexdigest()) for i, (n, c, s, k) in enumerate(want))
    cut = repeats.deduplicate(df)
    assert cut.columns == df.columns
    rows = cut.collect()
    stays = [None if t is None else k.decode("utf-8", "ignore") for t, (_, _, _, k) in zip(texts, want)]
    assert Counter(x.text for x in rows) == Counter(stays)
    assert Counter((x.doc_id, x.runs, x.first, x.n_chars) for x in rows) == Counter((i if i % 9 else None, "x", 1, None if t is None else len(t)) for i, t in enumerate(stays))


def passages_cut(texts, length, words, always):
    """Texts without their runs of covered bytes that have over so many words or so many bytes."""
    out = []
    for t, covered in zip(texts, covers(texts, length)):
        data, kept, i = (t or "").encode(), b"", 0
        while i < len(data):
            j = i
            while j < len(data) and covered[j] == covered[i]:
                j += 1
            run = data[i:j]
            if not covered[i] or len(run) < always and len(run.split()) <= words:
                kept += run
            i = j
        out.append(None if t is None else kept.decode("utf-8", "ignore"))
    return out


def covers(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cut = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                cut[i : i + length] = True
        out.append(cut)
    return out


def test_passages_by_words(spark):
    texts = corpus(4)
    r = random.Random(9)
    word = lambda n: "".join(r.choice("klmnopq") for _ in range(n))
    few, many = " ".join(word(9) for _ in range(26)), " ".join(word(4) for _ in range(53))
    texts += [word(30) + " " + few + " " + word(20), few, many + word(5), word(9) + " " + many + " " + few + " tail"]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], "doc_id long, text string, t1 string, T2 string, runs string").repartition(3)
    got = repeats.deduplicate(df, 200, 48, words=50)
    rows = got.collect()
    want = passages_cut(texts, 200, 50, 400)
    assert got.columns == df.columns and {(x.t1, x.T2, x.runs) for x in rows} == {("a", "b", "c")}
    assert [x.text for x in sorted(rows, key=lambda x: x.doc_id)] == want
    assert want[-3] == few and few in want[-4] and many not in want[-2]


def test_test_tables_by_brute_force(spark):
    """The query's rows on a whole table of the test data."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {x.doc_id: (n, c, s, hashlib.sha256(k).hexdigest()) for x, (n, c, s, k) in zip(rows, plain([x.text for x in rows], 400))}
    got = queries.op10_interval_repeats(spark, sf).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == want and len(got) == len(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.removed(df).count() == 0 and repeats.deduplicate(df).count() == 0
