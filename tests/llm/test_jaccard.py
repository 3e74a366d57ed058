"""Links by exact Jaccard coefficients of shingle sets against all pairs."""

import random

import numpy as np
import pytest

from helixframe.llm import jaccard, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_of(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    fps = [simhash.fingerprint(t or "") for t in texts]

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    wide = 0
    for i in range(len(texts)):
        for j in range(i):
            alike = sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            close = (fps[i] ^ fps[j]).bit_count() <= 2
            wide += bool(alike) and not close
            if alike or close:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], wide


@pytest.mark.parametrize("hot, listed", [(3, 0), (5, 1 << 20)])
def test_near_copies_go(spark, hot, listed, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "LISTED", listed)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4 * hot)
    r = random.Random(3)
    word = lambda: f"w{r.randrange(3000)}"
    line = " ".join(word() for _ in range(12))
    texts = [None, "", "one", "one two three", "ONE two Three"]
    for _ in range(25):
        base = [word() for _ in range(r.choice([20, 60, 150]))]
        texts.append(" ".join(base) + " " + line)
        for _ in range(4):
            near = list(base)
            for _ in range(r.randint(0, 6)):
                near[r.randrange(len(near))] = word()
            texts.append(" ".join(near) + r.choice(["", " " + line]))
    label, wide = components_of(texts)
    assert wide > 20
    df = spark.createDataFrame([(i, t, i, f"d{i}", -i) for i, t in enumerate(texts)], "doc_id long, text string, row long, Doc string, none long").repartition(3)
    rows = simhash.deduplicate(df, words=5).collect()
    assert sorted(x.doc_id for x in rows) == sorted(set(label))
    assert all((x.row, x.Doc, x.none) == (x.doc_id, f"d{x.doc_id}", -x.doc_id) for x in rows)
    assert simhash.deduplicate(df.limit(0), words=5).count() == 0


def test_sketches_never_exceed_the_difference():
    r = random.Random(5)
    for _ in range(300):
        pool = [r.getrandbits(64) for _ in range(r.choice([3, 60, 700, 3000]))]
        x, y = (np.unique(np.array(r.sample(pool, r.randint(1, len(pool))), np.uint64)) for _ in "ab")
        differ = len(np.setxor1d(x, y))
        got = jaccard.sketches_differ(jaccard.sketch(x), jaccard.sketch(y))
        assert got <= differ and got % 2 == differ % 2
    assert jaccard.sketches_differ(jaccard.sketch(x), jaccard.sketch(x)) == 0


def test_shingles_of_short_texts_differ():
    texts = ["", " ", "a", "a b", "b a", "a b c", "a b c d", "a b c d e", "a b c d e f"]
    sizes = [len(jaccard.shingle_set(t, 5)) for t in texts]
    assert sizes == [0, 0, 1, 1, 1, 1, 1, 1, 2]
    assert len({int(jaccard.shingle_set(t, 5)[0]) for t in texts[2:8]}) == 6


def test_close_pairs_equal_single_comparisons():
    r = random.Random(6)
    sets = []
    for _ in range(12):
        base = [r.getrandbits(64) for _ in range(r.choice([4, 90, 140, 300, 520]))]
        for _ in range(r.randint(1, 9)):
            sets.append(np.unique(np.array([x if r.random() > 0.06 else r.getrandbits(64) for x in base], np.uint64)))
    n, roots, marks = np.array([len(x) for x in sets]), np.array([r.randrange(30) for _ in sets]), [jaccard.sketch(x) for x in sets]
    for sides in ([0] * len(sets), [r.randrange(2) for _ in sets]):
        i, j = jaccard.close_pairs(n, roots, marks, np.array(sides) != 0, (4, 5))
        got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
        assert len(got) == len(i)
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                asked = roots[a] != roots[b] and (not any(sides) or sides[a] != sides[b])
                both = len(np.intersect1d(sets[a], sets[b]))
                if asked and 9 * both >= 4 * (n[a] + n[b]):
                    assert (a, b) in got
                elif (a, b) in got:
                    assert asked and jaccard.sketches_differ(marks[a], marks[b]) <= jaccard._allowed(n[a], n[b], (4, 5))
