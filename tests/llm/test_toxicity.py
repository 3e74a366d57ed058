"""Toxicity on invented texts with planted words: held-out accuracy, and defined cases."""

import random
import zlib

from helixframe.llm import toxicity


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))
    words = [word() for _ in range(400)]
    rows = []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(20, 150))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                t.insert(r.randrange(len(t)), r.choice(["Zounds!", "vexatious", "knavery"]))
        rows.append((i, " ".join(t), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1, 700)
    docs = spark.createDataFrame([(i, t, "en", t) for i, t, _ in rows], "doc_id long, text string, lang string, score string").repartition(3)
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 700
    want = {i: x for i, _, x in rows}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 100 and sum(got[i].predicted == want[i] for i in held) / len(held) > 0.97
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got.values())
    assert kept.where("score <> text").count() == 0


def test_features_are_strings_of_characters():
    got = {n: len(h) for n, h in toxicity.grams("ÀB日本語")}
    assert got == {3: 3, 4: 2, 5: 1} and not list(toxicity.grams("ab"))
    same = [dict(toxicity.grams(t))[3].tolist() for t in ("日本語", "x日本語")]
    assert same[0][0] == same[1][1] and dict(toxicity.grams("ABC"))[3] == dict(toxicity.grams("abc"))[3]


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = corpus(2, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    known = [(i, x) for i, _, x in rows]
    turned = [(i, 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, x in known]
    a, b = (toxicity.fit(docs, spark.createDataFrame(k, "doc_id long, toxic int")) for k in (known, turned))
    assert a.bias == b.bias and (a.features == b.features).all() and (a.weights == b.weights).all()


def test_defined_cases(spark):
    rows = corpus(3, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "é" * 400_000 + " vexatious knavery")], "doc_id long, text string")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 4 and all(r.held_out is not None for r in got)
    assert max(r.score for r in got if r.doc_id == 2) > 0.9 and len({r.score for r in got if r.doc_id != 2}) == 1
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)) is toxicity.EMPTY and toxicity.fit(docs, labels.where("toxic = 1")) is toxicity.EMPTY
    assert {r.score for r in toxicity.score(docs, toxicity.EMPTY).collect()} == {0.0}
