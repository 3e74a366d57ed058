"""The pipeline, stage by stage, against brute force on a small table."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from helixframe.llm import toxicity

from .test_jaccard import components_of
from .test_repeats import passages_cut
from .test_toxicity import corpus


def test_stages(spark, tmp_path):
    rows = corpus(4, 260)
    shared = "x".join(t for _, t, _ in rows[1:3])
    docs = [(i, t, "en", "s", len(t)) for i, t, _ in rows]
    docs += [(1000 + i, docs[4 * i + 1][1], "en", "s", 0) for i in range(8)]
    docs += [(1100 + i, rows[4 * i + 2][1] + " " + shared, "en", "s", 1) for i in range(5)] + [(2000, None, None, None, None), (None, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(now, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    inputs = [now]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, inputs[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        inputs.append(spark.read.parquet(f"{tmp_path}/{k}"))
    tables = [[tuple(r) for r in x.collect()] for x in inputs]
    assert Counter(tables[1]) == Counter(r for r in tables[0] if model.score(r[1]) < toxicity.THRESHOLD)
    assert len(tables[1]) < len(tables[0])
    before = tables[1]
    label, _ = components_of([r[1] for r in before])
    groups = {}
    for r, c in zip(before, label):
        groups.setdefault(c, []).append(r)
    order = lambda r: (r[0] is None, r[0] or 0)
    assert Counter(order(r) for r in tables[2]) == Counter(order(min(g, key=order)) for g in groups.values())
    want = passages_cut([r[1] for r in tables[2]], 200, 50, 400)
    assert Counter((r[0], r[1]) for r in tables[3]) == Counter((r[0], t) for r, t in zip(tables[2], want))
    assert any(r[1] != t for r, t in zip(tables[2], want))
    assert all(inputs[k].columns == inputs[0].columns for k in range(4))
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    ids = {r[0]: np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4") for r in tables[3]}
    for doc_id, start, length, crc, total, _, _ in tables[4]:
        assert total == len(ids[doc_id]) and crc == zlib.crc32(ids[doc_id][start : start + length].tobytes())
    assert sum(r[2] for r in tables[4]) == sum(map(len, ids.values()))
    got = corpus_pipeline.run(spark, str(tmp_path))
    totals = got.groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert Counter((r[0], r[1], r[2]) for r in totals) == Counter((k, len(v), len(v)) for k, v in ids.items())
