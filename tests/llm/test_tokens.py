"""Token operators against the libraries themselves and by exact round trips."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm import bpe_tree, packing, token_store
from helixframe.llm.tokens import Encoder

TEXTS = [None, "", " ", "  a  b", "It's a test.\n\n  Two  lines\t x", "Ünïcödé ß straße ΣΑΣ ΟΔΟΣ", "日本語 テキスト 1234", "á ë x", "🙂 emoji 👩‍👩‍👧", "\x1c x \x1f y \x85 z", "<|endoftext|> is text", "aaaa" * 700, "İstanbul ǅ ﬁ ª º ²", "x" * 5000 + " y", "tab\tend \n", "­ soft­ hyphen"]


def random_texts(n, seed=0):
    r = random.Random(seed)
    words = ["the", "Thing", "é", "ñ", "ßtr", "l'eau", "don't", "WE'RE", "***", "&&&", "12", "3.14", "\n", "\n\n", "", " ", "\t", "ó.", "日", "𝒳", "x" * 40]
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_library(name, kind):
    enc = Encoder(P.path(name), kind)
    tok = Tokenizer.from_file(P.path(name))
    tok.encode_special_tokens = True
    odd = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)} {chr(c)}" for c in [*range(1, 0x600), *range(0x1E00, 0x2100)]]
    for t in [*[x or "" for x in TEXTS], *random_texts(200), *odd]:
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t[:60])


def test_columns_of_texts_equal_library(monkeypatch):
    """Whatever lies beside the spaces, line feeds and signs at which columns are cut, with groups and caches that end within the texts."""
    from helixframe.llm import tokens

    enc = Encoder(P.path("byte_bpe_50k.json"), "byte")
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    spaces = ["\n", "\n\n", "\n ", " \n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "  "]
    signs = [",", ".\n", "'", "'s", "'s,", "&&&", ".é", "\u0301.", "\xad.", "1.", "ª,", "»,", "日,", "\x7f", "\x00."]
    odd = [f"{a}x{s} {a}{s}É{a}yy{s}{a}" for a in ["", *spaces] for s in ["", *signs]]
    r = random.Random(15)
    mixed = ["".join(r.choice(["ab", "é", "日", "1", "\n", " ", *spaces, *signs]) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    texts = [*TEXTS, *odd, *random_texts(100, 16), *mixed, *TEXTS]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for together, most in ((tokens.TOGETHER, tokens.MOST["byte"]), (1000, 20)):
        monkeypatch.setattr(tokens, "TOGETHER", together)
        monkeypatch.setitem(tokens.MOST, "byte", most)
        for of in (pa.array(texts, pa.string()), pa.array(["left out", *texts], pa.string())[1:]):
            got = [np.frombuffer(x, "<u2").tolist() for x in enc.encode_all(of)]
            assert [(t, g) for t, g in zip(texts, got, strict=True)] == list(zip(texts, want))
        assert len(enc.parts) <= max(most, 20) or together > 1000
    assert list(enc.encode_all(pa.array([], pa.string()))) == []
    assert [*enc.encode_all(pa.array([None]).cast(pa.string()))] == [b""]


def test_a_column_meets_each_word_once(monkeypatch):
    """A word is looked up once in all texts that hold it, whether signs follow it or not."""
    enc, seen = Encoder(P.path("byte_bpe_50k.json"), "byte"), []
    tokenize = enc.tokenize
    monkeypatch.setattr(enc, "tokenize", lambda x: seen.append(x) or tokenize(x))
    list(enc.encode_all(pa.array(["a strangeword, strangeword. strangeword&&&\nB strangeword"] * 50)))
    assert sum("strangeword" in x for x in seen) == 1


def reference_codec():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_equals_library():
    own, ref = bpe_tree.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), reference_codec()
    r = random.Random(1)
    long = ["".join(r.choice("ab") for _ in range(3000)), "a" * 4097, "=" * 1001, "".join(r.choice("etaoinshr") for _ in range(5000)), " " * 3000 + "x", "\n" * 2000]
    odd = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)} {chr(c)}" for c in [*range(1, 0xD800), *range(0xE000, 0x1F000, 7)]]
    for t in [*[x or "" for x in TEXTS], *random_texts(200, 2), *long, *odd]:
        ids, decimal = own.encode(t)
        assert ids == ref.encode_ordinary(t), repr(t[:40])
        assert decimal == " ".join(map(str, ids)) and own.decode(ids) == t.encode()


def plain_merges(ranks, data):
    """The neighbours of lowest rank are merged first, the leftmost of equals, until none can be."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        costs = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
        if not costs:
            return tuple(ranks[p] for p in parts)
        _, i = min(costs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_halves_join_to_the_whole():
    own, r = bpe_tree.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(3)
    for n in (0, 1, 2, 3, 30, 300):
        for letters in (b"aab ethn", b"a", bytes(range(256))):
            data = bytes(r.choice(letters) for _ in range(n))
            assert own.merged(data) == own.nodes[data] == plain_merges(own.ranks, data)


def test_documents_go_through_joins(spark, monkeypatch):
    """On the test documents, words are reduced by joins, and some of these need windows beyond the two ids at the border."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    own, ref = bpe_tree.Codec.from_file(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), reference_codec()
    joins, merged, wide = own.join, own.merged, own.pair
    seen = {"join": 0, "window": 0, "pair": 0}

    def count(name, f):
        def run(*args):
            seen[name] += 1
            return f(*args)

        return run

    own.join, own.merged, own.pair = count("join", joins), count("window", merged), count("pair", wide)
    texts = [x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in texts:
        ids, _ = own.encode(t)
        assert ids == ref.encode_ordinary(t) and own.decode(ids) == t.encode()
    words = len(own.words) + len(own.spaced)
    assert seen["join"] > words / 2 and seen["window"] > len(own.pairs) and seen["pair"] > seen["join"]


def test_fill_is_best():
    r = random.Random(4)
    for _ in range(200):
        counts = {r.randint(1, 40): r.randint(1, 4) for _ in range(r.randint(0, 6))}
        room = r.randint(0, 90)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        got = packing.fill(counts, room)
        assert sum(n * k for n, k in got.items()) == max(sums) and all(counts[n] >= k for n, k in got.items())


def documents(spark, texts, clash=True):
    rows = [(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, n_tokens int" if clash else "doc_id long, text string, lang string, k int")


def check_pieces(rows, texts, capacity=4096):
    by, seqs = {}, {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return seqs


def test_packing(spark):
    texts = [*TEXTS, *random_texts(300, 5), "word " * 9000]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    seqs = check_pieces(rows, texts)
    padding = sum(4096 - n for s in seqs.values() if (n := sum(r.length for r in s)) & (n - 1))
    assert padding == 0
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packing_of_null_and_repeated_ids(spark):
    texts = [(None, "a b"), (None, None), (5, "same words here"), (5, "same words here"), (5, "other"), (6, "long " * 5000)]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for i, t in texts:
        want[i] = want.get(i, 0) + len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    rows = packing.pack(spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id long, text string, offset long, START string").coalesce(1), P.path("word_bpe_49k.json")).collect()
    got, seqs = {}, {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n


def test_crc_join():
    r = random.Random(6)
    for _ in range(50):
        a, b = r.randbytes(r.randint(0, 300)), r.randbytes(r.randint(0, 300))
        assert token_store.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_store(spark):
    shared = " ".join(random_texts(80, 7))
    texts = [*TEXTS, *random_texts(60, 8), shared, "New start. " + shared, shared + " New end.", shared]
    docs = documents(spark, texts).repartition(5)
    store = token_store_path(spark)
    token_store.write_store(docs, store, P.path("byte_bpe_50k.json"))
    got = token_store.read_digests(spark, store).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = {}
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(i if i % 7 else None, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert len(got) == len(texts)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    full = token_store.read_documents(spark, store).collect()
    assert {(r.doc_id, r.start, zlib.crc32(r.ids)) for r in full} == {(r.doc_id, r.start, r.ids_crc32) for r in got}
    chunks = spark.read.parquet(f"{store}/objects").where("kind = 1")
    assert chunks.count() == chunks.select("key").distinct().count()


def token_store_path(spark):
    from helixframe.llm.common import scratch

    return scratch(spark, "store")


def test_store_detects_damage(spark):
    store = token_store_path(spark)
    docs = documents(spark, random_texts(20, 9))
    token_store.write_store(docs, store, P.path("byte_bpe_50k.json"))
    broken = token_store_path(spark)
    objects = spark.read.parquet(f"{store}/objects")
    objects.withColumn("payload", F.when(F.col("kind") == 1, F.concat("payload", F.lit(b"\x00\x00")))).write.parquet(f"{broken}/objects")
    for t in ("recipes", "manifest"):
        spark.read.parquet(f"{store}/{t}").write.parquet(f"{broken}/{t}")
    with pytest.raises(Exception, match="does not match its digest"):
        token_store.read_digests(spark, broken).collect()


@pytest.mark.parametrize("lost, says", [("kind = 0", "do not match its manifest"), ("kind = 1", "is missing")])
def test_store_detects_losses(spark, lost, says):
    """A recipe, or a single chunk, that is gone."""
    store, broken = token_store_path(spark), token_store_path(spark)
    token_store.write_store(documents(spark, random_texts(20, 9)), store, P.path("byte_bpe_50k.json"))
    objects, recipes = spark.read.parquet(f"{store}/objects"), spark.read.parquet(f"{store}/recipes")
    one = objects.where(lost).agg(F.min("key")).first()[0]
    objects.where(F.col("key") != F.lit(one)).write.parquet(f"{broken}/objects")
    recipes.where(F.col("key") != F.lit(one)).write.parquet(f"{broken}/recipes")
    spark.read.parquet(f"{store}/manifest").write.parquet(f"{broken}/manifest")
    for read in (token_store.read_digests, token_store.read_documents):
        with pytest.raises(Exception, match=says):
            read(spark, broken).collect()


def test_very_long_texts(spark):
    """A text of a million characters goes through the store and the tree whole."""
    r = random.Random(12)
    text = " ".join("".join(r.choice("etaoin日é") for _ in range(r.randint(1, 9))) for _ in range(170_000)) + "a" * 100_000
    docs = spark.createDataFrame([(1, text, "x"), (2, text[:50], "y")], "doc_id long, text string, ids string")
    store = token_store_path(spark)
    token_store.write_store(docs, store, P.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = np.array(tok.encode(text, add_special_tokens=False).ids + [2], "<u4")
    assert {x.doc_id: (x.n_tokens, x.ids_crc32) for x in token_store.read_digests(spark, store).collect()}[1] == (len(ids), zlib.crc32(ids.tobytes()))
    got = {x.doc_id: x for x in bpe_tree.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert got[1].ids == reference_codec().encode_ordinary(text) and bytes(got[1].decoded) == text.encode()


def test_empty_store(spark):
    store = token_store_path(spark)
    token_store.write_store(documents(spark, ["x"]).limit(0), store, P.path("byte_bpe_50k.json"))
    assert token_store.read_digests(spark, store).count() == 0


def test_bpe_query(spark):
    texts = [*TEXTS, *random_texts(30, 10)]
    ref = reference_codec()
    rows = bpe_tree.encode(documents(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True).collect()
    want = sorted((len(i := ref.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for t in texts)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_encoding_does_not_search_its_caches_for_garbage(monkeypatch):
    import gc
    from types import SimpleNamespace

    import pyarrow as pa

    from helixframe.llm import token_store

    monkeypatch.setattr(token_store, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    seen = []

    def batches(n):
        for k in range(n):
            seen.append(gc.isenabled())
            yield pa.RecordBatch.from_pydict({"doc_id": [k], "text": ["a text"] if k else [None]}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    path = P.path("byte_bpe_50k.json")
    assert sum(len(b) for b in token_store._objects(path, 2, "byte")(batches(3))) == 5 and gc.isenabled()
    assert seen == [False] * 3
    gc.disable()
    try:
        list(token_store._objects(path, 2, "byte")(batches(1)))
        assert not gc.isenabled()  # left as it was found
    finally:
        gc.enable()
