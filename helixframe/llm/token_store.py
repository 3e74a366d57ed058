"""Operator 1: token ids in a content-addressed store.

Rolling hashes over the ids cut each document into chunks; a chunk is stored once, under the digest of its bytes. A recipe
lists the chunk digests of a document and their Merkle root; the manifest has the number of ids before each shard of
recipes and the Merkle root of the shard. Recipes lie in ascending doc_id order (null first; equal ids by length and root).

Layout of a store: objects/ (chunks, and recipes as the encoding tasks met them), recipes/ (sorted shards), manifest/.

Defined cases: a null or empty text has the end id alone; a null doc_id is kept; repeated rows stay separate documents;
an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import narrow
from .tokens import encoder

#: Ids of the rolling window, mean and bounds of chunk lengths in ids.
WINDOW, MEAN, LEAST, MOST = 16, 1024, 128, 8192
OBJECT = "kind int, key binary, payload binary, doc_id bigint, n_tokens bigint, root binary, chunks array<binary>"
#: Digests that a task remembers in order not to send a chunk twice.
REMEMBERED = 100_000


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node moves up unchanged. No leaves: the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        up = [digest(b"\x01" + leaves[i] + leaves[i + 1]) for i in range(0, len(leaves) - 1, 2)]
        leaves = up + leaves[len(up) * 2 :]
    return leaves[0]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of chunks: where the rolling hash of the last WINDOW ids has its low bits clear, within LEAST and MOST."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    base, span = np.uint32(0x85EBCA6B), 1
    with np.errstate(over="ignore"):
        while span < WINDOW:  # the hash of 2s ids from those of s ids
            h[span:] = h[span:] + h[:-span] * base
            base = base * base
            span *= 2
    h ^= h >> np.uint32(16)
    found = np.flatnonzero((h & np.uint32(MEAN - 1)) == 0) + 1
    out, last = [], 0
    for at in found.tolist():
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST and at < n:
            out.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        out.append(last)
    return [*out, n]


def _objects(path: str, end_id: int, kind: str):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, part, row = encoder(path, kind), set(), TaskContext.get().partitionId(), 0
        dtype, end = f"<u{enc.width}", end_id.to_bytes(enc.width, "little")
        names = ["kind", "key", "payload", "doc_id", "n_tokens", "root", "chunks"]
        types = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
        out, held = [], 0
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                data += end
                ids, digests, at = np.frombuffer(data, dtype), [], 0
                for to in cuts(ids):
                    chunk = data[at * enc.width : to * enc.width]
                    digests.append(d := digest(chunk))
                    at = to
                    if d not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(d)
                        out.append((1, d, chunk, None, None, None, None))
                        held += len(chunk)
                key = digest(b"%d/%d" % (part, row))
                out.append((0, key, None, doc_id, len(ids), merkle(digests), digests))
                row += 1
                if held > 4 << 20 or len(out) > 20_000:
                    yield pack(out)
                    out, held = [], 0
        if out:
            yield pack(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nothing here refers to itself, but each search for such garbage would go through all that the caches hold."""
        on = gc.isenabled()
        gc.disable()
        try:
            yield from made(batches)
        finally:
            if on:
                gc.enable()

    return run


def write_store(docs: DataFrame, store: str, tokenizer: str, end_id: int = 2, kind: str = "byte") -> None:
    """Encode every whole text and write the store. One shuffle carries each distinct chunk of a task once; recipes move light."""
    spark = docs.sparkSession
    rows = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_objects(tokenizer, end_id, kind), OBJECT)
    # A task has dropped its own repeats: dealt by key first, the rows are sorted once, behind the shuffle.
    rows.repartition("kind", "key").dropDuplicates(["kind", "key"]).write.option("compression", "zstd").parquet(f"{store}/objects")
    recipes = spark.read.schema(OBJECT).parquet(f"{store}/objects").where("kind = 0").select("key", "doc_id", "n_tokens", "root", "chunks")
    order = ["doc_id", "n_tokens", "root", "key"]
    shards = recipes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    shards.write.option("compression", "zstd").parquet(f"{store}/recipes")
    _write_manifest(spark, store)


def _recipes(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("key binary, doc_id bigint, n_tokens bigint, root binary, chunks array<binary>, shard int").parquet(f"{store}/recipes")


_LINE = "shard int, docs bigint, ids bigint, start bigint, mark bigint, root binary"


def _lines(spark: SparkSession, store: str) -> list[tuple[int, int, int, int, int]]:
    """(shard, documents, ids, ids before it, mark of all its recipes) from the recipes as they are; there are as many shards as shuffle partitions."""
    mark = F.expr("bit_xor(xxhash64(key, doc_id, root, n_tokens))")
    by = _recipes(spark, store).groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("ids"), mark.alias("mark")).collect()
    lines, start = [], 0
    for r in sorted(by, key=lambda r: r.shard):
        lines.append((r.shard, r.docs, r.ids, start, r.mark))
        start += r.ids
    return lines


def _top(lines: list[tuple]) -> bytes:
    return merkle([digest(repr(x).encode()) for x in lines])


def _write_manifest(spark: SparkSession, store: str) -> None:
    lines = _lines(spark, store)
    top = bytearray(_top(lines))
    spark.createDataFrame([(*x, top) for x in lines], _LINE).coalesce(1).write.parquet(f"{store}/manifest")


def _manifest(spark: SparkSession, store: str) -> DataFrame:
    """The manifest, after its root has been compared with its lines, and its lines with the recipes."""
    got = spark.read.schema(_LINE).parquet(f"{store}/manifest")
    rows = sorted(got.collect(), key=lambda r: r.shard)
    lines = [tuple(x)[:5] for x in rows]
    if any(bytes(x.root) != _top(lines) for x in rows):
        raise ValueError(f"the manifest of {store} does not match its root")
    if lines != _lines(spark, store):
        raise ValueError(f"the recipes of {store} do not match its manifest")
    return got


def _checked(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if any(digest(x) != k for k, x in zip(keys, data, strict=True)):
                raise ValueError("a chunk does not match its digest")
            wide = [np.frombuffer(x, f"<u{width}").astype("<u4") for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in wide], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in wide], pa.int64())], names=["key", "n", "crc"])

    return run


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC polynomial, bits reflected."""
    out, m = 0, 1 << 31
    while a:
        if a & m:
            out ^= b
            a ^= m
        m >>= 1
        b = b >> 1 ^ _POLY if b & 1 else b >> 1
    return out


_POWERS: dict[int, int] = {}


def _zeros(n: int) -> int:
    """x to the 8n-th power: what n more bytes do to a CRC."""
    if n not in _POWERS:
        if len(_POWERS) > 20_000:
            _POWERS.clear()
        out, square, k = 1 << 31, 1 << 23, n
        while k:
            if k & 1:
                out = _times(square, out)
            square, k = _times(square, square), k >> 1
        _POWERS[n] = out
    return _POWERS[n]


def crc_join(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two strings set end to end, from theirs and the second one's length."""
    return _times(_zeros(n_bytes), first) ^ second


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.to_pydict()
        crcs = []
        for root, n, want, parts in zip(x["root"], x["n_tokens"], x["size"], x["parts"], strict=True):
            crc = total = 0
            if any(p["n"] is None for p in parts):
                raise ValueError("a chunk is missing")
            for p in parts:
                crc = crc_join(crc, p["crc"], 4 * p["n"]) if total else p["crc"]
                total += p["n"]
            if total != n or len(parts) != want or merkle([p["key"] for p in parts]) != root:
                raise ValueError("a recipe does not match its chunks")
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("start")), batch.column(batch.schema.get_field_index("n_tokens")), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _starts(spark: SparkSession, store: str) -> DataFrame:
    before = Window.partitionBy("shard").orderBy("doc_id", "n_tokens", "root", "key").rowsBetween(Window.unboundedPreceding, -1)
    base = _manifest(spark, store).select("shard", F.col("start").alias("base"))
    r = _recipes(spark, store).join(F.broadcast(base), "shard")  # a row for each shard
    return r.withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_digests(spark: SparkSession, store: str, width: int = 2) -> DataFrame:
    """Verify a store and give doc_id, start, n_tokens and ids_crc32 of every document.

    Every chunk file is read, compared with its digest, and its CRC taken over the ids it holds; recipes are
    followed by digest, Merkle roots compared, and CRCs of neighbouring chunks joined, so no id moves between machines.
    """
    chunks = spark.read.schema(OBJECT).parquet(f"{store}/objects").where("kind = 1").select("key", "payload").mapInArrow(_checked(width), "key binary, n bigint, crc bigint")
    starts = _starts(spark, store)
    listed = starts.select("shard", F.col("key").alias("doc"), "doc_id", "start", "n_tokens", "root", F.size("chunks").alias("size"), F.posexplode("chunks").alias("pos", "key"))
    parts = listed.join(chunks, "key", "left").groupBy("doc").agg(*[F.first(c).alias(c) for c in ("doc_id", "start", "n_tokens", "root", "size")], F.sort_array(F.collect_list(F.struct("pos", "key", "n", "crc"))).alias("parts"))
    return parts.mapInArrow(_assembled, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _joined(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            ids = []
            for parts in x["parts"]:
                if any(p["payload"] is None for p in parts):
                    raise ValueError("a chunk is missing")
                if any(digest(p["payload"]) != p["key"] for p in parts):
                    raise ValueError("a chunk does not match its digest")
                ids.append(np.frombuffer(b"".join([p["payload"] for p in parts]), f"<u{width}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x["doc_id"], pa.int64()), pa.array(x["start"], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    return run


def read_documents(spark: SparkSession, store: str, width: int = 2) -> DataFrame:
    """The documents themselves: doc_id, start and ids as little-endian unsigned 32-bit integers, rebuilt from recipes."""
    chunks = spark.read.schema(OBJECT).parquet(f"{store}/objects").where("kind = 1").select("key", "payload")
    listed = _starts(spark, store).select(F.col("key").alias("doc"), "doc_id", "start", F.posexplode("chunks").alias("pos", "key"))
    parts = listed.join(chunks, "key", "left").groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("pos", "key", "payload"))).alias("parts"))
    return parts.mapInArrow(_joined(width), "doc_id bigint, start bigint, ids binary")
