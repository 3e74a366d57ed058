"""The queries of the corpus operators, by name, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, chroma, html_text, licences, packing, repeats, simhash, token_store, topk, toxicity
from .common import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), store, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_digests(spark, store)


def op4_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op2_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), inside=True)


def op3_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_interval_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"))


def op7_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_chroma_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound: each embedding is played as a melody of its components.

    Queries are the rows whose vec_id is divisible by 100, recorded once more from the seventh tone on, softer and with noise. All rows answer.
    """
    rows = table(spark, sf_dir, "embeddings")
    prints = chroma.fingerprints(rows, "vec_id", "embedding", as_melody=True)
    again = chroma.fingerprints(rows.where(F.col("`vec_id`") % chroma.EVERY == 0), "vec_id", "embedding", as_melody=True, cut=6 * 128 + 40, noise=0.05)
    return chroma.search(prints, queries=again)


def op9_ngram_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_content_store, op2_minimum_cut, op3_bit_sliced_simhash, op4_min_bin_slack, op5_licence_dice, op6_bpe_tree, op7_norm_buckets, op8_chroma_prints, op9_ngram_bayes, op10_interval_repeats)}
ORACLE_SQL: dict[str, str] = {"op5_licence_dice": licences.ORACLE, "op7_norm_buckets": topk.ORACLE}
