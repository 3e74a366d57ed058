"""A corpus pipeline of four stages: toxic documents go, one of each group of near duplicates stays, repeated passages are cut, and the rest is packed.

Defined cases, in every stage: null and empty texts are no error (never toxic for that alone, near copies of each other, without
repeats, and packed as a lone end id); null ids stay; rows that are alike in every column are one row after the second stage; ties
go to the smallest doc_id, then the smallest hash of the row; an empty table gives an empty table; columns beyond doc_id and text
stay as they are, whatever their names, but for n_chars, which follows the text. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import packing, repeats, simhash, toxicity
from helixframe.llm.common import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't predict to be toxic."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints and of texts that share 0.8 of their five-word shingles."""
    return simhash.deduplicate(docs, words=5)


#: Bytes of the shortest repeated string that is looked for: 99 % of the repeated passages of over 50 words have as many.
LEAST_BYTES, ANCHOR_BYTES, LEAST_WORDS = 200, 48, 50


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated passages.

    A passage is a maximal run of bytes that strings of 200 bytes cover which also start elsewhere. It is cut if it has over 50 words
    or 400 bytes (the length of op10), in every copy, the first too: a document that consists of such passages stays as an empty text.
    """
    return repeats.deduplicate(docs, LEAST_BYTES, ANCHOR_BYTES, words=LEAST_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("suffix_array_dedup", cut_repeats), ("packing", pack)]

#: No stage has an SQL form: the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := scratch(spark, name))
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
