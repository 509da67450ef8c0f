"""Corpus cleaning pipeline: language, repeated lines, near-duplicates,
benchmark passages, tokens. Every stage works on all that its predecessor kept,
written as Parquet and read again. Every stage takes nulls in any column,
repeated rows, further columns of any name and an empty table; all but the last
return the columns they were given."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from routewise.llm import byte_bpe, decontaminate, language_id, line_dedup, minhash
from routewise.session import ensure_checkpoint_dir

BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach. Null and letterless
    texts go, repeated rows are judged alike; without labels every text with a
    letter stays."""
    return language_id.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of smaller id holds. Null
    texts stay null; null ids rank last, as one document; rows that share an id
    never drop each other's lines."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity 0.8. It is
    the one with the smallest id (null ids last); of rows that repeat id and text
    one stays; texts without a word are alone."""
    return minhash.keep_first(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null texts hold none;
    repeated rows are judged alike; an empty benchmark rejects nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its very text; a
    null text counts as empty."""
    path, pattern = public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN
    done = byte_bpe.round_trip(docs.select("doc_id", "text"), path, pattern)
    return done.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("exact"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
          ("benchmark", benchmark), ("tokens", tokens)]

#: The first stage is a fitted classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; the tables between them are
    Parquet in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
