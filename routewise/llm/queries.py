"""Registered queries of this subpackage: each operator over its whole table
with production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (byte_bpe, decontaminate, fingerprints, hmm_lm, language_id, line_dedup, merkle, minhash,
               periodic_runs, pii, sharding, suffix_dedup, topk)
from .common import table

BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op3_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.report(table(spark, sf_dir, "documents"))


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(table(spark, sf_dir, "embeddings"))


def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"),
                            public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"),
                                table(spark, sf_dir, "benchmark"))


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


def op11_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_suffix_dedup, op3_hmm_lm, op4_pii_anchors, op5_line_dedup, op6_nra_topk,
    op7_sampled_splitters, op8_byte_bpe, op9_decontaminate, op10_circulant_minhash,
    op11_quartile_digest, op12_merkle_manifest, op13_periodic_runs)}
QUERIES["pipeline"] = corpus_pipeline.run

#: The others have no SQL: a fitted model, an array or index method, a tokenizer,
#: a sample of splitters or a digest of hashes; tests hold them against brute force.
ORACLE = {"op5_line_dedup": line_dedup.ORACLE, "op6_nra_topk": topk.ORACLE,
          "op9_decontaminate": decontaminate.ORACLE, "op10_circulant_minhash": minhash.ORACLE,
          "op12_merkle_manifest": merkle.ORACLE, "op13_periodic_runs": periodic_runs.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
