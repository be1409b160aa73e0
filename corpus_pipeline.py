"""Cleaning of a document table in stages, each by one operator of ``tagloom.llm``.

Every stage takes (spark, docs, sf_dir) and gives what its predecessor's rows become; results are written as Parquet
to the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import bpe, decontamination, secrets, simhash, toxicity
from tagloom.llm.common import load, materialize

#: Near-duplicates of the pipeline: shingles of five words, a similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, 0.8


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones among them, doesn't call toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; null and empty texts are alike, and one of them stays."""
    return simhash.keep_one(docs, SHINGLE, SIMILARITY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.mask_secrets(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digest of the ids, and whether decoding gives the text back."""

    def digest(ids: list[int], decoded: str) -> tuple:
        return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return bpe.encode_texts(docs, emit=("n_tokens long, ids_sha256 string, decoded_sha256 string", digest))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the model nor fingerprints nor BPE; tests hold run() against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
