"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tagloom.llm import bpe, decontamination, licenses, quality, repeats, secrets, sharding, simhash, toxicity
from tagloom.llm.common import load


def op1_quality_rules(spark, sf_dir):
    scored = quality.quality(load(spark, sf_dir, "documents"))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    kept = ~failed & (F.col("p_good") >= 0.5)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), F.round("p_good", 6).alias("p_good"))


def op2_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def op3_sharding(spark, sf_dir):
    return sharding.shard(load(spark, sf_dir, "documents"))


def op4_secret_scans(spark, sf_dir):
    return secrets.find_secrets(load(spark, sf_dir, "documents"), emit=(secrets.DIGEST_DDL, secrets.digest))


def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_substring_dedup(spark, sf_dir):
    def digest(line, begins, n, spans):
        return n, sum(b - a for a, b in spans), hashlib.sha256(repeats.kept(line, begins, n, spans)).hexdigest()

    return repeats.without_repeats(load(spark, sf_dir, "documents"), repeats.WORDS, "n_words long, n_removed long, kept_sha256 string", digest)


def op7_decontamination(spark, sf_dir):
    return decontamination.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_license_scans(spark, sf_dir):
    return licenses.find_licenses(load(spark, sf_dir, "documents"), emit=(licenses.DIGEST_DDL, licenses.digest))


def op9_bpe(spark, sf_dir):
    def digest(ids, decoded):
        return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()

    return bpe.encode_texts(load(spark, sf_dir, "documents"), emit=("n_tokens long, ids_sha256 string, decoded_sha256 string", digest))


def op10_suffix_array(spark, sf_dir):
    def digest(line, begins, n, spans):
        return n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(repeats.kept(line, begins, n, spans)).hexdigest()

    return repeats.without_repeats(load(spark, sf_dir, "documents"), repeats.BYTES, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", digest)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_sharding, op4_secret_scans, op5_simhash, op6_substring_dedup, op7_decontamination, op8_license_scans, op9_bpe, op10_suffix_array)}
ORACLES: dict[str, str] = {}
