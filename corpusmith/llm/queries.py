"""The registered queries of this subpackage: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocation, editcount, langid, mixing, mixlm, permutation, pii, rangecoder, secrets, sequenced, simhash, tiff
from .common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editcount.count_with_edits(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.texts_as_tiff(table(spark, sf_dir, "documents"))


def op5_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rangecoder.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return rangecoder.read_tokens(files, digest=True)


def op6_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.score_documents(table(spark, sf_dir, "documents"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, digest=True)


def op9_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in secrets.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_confirmed")


def op12_sequenced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequenced.apply_in_sequence(sequenced.numbered(table(spark, sf_dir, "client_changes")))
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long")
    return out.select("change_id", "client_id", "status", "batch", "missed", "city", cents.alias("cents"), "current")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_permutation_index, op2_edit_aware_counts, op3_crf_language, op4_tiff_media, op5_range_coded_ids, op6_simhash_ball, op7_context_mixing_lm, op8_bpe_transducer, op9_low_discrepancy_mix, op10_disclosing_terms, op11_structural_secrets, op12_sequenced_changes, op13_collocations, pipeline)
}

ORACLES: dict[str, str] = {"op9_low_discrepancy_mix": mixing.mix_sql(), "op13_collocations": collocation.collocations_sql()}
