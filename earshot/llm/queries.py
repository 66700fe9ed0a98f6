"""Queries of this package: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, langid, mixing, neardup, pii, resample, secret_scan, sharding, tokens, toxicity, veccodes, warc
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op2_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op3_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op6_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op10_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(table(spark, sf_dir, "documents"))


def op11_position_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.digest(table(spark, sf_dir, "embeddings"))


def op13_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_vector_sharding, op3_one_bit_codes, op4_decontamination, op5_warc_revisits, op6_water_filling,
        op7_disclosure, op8_token_sequences, op9_language_filters, op10_odd_sketches, op11_position_ngrams,
        op12_hamerly_codes, op13_convolutional_toxicity,
    )
}
