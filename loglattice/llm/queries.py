"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, substrings
from .common import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(read_table(spark, sf_dir, "documents"), digest=True)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .dac import encoded_documents

    return encoded_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .iblt import fingerprints

    return fingerprints(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trips

    return round_trips(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_repeats import without_repeats

    return without_repeats(read_table(spark, sf_dir, "documents"), digest=True)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secrets

    return secrets(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_ids": op3_token_ids,
    "op4_simhash": op4_simhash,
    "op5_fingerprints": op5_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_secrets": op10_secrets,
}

ORACLES: dict[str, str] = {"op2_substring_dedup": substrings.ORACLE_SQL, "op7_decontamination": decontaminate.ORACLE_SQL}
