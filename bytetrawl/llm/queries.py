"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, crf, decontam, html_tree, minhash, packing, quality, suffix, toxicity, warc
from .common import table


def word_tokenizer() -> str:
    """Where the public word tokenizer lies; every machine has it in its own installation."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents."""
    return crf.pii_spans(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of documents."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through archives."""
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences."""
    return packing.packed_pieces(table(spark, sf_dir, "documents"), word_tokenizer())


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of pages."""
    return html_tree.extracted(table(spark, sf_dir, "pages"))


def op7_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours of embeddings."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated byte strings."""
    return suffix.without_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_crf": op1_pii_crf,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_rotated_codes": op7_rotated_codes,
    "op8_quality": op8_quality,
    "op9_html": op9_html,
    "op10_minhash": op10_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc.ORACLE,
    "op6_decontamination": decontam.ORACLE,
    "op10_minhash": minhash.ORACLE,
}
