"""The operators as stages over documents: each takes (spark, docs, sf_dir) and all but the last return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf, decontam, minhash, packing, quality
from .common import fresh, small_side, table
from .queries import word_tokenizer

#: Documents are near-duplicates from this similarity on, in percent of their runs of five words.
SIMILAR = 80


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, with their own columns.

    Null and empty texts are scored as such, whole texts of any length are read, repeated rows and ties get the same decision, rows
    without a doc_id are scored too, and an empty table stays empty.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with its own columns.

    Null texts, texts without words and rows without a doc_id stay. Ties are decided by doc_id, text and other columns, so that the
    result doesn't depend on the order of rows; rows with one doc_id and different texts are different documents. Texts of any length
    are compared whole; an empty table stays empty.
    """
    return minhash.one_of_each(docs, SIMILAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, with their own columns.

    Null and empty texts have no words and stay; rows without a doc_id are judged by their text; repeated rows share a decision; long
    texts are searched whole; without documents or benchmark items nothing is dropped.
    """
    found = decontam.phrase_matches(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    ident, mark = fresh(docs, 2)
    hit = found.select(F.col("doc_id").alias(ident), F.col("text_hash").alias(mark)).distinct()
    return docs.join(small_side(hit, 16), F.col("doc_id").eqNullSafe(F.col(ident)) & (F.xxhash64("text") == F.col(mark)), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; all rows and columns stay.

    Null texts stay null and empty ones empty; long texts are read whole; repeated rows give repeated rows; an empty table stays empty.
    """
    return crf.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences.

    Null and empty texts have an end token only; a text longer than a sequence is cut into pieces; repeated rows are packed each;
    columns other than doc_id and text are left out; an empty table gives an empty table.
    """
    return packing.packed_pieces(docs, word_tokenizer())
