"""From documents to packed sequences, in stages whose results are written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytetrawl.llm import common, stages

STAGES = [
    ("quality", stages.accept_quality),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("personal_data", stages.redact_personal_data),
    ("packing", stages.pack),
]

#: Learnt stages and tokenization are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that stay."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
