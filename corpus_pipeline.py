"""The training-data pipeline over documents: each stage works on all that its predecessor kept.

Stages 1 to 4 return the columns of documents; packing returns one row per piece.  Between stages the
documents are written as Parquet to the run's shared folder and read again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import lines, mixing, near_text, outliers, packing
from ledgerlake.llm.common import table
from ledgerlake.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return outliers.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.clean_documents(docs, min_words=1, blanks=lines.BLANKS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_text.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.contract(spark, docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_dedup),
          ("mix_sources", mix_sources), ("best_fit_packing", pack_sequences)]

# Robust outliers and SimHash can't be stated in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
