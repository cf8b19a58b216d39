"""Corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, packing.

Every stage but the last returns the columns of its input. Rows with a NULL text or a NULL doc_id pass the stages that
filter; empty tables stay empty; rows that repeat an id are one document in what compares documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelake.llm._store import written
from sievelake.llm.contamination import decontaminate
from sievelake.llm.lines import dedup_lines
from sievelake.llm.packing import pack
from sievelake.llm.simhash import without_near_duplicates
from sievelake.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text, as it is or restored from disguise, isn't toxic.

    The decision is by row. NULL and empty texts aren't toxic, nor is any text without toxic labels to learn from.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those left without text by that go.

    NULL, empty and blank texts stay as they are; of repeated rows, one id's lines stay in all of them.
    """
    return dedup_lines(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all others.

    Texts without words and rows without an id are in no group; the least id stays, with all its rows.
    """
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of at least five words.

    An empty benchmark, or one of NULL and empty texts, drops nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of what is left; every token of every row is in one window.

    Texts without tokens are in none; NULL ids stay NULL; repeated rows are packed repeatedly.
    """
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: MinHash, SimHash, Viterbi decoding and order-dependent packing can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table in the shared folder, which the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
