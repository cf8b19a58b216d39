"""Queries of the operators for training data, by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, lines, packing, pii, quality, records, secrets, simhash, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.tokenize(spark, _table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(spark, _table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a source are the historical versions of one path."""
    return secrets.scan_fresh(spark, _table(spark, sf_dir, "documents").withColumn("path", F.col("source")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100, each against all."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_binary_records, op3_pii, op4_packing, op5_secrets, op6_toxicity, op7_line_dedup, op8_top_k, op9_simhash, op10_quality)}

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
        bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
        n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
        SELECT doc_id, item_id, count(*) / CAST(any_value(n) AS DOUBLE) AS containment
        FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / CAST(any_value(n) AS DOUBLE) >= 0.8""",
    "op5_secrets": " UNION ALL ".join(
        f"""SELECT doc_id, path, '{r.name}' AS rule, CAST({r.version} AS INTEGER) AS rule_version, sha256(m) AS secret, m[1:4] AS masked,
        CAST(strpos(any_value(text), m) AS INTEGER) AS first, count(*) AS occurrences
        FROM (SELECT doc_id, source AS path, text, unnest(regexp_extract_all(text, '{r.pattern}')) AS m FROM documents) GROUP BY doc_id, path, m"""
        for r in secrets.RULES
    ),
    "op8_top_k": """
        WITH s AS (SELECT q.vec_id, p.vec_id AS neighbour, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS s
            FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) AS rank FROM s)
        SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(s, 6) AS score FROM r WHERE rank <= 10""",
}
