"""Text profile: empty and duplicate texts, length statistics.

NULL counts as an empty text of length 0. Texts are equal if they are after stripping white space; the second and any
later empty text is a duplicate of the first as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_empty_text, percent, split_lines, strip


def _key(text: str):
    return strip(F.coalesce(F.col(text), F.lit("")))


def empty(df: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """(row_id) of empty texts."""
    return df.where(is_empty_text(F.col(text))).select(F.col(row_id).alias("row_id"))


def duplicates(df: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """(row_id, original_row_id) of texts that equal one with a lesser id.

    Groups are found on 32-byte digests, so no text is shuffled, and by an aggregate, so that a text with millions of
    copies is combined map-side.
    """
    d = df.select(F.col(row_id).alias("row_id"), F.unhex(F.sha2(_key(text), 256)).alias("key"))
    first = d.groupBy("key").agg(F.min("row_id").alias("original_row_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return d.join(first, "key").where("row_id <> original_row_id").select("row_id", "original_row_id")


def _statistics():
    length = F.length(F.coalesce(F.col("text"), F.lit("")))
    return [F.count(F.lit(1)).alias("total"), F.count_if(is_empty_text(F.col("text"))).alias("empty"), F.avg(length).alias("avg"), F.min(length).alias("low"), F.max(length).alias("high")]


def metrics(df: DataFrame, text: str = "text", by: str | None = None) -> DataFrame:
    """total_texts, empty_text_rate, duplicate_text_rate in percent, average, min and max length in code points.

    With `by`, one row for each of its values, with duplicates counted inside each.
    """
    groups = [by] if by else []
    d = df.select(*groups, F.col(text).alias("text"))
    a = d.groupBy(*groups).agg(*_statistics())
    copies = d.groupBy(*groups, F.unhex(F.sha2(_key("text"), 256)).alias("key")).count().groupBy(*groups).agg((F.sum("count") - F.count(F.lit(1))).alias("copies"))
    if by:
        copies = copies.withColumnRenamed(by, "__by")
        j = a.join(copies, a[by].eqNullSafe(copies["__by"]))
    else:
        j = a.crossJoin(copies)
    zero = F.lit(0).cast("long")
    return j.select(
        *groups,
        F.col("total").alias("total_texts"),
        percent(F.col("empty"), F.col("total")).alias("empty_text_rate"),
        percent(F.coalesce("copies", zero), F.col("total")).alias("duplicate_text_rate"),
        F.coalesce(F.col("avg").cast("double"), F.lit(0.0)).alias("average_length"),
        F.coalesce(F.col("low").cast("double"), F.lit(0.0)).alias("min_length"),
        F.coalesce(F.col("high").cast("double"), F.lit(0.0)).alias("max_length"),
    )


def issues(df: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """(type, row_id, original_row_id): empty_text and duplicate_text."""
    a = empty(df, row_id, text).select(F.lit("empty_text").alias("type"), "row_id", F.lit(None).cast("long").alias("original_row_id"))
    b = duplicates(df, row_id, text).select(F.lit("duplicate_text").alias("type"), "row_id", "original_row_id")
    return a.unionByName(b)


def lines(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, line_no, line) of all lines of all texts."""
    return df.select(F.col(row_id).alias("row_id"), F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))
