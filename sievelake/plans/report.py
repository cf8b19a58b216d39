"""Reports: metrics and issues of a table, a text or an image profile in one shape, and their sinks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ISSUE_SCHEMA
from ..operators import image, labels, table, text
from ..sources import readers

KIND_ORDER = ("missing_value", "outlier", "duplicate_rows", "label_error", "empty_text", "duplicate_text", "small_image", "blurry_image", "corrupted_image")


@dataclass
class QualityReport:
    """Metrics, one row; issues in the unified schema; further frames by name."""

    modality: str
    metrics: DataFrame
    issues: DataFrame
    parts: dict[str, DataFrame] = field(default_factory=dict)
    error: str | None = None
    file: str | None = None

    def ordered(self) -> DataFrame:
        """Issues by kind, then column and row."""
        rank = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("type"))
        return self.issues.orderBy(rank, "column", "row_id")

    def to_json(self) -> DataFrame:
        """(kind, json): one row of metrics and one for each issue."""
        m = self.metrics if self.file is None else self.metrics.withColumn("file", F.lit(self.file))
        m = m.select(F.lit("metrics").alias("kind"), F.to_json(F.struct("*")).alias("json"))
        return m.unionByName(self.issues.select(F.lit("issue").alias("kind"), F.to_json(F.struct("*")).alias("json")))

    def write(self, path: str, format: str = "json") -> None:
        """Metrics, issues and parts as folders under path: json, parquet or csv."""
        for name, df in {"metrics": self.metrics, "issues": self.issues, **self.parts}.items():
            w = df.write.mode("overwrite")
            w.option("header", True).csv(f"{path}/{name}") if format == "csv" else w.format(format).save(f"{path}/{name}")


@dataclass(frozen=True)
class Options:
    """What a profile may be told; every kind takes what concerns it."""

    label: str | None = None
    row_id: str = "row_id"
    column: str = "text"
    approx: bool = False
    exclude: tuple[str, ...] = ()
    trees: int = 200
    depth: int = 10


class Detector(Protocol):
    """What turns rows into a report."""

    def __call__(self, df: DataFrame, options: Options = ...) -> QualityReport: ...


def unified(issues: DataFrame, modality: str) -> DataFrame:
    """Issues with all columns of the unified schema, NULL where a kind has no such value."""
    have = {c.lower(): c for c in issues.columns}
    cols = []
    for part in ISSUE_SCHEMA.split(", "):
        name, kind = part.split(" ")
        cols.append(F.lit(modality).alias(name) if name == "modality" else (F.col(f"`{have[name]}`") if name in have else F.lit(None)).cast(kind).alias(name))
    return issues.select(*cols)


def profile_table(df: DataFrame, options: Options = Options()) -> QualityReport:
    """Report of a table. An unknown label column is ignored; labels that can't be checked give an error, not a failure."""
    o = options
    report = QualityReport("table", table.metrics(df, o.approx), unified(table.issues(df, o.approx), "table"), {"missing": table.missing(df), "outliers": table.outliers(df, o.approx), "types": table.data_types(df), "duplicates": table.duplicate_rows(df)})
    if o.label and o.label in df.columns:
        rows = df if o.row_id in df.columns else df.withColumn(o.row_id, F.monotonically_increasing_id())
        try:
            d = labels.label_issues(rows, o.label, o.row_id, exclude=o.exclude, trees=o.trees, depth=o.depth)
        except labels.LabelError as e:
            report.error = str(e)
            return report
        bad = labels.errors(d).select(F.lit("label_error").alias("type"), F.lit(o.label).alias("column"), "row_id", F.col("given").alias("original_label"), F.col("predicted").alias("predicted_label"), F.col("quality").alias("quality_score"))
        report.issues = report.issues.unionByName(unified(bad, "table"))
        report.parts |= {"thresholds": labels.thresholds(d, approx=o.approx), "joint": labels.confident_joint(d, approx=o.approx), "noise": labels.noise_matrix(d, approx=o.approx), "labels": labels.summary(d)}
    return report


def profile_text(df: DataFrame, options: Options = Options()) -> QualityReport:
    """Report of texts with an id."""
    return QualityReport("text", text.metrics(df, options.column), unified(text.issues(df, options.row_id, options.column), "text"))


def profile_images(df: DataFrame, options: Options = Options()) -> QualityReport:
    """Report of rows of the image source; ids are hashes of the files' names."""
    m = image.measure(df).withColumn("row_id", F.xxhash64("origin"))
    return QualityReport("image", image.metrics(m), unified(image.issues(m), "image"), {"measured": m})


DETECTORS: dict[str, Detector] = {"table": profile_table, "text": profile_text, "image": profile_images}


def profile_file(spark: SparkSession, path: str, options: Options = Options(), strict: bool = False) -> QualityReport:
    """Report of a file of any known kind, with its name; UnsupportedFormat for others."""
    report = DETECTORS[readers.modality_of(path, strict)](readers.read(spark, path, strict), options)
    report.file = path.rstrip("/").rpartition("/")[2]
    return report


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """One CSV file with a header, for small tables."""
    (df.select(*columns) if columns else df).coalesce(1).write.mode("overwrite").csv(path, header=True)
