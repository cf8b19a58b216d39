"""Readers: CSV with missing-value tokens, lines of text, images, Excel, Parquet, and dispatch by file name."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import MISSING_TOKENS
from ..functions.scalar import split_lines


class UnsupportedFormat(ValueError):
    """No reader for this kind of file."""


#: What counts as a number or a truth value in a CSV cell; casts alone would also take 1d, yes or t.
_WHOLE = r"^\s*[+-]?\d+\s*$"
_REAL = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
_TRUTH = r"^(True|TRUE|true|False|FALSE|false)$"
_KINDS = {"bigint": _WHOLE, "double": _REAL, "boolean": _TRUTH}


def _typed(c: Column, kind: str) -> Column:
    """The cell as this type, NULL if it isn't one."""
    return F.when(c.rlike(_KINDS[kind]), F.trim(c).try_cast(kind))


def read_csv(spark: SparkSession, path: str, infer: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV with a header; the usual tokens for missing values become NULL, then each column gets the narrowest type.

    Types, from narrow to wide: BIGINT, DOUBLE, BOOLEAN, STRING; a column without any value is DOUBLE. All columns are
    judged in one pass over the file. multi_line=False lets one file be read by many tasks, if no cell has a line end.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    d = raw.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns))
    if not infer or not d.columns:
        return d
    aggs = [e for i, c in enumerate(d.columns) for e in (F.count(f"`{c}`").alias(f"n{i}"), *(F.count(_typed(F.col(f"`{c}`"), k)).alias(f"{k}{i}") for k in _KINDS))]
    row = d.agg(*aggs).first()
    types = ["double" if not row[f"n{i}"] else next((k for k in _KINDS if row[f"{k}{i}"] == row[f"n{i}"]), "string") for i in range(len(d.columns))]
    return d.select(*((F.col(f"`{c}`") if t == "string" else _typed(F.col(f"`{c}`"), t)).alias(c) for c, t in zip(d.columns, types)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_id, text): the lines of UTF-8 files, numbered from 0 in each; all Unicode line ends count."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return d.select("file", F.posexplode(split_lines(F.validate_utf8("value"))).alias("row_id", "text")).withColumn("row_id", F.col("row_id").cast("long"))


#: Tasks for each core, and bytes of files for each task if these give more tasks, in reading images.
IMAGE_TASKS, IMAGE_BYTES = 3, 64 << 20


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of Spark's image source; corrupt files stay, with a height of -1.

    Spark counts 4 MB for opening a file, so it would make a task of every few small images; these are read together.
    """
    d = spark.read.format("image").option("dropInvalid", False).load(path)
    size = int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return d.coalesce(max(IMAGE_TASKS * spark.sparkContext.defaultParallelism, -(-size // IMAGE_BYTES)))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of files as they are."""
    return spark.read.format("binaryFile").load(path)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _sheet(content: bytes) -> list[list[object]]:
    """Cells of a workbook's first sheet: text, numbers (whole ones as int), truth values, None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        first = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet").get(f"{_REL}id")
        rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == first).removeprefix("/").removeprefix("xl/")
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in x.iter(f"{_MAIN}t")) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/{target}")).iter(f"{_MAIN}row"):
            cells: list[object] = []
            for c in row.iter(f"{_MAIN}c"):
                letters = re.match("[A-Z]*", c.get("r", "")).group()
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                cells += [None] * (at + 1 - len(cells))
                v, kind = c.findtext(f"{_MAIN}v"), c.get("t", "n")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is not None:
                    number = float(v) if kind == "n" else None
                    cells[at] = shared[int(v)] if kind == "s" else v == "1" if kind == "b" else v if number is None else int(number) if number == int(number) and "." not in v else number
            rows.append(cells)
        return rows


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of one .xlsx workbook, the first row as header; a sheet has at most a million rows.

    Tokens for missing values become NULL. A column of whole numbers is BIGINT, of numbers DOUBLE, of truth values
    BOOLEAN, without any value DOUBLE, else STRING. Dates are numbers of days, as the file has them.
    """
    rows = _sheet(read_blobs(spark, path).first()["content"])
    if not rows:
        return spark.createDataFrame([], "empty double").drop("empty")
    head = [str(c) if c is not None else f"Unnamed: {i}" for i, c in enumerate(rows[0])]
    body = [[None if isinstance(c, str) and c in MISSING_TOKENS else c for c in [*r, *[None] * len(head)][: len(head)]] for r in rows[1:]]
    fields = []
    for i, name in enumerate(head):
        kinds = {type(r[i]) for r in body if r[i] is not None}
        kind = T.DoubleType() if not kinds or kinds == {float} or kinds == {float, int} else T.LongType() if kinds == {int} else T.BooleanType() if kinds == {bool} else T.StringType()
        for r in body:
            if r[i] is not None:
                r[i] = float(r[i]) if isinstance(kind, T.DoubleType) else str(r[i]) if isinstance(kind, T.StringType) else r[i]
        fields.append(T.StructField(name, kind))
    return spark.createDataFrame(body, T.StructType(fields))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = {
    "csv": ("table", read_csv),
    "xlsx": ("table", read_excel),
    "parquet": ("table", read_parquet),
    "txt": ("text", read_lines),
    "jpg": ("image", read_images),
    "jpeg": ("image", read_images),
    "png": ("image", read_images),
}


def modality_of(path: str, strict: bool = False) -> str:
    """table, text or image, by the suffix; strict: only lower-case suffixes count."""
    suffix = path.rpartition(".")[2]
    suffix = suffix if strict else suffix.lower()
    if suffix not in READERS:
        raise UnsupportedFormat(f"no reader for {path}")
    return READERS[suffix][0]


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The file's rows, by the reader of its suffix."""
    modality_of(path, strict)
    return READERS[path.rpartition(".")[2].lower()][1](spark, path)


def from_texts(spark: SparkSession, texts: Iterable[str | None]) -> DataFrame:
    """(row_id, text) of strings in memory."""
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
