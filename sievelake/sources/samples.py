"""Sample tables with known label errors, made by executors; the same seed gives the same rows."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ADJACENT = [[1], [0, 2], [1, 3], [2, 4], [3]]
_CONFUSED = [[2], [3], [0, 4], [1], [2]]
_CAT_1 = [[6, 2, 1, 0.5, 0.5], [1, 6, 2, 0.5, 0.5], [0.5, 1, 6, 2, 0.5], [0.5, 0.5, 1, 6, 2], [0.5, 0.5, 1, 2, 6]]
_CAT_2 = [[7, 2, 1], [5, 4, 1], [2, 6, 2], [1, 4, 5], [1, 2, 7]]
#: factor of the class mean, offset, deviation
_FEATURES = [(1, 0, 2), (1, 5, 3), (1, -3, 2.5), (0.8, 0, 5), (1.2, 0, 6), (0.5, 0, 8)]


def _pick(u: Column, k: Column, weights: list[list[float]], names: list[str]) -> Column:
    """A name by the weights of class k, from a uniform number."""
    out = None
    for cls, w in enumerate(weights):
        total, acc, e = sum(w), 0.0, F.lit(names[-1])
        steps = []
        for x in w[:-1]:
            acc += x / total
            steps.append(acc)
        for bound, name in reversed(list(zip(steps, names))):
            e = F.when(u < bound, name).otherwise(e)
        out = F.when(k == cls, e) if out is None else out.when(k == cls, e)
    return out


def _other(u: Column, k: Column, choices: list[list[int]]) -> Column:
    table = F.array(*(F.array(*map(F.lit, c)) for c in choices))
    row = F.get(table, k)
    return F.get(row, F.floor(u * F.size(row)).cast("int"))


def noisy_labels(spark: SparkSession, n: int = 2000, errors: int = 500, seed: int = 42) -> DataFrame:
    """id, nine features, three categories, true_label and label; exactly `errors` labels are wrong.

    40 % of them are any other class, 35 % a neighbouring one, the rest one that is easily confused.
    """
    d = spark.range(1, n + 1, 1, 4).withColumn("k", F.floor(F.rand(seed) * 5).cast("int"))
    mean = (F.col("k") + 1) * 10.0
    for i, (factor, offset, dev) in enumerate(_FEATURES, 1):
        d = d.withColumn(f"feature_{i}", F.bround(mean * factor + offset + F.randn(seed + i) * dev, 2))
    d = d.withColumn("feature_7", F.bround(50 + F.randn(seed + 7) * 20, 2)).withColumn("feature_8", F.bround(F.rand(seed + 8) * 100, 2))
    d = d.withColumn("feature_9", F.bround(-30 * F.ln(1 - F.rand(seed + 9)), 2))
    d = d.withColumn("cat_1", _pick(F.rand(seed + 10), F.col("k"), _CAT_1, list("ABCDE"))).withColumn("cat_2", _pick(F.rand(seed + 11), F.col("k"), _CAT_2, list("XYZ")))
    d = d.withColumn("cat_3", F.concat(F.lit("M"), (F.floor(F.rand(seed + 12) * 10) + 1).cast("string")))
    # the rows with wrong labels are chosen by a window over the ids alone: this is a sample table
    chosen = spark.range(1, n + 1).select("id", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "id"))).alias("place")).where(F.col("place") <= errors)
    u = F.rand(seed + 13)
    flip = F.when(F.col("place") <= int(errors * 0.4), _other(u, F.col("k"), [[j for j in range(5) if j != i] for i in range(5)])).when(F.col("place") <= int(errors * 0.75), _other(u, F.col("k"), _ADJACENT)).otherwise(_other(u, F.col("k"), _CONFUSED))
    d = d.withColumn("u", u).join(chosen, "id", "left").withColumn("wrong", F.when(F.col("place").isNotNull(), flip).otherwise(F.col("k")))
    names = ["id", *(f"feature_{i}" for i in range(1, 10)), "cat_1", "cat_2", "cat_3"]
    return d.select(*names, F.concat(F.lit("Class_"), "k").alias("true_label"), F.concat(F.lit("Class_"), "wrong").alias("label"))


def clean_labels(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """id, one feature that says nothing, true_label and an equal label."""
    d = spark.range(1, n + 1).withColumn("feature_1", F.randn(seed) * 2 + 10).withColumn("true_label", F.concat(F.lit("Class_"), F.floor(F.rand(seed + 1) * 5).cast("int")))
    return d.withColumn("label", F.col("true_label"))


def label_histogram(df: DataFrame) -> DataFrame:
    """(true_label, n, wrong): rows and wrong labels of each class."""
    return df.groupBy("true_label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != F.col("true_label")).alias("wrong"))


def png(x: np.ndarray) -> bytes:
    """A PNG file of pixels (height, width, channels): 1 gray, 3 colours, 4 with opacity."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, {1: 0, 3: 2, 4: 6}[x.shape[2]], 0, 0, 0)
    rows = np.concatenate([np.zeros((x.shape[0], 1), np.uint8), x.reshape(x.shape[0], -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


#: Most files in a folder.
FOLDER_FILES = 1000


def write_images(rows: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Write a gray PNG file <n>_<row_id>.png for each of rows (row_id, height, width, px); the folders, with their files' number.

    n counts the files of a folder, so rows that repeat an id have a file each. Pixel (r, c) is number 7 r + 3 c, around and
    around, of px. A row without px becomes a file that is no image. folder is a URI that all executors share; each attempt
    of a task writes to folders of its own in it, and only those that are whole are returned.
    """

    def batch(folders: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in folders], pa.string()), pa.array([x[1] for x in folders], pa.int64())], names=["name", "n"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = fs.FileSystem.from_uri(folder)
        name, n = None, 0
        for b in batches:
            full = []
            for r in b.to_pylist():
                if name is None:
                    name = uuid.uuid4().hex
                    at.create_dir(f"{base}/{name}", recursive=True)
                data = b"no image"
                if r["px"]:
                    place = 7 * np.arange(r["height"])[:, None] + 3 * np.arange(r["width"])
                    data = png(np.array(r["px"], np.uint8)[place % len(r["px"])][:, :, None])
                with at.open_output_stream(f"{base}/{name}/{n}_{r['row_id']}.png") as f:
                    f.write(data)
                n += 1
                if n == most:
                    full.append((name, n))
                    name, n = None, 0
            yield batch(full)
        if n:
            yield batch([(name, n)])

    most = FOLDER_FILES
    found = rows.select("row_id", "height", "width", "px").mapInArrow(part, "name string, n long").collect()
    return [(f"{folder}/{r['name']}", r["n"]) for r in found]
