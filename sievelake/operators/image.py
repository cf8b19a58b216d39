"""Image profile: corrupt, small and blurry images.

Grids of pixels in an array column stay in the JVM; encoded files are decoded by Spark's image source and measured in
numpy, one Arrow batch at a time, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BLUR_LIMIT, SMALL_SIDE
from ..functions.scalar import laplacian_variance, percent

CORRUPT = "image can't be decoded"


def sharpness(grids: DataFrame) -> DataFrame:
    """grids (row_id, height, width, px ARRAY<INT>) with the variance of the Laplacian; NULL where px is NULL."""
    return grids.withColumn("sharpness", laplacian_variance(F.col("px"), F.col("height"), F.col("width")))


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels as gray; three or four channels are blue, green, red and, ignored, opacity."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels < 3:
        return x[:, :, 0].astype(np.int64)
    return np.floor(0.114 * x[:, :, 0] + 0.587 * x[:, :, 1] + 0.299 * x[:, :, 2] + 0.5).astype(np.int64)


def variance_of_laplacian(g: np.ndarray) -> float:
    """The same measure as sharpness() of a gray image."""
    p = np.pad(g, [(1, 1) if n > 1 else (0, 0) for n in g.shape], mode="reflect")
    if g.shape[0] == 1:
        p = np.concatenate([p, p, p])
    if g.shape[1] == 1:
        p = np.concatenate([p, p, p], axis=1)
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    n = lap.size
    return float((lap * lap).sum() / n - (lap.sum() / n) ** 2)


def measure(images: DataFrame) -> DataFrame:
    """(origin, height, width, sharpness) of rows of Spark's image source read with dropInvalid=false; NULL if corrupt."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, data = b.drop_columns(["data"]).to_pylist(), b.column("data")  # pixels are measured where they lie, not copied
            good = [r["height"] > 0 for r in rows]
            out = [variance_of_laplacian(gray(data[i].as_buffer(), r["height"], r["width"], r["nChannels"])) if g else None for i, (r, g) in enumerate(zip(rows, good))]
            yield pa.RecordBatch.from_arrays([pa.array([r["origin"] for r in rows], pa.string()), pa.array([r["height"] if g else None for r, g in zip(rows, good)], pa.int32()), pa.array([r["width"] if g else None for r, g in zip(rows, good)], pa.int32()), pa.array(out, pa.float64())], names=["origin", "height", "width", "sharpness"])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(part, "origin string, height int, width int, sharpness double")


def _kinds() -> Column:
    """Issues of an image from height, width and sharpness; NULL for each that it hasn't."""
    small = (F.col("height") < SMALL_SIDE) | (F.col("width") < SMALL_SIDE)
    blank = F.lit(None)
    return F.array(
        F.when(small, F.struct(F.lit("small_image").alias("type"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), blank.cast("double").alias("sharpness"), blank.cast("string").alias("error"))),
        F.when(F.col("sharpness") < BLUR_LIMIT, F.struct(F.lit("blurry_image").alias("type"), blank.cast("int").alias("height"), blank.cast("int").alias("width"), F.col("sharpness").alias("sharpness"), blank.cast("string").alias("error"))),
        F.when(F.col("sharpness").isNull(), F.struct(F.lit("corrupted_image").alias("type"), blank.cast("int").alias("height"), blank.cast("int").alias("width"), blank.cast("double").alias("sharpness"), F.lit(CORRUPT).alias("error"))),
    )


def issues(measured: DataFrame) -> DataFrame:
    """(type, row_id, height, width, sharpness, error) from (row_id, height, width, sharpness).

    small_image if a side has under 100 pixels, blurry_image if the sharpness is under 50, both possible;
    corrupted_image if there is no sharpness.
    """
    return measured.select("row_id", F.explode(_kinds()).alias("k")).where("k is not null").select("k.type", "row_id", "k.height", "k.width", "k.sharpness", "k.error")


def metrics(measured: DataFrame) -> DataFrame:
    """(total_images, issue_rate): issues in percent of images, over 100 if images have several. Each is measured once."""
    n = measured.agg(F.count(F.lit(1)).alias("total_images"), F.coalesce(F.sum(F.size(F.array_compact(_kinds()))), F.lit(0)).alias("i"))
    return n.select("total_images", percent(F.col("i"), F.col("total_images")).alias("issue_rate"))
