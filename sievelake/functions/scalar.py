"""Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import LINE_BREAK, WHITE_SPACE


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_empty_text(c: Column) -> Column:
    """NULL, empty or blank."""
    return c.isNull() | (strip(c) == "")


def split_lines(c: Column) -> Column:
    """Lines of a text; a separator at the end doesn't begin another line, and an empty text has none."""
    parts = F.split(c, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent; 0.0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double") * 100.0)


def is_missing(f: T.StructField) -> Column:
    """NULL, or NaN in a floating-point column."""
    c = F.col(f"`{f.name}`")
    return c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def number(f: T.StructField) -> Column:
    """A numeric column as DOUBLE with NaN as NULL."""
    c = F.col(f"`{f.name}`").cast("double")
    return F.when(F.isnan(c), None).otherwise(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c


def numeric_fields(df: DataFrame) -> list[T.StructField]:
    """Numeric columns; booleans aren't."""
    return [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def argmax(p: Column) -> Column:
    """Place, from 0, of the first greatest element."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def laplacian_variance(px: Column, height: Column, width: Column) -> Column:
    """Population variance of the 4-neighbour Laplacian of a row-major grid, with mirrored borders (edge not repeated).

    Sums are of integers, so the result doesn't depend on their order. NULL for an empty or NULL grid, or one whose
    size isn't height times width.
    """

    def at(r: Column, c: Column) -> Column:
        return F.get(px, (r * width + c).cast("int")).cast("long")

    def cell(i: Column) -> Column:
        r, c = F.floor(i / width), i % width
        up = F.when(r > 0, r - 1).otherwise(F.least(F.lit(1), height - 1))
        down = F.when(r < height - 1, r + 1).otherwise(F.greatest(height - 2, F.lit(0)))
        left = F.when(c > 0, c - 1).otherwise(F.least(F.lit(1), width - 1))
        right = F.when(c < width - 1, c + 1).otherwise(F.greatest(width - 2, F.lit(0)))
        return at(up, c) + at(down, c) + at(r, left) + at(r, right) - 4 * at(r, c)

    lap = F.transform(F.sequence(F.lit(0), F.size(px) - 1), cell)
    n = F.size(px).cast("double")
    total = F.aggregate(lap, F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    square = F.aggregate(lap, F.lit(0).cast("long"), lambda a, x: a + x * x).cast("double")
    return F.when((F.size(px) > 0) & (F.size(px) == height * width), square / n - (total / n) * (total / n))
