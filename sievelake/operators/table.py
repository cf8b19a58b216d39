"""Table profile: missing values, IQR outliers, duplicate rows, types.

Counts of all columns come from one aggregate over one scan, quartiles from two; all combine map-side, so what is
shuffled doesn't grow with the rows. Bounds are computed when a function is called and become literals, which reach the
scan. Empty tables have rates of 0.0, and booleans have no outliers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import IQR_FACTOR
from ..functions.quantiles import exact_quantiles
from ..functions.scalar import is_missing, number, numeric_fields, percent


def basic_info(df: DataFrame) -> DataFrame:
    """(rows, columns, columns_list) in one row."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).cast("long").alias("columns"), F.lit(",".join(df.columns)).alias("columns_list"))


def _long(wide: DataFrame, items: Sequence[tuple[str, list]], names: Sequence[str]) -> DataFrame:
    """One row for each item of a one-row frame: its name, then its expressions under these names."""
    rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("column"), *(e.alias(n) for e, n in zip(exprs, names))) for i, (name, exprs) in enumerate(items)]
    if not rows:
        return wide.limit(0).select(F.lit(0).alias("ordinal"), F.lit("").alias("column"), *(F.lit(0.0).alias(n) for n in names))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missing(df: DataFrame) -> DataFrame:
    """(column, count, percentage) of NULL and NaN values of every column, columns without any included."""
    fields = df.schema.fields
    wide = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(is_missing(f)).alias(f"m{i}") for i, f in enumerate(fields)))
    return _long(wide, [(f.name, [F.col(f"m{i}"), percent(F.col(f"m{i}"), F.col("n"))]) for i, f in enumerate(fields)], ["count", "percentage"]).select("column", "count", "percentage")


def missing_total(df: DataFrame) -> DataFrame:
    """(total, percentage) of missing values among all cells."""
    m = missing(df).agg(F.coalesce(F.sum("count"), F.lit(0).cast("long")).alias("total"))
    cells = df.agg((F.count(F.lit(1)) * len(df.columns)).alias("cells"))
    return m.crossJoin(cells).select("total", percent(F.col("total"), F.col("cells")).alias("percentage"))


def bounds(df: DataFrame, approx: bool = False, columns: Sequence[str] | None = None) -> list[tuple[T.StructField, float, float, float, float]]:
    """(field, q1, q3, lower, upper) of every numeric column with a value, or of those named.

    Quartiles interpolate linearly and are exact; approx=True takes approximate ones in one pass.
    """
    fields = [f for f in numeric_fields(df) if columns is None or f.name in columns]
    if not fields:
        return []
    if approx:
        row = df.agg(*(F.percentile_approx(number(f), [0.25, 0.75], 100_000).alias(f"q{i}") for i, f in enumerate(fields))).first()
        found = {i: row[f"q{i}"] for i in range(len(fields)) if row[f"q{i}"] is not None}
    else:
        items = F.array(*(F.struct(F.lit(i).alias("k"), number(f).alias("x")) for i, f in enumerate(fields)))
        found = {k: q for k, (_, q) in exact_quantiles(df.select(F.explode(items).alias("v")).select("v.k", "v.x"), [0.25, 0.75]).items()}
    out = []
    for i, f in enumerate(fields):
        if i in found:
            q1, q3 = found[i]
            out.append((f, q1, q3, q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)))
    return out


def iqr_bounds(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, q1, q3, iqr, lower, upper) of every numeric column with a value."""
    rows = [(f.name, q1, q3, q3 - q1, lower, upper) for f, q1, q3, lower, upper in bounds(df, approx)]
    return df.sparkSession.createDataFrame(rows, "column string, q1 double, q3 double, iqr double, lower double, upper double")


def _outside(f: T.StructField, lower: float, upper: float):
    return (number(f) < F.lit(lower)) | (number(f) > F.lit(upper))


def outliers(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, count, percentage, lower, upper) of numeric columns with values strictly outside their bounds."""
    found = bounds(df, approx)
    wide = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(_outside(f, lower, upper)).alias(f"c{i}") for i, (f, _, _, lower, upper) in enumerate(found)))
    return _outlier_rows(wide, found)


def _outlier_rows(wide: DataFrame, found: list) -> DataFrame:
    items = [(f.name, [F.col(f"c{i}"), percent(F.col(f"c{i}"), F.col("n")), F.lit(lower), F.lit(upper)]) for i, (f, _, _, lower, upper) in enumerate(found)]
    if not items:
        return wide.sparkSession.createDataFrame([], "column string, count long, percentage double, lower double, upper double")
    return _long(wide, items, ["count", "percentage", "lower", "upper"]).where("count > 0").select("column", "count", "percentage", "lower", "upper")


def outlier_rows(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """The rows of df whose value in one numeric column is an outlier, with the bounds. The filter reaches the scan."""
    found = bounds(df, approx, [column])
    if not found:
        return df.limit(0).withColumns({"lower": F.lit(0.0), "upper": F.lit(0.0)})
    f, _, _, lower, upper = found[0]
    return df.where(_outside(f, lower, upper)).withColumns({"lower": F.lit(lower), "upper": F.lit(upper)})


def outlier_rate(df: DataFrame, approx: bool = False) -> DataFrame:
    """(outlier_rate): outliers of all columns in percent of the rows; with several columns it may exceed 100."""
    hits = [F.count_if(_outside(f, lower, upper)) for f, _, _, lower, upper in bounds(df, approx)]
    return df.agg(percent(sum(hits, F.lit(0).cast("long")), F.count(F.lit(1))).alias("outlier_rate"))


def _comparable(df: DataFrame) -> list:
    """Columns in a form where equal rows group: NaN as NULL, maps as sorted JSON."""

    def one(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(F.isnan(c), None).otherwise(c)
        return F.to_json(F.array_sort(F.map_entries(c))) if isinstance(f.dataType, T.MapType) else c

    return [one(f).alias(f"k{i}") for i, f in enumerate(df.schema.fields)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(count, percentage) of rows that equal an earlier one; NULL equals NULL and NaN, 0.0 equals -0.0."""
    keys = _comparable(df)
    groups = df.select(*keys).groupBy(*(f"k{i}" for i in range(len(keys)))).count()
    total = groups.agg(F.coalesce(F.sum(F.col("count")), F.lit(0).cast("long")).alias("n"), F.count(F.lit(1)).alias("d"))
    return total.select((F.col("n") - F.col("d")).alias("count"), percent(F.col("n") - F.col("d"), F.col("n")).alias("percentage"))


def flag_duplicates(df: DataFrame, order: Sequence[str], subset: Sequence[str]) -> DataFrame:
    """df with is_duplicate: whether an earlier row, by the order columns, is equal in the subset.

    Of rows that are equal in the order columns as well, one isn't a duplicate. A group's first row comes from an
    aggregate that combines map-side, so that a hot group is no bottleneck; only the rows that are first, or tie with the
    first, are numbered.
    """
    keyed = df.select(*df.columns, *_comparable(df.select(*subset)), F.struct(*order).alias("__order"))
    names = [f"k{i}" for i in range(len(subset))]
    first = keyed.groupBy(*names).agg(F.min("__order").alias("__first"))
    first = first.select(*(F.col(n).alias(f"f_{n}") for n in names), "__first")
    j = keyed.join(first, [keyed[n].eqNullSafe(first[f"f_{n}"]) for n in names])
    later = j.where("__order <> __first").select(*df.columns, F.lit(True).alias("is_duplicate"))
    nth = F.row_number().over(W.partitionBy(*names).orderBy("__order"))
    return later.unionByName(j.where("__order = __first").withColumn("__nth", nth).select(*df.columns, (F.col("__nth") > 1).alias("is_duplicate")))


_DTYPE = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "boolean": "bool", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]"}


def _dtype(f: T.StructField, missing, n):
    """A column's type as a data-frame library would report it: without any value, or an integer with gaps, float64."""
    kind = _DTYPE.get(f.dataType.simpleString(), "object")
    return F.when((missing == n) & (n > 0), "float64").when((missing > 0) & F.lit(kind.startswith("int")), "float64").otherwise(kind)


def data_types(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, dtype): the type that a data-frame library would report.

    exact=True looks at the data: an integer column with missing values, or a column without any value, is float64.
    """
    fields = df.schema.fields
    if not exact:
        return df.sparkSession.createDataFrame([(f.name, _DTYPE.get(f.dataType.simpleString(), "object")) for f in fields], "column string, dtype string")
    wide = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(is_missing(f)).alias(f"m{i}") for i, f in enumerate(fields)))
    return _long(wide, [(f.name, [_dtype(f, F.col(f"m{i}"), F.col("n"))]) for i, f in enumerate(fields)], ["dtype"]).select("column", "dtype")


def _counts(df: DataFrame, found: list) -> tuple[DataFrame, list[str]]:
    """One row with all counts of one scan: n, missing values m0.., outliers c0... and the sum of each."""
    fields = df.schema.fields
    m = [F.count_if(is_missing(f)) for f in fields]
    c = [F.count_if(_outside(f, lower, upper)) for f, _, _, lower, upper in found]
    zero = F.lit(0).cast("long")
    named = [e.alias(f"m{i}") for i, e in enumerate(m)] + [e.alias(f"c{i}") for i, e in enumerate(c)]
    return df.agg(F.count(F.lit(1)).alias("n"), *named, sum(m, zero).alias("missing"), sum(c, zero).alias("outlying")), [f.name for f in fields]


def metrics(df: DataFrame, approx: bool = False) -> DataFrame:
    """(rows, columns, missing_value_rate, duplicate_row_rate, outlier_rate) in percent, in one row.

    Besides the quartiles, one scan counts everything but duplicates, and one counts those.
    """
    wide, names = _counts(df, bounds(df, approx))
    dup = duplicate_rows(df).select(F.col("percentage").alias("duplicate_row_rate"))
    rates = wide.select(F.col("n").alias("rows"), F.lit(len(names)).cast("long").alias("columns"), percent(F.col("missing"), F.col("n") * len(names)).alias("missing_value_rate"), percent(F.col("outlying"), F.col("n")).alias("outlier_rate"))
    return rates.crossJoin(dup).select("rows", "columns", "missing_value_rate", "duplicate_row_rate", "outlier_rate")


def issues(df: DataFrame, approx: bool = False) -> DataFrame:
    """(type, column, count, percentage) of columns with missing values, columns with outliers, and duplicate rows."""
    found = bounds(df, approx)
    wide, names = _counts(df, found)
    items = [(n, [F.lit("missing_value"), F.col(f"m{i}"), percent(F.col(f"m{i}"), F.col("n"))]) for i, n in enumerate(names)]
    items += [(f.name, [F.lit("outlier"), F.col(f"c{i}"), percent(F.col(f"c{i}"), F.col("n"))]) for i, (f, *_) in enumerate(found)]
    a = _long(wide, items, ["type", "count", "percentage"]).where("count > 0").select("type", "column", "count", "percentage")
    c = duplicate_rows(df).where("count > 0").select(F.lit("duplicate_rows").alias("type"), F.lit(None).cast("string").alias("column"), "count", "percentage")
    return a.unionByName(c)


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, dtype, missing_count, missing_percentage, lower, upper, outlier_count): all about every column."""
    found = bounds(df, approx)
    at = {f.name: i for i, (f, *_) in enumerate(found)}
    wide, names = _counts(df, found)
    none = F.lit(None)
    items = []
    for i, f in enumerate(df.schema.fields):
        k = at.get(f.name)
        box = [F.lit(found[k][3]), F.lit(found[k][4]), F.col(f"c{k}")] if k is not None else [none.cast("double"), none.cast("double"), none.cast("long")]
        items.append((f.name, [_dtype(f, F.col(f"m{i}"), F.col("n")), F.col(f"m{i}"), percent(F.col(f"m{i}"), F.col("n")), *box]))
    return _long(wide, items, ["dtype", "missing_count", "missing_percentage", "lower", "upper", "outlier_count"]).drop("ordinal")
