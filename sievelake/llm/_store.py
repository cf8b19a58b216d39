"""Lineage cuts in the shared folder, and filters by key sets that may outgrow a broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import forget, new_folder, shared_dir

#: Least and greatest bits of a key filter. It has 32 bits for a key, and at most 32 MB are broadcast; with more keys than
#: a filter that large can tell apart, a plain join of all rows takes its place.
FILTER_BITS, MOST_BITS = 1 << 20, 1 << 28


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: it outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for what is too large for a checkpoint's row format.

    The folder goes when the Python process ends; df is computed once, so that all readers see the same rows.
    """
    path = new_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    forget(df.sparkSession, path)
    return df.sparkSession.read.parquet(path)


#: Columns of ids.
IDS = ("doc_id", "vec_id")


def shield(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], dict[str, str]]:
    """df with positional column names, so that no other column can clash; the old names, and where the named ones are.

    An exact match is preferred over one that differs in case; of repeated names the first counts. Columns named in IDS
    must hold whole numbers, which become BIGINT; others raise TypeError.
    """
    old = df.columns
    safe = [f"__sl_c{i}" for i in range(len(old))]
    at = {}
    for n in names:
        hit = [i for i, c in enumerate(old) if c == n] or [i for i, c in enumerate(old) if c.lower() == n.lower()]
        if not hit:
            raise ValueError(f"no column {n} in {old}")
        at[n] = safe[hit[0]]
        if n in IDS and not isinstance(df.schema[hit[0]].dataType, (T.IntegralType, T.NullType)):
            raise TypeError(f"{n} must be a whole number, not {df.schema[hit[0]].dataType.simpleString()}")
    return df.toDF(*safe), old, at


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, under these names."""
    s, _, at = shield(df, *names)
    return s.select(*((F.col(at[n]).cast("long") if n in IDS else F.col(at[n])).alias(n) for n in names))


def filter_size(keys: int) -> int:
    """Bits of a filter for so many keys, a power of two; 0 if none within bounds would tell them apart."""
    bits = max(FILTER_BITS, 1 << (32 * keys - 1).bit_length() if keys else 0)
    return min(bits, MOST_BITS) if 4 * keys <= MOST_BITS else 0


def _marked(df: DataFrame, key: str, keys: DataFrame, bits: int) -> DataFrame:
    """df with __sl_hit: whether the key may be among keys' first column. False is certain; NULL keys are false."""
    k = keys.columns[0]
    kind = keys.schema[0].dataType

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast(kind)), F.lit(bits))

    at = keys.where(F.col(k).isNotNull()).select(place(F.col(k)).alias("at")).select(F.shiftright("at", 15).alias("__sl_bucket"), F.col("at").bitwiseAND(32767).alias("p"))
    maps = at.groupBy("__sl_bucket").agg(F.bitmap_construct_agg("p").alias("__sl_map"))
    d = df.withColumn("__sl_at", place(F.col(key))).withColumn("__sl_bucket", F.shiftright("__sl_at", 15))
    d = d.join(F.broadcast(maps), "__sl_bucket", "left")
    p = F.col("__sl_at").bitwiseAND(32767)
    byte = F.conv(F.hex(F.substring(F.col("__sl_map"), (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(__sl_byte, cast(__sl_at & 7 as int)) & 1") == 1
    d = d.withColumn("__sl_byte", byte).withColumn("__sl_hit", F.coalesce(hit & F.col(key).isNotNull(), F.lit(False)))
    return d.drop("__sl_at", "__sl_bucket", "__sl_map", "__sl_byte")


def possibly_with(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key may be among the keys, without a shuffle; an exact join must follow. keys should be checkpointed."""
    bits = filter_size(keys.count())
    return _marked(df, key, keys, bits).where(F.col("__sl_hit")).drop("__sl_hit") if bits else df.where(F.col(key).isNotNull())


def split_by(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(rows whose key is surely not among the keys, the others); no first part where no filter would tell.

    Both are filters over df, without a shuffle. NULL keys are surely not among them. keys should be checkpointed.
    """
    bits = filter_size(keys.count())
    if not bits:
        return None, df
    m = _marked(df, key, keys, bits)
    return m.where(~F.col("__sl_hit")).drop("__sl_hit"), m.where(F.col("__sl_hit")).drop("__sl_hit")


def drop_all(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Anti-join that shuffles only rows which a filter of bounded size can't clear. NULL keys stay."""
    k = keys.toDF("__sl_k")
    clear, d = split_by(df, key, k)
    d = d.join(k, d[key] == k["__sl_k"], "left_anti")
    return d if clear is None else clear.unionByName(d)
