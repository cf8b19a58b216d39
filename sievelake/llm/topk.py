"""Exact top-k inner products by norm buckets with per-bucket pruning.

Vectors are grouped by length into blocks, longest first. Queries meet the blocks in rounds of growing width; after each
round every query's k-th best product so far is the threshold by which later blocks, and rows in them, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut, narrow

BLOCK_BYTES = 1 << 20
#: Bytes of blocks that a task of the grouping makes, at most; a round takes this many times the blocks of the one before.
TASK_BYTES, WIDER = 1 << 26, 4
#: Rows whose id is divisible by this are queries.
EVERY = 100
#: Error of a single-precision product, relative to the product of the lengths.
SLACK = 2e-5
#: Coordinate lists are used if they leave less than this part of a bucket.
COORDINATE_PART = 0.15


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float32).reshape(len(column), dim)


def blocks(vectors: DataFrame) -> DataFrame:
    """Vectors (vec_id, v) in blocks of one dimension and about equal length: (block, d, n, high, ids, data).

    data are float32 rows, longest first, and high is the length of the longest.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    v = vectors.withColumn("norm", norm).withColumn("d", F.size("v"))
    total = v.agg(F.sum(F.col("d") * 4.0)).first()[0] or 0.0
    wanted = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, round(total / TASK_BYTES), min(wanted, round(total / BLOCK_BYTES)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, count = TaskContext.get().partitionId(), 0
        ids, data = np.zeros(0, np.int64), np.zeros((0, 0), np.float32)

        def block(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal count
            count += 1
            high = float(np.sqrt((x.astype(np.float64) ** 2).sum(1)).max())
            return pa.RecordBatch.from_arrays([pa.array([(me << 32) + count]), pa.array([x.shape[1]], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([high]), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], names=["block", "d", "n", "high", "ids", "data"])

        for b in batches:
            dims = b.column(2).to_numpy()
            for lo, hi in pairwise([0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1), len(dims)] if len(dims) else []):
                dim = int(dims[lo])
                if data.shape[1] != dim:
                    if len(ids):
                        yield block(ids, data)
                    ids, data = ids[:0], np.zeros((0, dim), np.float32)
                ids = np.concatenate([ids, b.column(0).slice(lo, hi - lo).to_numpy()])
                data = np.concatenate([data, _matrix(b.column(1).slice(lo, hi - lo), dim)])
                rows = max(64, BLOCK_BYTES // (4 * dim))
                while len(ids) >= rows:
                    yield block(ids[:rows], data[:rows])
                    ids, data = ids[rows:], data[rows:]
        if len(ids):
            yield block(ids, data)

    order = ["d", F.desc("norm"), "vec_id"]
    v = v.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return v.select("vec_id", "v", "d").mapInArrow(part, "block long, d int, n int, high double, ids binary, data binary")


def search(q_ids: np.ndarray, q: np.ndarray, p_ids: np.ndarray, p: np.ndarray, k: int, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, bucket row, product): of each query its k best in the bucket, ties included, that reach theta.

    The bucket p is sorted by length, longest first. A query's least useful cosine with the bucket's longest vector
    decides: with a high one, the most selective coordinate list gives the candidates; otherwise the rows that are
    long enough do, by blocked products in single precision. Candidates are verified in double precision.
    """
    q64, p64 = q.astype(np.float64), p.astype(np.float64)
    qn, pn = np.sqrt((q64**2).sum(1)), np.sqrt((p64**2).sum(1))
    slack = SLACK * qn * pn.max(initial=0.0)
    out_q, out_p = [], []
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(qn > 0, theta / (qn * max(pn.max(initial=0.0), 1e-300)), -np.inf)
        need = np.where(qn > 0, theta / qn, -np.inf)
    reach = np.searchsorted(-pn, -(need - 1e-6 * np.abs(need)), side="right")  # rows long enough
    reach[~np.isfinite(need)] = len(p)
    live = reach > 0
    high = live & (cosine > 0.6) & (cosine <= 1 + 1e-6)
    by_length = live & ~high & ~(cosine > 1 + 1e-6)
    if high.any():
        unit = p64 / np.maximum(pn, 1e-300)[:, None]
        order = np.argsort(unit, axis=0)
        lists = np.take_along_axis(unit, order, 0)
        for i in np.flatnonzero(high):
            u = q64[i] / qn[i]
            t = min(1.0, max(-1.0, cosine[i] - 1e-6))
            focus = np.argsort(-np.abs(u))[:4]
            wide = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(np.maximum(0, 1 - u[focus] ** 2))
            low, up = t * u[focus] - wide, np.where(u[focus] >= t, 1.0, t * u[focus] + wide)
            low = np.where(u[focus] <= -t, -1.0, low)
            spans = [(np.searchsorted(lists[:, f], a - 1e-9), np.searchsorted(lists[:, f], b + 1e-9, side="right"), f) for f, a, b in zip(focus, low, up)]
            a, b, f = min(spans, key=lambda s: s[1] - s[0])
            if b - a <= COORDINATE_PART * len(p):
                rows = order[a:b, f]
                rows = rows[rows < reach[i]]
                out_q.append(np.full(len(rows), i))
                out_p.append(rows)
            else:
                by_length[i] = True
    rows_by_length = np.flatnonzero(by_length)
    rows_by_length = rows_by_length[np.argsort(reach[rows_by_length], kind="stable")]
    for lo in range(0, len(rows_by_length), 512):
        at = rows_by_length[lo : lo + 512]
        m = int(reach[at].max())
        s = q[at] @ p[:m].T
        bar = theta[at] - slack[at]
        if m > k + 1:
            kth = -np.partition(-s, k, axis=1)[:, k]  # one more than k, as a query may find itself
            bar = np.maximum(bar, kth - 2 * slack[at])
        i, j = np.nonzero(s >= bar[:, None].astype(np.float32) - np.float32(0))
        out_q.append(at[i])
        out_p.append(j)
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b = np.concatenate(out_q), np.concatenate(out_p)
    ok = q_ids[a] != p_ids[b]
    a, b = a[ok], b[ok]
    s = np.einsum("ij,ij->i", q64[a], p64[b])
    ok = s >= theta[a]
    a, b, s = a[ok], b[ok], s[ok]
    order = np.lexsort((p_ids[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    first = np.searchsorted(a, np.arange(len(q)))
    ok = np.arange(len(a)) - first[a] < k
    return a[ok], b[ok], s[ok]


def top_k(vectors: DataFrame, k: int = 10, every: int = EVERY) -> DataFrame:
    """(vec_id, rank, neighbour, score): for every query the k other vectors with the greatest inner products, exactly.

    vectors has vec_id and embedding; queries are the rows whose vec_id is divisible by `every`, and each is searched
    among all rows of its dimension. Score is rounded to six decimals; equal products rank by the lesser id. Left out are
    rows with a NULL id or embedding, without coordinates, or with one that is NULL, NaN or infinite. Zero vectors take
    part, with products of 0. Of rows that repeat an id, the first in the order of coordinates counts. With fewer than k
    others, there are as many rows as others.
    """
    v = narrow(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    v = v.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('inf'))")
    v = v.groupBy("vec_id").agg(F.min("v").alias("v"))
    p = cut(blocks(v))
    # one row for each block: its place among those of its dimension, longest first
    place = p.select("block", "d", "high", (F.row_number().over(Window.partitionBy("d").orderBy(F.desc("high"), "block")) - 1).alias("place"))
    place = cut(place.select("block", "d", "high", F.col("place").cast("long")))
    last = place.agg(F.max("place")).first()[0]
    q = cut(blocks(v.where(F.col("vec_id") % every == 0)).select(F.col("block").alias("q_block"), "d", "n", F.col("high").alias("q_high"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                q_ids, p_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, x = (np.frombuffer(r[c], np.float32).reshape(-1, r["d"]) for c in ("q_data", "data"))
                theta = np.full(len(q_ids), -np.inf)
                if r["known"]:
                    order = np.argsort(q_ids)
                    theta[order[np.searchsorted(q_ids[order], [t["vec_id"] for t in r["known"]])]] = [t["theta"] for t in r["known"]]
                a, j, s = search(q_ids, q, p_ids, x, k, theta)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), r["q_block"])), pa.array(q_ids[a]), pa.array(p_ids[j]), pa.array(s)], names=["q_block", "vec_id", "neighbour", "s"])

    spark = vectors.sparkSession
    top = spark.createDataFrame([], "q_block long, vec_id long, neighbour long, s double")
    lo, width = 0, 1
    while last is not None and lo <= last:
        kth = top.groupBy("q_block", "vec_id").agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("theta")).where(F.col("c") >= k)
        known = kth.groupBy(F.col("q_block").alias("k_block")).agg(F.collect_list(F.struct("vec_id", "theta")).alias("known"), F.count(F.lit(1)).alias("full"), F.min("theta").alias("low"))  # at most a block's queries
        state = q.join(known, F.col("q_block") == F.col("k_block"), "left").withColumn("least", F.when(F.col("full") >= F.col("n"), F.col("low")))
        now = place.where((F.col("place") >= lo) & (F.col("place") < lo + width))
        longest = now.groupBy(F.col("d").alias("_d")).agg(F.max("high").alias("longest"), F.min("place").alias("first"), F.max("place").alias("final"))
        # a query block meets the round's blocks of its dimension; those that can't hold a better product are left out
        pairs = state.select("q_block", "d", "q_high", "least").join(longest, F.col("d") == F.col("_d"))
        pairs = pairs.where(F.col("least").isNull() | (F.col("q_high") * F.col("longest") * (1 + 1e-9) >= F.col("least")))
        pairs = pairs.select("q_block", "d", "q_high", "least", F.explode(F.sequence("first", "final")).alias("at"))
        here = now.select("block", F.col("d").alias("_d"), "high", "place")
        pairs = pairs.join(here, (F.col("d") == F.col("_d")) & (F.col("at") == F.col("place")))
        pairs = cut(pairs.where(F.col("least").isNull() | (F.col("q_high") * F.col("high") * (1 + 1e-9) >= F.col("least"))).select("q_block", "block"))
        if pairs.isEmpty():  # later blocks are shorter still
            break
        work = pairs.toDF("w_block", "p_block").join(state, F.col("w_block") == F.col("q_block")).select("q_block", "q_ids", "q_data", "known", "p_block")
        work = work.join(p, F.col("p_block") == F.col("block")).select("q_block", "d", "q_ids", "q_data", "known", "ids", "data")
        found = top.union(work.mapInArrow(meet, "q_block long, vec_id long, neighbour long, s double"))
        # at most k rows of a query come from each block
        rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("s"), "neighbour"))
        top = cut(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        lo, width = lo + width, width * WIDER
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("s"), "neighbour"))
    return top.withColumn("rank", rank).select("vec_id", "rank", "neighbour", F.round("s", 6).alias("score"))
