"""Benchmark decontamination by size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import MOST_BITS, cut, drop_all, filter_size, narrow, possibly_with, shield
from ._text import Words, lean, mix, signed, slices

#: Words of a shingle, least part of an item's shingles, MinHash values of a window.
SHINGLE, THRESHOLD, HASHES = 5, 0.8, 24
_MULT = (mix(np.arange(101, 101 + HASHES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_CLASSES = tuple(1 << c for c in range(31))


def size_class(n: int) -> int:
    """The least class that holds n shingles; a class's items are searched in windows of twice its size."""
    return next(c for c in _CLASSES if n <= c)


def _keys(which: int, hash_no: int, least: np.ndarray) -> np.ndarray:
    return mix(least.astype(np.uint64) ^ mix(np.array([which * 1000 + hash_no], np.uint64)))


def _shingles(w: Words, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the shingles of so many words; those of different lengths never have equal hashes but by chance."""
    h, row = w.shingles(words)
    return (h if words == SHINGLE else mix(h ^ np.uint64(words))), row


def item_shingles(items: DataFrame) -> DataFrame:
    """Distinct (item_id, words, s): hashed shingles of each item; an item of fewer words than a shingle is one of its own."""

    @lean
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                w = Words(b.column(1).slice(lo, hi - lo))
                count = np.diff(w.first)
                for words in range(1, SHINGLE + 1):
                    h, row = _shingles(w, words)
                    ok = (count[row] == words) | (words == SHINGLE)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(row[ok])), pa.array(np.full(int(ok.sum()), words, np.int32)), pa.array(signed(h[ok]))], names=["item_id", "words", "s"])

    return items.mapInArrow(part, "item_id string, words int, s long").distinct()


def item_keys(shingles: DataFrame) -> DataFrame:
    """Distinct (item_id, size, key): one key for each MinHash value of each item.

    MinHash values are least products over the item's shingles, so they combine map-side. An item shorter than a shingle
    has its own hash as its key, and size 0.
    """
    # the upper 32 bits of the hash, times each multiplier, modulo 2**32; halves keep the products in 64 bits
    high, low = F.shiftrightunsigned("s", 48), F.shiftrightunsigned("s", 32).bitwiseAND(0xFFFF)
    least = [F.min((low * F.lit(int(a)) + F.shiftleft((high * F.lit(int(a))).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)).alias(f"m{k}") for k, a in enumerate(_MULT)]
    t = shingles.where(F.col("words") == SHINGLE).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), *least)

    @lean
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([size_class(n) for n in b.column(1).to_pylist()], np.int32)
            for c in np.unique(size):
                at = np.flatnonzero(size == c)
                ids = b.column(0).take(pa.array(at))
                for k in range(HASHES):
                    key = _keys(int(c), k, b.column(2 + k).to_numpy()[at].astype(np.uint32))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(size[at]), pa.array(signed(key))], names=["item_id", "size", "key"])

    short = shingles.where(F.col("words") < SHINGLE).select("item_id", F.lit(0).alias("size"), F.col("s").alias("key"))
    return t.mapInArrow(part, "item_id string, size int, key long").union(short).distinct()


def _bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Flags of the keys' low bits, gathered on the driver: from 1 MB, with 256 bits a key, to 32 MB; a power of two.

    Every window of every text is looked up, so few may pass by chance. With very many keys more do; what passes is joined
    with the keys anyway.
    """
    bits = max(1 << 23, filter_size(8 * keys.count()) or MOST_BITS)
    at = F.col(column).bitwiseAND(bits - 1)
    rows = keys.select(F.shiftright(at, 15).alias("b"), at.bitwiseAND(32767).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["b"] * 4096 : r["b"] * 4096 + 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def _flagged(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of keys whose flag is set."""
    at = (key & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)


def window_hits(docs: DataFrame, sizes: list[int], short: list[int], bits) -> DataFrame:
    """(doc_id, key) of the MinHash values of all windows of all documents that the flags (broadcast) let through.

    For each size class, a text's shingles are cut into blocks of the class's size, and every two neighbours make a
    window, so that each passage of that size lies whole in some window. For items shorter than a shingle (short: their
    numbers of words), all word sequences of their length are looked up.
    """

    @lean
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi in slices(b.column(1)):
                words = Words(b.column(1).slice(lo, hi - lo))
                out_id, out_key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for n in short:
                    h, row = _shingles(words, n)
                    hit = _flagged(bits.value, h)
                    out_id.append(ids[lo:hi][row[hit]])
                    out_key.append(signed(h[hit]))
                h, row = _shingles(words, SHINGLE)
                low = (h >> np.uint64(32)).astype(np.uint32)
                count = np.bincount(row, minlength=hi - lo)
                inside = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
                cuts = {c: np.flatnonzero(inside % c == 0) for c in sizes} if len(h) else {}
                more = {c: row[s[1:]] == row[s[:-1]] for c, s in cuts.items()}
                for k, a in enumerate(_MULT if cuts else ()):
                    v = low * a
                    for c, s in cuts.items():
                        m = np.minimum.reduceat(v, s)
                        pair = m.copy()
                        pair[:-1] = np.where(more[c], np.minimum(m[:-1], m[1:]), m[:-1])
                        key = _keys(c, k, pair)
                        hit = _flagged(bits.value, key)
                        out_id.append(ids[lo:hi][row[s[hit]]])
                        out_key.append(signed(key[hit]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_key))], names=["doc_id", "key"])

    return docs.mapInArrow(part, "doc_id long, key long")


def _with_words(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """contained() with the least number of words of a shingle of the item."""
    d = narrow(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    i = narrow(items, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    shingles = cut(item_shingles(i))
    keys = cut(item_keys(shingles))
    lengths = sorted(r["words"] for r in shingles.select("words").distinct().collect())  # at most SHINGLE
    sizes = sorted(r["size"] for r in keys.where("size > 0").select("size").distinct().collect())  # at most one for each class
    send = docs.sparkSession.sparkContext.broadcast
    hits = window_hits(d, sizes, [n for n in lengths if n < SHINGLE], send(_bitmap(keys, "key"))).distinct()
    pairs = cut(hits.join(keys, "key").select("doc_id", "item_id").distinct())
    bits = send(_bitmap(shingles, "s"))

    @lean
    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct shingles of each text that an item may have."""
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi in slices(b.column(1)):
                w = Words(b.column(1).slice(lo, hi - lo))
                for words in lengths:
                    h, row = _shingles(w, words)
                    at = _flagged(bits.value, h)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][row[at]]), pa.array(signed(h[at]))], names=["doc_id", "s"])

    have = possibly_with(d, "doc_id", pairs.select("doc_id").distinct()).mapInArrow(known, "doc_id long, s long").distinct()
    want = pairs.join(shingles, "item_id").select(F.col("doc_id").alias("id"), "item_id", F.col("s").alias("t"))
    both = have.join(want, (F.col("doc_id") == F.col("id")) & (F.col("s") == F.col("t"))).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("k"))
    n = shingles.groupBy(F.col("item_id").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("words"))
    out = both.join(n, F.col("item_id") == F.col("item")).withColumn("containment", F.col("k") / F.col("n").cast("double"))
    return out.where(F.col("containment") >= threshold).select("doc_id", "item_id", "containment", "words")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, containment) of all pairs where docs (doc_id, text) hold an item (item_id, text).

    Containment is the part of the item's distinct 5-word shingles (lower-cased runs of letters, digits, underscore)
    that the document has, at least threshold; an item of fewer words is one shingle, so a document has it whole or not.
    Items without words, NULL or empty texts and rows with a NULL id are in no pair. Rows that repeat an id are one
    document or item with the shingles of all. Candidates come from 24 MinHash values for each window; only documents
    with a candidate are read again, and only shingles that some item may have are shuffled. item_id is a string.
    """
    return _with_words(docs, items, threshold).drop("words")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose document holds no item; rows with a NULL id stay.

    An item of fewer than 5 words, which ordinary prose has by chance, isn't reason enough to drop a document.
    """
    gone = cut(_with_words(docs, items, threshold).where(F.col("words") >= SHINGLE).select("doc_id").distinct())
    s, old, at = shield(docs, "doc_id")
    return drop_all(s, at["doc_id"], gone).select(*s.columns).toDF(*old)
