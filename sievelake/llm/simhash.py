"""Near-duplicate documents by 256-bit SimHash fingerprints, an LSH forest and a sweep over what it leaves apart.

Each try is a trie over randomly permuted bits. Where documents are sparse, short prefixes with few tries reach the target
recall; where they are dense, longer prefixes with more tries do so with fewer comparisons. Each document chooses its own
prefix depth from the density around it, and two documents are compared at the shorter of their depths, so that the
recall at the largest distance holds for every pair, whatever the size of the corpus. What the forest misses is found by
a sweep that compares every two fingerprints of different groups, so the groups are those of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._runs import distance, labels, missing_edges, run_edges, runs
from ._store import cut, drop_all, narrow, shield
from ._text import Words, lean, mix, slices

BITS = 256
#: Largest Hamming distance of near-duplicates: a cosine of about 0.87 between the sets of words.
MAX_DISTANCE = 42
#: Prefix depths between which documents choose.
DEPTHS = (8, 12, 16, 20, 24, 28, 32)
#: Tries in which density is counted, and the depth of those counts: fixed, so 0.5 MB whatever the corpus.
PROBES, PROBE_DEPTH = 4, 14
#: What planting a document in a try costs, in comparisons: a row of about 60 bytes is shuffled and sorted.
PLANT_COST = 500
#: Fingerprints of a part of the sweep, into how many parts small and large corpora are cut, and the most that a part may
#: hold at any size: each fingerprint is shuffled once for every part.
SWEEP_ROWS, SWEEP_LEAST, SWEEP_MOST, SWEEP_HELD = 32_768, 8, 96, 1_000_000
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)
_SEEDS = mix(np.arange(1, 5, dtype=np.uint64))


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, four 64-bit words each, of the set of lower-cased words, and the number of distinct words.

    A bit is set if more than half of the distinct words set it. Without words the fingerprint is 0.
    """
    w = Words(texts)
    n = len(texts)
    order = np.lexsort((w.hash, w.row))
    r, h = w.row[order], w.hash[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    r, h = r[new], h[new]
    size = np.bincount(r, minlength=n)
    out = np.zeros((n, 4), np.uint64)
    if not len(h):
        return out, size
    first = np.concatenate([[0], np.cumsum(size)])
    # eight counters of eight bits are added at once, so a run has at most 255 words
    lane = np.zeros((n, BITS), np.int32)
    block = 60_000
    for lo in range(0, len(h), block):
        hi = min(len(h), lo + block)
        inside = np.arange(lo, hi) - first[r[lo:hi]]
        start = np.flatnonzero((inside % 255 == 0) | (np.arange(lo, hi) == lo))
        bits = mix(h[lo:hi, None] ^ _SEEDS[None]).view(np.uint8).reshape(hi - lo, 32)
        part = np.add.reduceat(_SPREAD[bits], start, axis=0).view(np.uint8).astype(np.int32)
        rows = r[lo:hi][start]
        edge = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        lane[rows[edge]] += np.add.reduceat(part, edge, axis=0)
    on = (2 * lane > size[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64).reshape(n, 4), size


def tries_for(depth: int, max_distance: int = MAX_DISTANCE, recall: float = 0.95) -> int:
    """Tries after which two fingerprints at max_distance have shared a prefix of this depth with the given probability."""
    p = math.prod((BITS - max_distance - i) / (BITS - i) for i in range(depth))
    if p <= 0:
        raise ValueError("max_distance is too large for this depth")
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-p))) if p < 1 else 1


def trie_keys(prints: np.ndarray, tries: range, depth: int) -> np.ndarray:
    """The first depth bits of each try's random permutation, as numbers (rows, tries); the permutations are fixed."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), 32), axis=1, bitorder="little")
    bits = np.ascontiguousarray(bits.T)
    out = np.zeros((len(prints), len(tries)), np.int64)
    for i, t in enumerate(tries):
        k = np.zeros(len(prints), np.int64)
        for j in _permutation(t)[:depth].tolist():
            k <<= 1
            k |= bits[j]
        out[:, i] = k
    return out


@lru_cache(maxsize=4096)
def _permutation(t: int) -> np.ndarray:
    return np.random.default_rng([20240229, t]).permutation(BITS)


def choose_depths(cells: np.ndarray, depths: tuple[int, ...], tries: list[int]) -> np.ndarray:
    """Place in depths of each document's own depth, given the documents in its cells at the depths 0 to PROBE_DEPTH.

    From the deepest prefix it climbs to shorter ones as long as the fewer tries save more than the fuller cells cost.
    Below the counted depths, a cell thins out as it does above them.
    """
    last = cells[:, PROBE_DEPTH]
    thin = np.clip((last / np.maximum(cells[:, PROBE_DEPTH - 4], 1)) ** 0.25, 0.5, 0.95)
    cost = [t * (PLANT_COST + (cells[:, d] if d <= PROBE_DEPTH else last * thin ** (d - PROBE_DEPTH)) / 2) for d, t in zip(depths, tries)]
    return np.argmin(np.stack(cost), axis=0)


def density(prints: DataFrame) -> np.ndarray:
    """(PROBES, 2**PROBE_DEPTH): documents by prefix, over all of prints (doc_id, a, b, c, d)."""

    @lean
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PROBES << PROBE_DEPTH, np.int64)
        for b in batches:
            k = trie_keys(_prints(b), range(PROBES), PROBE_DEPTH) + (np.arange(PROBES) << PROBE_DEPTH)
            total += np.bincount(k.ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(PROBES << PROBE_DEPTH, np.int64)
    for r in prints.mapInArrow(part, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["at"]] = r["n"]
    return out.reshape(PROBES, -1)


def own_depths(prints: np.ndarray, counts: np.ndarray, depths: tuple[int, ...], tries: list[int]) -> np.ndarray:
    """Place in depths of each fingerprint's own depth, from density()."""
    k = trie_keys(prints, range(PROBES), PROBE_DEPTH)
    cells = np.zeros((len(prints), PROBE_DEPTH + 1))
    for d in range(PROBE_DEPTH + 1):
        sums = counts.reshape(PROBES, 1 << d, -1).sum(2)
        for t in range(PROBES):
            cells[:, d] += sums[t][k[:, t] >> (PROBE_DEPTH - d)]
    return choose_depths(cells / PROBES, depths, tries)


def _prints(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([b[c].to_numpy() for c in "abcd"], axis=1).view(np.uint64)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, a, b, c, d) of documents with an id and at least one word."""

    @lean
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo, hi in slices(texts):
                prints, size = fingerprints(texts.slice(lo, hi - lo))
                ok = pa.array(size > 0)
                cols = [ids.slice(lo, hi - lo), *(pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in range(4))]
                yield pa.RecordBatch.from_arrays([c.filter(ok) for c in cols], names=["doc_id", "a", "b", "c", "d"])

    return narrow(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(part, "doc_id long, a long, b long, c long, d long")


def edges(prints: DataFrame, max_distance: int = MAX_DISTANCE, recall: float = 0.95) -> DataFrame:
    """Verified pairs (x, y) of ids that connect near-duplicates; prints is a checkpointed fingerprint_table().

    Documents with one fingerprint are joined to the least id, and only that id enters the forest. The recall holds for
    each pair at max_distance; nearer pairs are found more often. A cell of over a million documents is compared in
    pieces, each with all later ones by what covers it to within a quarter of max_distance.
    """
    fp = ["a", "b", "c", "d"]
    heads = cut(prints.groupBy(*fp).agg(F.min("doc_id").alias("doc_id")).select("doc_id", *fp))
    counts = prints.sparkSession.sparkContext.broadcast(density(heads))
    depths = tuple(d for d in DEPTHS if d <= BITS - max_distance)
    tries = [tries_for(d, max_distance, recall) for d in depths]

    @lean
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = own_depths(_prints(b), counts.value, depths, tries)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int8))], names=[*b.schema.names, "own"])

    settled = cut(heads.mapInArrow(settle, "doc_id long, a long, b long, c long, d long, own byte"))
    used = sorted(r["own"] for r in settled.select("own").distinct().collect())  # at most as many as DEPTHS

    @lean
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b["own"].to_numpy()
            for lo in range(0, b.num_rows, 20_000):
                # a document is in the cells of its own depth, and in those of each shorter depth that others have
                for u in used:
                    at = lo + np.flatnonzero(own[lo : lo + 20_000] >= u)
                    if not len(at):
                        continue
                    s = b.take(pa.array(at))
                    prints = _prints(s)
                    for first in range(0, tries[u], 32):
                        some = range(first, min(first + 32, tries[u]))
                        # a cell's name: its prefix, with a one before it, and its try
                        name = mix(mix(np.array(some, np.uint64)) ^ (trie_keys(prints, some, depths[u]) | 1 << depths[u]).view(np.uint64))
                        take = pa.array(np.tile(np.arange(len(at)), len(some)))
                        cols = [pa.array(np.ascontiguousarray(name.T).ravel().view(np.int64)), pa.array(np.tile(own[at] == u, len(some))), *(s[c].take(take) for c in ("doc_id", *fp))]
                        yield pa.RecordBatch.from_arrays(cols, names=["cell", "ask", "doc_id", *fp])

    planted = settled.mapInArrow(plant, "cell long, ask boolean, doc_id long, a long, b long, c long, d long")
    # a cell that one document has needs no comparison, but finding that out costs what comparing costs
    planted = planted.repartition("cell").sortWithinPartitions("cell")

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover: list[np.ndarray] = []
        for t, open_, more in runs(batches, ("cell",)):
            cell, ids, ask, prints = t["cell"].to_numpy(), t["doc_id"].to_numpy(), t["ask"].to_numpy(), _prints(t)
            if open_ and cover:
                cell = np.concatenate([np.repeat(cell[:1], len(cover[0])), cell])
                ids, ask, prints = (np.concatenate([c, v]) for c, v in zip(cover, (ids, ask, prints)))
            x, y = run_edges(cell, prints, max_distance, ask)
            cover = []
            if more:
                lab, rest, keep = labels(len(ids), x, y), np.arange(len(ids)), []
                while len(rest):
                    keep.append(rest[0])
                    rest = rest[(lab[rest] != lab[rest[0]]) | (distance(prints[rest], prints[rest[0]]) > max_distance // 4)]
                cover = [v[keep] for v in (ids, ask, prints)]
            x, y = ids[x], ids[y]
            u = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u[:, 0])), pa.array(np.ascontiguousarray(u[:, 1]))], names=["x", "y"])

    near = planted.mapInArrow(compare, "x long, y long")
    low = heads.select(F.col("doc_id").alias("low"), *(F.col(c).alias(f"_{c}") for c in fp))
    same = prints.join(low, [F.col(c) == F.col(f"_{c}") for c in fp]).select("doc_id", "low")
    return near.union(same).where("x <> y")


def sweep_parts(n: int) -> int:
    """Into how many parts the sweep cuts n fingerprints; every two parts, and each with itself, are a task."""
    return max(1, min(SWEEP_LEAST, -(-n // 2048)), min(SWEEP_MOST, -(-n // SWEEP_ROWS)), -(-n // SWEEP_HELD))


def missed(prints: DataFrame, groups: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs (x, y) of roots of groups (node, root) that some two fingerprints within max_distance connect.

    Every two fingerprints of different groups are compared; a document in no group is its own root.
    """
    fp = ["a", "b", "c", "d"]
    rooted = prints.join(groups, F.col("doc_id") == F.col("node"), "left").select(*fp, F.coalesce("root", "doc_id").alias("root"))
    heads = cut(rooted.groupBy(*fp).agg(F.min("root").alias("root")))
    n = sweep_parts(heads.count())
    part, other = F.col("part"), F.col("other")
    cells = heads.withColumn("part", F.pmod(F.xxhash64(*fp), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    # the parts i <= j meet in cell j (j + 1) / 2 + i
    high = F.greatest(part, other)
    cells = cells.select((high * (high + 1) / 2 + F.least(part, other)).cast("int").alias("cell"), "part", "root", *fp)
    cells = cells.repartitionById(n * (n + 1) // 2, F.col("cell")).sortWithinPartitions("cell", "part")

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a cell is two parts, each of bounded size, so it never comes in pieces
        for t, _, _ in runs(batches, ("cell",), 1 << 62):
            cell, root, part, all_prints = t["cell"].to_numpy(), t["root"].to_numpy(), t["part"].to_numpy(), _prints(t)
            border = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            for lo, hi in zip(border[:-1], border[1:]):
                own, lab = np.unique(root[lo:hi], return_inverse=True)
                # of two parts, those of the first; of a part with itself (or whose other one is empty), all
                split = int(np.searchsorted(part[lo:hi], part[lo], side="right"))
                x, y = missing_edges(all_prints[lo:hi], split, lab, max_distance)
                x, y = own[lab[x]], own[lab[y]]
                u = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u[:, 0])), pa.array(np.ascontiguousarray(u[:, 1]))], names=["x", "y"])

    return cells.mapInArrow(compare, "x long, y long")


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, recall: float = 0.95) -> DataFrame:
    """(doc_id, keeper): every document in a group of two or more near-duplicates, and the group's least id, which stays.

    Two documents are near-duplicates if the 256-bit fingerprints of their word sets differ in at most max_distance
    bits; groups are the connected components over all such pairs. recall is that of the forest, which finds most of
    them; it decides how much is left to the sweep, not what is found. Documents without words (NULL, empty, only signs)
    and without an id are in no group. Rows that repeat an id are one document; with different texts, it is near to
    whatever either is near to.
    """
    prints = cut(fingerprint_table(docs).distinct())
    groups = cut(components(edges(prints, max_distance, recall)))
    more = cut(missed(prints, groups, max_distance).distinct())
    if not more.isEmpty():
        ends = more.select(F.col("x").alias("node")).union(more.select("y")).distinct()
        groups = groups.union(ends.select("node", F.col("node").alias("root"))).distinct()
        joined = components(more).toDF("old", "new")
        groups = groups.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return groups.select(F.col("node").alias("doc_id"), F.col("root").alias("keeper"))


def without_near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, recall: float = 0.95) -> DataFrame:
    """The rows of docs, with all their columns, less those whose document isn't its group's keeper."""
    gone = cut(near_duplicates(docs, max_distance, recall).where("doc_id <> keeper").select("doc_id"))
    s, old, at = shield(docs, "doc_id")
    return drop_all(s, at["doc_id"], gone).select(*s.columns).toDF(*old)
