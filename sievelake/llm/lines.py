"""Fuzzy line dedup: character-shingle MinHash, banding, exact Jaccard verification and distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._runs import labels, run_edges, runs
from ._store import cut, narrow, possibly_with, shield, split_by
from ._text import codepoints, lean, mix, prefix_hash, signed, slices, span_hash, tables

#: Characters of a shingle, hashes by band, bands, least Jaccard similarity, and characters from which lines may be similar
#: without being equal.
SHINGLE, BAND_ROWS, BANDS, THRESHOLD, MIN_CHARS = 9, 4, 8, 0.75, 20
#: Sketches of unrelated lines differ in 32 of 64 bits on average, of lines at the threshold in 8.
SKETCH_LIMIT = 18
#: Lines and characters of a group that one task compares; larger groups are compared in parts.
PART_LINES, PART_CHARS = 2048, 1 << 21
_MULT = (mix(np.arange(1, 1 + BAND_ROWS * BANDS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class Lines:
    """Lines of a string column in normal form: lower case, white space as one blank, none at the ends.

    Only lines with at least min_chars characters in normal form are kept. number is the place in the document.
    """

    def __init__(self, texts: pa.Array, min_chars: int):
        lower, _, space = tables()
        cp, offs = codepoints(texts)
        blank = space[cp]
        newline = np.flatnonzero(cp == 10)
        blank[newline] = False
        cp = lower[cp]
        cp[blank] = 32
        double = blank[1:] & blank[:-1]
        double[offs[(offs > 0) & (offs < len(cp))] - 1] = False
        if double.any():
            gone = np.flatnonzero(double) + 1
            cp = np.delete(cp, gone)
            offs, newline = offs - np.searchsorted(gone, offs), newline - np.searchsorted(gone, newline)
        self.cp, self.offs = cp, offs
        s = np.sort(np.concatenate([offs[:-1], newline + 1]))
        e = np.sort(np.concatenate([newline, offs[1:]]))
        count = 1 + np.searchsorted(newline, offs[1:]) - np.searchsorted(newline, offs[:-1])
        row = np.repeat(np.arange(len(count)), count)
        number = np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
        some = np.flatnonzero(e > s)
        s, e, row, number = s[some], e[some], row[some], number[some]
        s = s + (cp[s] == 32)
        e = e - ((e > s) & (cp[e - 1] == 32))
        ok = e - s >= max(min_chars, 1)
        self.start, self.end, self.row, self.number = s[ok], e[ok], row[ok], number[ok]
        self.p, self.inv = prefix_hash(self.cp)
        self.hash = span_hash(self.p, self.inv, self.start, self.end)

    def text(self, i: int) -> str:
        return self.cp[self.start[i] : self.end[i]].tobytes().decode("utf-32-le")

    def shingles(self, which: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of the chosen lines in a row, and where each line's begin; a line shorter than k has one."""
        s, e = self.start[which], self.end[which]
        size = np.maximum(e - s - k + 1, 1)
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(first[-1]) - np.repeat(first[:-1] - s, size)
        to = np.minimum(at + k, np.repeat(e, size))
        return mix((self.p[to] - self.p[at]) * self.inv[at]), first


def signatures(x: Lines, which: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """MinHash values (lines, BANDS * BAND_ROWS) of the chosen lines' k-character shingles; none is shorter than k."""
    h = x.p[k:] - x.p[:-k]
    h *= x.inv[: len(h)]
    low = (h >> np.uint64(32)).astype(np.uint32)
    low ^= low >> np.uint32(16)
    # from each line's first shingle up to behind its last; what lies between two lines is computed and left out
    ends = x.end[which] - k + 1
    at = np.stack([x.start[which], ends], axis=1).ravel()
    if at[-1] >= len(low):
        at = at[:-1]
    out = np.empty((len(which), len(_MULT)), np.uint32)
    v = np.empty_like(low)
    for j, a in enumerate(_MULT):
        np.multiply(low, a, out=v)
        out[:, j] = np.minimum.reduceat(v, at)[::2]
    return out


def bands(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (lines, BANDS) and 64-bit sketches of signatures."""
    s = sig.astype(np.uint64).reshape(len(sig), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS))
    for j in range(BAND_ROWS):
        key = mix(key * np.uint64(0x100000001B3) + s[:, :, j])
    two = mix(sig.astype(np.uint64)) >> np.uint64(62)
    shift = np.arange(0, 64, 2, dtype=np.uint64)[: sig.shape[1]]
    return key, np.bitwise_or.reduce(two << shift, axis=1)


def positions(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """(h, doc_id, line_no, size) of all lines with at least `shortest` characters, of documents with an id."""

    @lean
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi in slices(b.column(1)):
                x = Lines(b.column(1).slice(lo, hi - lo), shortest)
                yield pa.RecordBatch.from_arrays([pa.array(signed(x.hash)), pa.array(ids[lo:hi][x.row]), pa.array(x.number.astype(np.int32)), pa.array((x.end - x.start).astype(np.int32))], names=["h", "doc_id", "line_no", "size"])

    return narrow(docs, "doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(part, "h long, doc_id long, line_no int, size int")


def candidates(docs: DataFrame, min_chars: int) -> DataFrame:
    """(g, h): groups of line hashes in which, by shared bands and near sketches, lines may be similar.

    A group is what near sketches connect within a band's bucket; its name comes from its members, so that the same
    group in several bands is compared once. A bucket too long for one task is one group.
    """

    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for b in batches:
            for lo, hi in slices(b.column(0)):
                x = Lines(b.column(0).slice(lo, hi - lo), min_chars)
                h, at = np.unique(x.hash, return_index=True)
                new = ~np.isin(h, seen, assume_unique=True)
                h, at = h[new], at[new]
                if not len(h):
                    continue
                if len(seen) > 200_000:  # only a memory of what was emitted; repetitions are dropped later
                    seen = seen[:0]
                seen = np.concatenate([seen, h])
                at = np.sort(at)
                h = x.hash[at]
                key, sketch = bands(signatures(x, at))
                yield pa.RecordBatch.from_arrays([pa.array(signed(key.ravel())), pa.array(np.repeat(signed(h), BANDS)), pa.array(np.repeat(signed(sketch), BANDS))], names=["key", "h", "sketch"])

    rows = narrow(docs, "text").where("text is not null").mapInArrow(emit, "key long, h long, sketch long")
    rows = rows.repartition("key").sortWithinPartitions("key", "h")

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, open_, more in runs(batches, ("key",)):
            key, h, sketch = (t[c].to_numpy() for c in ("key", "h", "sketch"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
            key, h, sketch = key[new], h[new], sketch[new]
            g = mix(key.view(np.uint64))
            if not (open_ or more):
                x, y = run_edges(key, sketch.view(np.uint64)[:, None], SKETCH_LIMIT)
                at = np.unique(np.concatenate([x, y]))
                lab = labels(len(key), x, y)[at]
                at = at[np.argsort(lab, kind="stable")]
                lab = np.sort(lab)
                first = np.flatnonzero(np.concatenate([[True], lab[1:] != lab[:-1]])) if len(lab) else at
                h = h[at]
                g = np.repeat(mix(np.add.reduceat(mix(h.view(np.uint64)), first)), np.diff(np.append(first, len(h)))) if len(h) else h.view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(g)), pa.array(h)], names=["g", "h"])

    return rows.mapInArrow(compare, "g long, h long").distinct()


def connect(group: np.ndarray, root: np.ndarray, texts: pa.Array, threshold: float, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places whose exact shingle sets have a Jaccard similarity of threshold or more.

    Within each group (sorted) they connect what all such pairs of the group would connect, given that lines of one root
    are connected already: a walk compares each line of a growing component with the lines that have none yet.
    """
    x = Lines.__new__(Lines)
    x.cp, offs = codepoints(texts)
    x.start, x.end = offs[:-1], offs[1:]
    x.p, x.inv = prefix_hash(x.cp)
    n = len(group)
    flat, first = x.shingles(np.arange(n), k)
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        v = np.sort(flat[a:b])
        sets.append(v[np.concatenate([[True], v[1:] != v[:-1]])])
    size = np.array([len(v) for v in sets])
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    border = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if n else [0]
    for lo, hi in zip(border[:-1], border[1:]):
        rest = np.arange(lo, hi)
        while len(rest) > 1:
            same = root[rest] == root[rest[0]]
            queue, rest = rest[same].tolist(), rest[~same]
            while queue and len(rest):
                i = queue.pop()
                # sets whose sizes differ too much can't be similar
                may = rest[np.minimum(size[rest], size[i]) >= threshold * np.maximum(size[rest], size[i])]
                for step in np.array_split(may, 1 + int(size[may].sum()) // 2_000_000):
                    if not len(step):
                        continue
                    v = np.concatenate([sets[j] for j in step.tolist()])
                    at = np.searchsorted(sets[i], v)
                    at[at == size[i]] = 0
                    inter = np.add.reduceat(sets[i][at] == v, np.cumsum(size[step]) - size[step], dtype=np.int64)
                    hit = step[inter >= threshold * (size[i] + size[step] - inter)]
                    if len(hit):
                        out_a.append(np.full(len(hit), i))
                        out_b.append(hit)
                        joined = np.isin(root[rest], root[hit])
                        queue.extend(rest[joined].tolist())
                        rest = rest[~joined]
    return np.concatenate(out_a), np.concatenate(out_b)


def verified(docs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Edges (x, y) of line hashes with similar shingle sets, of groups members (g, part, h, root, id).

    id is a document that has the line; each text goes from there to all its groups, of which a line has few.
    """
    want = cut(members.groupBy("h").agg(F.first("id").alias("id"), F.collect_list(F.struct("g", "part", "root")).alias("to")))
    by_doc = want.groupBy("id").agg(F.collect_list(F.struct("h", "to")).alias("want"))
    d = narrow(docs, "doc_id", "text").where("text is not null")
    d = possibly_with(d, "doc_id", want.select("id").distinct())
    d = d.join(by_doc, d["doc_id"] == by_doc["id"]).select("text", F.col("want.h").alias("h"), F.col("want.to").alias("to"))

    @lean
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(0)):
                x = Lines(b.column(0).slice(lo, hi - lo), 1)
                line = np.searchsorted(x.row, np.arange(hi - lo + 1))
                hash_ = signed(x.hash)
                out: list[tuple] = []
                for i in range(hi - lo):
                    of = dict(zip(b.column(1)[lo + i].as_py(), b.column(2)[lo + i].as_py()))
                    for j in range(line[i], line[i + 1]):
                        h = int(hash_[j])
                        if (to := of.pop(h, None)) is not None:
                            text = x.text(j)
                            out += [(t["g"], t["part"], h, t["root"], text) for t in to]
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["g", "part", "h", "root", "text"])

    lines = d.mapInArrow(fetch, "g long, part long, h long, root long, text string").repartition("g", "part").sortWithinPartitions("g", "part", "h")

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without rows like the one before: a document that is there twice brings its lines twice."""
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(i).to_numpy() for i in range(3)])
            new = np.concatenate([[before is None or (at[:, 0] != before).any()], (at[:, 1:] != at[:, :-1]).any(0)])
            before = at[:, -1]
            yield b.filter(pa.array(new))

    @lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, _ in runs(fresh(batches), ("g", "part")):
            g, part, h, root = (t[c].to_numpy() for c in ("g", "part", "h", "root"))
            texts = t["text"].combine_chunks()
            chars = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (part[1:] != part[:-1])]))
            # whole groups, so many at once as have about PART_CHARS characters
            block = np.cumsum(chars)[begin] // PART_CHARS
            cut_at = begin[np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))]
            number = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(g))))
            for lo, hi in zip(cut_at, np.append(cut_at[1:], len(g))):
                x, y = connect(number[lo:hi], root[lo:hi], texts.slice(lo, hi - lo), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(h[lo:hi][x]), pa.array(h[lo:hi][y])], names=["x", "y"])

    return lines.mapInArrow(verify, "x long, y long")


def similar_lines(docs: DataFrame, first: DataFrame, threshold: float, min_chars: int) -> DataFrame:
    """(h, root): line hashes in a component of two or more similar lines, and the component's least hash.

    Candidate pairs are verified first, by exact Jaccard similarity of their shingle sets; union-find then joins the
    verified edges. Groups too large for one task are split by hash, differently in each group, so that several bands
    connect the parts; of a split group that is still in several components, every two parts are compared as well.
    """
    place = first.select(F.col("h").alias("__h"), "size", F.col("p.doc_id").alias("id"))
    m = cut(candidates(docs, min_chars).join(place, F.col("h") == F.col("__h")).select("g", "h", "size", "id"))
    size = m.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"))
    parts = F.greatest(F.ceil(F.col("n") / PART_LINES), F.ceil(F.col("chars") / PART_CHARS))
    large = cut(size.select(F.col("g").alias("__g"), parts.alias("parts")).where("parts > 1"))
    whole = m.withColumn("part", F.lit(0).cast("long")).withColumn("root", F.col("h"))
    if large.isEmpty():
        return components(verified(docs, whole, threshold)).select(F.col("node").alias("h"), "root")
    part = F.coalesce(F.pmod(F.xxhash64("g", "h"), F.col("parts")), F.col("part"))
    m = cut(whole.join(large, F.col("g") == F.col("__g"), "left").withColumn("part", part).select("g", "part", "h", "root", "id", "parts"))
    edges = cut(verified(docs, m, threshold))
    c = cut(components(edges))
    rest = m.where("parts > 1").drop("root").join(c, F.col("h") == F.col("node"), "left").withColumn("root", F.coalesce("root", "h"))
    open_ = rest.groupBy(F.col("g").alias("__g")).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("__g")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    pairs = rest.join(open_, F.col("g") == F.col("__g"), "left_semi").withColumn("other", other).where("other <> part")
    pair = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    more = verified(docs, pairs.withColumn("part", pair).select("g", "part", "h", "root", "id"), threshold)
    return components(edges.union(more)).select(F.col("node").alias("h"), "root")


def duplicate_lines(docs: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS, shortest: int = 1) -> DataFrame:
    """(doc_id, line_no, h, keeper_doc, keeper_line) of every line that equals or resembles an earlier one.

    Lines are compared in lower case with white space as one blank; blank ones don't count. Lines with at least
    min_chars characters are similar if their sets of 9-character shingles have a Jaccard similarity of at least
    threshold; shorter lines only if they are equal. By default that holds however short they are; where lines like a
    closing bracket matter, as in source code, `shortest` gives the characters under which lines never count. Of each
    connected component the line with the least (doc_id, line_no) is kept, in this or in any other document.
    """
    if not SHINGLE <= min_chars >= shortest:
        raise ValueError(f"min_chars must be at least {SHINGLE}, and not under shortest")
    where = cut(positions(docs, shortest))
    first = cut(where.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("p"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size")))
    near = similar_lines(docs, first, threshold, min_chars).toDF("__h", "g")
    all_ = cut(first.join(near, F.col("h") == F.col("__h"), "left").select("h", "p", "n", "g"))
    keep = all_.where("g is not null").groupBy(F.col("g").alias("__g")).agg(F.min("p").alias("k"))
    alike = all_.join(keep, F.col("g") == F.col("__g")).select(F.col("h").alias("__h"), "k")
    alike = cut(alike.union(all_.where("g is null and n > 1").select("h", "p")))
    p = possibly_with(where, "h", alike.select("__h"))
    p = p.join(alike, p["h"] == alike["__h"]).where("doc_id <> k.doc_id or line_no <> k.line_no")
    return p.select("doc_id", "line_no", "h", F.col("k.doc_id").alias("keeper_doc"), F.col("k.line_no").alias("keeper_line")).distinct()


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS, shortest: int = 1, drop_emptied: bool = False) -> DataFrame:
    """docs, all columns, without the lines that duplicate_lines() names; drop_emptied: nor documents left without text.

    Rows with NULL text or NULL doc_id stay as they are, and so do empty texts and blank lines. Rows that repeat an id
    are one document: a line that stays in one of them stays in all. Only documents that may lose a line are shuffled.
    """
    gone = cut(duplicate_lines(docs, threshold, min_chars, shortest).groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h")).alias("gone")))
    gone = gone.select(F.col("doc_id").alias("__sl_id"), F.col("gone.line_no").alias("__sl_n"), F.col("gone.h").alias("__sl_h"))
    s, old, at = shield(docs, "doc_id", "text")
    clear, touched = split_by(s, at["doc_id"], gone.select("__sl_id"))
    touched = touched.join(gone, touched[at["doc_id"]] == gone["__sl_id"], "left").drop("__sl_id")
    place = s.columns.index(at["text"])
    names, width = s.columns, len(s.columns)

    @lean
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, new, keep = b.column(place), [], []
            for lo, hi in slices(texts):
                x = Lines(texts.slice(lo, hi - lo), 1)
                first = np.searchsorted(x.row, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    text, lines = texts[lo + i].as_py(), b.column(width)[lo + i].as_py()
                    if text is not None and lines:
                        known = dict(zip(x.number[first[i] : first[i + 1]].tolist(), signed(x.hash[first[i] : first[i + 1]]).tolist()))
                        drop = {n for n, h in zip(lines, b.column(width + 1)[lo + i].as_py()) if known.get(n) == h}
                        text = "\n".join(t for n, t in enumerate(text.split("\n")) if n not in drop)
                        keep.append(not drop or not drop_emptied or bool(text.strip()))
                    else:
                        keep.append(True)
                    new.append(text)
            cols = [b.column(i) if i != place else pa.array(new, b.column(i).type) for i in range(width)]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    touched = touched.select(*s.columns, "__sl_n", "__sl_h").mapInArrow(rewrite, s.schema)
    return (touched if clear is None else clear.select(*s.columns).unionByName(touched)).toDF(*old)
