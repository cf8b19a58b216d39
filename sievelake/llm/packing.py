"""Bounded-space online packing of documents into training windows."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import narrow, written
from ._text import codepoints, lean, slices, spans, tables

CAPACITY, OPEN_WINDOWS, MERGE = 2048, 64, 32
SCHEMA = "window string, n_tokens int, doc_ids array<long>, starts array<int>, lengths array<int>, texts array<string>"
_NAMES = ["window", "n_tokens", "doc_ids", "starts", "lengths", "texts"]


@dataclass
class Window:
    """An open window: tokens so far and its segments (doc_id, first token, tokens, text)."""

    n: int = 0
    segments: list[tuple[int | None, int, int, str]] = field(default_factory=list)


class Packer:
    """At most `places` open windows; best fit, and where none fits and no place is free, the fullest goes."""

    def __init__(self, capacity: int, places: int):
        self.capacity, self.places = capacity, places
        self.open: list[tuple[int, int, Window]] = []  # (free tokens, serial, window), in order
        self.serial = 0

    def add(self, n: int, segments: list[tuple[int | None, int, int, str]]) -> Window | None:
        """Place n tokens; the window that goes, if one does."""
        gone = None
        i = bisect.bisect_left(self.open, (n, -1))
        if i < len(self.open):
            _, _, w = self.open.pop(i)
        else:
            w = Window()
            if n < self.capacity and len(self.open) >= self.places:
                gone = self.open.pop(0)[2]
        w.n += n
        w.segments += segments
        if w.n >= self.capacity:
            assert gone is None, "a window that fills up was open, or takes no place"
            return w
        self.serial += 1
        bisect.insort(self.open, (self.capacity - w.n, self.serial, w))
        return gone

    def rest(self) -> list[Window]:
        return [w for _, _, w in self.open]


def _batch(named: list[tuple[str, Window]]) -> pa.RecordBatch:
    seg = [w.segments for _, w in named]
    cols = [pa.array([k for k, _ in named], pa.string()), pa.array([w.n for _, w in named], pa.int32())]
    for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string())):
        cols.append(pa.array([[s[i] for s in x] for x in seg], pa.list_(t)))
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def pieces(texts: pa.Array, capacity: int) -> Iterator[tuple[int, int, int, str]]:
    """(row, first token, tokens, text) of consecutive parts of at most capacity tokens; together the whole text."""
    _, _, space = tables()
    for lo, hi in slices(texts):
        cp, offs = codepoints(texts.slice(lo, hi - lo))
        s, _ = spans(~space[cp], offs)
        first = np.searchsorted(s, offs)
        for r in range(hi - lo):
            n = int(first[r + 1] - first[r])
            for a in range(0, n, capacity):
                b = min(n, a + capacity)
                start = offs[r] if a == 0 else s[first[r] + a]
                end = offs[r + 1] if b == n else s[first[r] + b]
                yield lo + r, a, b - a, cp[start:end].tobytes().decode("utf-32-le")


def segments(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[tuple[int, list[tuple[int | None, int, int, str]]]]:
    """Each piece of each text (doc_id, text) by itself: its tokens and its segment."""
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        for r, a, n, text in pieces(texts, capacity):
            yield n, [(ids[r].as_py(), a, n, text)]


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int | None, int, int, str]]]]:
    """The tokens and the segments of each window."""
    for b in batches:
        for lo in range(0, b.num_rows, OPEN_WINDOWS):
            for w in b.slice(lo, OPEN_WINDOWS).to_pylist():
                yield w["n_tokens"], list(zip(*(w[k] for k in _NAMES[2:])))


def windows(p: Packer, parts: Iterator[tuple[int, list[tuple[int | None, int, int, str]]]], gone: str, rest: str | None = None) -> Iterator[pa.RecordBatch]:
    """Windows of the parts as they go, a few in a batch, however many rows the parts come from; at last those still open.

    Names are a prefix and a number: gone and, from 0 again, rest; without rest the numbers of gone go on.
    """
    done: list[tuple[str, Window]] = []
    count = 0
    for n, segs in parts:
        if (w := p.add(n, segs)) is not None:
            done.append((f"{gone}{count}", w))
            count += 1
            if len(done) == OPEN_WINDOWS:
                yield _batch(done)
                done = []
    if done:
        yield _batch(done)
    if p.open:
        yield _batch([(f"{gone}{count + i}" if rest is None else f"{rest}{i}", w) for i, w in enumerate(p.rest())])


def pack(docs: DataFrame, capacity: int = CAPACITY, places: int = OPEN_WINDOWS, merge: int = MERGE) -> DataFrame:
    """Windows of at most capacity tokens (runs of non-space characters) that hold every token of docs once.

    window, n_tokens, and for each segment doc_ids, starts (first token in the document), lengths and texts; the texts
    of a document's segments, in order of starts, make up the document. Documents longer than a window are cut into
    full windows and a remainder. Each partition keeps `places` open windows, places best-fit, and lets the fullest go
    when none fits; what is open at its end is merged with that of about `merge` others in the same way. Texts
    without tokens (NULL, empty, blank) are in no window; NULL ids stay NULL; repeated rows are packed repeatedly.
    """
    from pyspark import TaskContext

    @lean
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, p = TaskContext.get().partitionId(), Packer(capacity, places)
        yield from windows(p, segments(batches, capacity), f"{me}-", f"open-{me}-")

    @lean
    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, p = TaskContext.get().partitionId(), Packer(capacity, places)
        yield from windows(p, opened(batches), f"m{me}-")

    d = narrow(docs, "doc_id", "text").where("text is not null")
    t = written(d.mapInArrow(first, SCHEMA), "windows")  # once, so that windows and leftovers fit together
    left = t.where(F.col("window").startswith("open-"))
    n = max(1, -(-d.rdd.getNumPartitions() // merge))
    merged = left.repartition(n, F.xxhash64("window")).sortWithinPartitions(F.desc("n_tokens"), "window").mapInArrow(second, SCHEMA)
    return t.where(~F.col("window").startswith("open-")).unionByName(merged)
