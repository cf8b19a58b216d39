"""Vectorised text kernels: whole Arrow string columns as code-point arrays, hashed without per-row Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
#: Code points handled at once; one longer document is handled alone.
SLICE_CHARS = 1_500_000


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Simple lower-case map, word-character flag (letters, digits, underscore) and white-space flag by code point."""
    lower = np.arange(0x110000, dtype=np.uint32)
    word = np.zeros(0x110000, dtype=bool)
    space = np.zeros(0x110000, dtype=bool)
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isalnum() or i == 95:
            word[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
        elif c.isspace():
            space[i] = True
    return lower, word, space


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _B, dtype=np.uint64)
    down = np.full(n, _BINV, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(size):
        yield start, len(size)


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row and len(texts) + 1 offsets. NULL counts as empty; invalid bytes become U+FFFD."""
    texts = pc.fill_null(texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = b"" if data is None else memoryview(data)[offs[0] : offs[-1]]
    try:
        joined = str(raw, "utf-8")
        out = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    except UnicodeDecodeError:
        parts = [str(memoryview(data)[a:b], "utf-8", "replace") for a, b in zip(offs[:-1], offs[1:])]
        joined = "".join(parts)
        out = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), out


def release() -> None:
    """Give the system back what memory is free: the allocators keep it, and a Python worker outlives its task."""
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def lean(part: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that calls release() when its task ends."""

    @wraps(part)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from part(batches)
        finally:
            release()

    return run


def rows_of(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row of each position."""
    return np.searchsorted(offs, at, side="right") - 1


def spans(flag: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; a row border ends a run."""
    n = len(flag)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[offs] = True
    start = flag.copy()
    start[1:] &= ~flag[:-1] | border[1:n]
    end = flag.copy()
    end[:-1] &= ~flag[1:] | border[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def prefix_hash(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hash and the inverse powers; (p[e] - p[s]) * inv[s] is the hash of cp[s:e]."""
    up, down = powers(len(cp) + 1)
    p = np.zeros(len(cp) + 1, dtype=np.uint64)
    t = p[1:]
    np.add(cp, np.uint64(1), out=t)
    t *= up[: len(cp)]
    np.cumsum(t, out=t)
    return p, down


def span_hash(p: np.ndarray, inv: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((p[e] - p[s]) * inv[s])


class Words:
    """Lower-cased words (runs of letters, digits, underscore) of a string column: hash, row, start and end."""

    def __init__(self, texts: pa.Array):
        lower, word, _ = tables()
        cp, self.offs = codepoints(texts)
        self.cp = lower[cp]
        self.start, self.end = spans(word[cp], self.offs)
        self.p, self.inv = prefix_hash(self.cp)
        self.hash = span_hash(self.p, self.inv, self.start, self.end)
        self.first = np.searchsorted(self.start, self.offs)  # first word of each row, and the total
        self.row = np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and rows of the n-word shingles in text order; a row with fewer than n words has none."""
        total = len(self.hash)
        h = np.zeros(total, dtype=np.uint64)
        for j in range(min(n, total)):
            h[: total - j] += mix(self.hash[j:] ^ np.uint64((j + 1) * 0x9E3779B1)) * np.uint64(2 * j + 1)
        keep = np.arange(total) + n <= np.repeat(self.first[1:], np.diff(self.first))
        return mix(h[keep]), self.row[keep]

    def words(self, row: int) -> list[str]:
        """The words of one row."""
        lo, hi = self.first[row], self.first[row + 1]
        if lo == hi:
            return []
        base = self.start[lo]
        text = self.cp[base : self.end[hi - 1]].tobytes().decode("utf-32-le")
        return [text[a:b] for a, b in zip((self.start[lo:hi] - base).tolist(), (self.end[lo:hi] - base).tolist())]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's BIGINT."""
    return x.view(np.int64) if x.dtype == np.uint64 else x
