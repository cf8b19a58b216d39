"""Runs of equal keys in sorted Arrow batches, and what connects the rows of a run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of one run that a task holds at once.
RUN_ROWS = 1_000_000


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], limit: int = RUN_ROWS) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Sorted batches again, cut at the ends of runs of equal keys: (rows, open, more).

    A run longer than limit comes alone and in pieces: open says that it began in the piece before, more that it may
    go on in the next one. A task so never holds more than about limit rows and a batch.
    """
    kept: list[pa.RecordBatch] = []
    held, open_, tail = 0, False, None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        starts = np.flatnonzero(change) + 1
        if tail is not None and tail != [c[0] for c in cols]:
            if kept:
                yield pa.Table.from_batches(kept), open_, False
            kept, held, open_ = [], 0, False
        tail = [c[-1] for c in cols]
        if len(starts):
            lo, hi = 0, int(starts[-1])
            if open_:  # the long run ends in this batch; other runs follow
                lo = int(starts[0])
                yield pa.Table.from_batches([*kept, b.slice(0, lo)]), True, False
                kept, open_ = [], False
            if hi > lo:
                yield pa.Table.from_batches([*kept, b.slice(lo, hi - lo)]), False, False
            kept, held, b = [], 0, b.slice(hi)
        kept.append(b)
        held += b.num_rows
        if held > limit:
            yield pa.Table.from_batches(kept), open_, True
            kept, held, open_ = [], 0, True
    if kept:
        yield pa.Table.from_batches(kept), open_, False


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


#: Rows compared at once with as many columns as fit in a processor's cache, and the links from which a row is in a crowd.
TILE, COLUMNS, CROWD = 64, 4096, 32


def _near(mine: np.ndarray, ask: np.ndarray, tile: np.ndarray, asks: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of tile, column of mine) of all fingerprints, given by columns of words, that are near and one of them asks."""
    rows, cols = [], []
    for lo in range(0, mine.shape[1], COLUMNS):
        some = mine[:, lo : lo + COLUMNS]
        total = np.bitwise_count(tile[0][:, None] ^ some[0])
        for t, c in zip(tile[1:], some[1:]):
            total = np.add(total, np.bitwise_count(t[:, None] ^ c), dtype=np.uint16)
        i, j = np.nonzero(total <= limit)
        ok = asks[i] | ask[lo + j]
        rows.append(i[ok])
        cols.append(lo + j[ok])
    return np.concatenate(rows), np.concatenate(cols)


def run_edges(key: np.ndarray, prints: np.ndarray, limit: int, ask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with equal keys (sorted) whose fingerprints differ in at most limit bits; one of the two must ask.

    All such pairs, but in crowds: where a row of a run of over 48 is near to many others, a walk goes through its
    component and compares each member only with rows that aren't in it yet. That connects what all pairs would connect.
    """
    n = len(key)
    ask = np.ones(n, bool) if ask is None else ask
    border = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    length = np.diff(border)
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    small = np.repeat(length <= 48, length)
    left = np.repeat(border[1:], length) - np.arange(n)  # rows to the run's end
    columns = np.ascontiguousarray(prints.T)
    for s in range(1, min(48, int(length.max(initial=1)))):
        i = np.flatnonzero(small & (left > s))
        if not len(i):
            break
        i = i[ask[i] | ask[i + s]]
        total = np.zeros(len(i), np.uint16)
        for c in columns:
            total += np.bitwise_count(c[i] ^ c[i + s])
        i = i[total <= limit]
        out.append((i, i + s))
    for k in np.flatnonzero(length > 48):
        rest = np.arange(border[k], border[k + 1])
        rest = rest[np.argsort(~ask[rest], kind="stable")]  # those who ask first
        mine = np.ascontiguousarray(prints[rest].T)
        while len(rest) > 1 and ask[rest[0]]:
            size = min(TILE, len(rest))
            i, j = _near(mine, ask[rest], mine[:, :size], ask[rest[:size]], limit)
            i, j = i[j > i], j[j > i]
            crowd = np.flatnonzero(np.bincount(i, minlength=size) > CROWD)
            done = int(crowd[0]) if len(crowd) else size
            out.append((rest[i[i < done]], rest[j[i < done]]))
            rest, mine = rest[done:], mine[:, done:]
            queue = rest[:0]
            if len(crowd):
                queue, rest, mine = rest[:1], rest[1:], mine[:, 1:]
            while len(queue) and len(rest):
                tile, queue = queue[:TILE], queue[TILE:]
                i, j = _near(mine, ask[rest], np.ascontiguousarray(prints[tile].T), ask[tile], limit)
                j, one = np.unique(j, return_index=True)
                out.append((tile[i[one]], rest[j]))
                queue = np.concatenate([queue, rest[j]])
                keep = np.ones(len(rest), bool)
                keep[j] = False
                rest, mine = rest[keep], np.ascontiguousarray(mine[:, keep])
    return tuple(np.concatenate(x) for x in zip(*out))


def labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least place in the component of each of n places, given the pairs."""
    lab = np.arange(n)
    while len(x):
        low = np.minimum(lab[x], lab[y])
        new = lab.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


#: Bits that missing_edges() compares by a product of matrices, and rows that share a number in it: three sums of at most
#: twice 127 fit in the 24 bits of a float, so the product is exact.
SIFT, PACK = 127, 3
#: Rows of numbers and columns of a product.
SIFT_ROWS, SIFT_COLUMNS = 128, 1024


def _sift_left(prints: np.ndarray) -> np.ndarray:
    """(rows of numbers, SIFT + 1): number p holds the rows p, p + P and p + 2 P, for P numbers."""
    size = -(-len(prints) // PACK)
    out = np.zeros((size, SIFT + 1), np.float32)
    for k in range(PACK):
        some = prints[k * size : (k + 1) * size]
        out[: len(some), :SIFT] += np.unpackbits(some.view(np.uint8).reshape(len(some), 8 * some.shape[1]), axis=1, bitorder="little", count=SIFT) * np.float32(256**k)
        out[: len(some), SIFT] += 256**k
    return out


def _sift_right(prints: np.ndarray) -> np.ndarray:
    """(SIFT + 1, rows): times _sift_left(), byte k of a number is SIFT less the first bits in which the two rows differ."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), 8 * prints.shape[1]), axis=1, bitorder="little", count=SIFT)
    out = np.empty((SIFT + 1, len(prints)), np.float32)
    out[:SIFT] = bits.T
    out[SIFT] = SIFT - out[:SIFT].sum(0)
    out[:SIFT] *= 2
    out[:SIFT] -= 1
    return out


def missing_edges(prints: np.ndarray, split: int, lab: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that connect what lab (0 to n - 1, by place) has apart and a pair within limit bits connects.

    Every place before split is compared with every place from it on or, if split is n, with every other one. Pairs that
    differ in more than limit of their first bits are left out by that; of all others the whole distance is taken.
    """
    n = len(prints)
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    product = np.empty((SIFT_ROWS, SIFT_COLUMNS), np.float32)
    whole = np.empty(product.size, np.int32)
    mask = np.empty(4 * product.size, bool)
    step = PACK * SIFT_ROWS * 16
    for lo in range(0, split, step):
        hi = min(split, lo + step)
        left = _sift_left(prints[lo:hi])
        for c in range(lo if split == n else split, n, SIFT_COLUMNS):
            right = _sift_right(prints[c : c + SIFT_COLUMNS])
            width = right.shape[1]
            for r in range(0, len(left), SIFT_ROWS):
                some = left[r : r + SIFT_ROWS]
                m = np.matmul(some, right, out=product.reshape(-1)[: len(some) * width].reshape(len(some), width))
                w = whole[: m.size]
                np.copyto(w, m.reshape(-1), casting="unsafe")
                near = np.greater_equal(w.view(np.uint8), max(0, SIFT - limit), out=mask[: 4 * m.size])
                # first the columns with any, then the numbers in these, then their bytes
                numbers = near.view(np.uint32).reshape(m.shape)
                columns = np.flatnonzero(np.bitwise_or.reduce(numbers, axis=0))
                if not len(columns):
                    continue
                p, q = np.nonzero(numbers[:, columns])
                q = columns[q]
                at, k = np.nonzero(near.reshape(-1, 4)[p * width + q, :PACK])
                i, j = lo + r + p[at] + k * len(left), c + q[at]
                ok = i < hi
                if split == n:
                    ok &= i < j
                i, j = i[ok], j[ok]
                ok = lab[i] != lab[j]
                i, j = i[ok], j[ok]
                ok = distance(prints[i], prints[j]) <= limit
                if ok.any():
                    out.append((i[ok], j[ok]))
                    lab = labels(n, lab[i[ok]], lab[j[ok]])[lab]
    x, y = (np.concatenate(v) for v in zip(*out))
    return x, y
