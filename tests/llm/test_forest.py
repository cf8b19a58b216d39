"""The forest reaches its recall at the largest distance of near-duplicates, and its depths follow the density."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from sievelake.llm import _runs, simhash

TRIES = [simhash.tries_for(d) for d in simhash.DEPTHS]


def flipped(rng, prints: np.ndarray, bits: int) -> np.ndarray:
    flips = np.zeros((len(prints), simhash.BITS), np.uint8)
    np.put_along_axis(flips, rng.permuted(np.tile(np.arange(simhash.BITS), (len(prints), 1)), axis=1)[:, :bits], 1, axis=1)
    return prints ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)


def counts(prints: np.ndarray) -> np.ndarray:
    k = simhash.trie_keys(prints, range(simhash.PROBES), simhash.PROBE_DEPTH)
    return np.stack([np.bincount(k[:, t], minlength=1 << simhash.PROBE_DEPTH) for t in range(simhash.PROBES)])


@pytest.mark.parametrize("times", [1, 1_000, 100_000])
def test_recall_at_every_corpus_size(times):
    rng = np.random.default_rng(times)
    a = rng.integers(0, 1 << 63, (20_000, 4), dtype=np.uint64)
    # of half of them, 100 of 256 bits are as in one text, so that they crowd in one region
    mask = np.packbits(np.arange(256) < 100, bitorder="little").view(np.uint64)
    a[::2] = (a[0] & mask) | (a[::2] & ~mask)
    n = counts(a) * times
    own = simhash.own_depths(a, n, simhash.DEPTHS, TRIES)
    assert np.mean(own[::2]) > np.mean(own[1::2]) or times != 1_000  # denser is deeper
    some = rng.choice(len(a), 600, replace=False)
    for d in (29, 36, simhash.MAX_DISTANCE):
        b = flipped(rng, a[some], d)
        meet = np.minimum(own[some], simhash.own_depths(b, n, simhash.DEPTHS, TRIES))
        found = 0
        for u in np.unique(meet):
            at = meet == u
            t = range(TRIES[u])
            found += (simhash.trie_keys(a[some][at], t, simhash.DEPTHS[u]) == simhash.trie_keys(b[at], t, simhash.DEPTHS[u])).any(1).sum()
        assert found >= 0.92 * len(some), (times, d, found)


def test_larger_corpora_are_searched_deeper():
    a = np.random.default_rng(1).integers(0, 1 << 63, (20_000, 4), dtype=np.uint64)
    deep = [np.median(simhash.own_depths(a, counts(a) * t, simhash.DEPTHS, TRIES)) for t in (1, 100, 10_000)]
    assert deep[0] < deep[1] < deep[2]


@pytest.mark.parametrize("n", [500, 20_000])
def test_edges_at_the_largest_distance(spark, n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64)
    b = flipped(rng, a[:400], simhash.MAX_DISTANCE)
    t = np.concatenate([a, b]).view(np.int64)
    d = spark.createDataFrame(pa.table({"doc_id": np.arange(len(t)), **{c: np.ascontiguousarray(t[:, i]) for i, c in enumerate("abcd")}}))
    got = {(r["x"], r["y"]) for r in simhash.edges(d).collect()}
    want = {(i, n + i) for i in range(400)}
    assert got <= want and len(got) >= 0.92 * len(want)


def test_pairs_of_a_run():
    rng = np.random.default_rng(4)
    for n in (5, 40, 200):
        base = rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
        prints = flipped(rng, base[rng.integers(0, 6, n)], 20)
        key, ask = np.sort(rng.integers(0, 2, n)), rng.random(n) < 0.6
        x, y = _runs.run_edges(key, prints, simhash.MAX_DISTANCE, ask)
        pairs = [(i, j) for i in range(n) for j in range(i) if key[i] == key[j] and (ask[i] or ask[j]) and simhash.distance(prints[i], prints[j]) <= simhash.MAX_DISTANCE]
        want = _runs.labels(n, *np.array(pairs or np.zeros((0, 2), int)).T)
        assert (_runs.labels(n, x, y) == want).all()


def test_long_runs_come_in_pieces():
    rng = np.random.default_rng(0)
    for _ in range(100):
        k = np.sort(rng.integers(0, rng.integers(1, 8), rng.integers(1, 60)))
        cuts = np.sort(rng.integers(0, len(k) + 1, 8))
        batches = [pa.RecordBatch.from_arrays([pa.array(k[a:b]), pa.array(np.arange(a, b))], names=["k", "v"]) for a, b in zip([0, *cuts], [*cuts, len(k)])]
        seen, before = [], None
        for t, open_, more in _runs.runs(iter(batches), ("k",), 5):
            here = t["k"].to_numpy()
            assert not (open_ or more) or len(set(here)) == 1
            assert open_ == (before is not None and before == here[0])
            before = here[-1]
            seen += t["v"].to_numpy().tolist()
        assert seen == list(range(len(k)))


def pairs_of_texts(seed: int, n: int) -> list[str]:
    """n texts of 60 to 140 words, and a copy of each with so many other words that they are about as far as allowed."""
    rng = np.random.default_rng(seed)
    texts, copies = [], []
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, rng.integers(60, 140))]
        other = [f"w{x}" if rng.random() < 0.13 else w for w, x in zip(words, rng.integers(0, 1 << 40, len(words)))]
        texts.append(" ".join(words))
        copies.append(" ".join(other))
    return texts + copies


@pytest.mark.parametrize("recall", [0.95, 0.05])
def test_groups_are_those_of_all_pairs(spark, recall):
    texts = pairs_of_texts(7, 1_500)
    prints, _ = simhash.fingerprints(pa.array(texts))
    x, y = [], []
    for i in range(len(prints)):
        j = i + 1 + np.flatnonzero(_runs.distance(prints[i + 1 :], prints[i]) <= simhash.MAX_DISTANCE)
        x += [i] * len(j)
        y += j.tolist()
    far = _runs.distance(prints[x], prints[y]) >= simhash.MAX_DISTANCE - 4
    assert far.sum() > 150
    lab = _runs.labels(len(prints), np.array(x), np.array(y))
    size = np.bincount(lab, minlength=len(lab))
    want = {(i, int(k)) for i, k in enumerate(lab) if size[k] > 1}
    d = spark.createDataFrame(pa.table({"doc_id": np.arange(len(texts)), "text": texts})).repartition(4)
    assert {(r["doc_id"], r["keeper"]) for r in simhash.near_duplicates(d, recall=recall).collect()} == want


@pytest.mark.parametrize("n", [1, 2, 700, 9_000])
@pytest.mark.parametrize("share", [0.3, 1.0])
def test_sweep_compares_every_pair(n, share):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, (max(1, n // 3), 4), dtype=np.uint64)
    prints = flipped(rng, base[rng.integers(0, len(base), n)], 21)
    prints[n // 2 :: 5] = flipped(rng, prints[: len(prints[n // 2 :: 5])], simhash.MAX_DISTANCE)
    split, lab = max(1, int(share * n)), np.arange(n)
    x, y = _runs.missing_edges(prints, split, lab, simhash.MAX_DISTANCE)
    assert (_runs.distance(prints[x], prints[y]) <= simhash.MAX_DISTANCE).all()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(split):
        j = (i + 1 if split == n else split) + np.flatnonzero(_runs.distance(prints[i + 1 if split == n else split :], prints[i]) <= simhash.MAX_DISTANCE)
        a.append(np.full(len(j), i))
        b.append(j)
    want = _runs.labels(n, np.concatenate(a), np.concatenate(b))
    assert (_runs.labels(n, x, y) == want).all()
    # what is together already gives no pairs, and any distance is one that may be asked for
    assert not len(_runs.missing_edges(prints, split, want, simhash.MAX_DISTANCE)[0])
    assert n > 700 or split == n == 1 or (_runs.labels(n, *_runs.missing_edges(prints, split, lab, 256)) == 0).all()


def test_parts_of_the_sweep(spark, monkeypatch):
    assert [simhash.sweep_parts(n) for n in (0, 1, 2048, 9_000, 250_000, 14_000_000)] == [1, 1, 1, 5, 8, 96]
    assert all(n / simhash.sweep_parts(n) <= simhash.SWEEP_HELD for n in (10**8, 10**9))
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, (200, 4), dtype=np.uint64)
    t = np.concatenate([a, flipped(rng, a[:100], simhash.MAX_DISTANCE)]).view(np.int64)
    d = spark.createDataFrame(pa.table({"doc_id": np.arange(len(t)), **{c: np.ascontiguousarray(t[:, i]) for i, c in enumerate("abcd")}}))
    none = spark.createDataFrame([], "node long, root long")
    for rows in (1, 60, 1_000):
        monkeypatch.setattr(simhash, "sweep_parts", lambda n: min(12, -(-n // rows)))
        assert {(r["x"], r["y"]) for r in simhash.missed(d, none).collect()} == {(i, 200 + i) for i in range(100)}
