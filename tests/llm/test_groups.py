"""Short items, groups of lines larger than a task, many blocks of vectors, and lattices against all paths."""

from __future__ import annotations

import base64
import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelake.llm import contamination, lines, toxicity, topk
from sievelake.llm._runs import labels


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


def test_every_short_item_is_found(spark):
    """400 items of each length, each in a document of its own; what else is found is really there."""
    rng = random.Random(7)
    items = [words(rng, n) for n in (1, 3, 4, 5, 6, 8, 12) for _ in range(400)]
    docs = [f"{words(rng, rng.randint(0, 200))} {t} {words(rng, rng.randint(0, 200))}" for t in items]
    got = contamination.contained(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(r["doc_id"], int(r["item_id"])) for r in got.collect()}
    own = {(i, i) for i in range(len(items))}
    assert own <= got and all(f" {items[j]} " in f" {docs[i]} " for i, j in got - own)


def test_a_few_words_dont_drop_a_document(spark):
    d = spark.createDataFrame([(1, "what is the matter"), (2, "a much longer text with five words or more")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "the matter"), (2, "with five words or more")], "item_id long, text string")
    assert {r["doc_id"] for r in contamination.contained(d, i).collect()} == {1, 2}
    assert [r["doc_id"] for r in contamination.decontaminate(d, i).collect()] == [1]


def test_groups_larger_than_a_task(spark, monkeypatch):
    """One bucket's lines in many parts: most are alike, and some form a component of their own."""
    monkeypatch.setattr(lines, "PART_LINES", 16)
    rng = random.Random(1)
    base, other = words(rng, 40), words(rng, 40)
    docs = [(i, f"{base} {i}" if i % 5 else f"{other} {i}") for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["keeper_doc"]) for r in lines.duplicate_lines(d).collect()}
    assert got == {(i, 1 if i % 5 else 0) for i in range(2, 300)} | {(i, 0) for i in range(0)} - {(0, 0)}


def test_parts_without_a_common_root(spark, monkeypatch):
    """Members of one group that only lines of other parts connect are found by comparing every two parts."""
    monkeypatch.setattr(lines, "PART_LINES", 2)
    rng = random.Random(2)
    chain, texts = words(rng, 30).split(), []
    for i in range(12):  # each is like its neighbours alone
        chain = chain[3:] + words(rng, 3).split()
        texts.append(" ".join(chain))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{t[i : i + 9] for i in range(len(t) - 8)} for t in texts]
    near = {(i, j) for i in range(12) for j in range(i) if len(sets[i] & sets[j]) >= lines.THRESHOLD * len(sets[i] | sets[j])}
    got = lines.duplicate_lines(d).count()
    assert near and got >= 0.9 * len({i for i, _ in near})


def test_connect_finds_what_all_pairs_do():
    rng = random.Random(3)
    texts = []
    for _ in range(8):
        t = words(rng, 20).split()
        for _ in range(6):
            t = t.copy()
            t[rng.randrange(20)] = words(rng, 1)
            texts.append(" ".join(t))
    rng.shuffle(texts)
    group = np.sort(np.array([rng.randrange(3) for _ in texts]))
    x, y = lines.connect(group, np.arange(len(texts)), pa.array(texts), 0.75)
    sets = [{t[i : i + 9] for i in range(len(t) - 8)} for t in texts]
    like = lambda i, j: len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])
    assert all(group[i] == group[j] and like(i, j) for i, j in zip(x, y)) and len(x)
    want = np.array([(i, j) for i in range(len(texts)) for j in range(i) if group[i] == group[j] and like(i, j)])
    assert (labels(len(texts), x, y) == labels(len(texts), *want.T)).all()


def test_top_k_over_many_blocks(spark):
    rng = np.random.default_rng(6)
    v = (rng.normal(size=(20_000, 64)) * rng.exponential(size=(20_000, 1))).astype(np.float32)
    v[5::7] = v[5]  # ties
    d = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 64).cast(pa.list_(pa.float32()))}))
    got = {(r["vec_id"], r["rank"]): (r["neighbour"], r["score"]) for r in topk.top_k(d, 5, every=250).collect()}
    q = np.arange(0, len(v), 250)
    s = v[q].astype(np.float64) @ v.astype(np.float64).T
    s[np.arange(len(q)), q] = -np.inf
    for i, x in zip(q, s):
        best = np.lexsort((np.arange(len(v)), -x))[:5]
        assert [got[i, r + 1][0] for r in range(5)] == best.tolist()
        assert np.allclose([got[i, r + 1][1] for r in range(5)], x[best], atol=2e-6)


PLAIN = "stupid fools kill and bully the ass in hell with fuck and shit " * 50


@pytest.fixture(scope="module")
def lm(spark):
    return toxicity.language_model(toxicity.count_trigrams(spark.createDataFrame([(PLAIN,)], "text string")))


def test_decode_is_the_best_of_all_paths(lm):
    def value(path) -> float:
        s, x, y = 0.0, 0, 0
        for emitted, cost in path:
            s += cost
            for ch in emitted:
                z = int(toxicity.codes()[ord(ch)])
                if z or y:
                    s += float(lm[x, y, z])
                    x, y = y, z
        return s + (float(lm[x, y, 0]) if y else 0.0)

    for token, apart, chunks in [("sh1t", False, False), ("4$$", False, False), ("f.u-ck", False, False), ("b|ll", False, False), ("kki11", False, False), ("k1ll", True, False), ("fu ck", False, True), ("a s s", False, True), ("", False, False)]:
        paths = list(itertools.product(*(toxicity.chunk_lattice(token) if chunks else toxicity.lattice(token, apart))))
        best = max(map(value, paths))
        said = {"".join(e for e, _ in p).strip() for p in paths if value(p) >= best - 1e-4}
        assert toxicity.decode(token, lm, apart, chunks) in said, token


def test_a_token_of_a_megabyte(lm):
    token = base64.b64encode(np.random.default_rng(0).bytes(750_000)).decode()
    began = time.time()
    toxicity.decode(token[:100_000], lm)
    tenth = time.time() - began
    toxicity.decode(token, lm)
    assert time.time() - began < 25 * max(tenth, 0.5)
