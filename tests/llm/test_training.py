"""Parts of the trained models against plain formulas."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from sievelake.llm import pii, quality
from sievelake.llm._text import Words


def test_a_newton_step(spark):
    rng = np.random.default_rng(1)
    n, d = 300, (5, 4)
    x = [np.concatenate([np.ones((n, 1)), rng.normal(size=(n, k - 1))], axis=1) for k in d]
    y = (rng.random(n) < 0.4).astype(float)
    w = rng.random(n)
    table = spark.createDataFrame([(i, x[0][i].tolist(), x[1][i].tolist(), float(y[i]), float(w[i])) for i in range(n)], "doc_id long, t array<float>, m array<float>, y double, w double").repartition(3)
    views = [quality.View(rng.normal(size=k), np.zeros(k), np.ones(k)) for k in d]
    want = []
    for v, z in zip(views, x):
        z = z.astype(np.float32).astype(float)
        p = 1 / (1 + np.exp(-z @ v.weights))
        ridge = np.full(len(v.weights), 0.01 * max(w.sum(), 1))
        ridge[0] = 1e-6
        h = sum(wi * pi * (1 - pi) * np.outer(r, r) for wi, pi, r in zip(w, p, z)) + np.diag(ridge + 1e-6)
        want.append(v.weights + np.linalg.solve(h, sum(wi * (yi - pi) * r for wi, yi, pi, r in zip(w, y, p, z)) - ridge * v.weights))
    quality._newton(table, views, lambda b, t, m: [(b.column(3).to_numpy(), b.column(4).to_numpy())] * 2, 1, 0.01)
    for v, x_ in zip(views, want):
        assert np.allclose(v.weights, x_, rtol=1e-6)


def test_views_teach_each_other():
    rng = np.random.default_rng(2)
    t, m = rng.normal(size=(200, 3)) * 3, rng.normal(size=(200, 2)) * 3
    said = [quality.View(rng.normal(size=k), np.zeros(k), np.ones(k), 1.3, 0.1) for k in (3, 2)]
    y, w, free = rng.integers(0, 2, 200).astype(float), (rng.random(200) < 0.3).astype(float), rng.random(200) < 0.6
    (ty, tw), (my, mw) = quality.exchange(said, y, w, free, t, m, 0.9, 0.25)
    for i in range(200):
        for other, x, gy, gw in ((said[1], m, ty, tw), (said[0], t, my, mw)):
            p = 1 / (1 + math.exp(-(1.3 * float(x[i] @ other.weights) + 0.1)))
            if free[i] and (p >= 0.9 or p <= 0.1):
                assert (gy[i], gw[i]) == (float(p > 0.5), 0.25)
            else:
                assert (gy[i], gw[i]) == (y[i], w[i])
    assert (tw == 0.25).any() and (mw == 0.25).any()


def test_words_count_by_fold(spark):
    docs = [(i, ("good fine word" if i % 2 else "bad poor word") + f" n{i}") for i in range(200)] + [(300, None), (None, "good")]
    y = spark.createDataFrame([(i, i % 2) for i in range(0, 200, 1)] + [(300, 1)], "label_id long, y int")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    n = quality.word_counts(d, y)
    assert n[:, :, -1].sum() == 200 and n[:, 0, -1].sum() == 100
    good, bad, word, new = quality._word_bucket(Words(pa.array(["good bad word unseen"])).hash)
    assert n[:, 1, good].sum() == 100 and n[:, 0, bad].sum() == 100 and n[:, :, word].sum() == 200
    w = quality.word_weights(n)
    assert (w[:, good] > 2).all() and (w[:, bad] < -2).all() and np.allclose(w[:, new], 0) and (np.abs(w[:, word]) < 0.1).all()
    # a document's own fold doesn't tell about it
    c = n.copy()
    c[2] = 0
    assert np.allclose(quality.word_weights(c)[2], w[2]) and not np.allclose(quality.word_weights(c)[3], w[3])
    assert not quality.word_weights(np.zeros_like(n)).any()


def test_the_field_learns_what_its_likelihood_says(spark):
    """By all paths: after training, the tags of the training sentences are likelier than before, and likely."""
    rows = [r for r in pii._sentences(60, 5) if len(r[0]) <= 4]
    table = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "sentence int, tokens array<string>, tags array<string>")

    def mean_log_likelihood(f: pii.Field) -> float:
        total = 0.0
        for tokens, tags in rows:
            em = pii._emissions(f, [[pii.shape(t) for t in tokens]], len(tokens))[0]
            value = lambda p: f.start[p[0]] + sum(em[i, k] for i, k in enumerate(p)) + sum(f.trans[a, b] for a, b in zip(p, p[1:]))  # noqa: E731,B023
            z = np.logaddexp.reduce([value(p) for p in itertools.product(range(len(pii.TAGS)), repeat=len(tokens))])
            total += value([pii.TAGS.index(t) for t in tags]) - z
        return total / len(rows)

    # no round leaves uniform tags, but for those that must follow their own kind
    start, short, long_ = (mean_log_likelihood(pii.train(table, rounds=r)) for r in (0, 5, 60))
    assert start < min(short, long_) and min(short, long_) > math.log(0.95)  # the decay lets the longer one be a little below


@pytest.mark.parametrize("shape", ["0" * 50, "a" * 1 + "-0" * 60, "@." * 40])
def test_whole_shapes_are_features(shape):
    assert f"s={shape}" in pii.shape_features(shape)
    assert pii.shape_features(shape) != pii.shape_features(shape[:-1] + "%")


HELD_OUT = [
    ("Please write to anna.schmidt@uni-bonn.de before Friday.", {("EMAIL", "anna.schmidt@uni-bonn.de")}),
    ("Call me: (415) 555-0132, any time", {("PHONE", "(415) 555-0132")}),
    ("my number is 212-555-0187 thanks", {("PHONE", "212-555-0187")}),
    ("The server at 192.168.10.24 is down again", {("IP", "192.168.10.24")}),
    ("SSN 078-05-1120 was printed on cards", {("SSN", "078-05-1120")}),
    ("card 4111 1111 1111 1111 expires soon", {("CARD", "4111 1111 1111 1111")}),
    ("Pay with 4111111111111111 or cash", {("CARD", "4111111111111111")}),
    ("In 1984, about 3.5 million people (12%) lived there.", set()),
    ("Version 2.10.3 fixes issue 4821; see chapter 7.", set()),
    ("The ratio was 3:2 on 2021-05-17 at 10:45", set()),
]


def test_sentences_that_no_generator_made(spark):
    field = pii.train(pii.labelled_table(spark))
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HELD_OUT)], "doc_id long, text string")
    got = {(r["doc_id"], r["kind"], r["value"]) for r in pii.find(d, field).collect()}
    want = {(i, k, v) for i, (_, x) in enumerate(HELD_OUT) for k, v in x}
    assert len(got & want) >= len(want) - 1 and len(got - want) <= 1
