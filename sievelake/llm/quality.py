"""Document quality by co-training of a text view and a metadata view.

Two logistic regressions, one on the text's words and what it is like and one on what is known about the page, start from
labels. In each round either one's confident verdicts on unlabelled documents join the other's training rows. In the end the two
calibrated views are combined, and every document gets a score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, narrow
from ._text import Words, codepoints, slices, spans, tables

#: Buckets into which sources and languages are hashed.
SOURCE_BUCKETS, LANG_BUCKETS = 32, 8
#: Buckets into which words are hashed.
WORD_BUCKETS = 1 << 16
TEXT_BASE = 18
TEXT_DIM = 1 + 2 * TEXT_BASE
META_DIM = 1 + 8 + LANG_BUCKETS + SOURCE_BUCKETS
FOLDS = 5


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and hashes of each row's distinct words, and how often each occurs."""
    order = np.lexsort((w.hash, w.row))
    r, h = w.row[order], w.hash[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new], np.diff(np.append(np.flatnonzero(new), len(r)))


def word_counts(docs: DataFrame, labels: DataFrame, max_lexicon: int = 20_000) -> np.ndarray:
    """(FOLDS, 2, WORD_BUCKETS + 1): labelled documents (label_id, y) by fold, label and hashed word; last, all of them.

    Whole texts count, each word once, of at most max_lexicon labelled documents, those with the least hash of the id;
    their ids are broadcast, so that no text is shuffled. What reaches the driver has this fixed size.
    """
    few = labels.orderBy(F.xxhash64("label_id"), "label_id").limit(max_lexicon).toPandas().astype({"label_id": "int64", "y": "int32"})
    labels = docs.sparkSession.createDataFrame(few, "label_id long, y int")
    width = WORD_BUCKETS + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FOLDS * 2 * width, np.int64)
        for b in batches:
            kind = b.column(1).to_numpy() * 2 + (b.column(2).to_numpy() > 0)
            for lo, hi in slices(b.column(0)):
                r, h, _ = _distinct(Words(b.column(0).slice(lo, hi - lo)))
                at = np.concatenate([kind[lo:hi][r] * width + _word_bucket(h), kind[lo:hi] * width + WORD_BUCKETS])
                total += np.bincount(at, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    d = narrow(docs, "doc_id", "text").where("text is not null")
    d = d.join(F.broadcast(labels), F.col("doc_id") == F.col("label_id")).select("text", _fold().alias("fold"), "y")
    out = np.zeros(FOLDS * 2 * width, np.int64)
    for r in d.mapInArrow(part, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["at"]] = r["n"]
    return out.reshape(FOLDS, 2, width)


def word_weights(counts: np.ndarray) -> np.ndarray:
    """(FOLDS, WORD_BUCKETS): for documents of each fold, log-odds of words in good and bad documents of the others.

    Fold 0 calibrates and never counts. A word that labelled documents don't have weighs nothing.
    """
    out = np.zeros((FOLDS, WORD_BUCKETS), np.float32)
    for f in range(FOLDS):
        c = counts[[g for g in range(1, FOLDS) if g != f]].sum(0).astype(float)
        n = np.maximum(c[:, -1:], 1)
        bad, good = c[:, :-1] / n + 2 / (n.sum() + 1)
        out[f] = np.log(good / bad)
    return out


def _word_bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64) & (WORD_BUCKETS - 1)


def _fold():
    return F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))


def text_view(texts: pa.Array, weights: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """(rows, TEXT_DIM): a constant, 18 measures of each whole text, and their squares. Empty and NULL texts are alike.

    Two of them are the mean weight of the distinct words, and their sum over the root of their number.
    """
    n = len(texts)
    _, word, space = tables()
    w = Words(texts)
    cp, _ = codepoints(texts)
    offs = w.offs
    size = np.maximum(np.diff(offs), 1)

    def share(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag)])
        return (c[offs[1:]] - c[offs[:-1]]) / size

    letter = word[cp] & ((cp < 48) | (cp > 57)) & (cp != 95)
    solid = ~space[cp]
    sign = solid & ~word[cp]
    plain = np.isin(cp, np.array([ord(c) for c in ".,;:'\"()-"], np.uint32))
    words = np.diff(w.first)
    some = np.maximum(words, 1)
    length = (w.end - w.start).astype(float)
    mean_len = np.bincount(w.row, weights=length, minlength=n) / some
    r, h, run = _distinct(w)
    distinct = np.bincount(r, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, r, run)
    said = np.bincount(r, weights=weights[fold[r], _word_bucket(h)], minlength=n)
    same = np.zeros(len(w.hash))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    repeat = np.bincount(w.row, weights=same, minlength=n) / some
    s, e = spans(cp != 10, offs)
    row = np.searchsorted(offs, s, side="right") - 1
    lines = np.maximum(np.bincount(row, minlength=n), 1)
    line_len = np.bincount(row, weights=e - s, minlength=n) / lines
    doubled = np.zeros(len(cp), bool)
    doubled[1:] = sign[1:] & sign[:-1] & (cp[1:] == cp[:-1])
    upper = letter & (cp != w.cp)
    x = np.stack([np.log1p(words), mean_len / 10, share(sign), share(sign & ~plain), share(doubled), share(upper), share(word[cp] & ~letter), share(space[cp]), share(cp == 124), distinct / some, top / some, repeat, np.log1p(line_len) / 5, np.log1p(lines), share(letter), np.log1p(np.diff(offs)) / 5, said / np.maximum(distinct, 1), said / np.sqrt(np.maximum(distinct, 1))], axis=1)
    return np.concatenate([np.ones((n, 1)), x, x * x], axis=1)


def _bucket(column: pa.Array, buckets: int) -> np.ndarray:
    """A stable hash of whole strings; NULL is bucket 0."""
    d = column.dictionary_encode()
    names = [0 if v is None else 1 + int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") % (buckets - 1) for v in d.dictionary.to_pylist()]
    index = pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False)
    return np.where(index < 0, 0, np.array([*names, 0])[index])


def meta_view(lang: pa.Array, source: pa.Array, chars: pa.Array) -> np.ndarray:
    """(rows, META_DIM): a constant, the logarithm of the size in eight pieces, and hashed language and source."""
    n = len(lang)
    z = np.log2(1 + np.maximum(pc.fill_null(chars.cast(pa.float64()), 0).to_numpy(zero_copy_only=False), 0))
    z = np.where(np.isfinite(z), z, 0)
    pieces = np.stack([np.clip(z - c, 0, 2) for c in range(1, 17, 2)], axis=1)
    return np.concatenate([np.ones((n, 1)), pieces, np.eye(LANG_BUCKETS)[_bucket(lang, LANG_BUCKETS)], np.eye(SOURCE_BUCKETS)[_bucket(source, SOURCE_BUCKETS)]], axis=1)


def features(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, t, m): both views of every document, given word_weights()."""
    known = docs.sparkSession.sparkContext.broadcast(weights)  # 1.3 MB

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                s = b.slice(lo, hi - lo)
                t, m = text_view(s.column(1), known.value, s.column(5).to_numpy()), meta_view(s.column(2), s.column(3), s.column(4))
                cols = [pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32())) for x in (t, m)]
                yield pa.RecordBatch.from_arrays([s.column(0), *cols], names=["doc_id", "t", "m"])

    d = narrow(docs, "doc_id", "text", "lang", "source", "n_chars").select("doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("double"), _fold().alias("fold"))
    return d.mapInArrow(part, "doc_id long, t array<float>, m array<float>")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class View:
    """A view's weights over standardised features, and the slope and intercept that calibrate its log-odds."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.intercept


@dataclass
class Model:
    text: View
    meta: View
    combine: np.ndarray
    threshold: float = 0.5

    def score(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(t), self.meta.logit(m)
        return sigmoid(a), sigmoid(b), sigmoid(self.combine[0] + self.combine[1] * a + self.combine[2] * b)


def _views(b: pa.RecordBatch, t: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(b.column(i).flatten()).astype(np.float64).reshape(b.num_rows, -1) for i in (t, m))


def _sums(table: DataFrame, f) -> np.ndarray:
    """Sum over all rows of the vectors that f(batch) gives; added up by the executors, entry by entry."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = f(b)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "x"])

    rows = table.mapInArrow(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(1 + max((r["i"] for r in rows), default=-1))
    for r in rows:
        out[r["i"]] = r["x"]
    return out


def _newton(table: DataFrame, views: list[View], target, steps: int, ridge: float) -> None:
    """Newton steps of both weighted regressions at once, each step one pass; target(batch, t, m) gives (y, w) by view."""
    dims = [len(v.weights) for v in views]
    for _ in range(steps):

        def gather(b: pa.RecordBatch) -> np.ndarray:
            x = _views(b, 1, 2)
            out = []
            for view, z, (y, w) in zip(views, x, target(b, *x)):
                z = (z - view.mean) / view.scale
                p = sigmoid(z @ view.weights)
                out += [z.T @ (w * (y - p)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel(), [w.sum()]]
            return np.concatenate(out)

        s = _sums(table, gather)
        if not len(s):
            return
        at = 0
        for view, d in zip(views, dims):
            g, h, n = s[at : at + d], s[at + d : at + d + d * d].reshape(d, d), s[at + d + d * d]
            at += d + d * d + 1
            reg = np.full(d, ridge * max(n, 1))
            reg[0] = 1e-6
            view.weights = view.weights + np.linalg.solve(h + np.diag(reg + 1e-6), g - reg * view.weights)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 20) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]) * 1e-3
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-3 * w)
    return w


def exchange(said: list[View], y: np.ndarray, w: np.ndarray, free: np.ndarray, t: np.ndarray, m: np.ndarray, confident: float, weight: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(labels, weights) by which each view learns next: its own ones and, on free rows, the other's confident verdicts."""
    out = []
    for other, x in ((said[1], m), (said[0], t)):
        p = sigmoid(other.logit(x))
        sure = free & ((p >= confident) | (p <= 1 - confident))
        out.append((np.where(sure, p > 0.5, y).astype(float), np.where(sure, weight, w)))
    return out


def fit(table: DataFrame, rounds: int = 3, steps: int = 4, confident: float = 0.97, weight: float = 0.3, ridge: float = 1e-4, max_calibration: int = 20_000) -> Model:
    """Co-train on a checkpointed table (doc_id, t, m, y), y NULL where there is no label.

    Every labelled document trains, but for a fifth, by hash of the id, that calibrates; of these at most
    max_calibration, the least by hash, are gathered on the driver. A verdict with a calibrated probability of at least
    `confident`, either way, goes to the other view with the given weight.
    """
    held = _fold() == 0
    sums = _sums(table, lambda b: np.concatenate([[b.num_rows], *(y for x in _views(b, 1, 2) for y in (x.sum(0), (x * x).sum(0)))]))
    if not len(sums):
        sums = np.concatenate([[1.0], np.zeros(2 * (TEXT_DIM + META_DIM))])
    views, at = [], 1
    for d in (TEXT_DIM, META_DIM):
        mean = sums[at : at + d] / sums[0]
        scale = np.sqrt(np.maximum(sums[at + d : at + 2 * d] / sums[0] - mean**2, 0))
        at += 2 * d
        mean[0] = 0
        views.append(View(np.zeros(d), mean, np.where(scale > 1e-9, scale, 1.0)))
    data = table.withColumn("train", F.col("y").isNotNull() & ~held)
    calibration = table.where(F.col("y").isNotNull() & held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_calibration).select("t", "m", "y").toPandas()
    ct, cm = (np.stack(calibration[c].to_list()).astype(float) if len(calibration) else np.zeros((0, d)) for c, d in (("t", TEXT_DIM), ("m", META_DIM)))
    cy = calibration["y"].to_numpy(float)

    def labels(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = pc.fill_null(b.column(3).cast(pa.float64()), 0).to_numpy(zero_copy_only=False)
        return y, b.column(4).to_numpy(zero_copy_only=False).astype(float)

    def calibrate() -> None:
        if len(cy) and 0 < cy.mean() < 1:
            for v, x in zip(views, (ct, cm)):
                c = _logistic(np.stack([np.ones(len(cy)), v.raw(x)], axis=1), cy)
                v.intercept, v.slope = float(c[0]), float(c[1])

    _newton(data, views, lambda b, t, m: [labels(b)] * 2, steps + 2, ridge)
    calibrate()
    for _ in range(rounds):
        said = [View(v.weights.copy(), v.mean, v.scale, v.slope, v.intercept) for v in views]

        def target(b: pa.RecordBatch, t: np.ndarray, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            return exchange(said, *labels(b), ~b.column(3).is_valid().to_numpy(zero_copy_only=False), t, m, confident, weight)

        _newton(data, views, target, steps, ridge)
        calibrate()
    combine = np.array([0.0, 0.5, 0.5])
    if len(cy) and 0 < cy.mean() < 1:
        combine = _logistic(np.stack([np.ones(len(cy)), views[0].logit(ct), views[1].logit(cm)], axis=1), cy)
    return Model(views[0], views[1], combine)


def quality(docs: DataFrame, labels: DataFrame, max_lexicon: int = 20_000, **params) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) of every row of docs (doc_id, text, lang, source, n_chars).

    labels has doc_id and quality (positive is good). Rows with a NULL id or quality don't count; of repeated labels the
    highest does. NULL and empty texts, languages and sources are values of their own; a NULL size is 0; rows with a
    NULL id, and repeated rows, are scored like any. Words get their weights from at most max_lexicon labelled documents;
    every labelled one trains the views. Without labels of both kinds every score is 0.5, and all are kept.
    """
    y = cut(narrow(labels, "doc_id", "quality").dropna().groupBy(F.col("doc_id").alias("label_id")).agg((F.max("quality") > 0).cast("int").alias("y")))
    x = features(docs, word_weights(word_counts(docs, y, max_lexicon)))
    table = cut(x.join(y, x["doc_id"] == y["label_id"], "left").select("doc_id", "t", "m", "y"))
    kinds = table.agg(F.min("y"), F.max("y")).first()
    if kinds[0] == kinds[1]:
        return table.select("doc_id", *(F.lit(0.5).alias(c) for c in ("p_text", "p_meta", "score")), F.lit(True).alias("keep"))
    model = fit(table, **params)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, s = model.score(*_views(b, 1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a), pa.array(c), pa.array(s), pa.array(s >= model.threshold)], names=["doc_id", "p_text", "p_meta", "score", "keep"])

    return table.select("doc_id", "t", "m").mapInArrow(part, "doc_id long, p_text double, p_meta double, score double, keep boolean")
