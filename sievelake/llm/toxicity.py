"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over every document. Tokens with signs of disguise (symbols for letters, letters
repeated three times or more or doubled in a rare word, letters or short chunks set apart) become lattices whose best path under channel and language
model restores the text; a lexicon of words and word beginnings, learned from labelled documents, scores plain and
restored text alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, narrow, shield
from ._text import Words, codepoints, lean, mix, signed, slices, spans, tables
from ._runs import distance
from .simhash import fingerprints

#: Symbols and the letters that they may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}
CODES = 128
PREFIXES = (3, 4, 5, 6, 7, 8)
WHOLE = 99
#: A word is common if it is seen so often, and is such a share of all words.
COMMON_COUNT, COMMON_SHARE = 5, 1e-5
_NONE = np.zeros(0, np.uint64)
_LATIN = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœąćęłńśźżčďěňřšťůžğışőű"


def code_table() -> np.ndarray:
    """Code of each code point: 0 for what is no letter, one each for Latin letters, shared ones for all others."""
    lower, _, _ = tables()
    t = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
            t[i] = 96 + i % 32
    for k, c in enumerate(_LATIN, 1):
        t[ord(c)] = k
    return t[lower]


_codes: list[np.ndarray] = []


def codes() -> np.ndarray:
    if not _codes:
        _codes.append(code_table())
    return _codes[0]


def count_trigrams(docs: DataFrame) -> DataFrame:
    """Counts (gram, n) of all letter trigrams in all texts; any run of other characters is one border."""

    @lean
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES**3, dtype=np.int64)
        for b in batches:
            texts = b.column(0)
            for lo, hi in slices(texts):
                cp, offs = codepoints(texts.slice(lo, hi - lo))
                if not len(cp):
                    continue
                c = codes()[cp].astype(np.int32)
                keep = c > 0
                keep[1:] |= c[:-1] > 0
                c = np.concatenate([[0], c[keep], [0]])
                g = (c[:-2] * CODES + c[1:-1]) * CODES + c[2:]
                total += np.bincount(g, minlength=CODES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    return narrow(docs, "text").mapInArrow(part, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Log-probability of each code after two others, interpolated with the shorter contexts. Its size is fixed."""
    n3 = np.zeros(CODES**3)
    for r in counts.toLocalIterator():
        n3[r["gram"]] = r["n"]
    n3 = n3.reshape(CODES, CODES, CODES)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 0.1) / (n1.sum() + 0.1 * CODES)
    p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
    p3 = (n3 + 5 * p2[None]) / (n3.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


_RUN = re.compile(r"(.)\1*", re.DOTALL)


@lru_cache(maxsize=1 << 16)
def _readings(c: str, run: int) -> list[tuple[str, float]]:
    """Readings of a run of one character, of 1, of 2, or of 3 and more."""
    if c in LEET:
        x = [(m, -1.0) for m in LEET[c]] if run == 1 else [(m * k, -1.0 - 0.5 * (k == 1)) for m in LEET[c] for k in (1, 2)]
        return [*x, (" ", -9.0) if run == 1 else ("", -7.0 if run == 2 else -3.0)]
    if c.isalpha():
        return [(c, 0.0)] if run == 1 else [(c + c, 0.0), (c, -3.0)] if run == 2 else [(c, -1.0), (c + c, -1.5)]
    return [("", -1.0), (" ", -1.0)]


def lattice(token: str, apart: bool = False) -> Iterator[list[tuple[str, float]]]:
    """Readings, with log-probabilities of the channel, of each run of equal characters in a token.

    Letters that have one reading come together. apart: each character by itself, perhaps the first of a new word.
    """
    t = token.lower()
    if apart:
        for i, c in enumerate(t):
            x = _readings(c, 1)
            yield x + [(" " + e, s - 2.0) for e, s in x if e.strip()] if i else x
        return
    plain = ""
    for m in _RUN.finditer(t):
        x = _readings(m[1], min(m.end() - m.start(), 3))
        if len(x) == 1:
            plain += m[1]
            continue
        if plain:
            yield [(plain, 0.0)]
            plain = ""
        yield x
    if plain:
        yield [(plain, 0.0)]


def chunk_lattice(chunks: str) -> Iterator[list[tuple[str, float]]]:
    """Lattice of chunks with blanks between them. A blank is real, unless it stands between two single letters."""
    before = ""
    for k, c in enumerate(chunks.split(" ")):
        if k:
            yield [("", 0.0), (" ", -2.0)] if len(c) == len(before) == 1 else [(" ", 0.0), ("", -2.0)]
        yield from lattice(c)
        before = c


def _said(node: tuple | None) -> str:
    """What a chain of back-pointers (node before, emitted) emits."""
    out = []
    while node is not None:
        node, emitted = node
        out.append(emitted)
    return "".join(reversed(out))


def decode(token: str, lm: np.ndarray, apart: bool = False, chunks: bool = False) -> str:
    """Viterbi path through the lattice of a token; the state is the last two characters. An empty token stays empty.

    Paths are back-pointers, and where one state is left what led to it is settled, so time and memory grow with the
    token's length alone.
    """
    code, p = memoryview(codes()), memoryview(lm.reshape(-1))
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {}
    settled: list[str] = []
    a = b = 0
    total = 0.0  # of the one state that is left, while best is empty
    for options in chunk_lattice(token) if chunks else lattice(token, apart):
        if not best and len(options) == 1:
            emitted, cost = options[0]
            total += cost
            for ch in emitted:
                z = code[ord(ch)]
                if z or b:
                    total += p[(a * CODES + b) * CODES + z]
                    a, b = b, z
            settled.append(emitted)
            continue
        new: dict[tuple[int, int], tuple[float, tuple | None, str]] = {}
        for (a, b), (score, node) in best.items() if best else (((a, b), (total, None)),):
            for emitted, cost in options:
                s, x, y = score + cost, a, b
                for ch in emitted:
                    z = code[ord(ch)]
                    if z or y:
                        s += p[(x * CODES + y) * CODES + z]
                        x, y = y, z
                if (x, y) not in new or new[x, y][0] < s:
                    new[x, y] = (s, node, emitted)
        if len(new) == 1:
            (((a, b), (total, node, emitted)),) = new.items()
            settled.append(_said((node, emitted)))
            best = {}
        else:
            best = {k: (s, (node, emitted)) for k, (s, node, emitted) in new.items()}
    if best:
        settled.append(max((s + (p[(a * CODES + b) * CODES] if b else 0.0), _said(node)) for (a, b), (s, node) in best.items())[1])
    return "".join(settled).strip()


def common_words(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the words with a doubled letter, or of at most 3 letters, that the corpus has often.

    Often means at least COMMON_COUNT times and a COMMON_SHARE of all words, so there are at most 1 / COMMON_SHARE.
    """

    @lean
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)
            for lo, hi in slices(texts):
                w = Words(texts.slice(lo, hi - lo))
                if len(w.hash):
                    h, n = np.unique(w.hash[doubled(w) | (w.end - w.start <= 3)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([None, *signed(h).tolist()], pa.int64()), pa.array([len(w.hash), *n.tolist()], pa.int64())], names=["h", "n"])

    n = cut(narrow(docs, "text").mapInArrow(part, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = n.where("h IS NULL").first()
    least = max(COMMON_COUNT, COMMON_SHARE * total["n"]) if total else COMMON_COUNT
    return np.sort(n.where(F.col("h").isNotNull() & (F.col("n") >= least)).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def doubled(w: Words) -> np.ndarray:
    """Whether each word has the same letter twice in a row."""
    same = np.zeros(len(w.cp) + 1, np.int64)
    if len(w.cp):
        same[2:] = np.cumsum((w.cp[1:] == w.cp[:-1]) & (codes()[w.cp[1:]] > 0))
    return same[w.end] > same[np.minimum(w.start + 1, w.end)]


def _among(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), bool)
    return keys[np.searchsorted(keys, h).clip(max=len(keys) - 1)] == h


def suspects(texts: pa.Array, common: np.ndarray = _NONE, w: Words | None = None) -> tuple[list[tuple[int, str]], list[tuple[int, str]], list[tuple[int, str]]]:
    """(row, token) with symbols for letters, separators within words or repeated letters; (row, letters) set apart one
    by one; (row, chunks with blanks between) set apart by twos and threes.

    Letters doubled in words that are common, and common words of three letters, aren't signs of disguise.
    """
    _, word, space = tables()
    w = w or Words(texts)
    cp, offs = codepoints(texts)
    n = len(cp)
    if not n:
        return [], [], []
    letter = codes()[cp] > 0
    sign = np.zeros(0x110000, dtype=bool)
    sign[[ord(c) for c in LEET]] = True
    sign = sign[cp]
    mark = (cp == ord("!")) | (cp == ord("|")) | (cp == ord("("))
    first, last = offs[:-1][offs[:-1] < n], offs[1:][offs[1:] > 0] - 1

    def beside(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = flag[:-1], flag[1:]
        before[first] = after[last] = False
        return before, after

    def count(flag: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flag)])

    before, after = beside(letter)
    low = w.cp
    odd = np.zeros(n, bool)
    odd[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    odd[w.start[doubled(w) & ~_among(w.hash, common)]] = True
    # runs of symbols: before or after letters, or all that a token has; marks at the end are punctuation
    a, b = spans(sign, offs)
    firm, bits, letters = count(sign & ~mark), count(word[cp] | sign), count(letter)
    odd[a[after[b - 1] | before[a] & (firm[b] > firm[a])]] = True
    s, e = spans(~space[cp], offs)
    if len(a):
        t = np.searchsorted(s, a, side="right") - 1
        differ = np.zeros(n, bool)
        differ[1:] = cp[1:] != cp[:-1]
        differ = count(differ)
        odd[a[(b - a >= 3) & (bits[e[t]] - bits[s[t]] == b - a) & (firm[b] > firm[a]) & (differ[b] > differ[a + 1])]] = True
    # separators, however many, between two letters or a letter and a symbol
    a, b = spans(~(letter | sign | space[cp] | word[cp] & (cp != ord("_"))), offs)
    before, after = beside(letter | sign)
    side = before[a] & after[b - 1]
    a, b = a[side], b[side]
    odd[a[letter[a - 1] | letter[b]]] = True
    hit = np.flatnonzero(np.add.reduceat(odd.astype(np.int32), s) > 0) if len(s) else np.zeros(0, np.int64)
    # reduceat sums up to the next start, and what lies between two tokens is white space, which is never odd
    noisy = [(int(r), cp[a:b].tobytes().decode("utf-32-le").strip("!?.,;:*#%&\"'")) for r, a, b in zip(rows_of_spans(offs, s[hit]), s[hit], e[hit])]
    ws, we = spans(word[cp] | sign, offs)
    apart: list[tuple[int, str]] = []
    chunks: list[tuple[int, str]] = []
    if not len(ws):
        return noisy, apart, chunks
    row = rows_of_spans(offs, ws)
    size = we - ws
    single = (size == 1) & (cp[ws] != ord("|"))
    short = single | (size == 2) & (letters[we] + firm[we] > letters[ws] + firm[ws])
    three = np.flatnonzero((size == 3) & (letters[we] > letters[ws]))
    i = np.searchsorted(w.start, ws[three]).clip(max=max(len(w.start) - 1, 0))
    if len(w.start):
        short[three] = ~((w.start[i] == ws[three]) & (w.end[i] == we[three]) & _among(w.hash[i], common))

    def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.zeros(len(ws) + 1, bool)
        near[1:-1] = flag[1:] & flag[:-1] & (row[1:] == row[:-1])
        # `near` marks a chunk that continues the one before
        return np.flatnonzero(near[1:] & ~near[:-1]), np.flatnonzero(near[:-1] & ~near[1:]) + 1

    for a, b in zip(*runs(single)):
        if b - a >= 3:
            apart.append((int(row[a]), cp[ws[a:b]].tobytes().decode("utf-32-le")))
    a, b = runs(short)
    sizes = count(size)
    mixed = (sizes[b] - sizes[a] > b - a) & (letters[we[b - 1]] > letters[ws[a]])
    for a, b in zip(a[mixed].tolist(), b[mixed].tolist()):
        text = cp[ws[a] : we[b - 1]].tobytes().decode("utf-32-le")
        chunks.append((int(row[a]), " ".join(text[x - ws[a] : y - ws[a]] for x, y in zip(ws[a:b], we[a:b]))))
    return noisy, apart, chunks


def rows_of_spans(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, at, side="right") - 1


def features(w: Words, lengths: tuple[int, ...] = (*PREFIXES, WHOLE)) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: hashes of the words' beginnings (WHOLE: of the words of 3 letters or more), and the words' places."""
    n = w.end - w.start
    for k in lengths:
        at = np.flatnonzero(n >= (3 if k == WHOLE else k))
        h = w.hash[at] if k == WHOLE else mix((w.p[w.start[at] + k] - w.p[w.start[at]]) * w.inv[w.start[at]])
        yield k, mix(h ^ np.uint64(k)), at


@dataclass
class Model:
    """Language model, and by feature length the sorted hashes and weights of the lexicon."""

    lm: np.ndarray
    lexicon: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    threshold: float = 0.5
    common: np.ndarray = field(default_factory=lambda: _NONE)


def restored(texts: pa.Array, lm: np.ndarray, known: dict, common: np.ndarray = _NONE, w: Words | None = None) -> tuple[list[int], list[str]]:
    """Rows and restored readings of all suspect tokens."""
    rows, out = [], []
    for kind, found in enumerate(suspects(texts, common, w)):
        for r, t in found:
            said = known.get((kind, t))
            if said is None:
                said = decode(t, lm, kind == 1, kind == 2)
                if len(known) > 50_000:
                    known.clear()  # only a memory of what was decoded
                if len(t) < 1000:
                    known[kind, t] = said
            rows.append(r)
            out.append(said)
    return rows, out


def lexicon_hits(w: Words, lexicon: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of words in the lexicon, the weights, and the features' hashes."""
    at_all, wt_all, h_all = [], [], []
    for k, h, at in features(w, tuple(lexicon)):
        keys, weights = lexicon[k]
        table = np.zeros(1 << 16, bool)
        table[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        c = np.flatnonzero(table[(h & np.uint64(0xFFFF)).astype(np.int64)])
        i = np.searchsorted(keys, h[c]).clip(max=len(keys) - 1)
        ok = keys[i] == h[c]
        at_all.append(at[c[ok]])
        wt_all.append(weights[i[ok]])
        h_all.append(h[c[ok]])
    if not at_all:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(at_all), np.concatenate(wt_all), np.concatenate(h_all)


def _doc_features(texts: pa.Array, lm: np.ndarray, known: dict, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of plain and restored text."""
    w = Words(texts)
    rows, hs = [], []
    for _, h, at in features(w):
        rows.append(w.row[at])
        hs.append(h)
    r2, words = restored(texts, lm, known, common, w)
    if words:
        v = Words(pa.array(words))
        back = np.array(r2)
        for _, h, at in features(v):
            rows.append(back[v.row[at]])
            hs.append(h)
    r, h = np.concatenate(rows), np.concatenate(hs)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]


def _lower_bound(pos: np.ndarray, n: np.ndarray, z: float = 1.64) -> np.ndarray:
    """Lower end of Wilson's interval of a proportion."""
    p = pos / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _distinct_enough(d: DataFrame) -> list[int]:
    """Ids of toxic training texts of which none is a near copy of another; d is bounded by max_labelled."""

    @lean
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                prints, _ = fingerprints(b.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in range(4))], names=["doc_id", "a", "b", "c", "d"])

    t = d.where("toxic > 0").select("doc_id", "text").mapInArrow(part, "doc_id long, a long, b long, c long, d long").toPandas().sort_values("doc_id")
    prints = t[["a", "b", "c", "d"]].to_numpy().view(np.uint64)
    kept: list[int] = []
    for i in range(len(t)):
        if not kept or (distance(prints[kept], prints[i]) > 64).all():
            kept.append(i)
    return t["doc_id"].iloc[kept].tolist()


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, min_support: int = 4, min_precision: float = 0.75, threshold: float = 0.5) -> Model:
    """Language model over all documents, and a lexicon from labels (doc_id, toxic).

    At most max_labelled labelled documents are used, those with the least hash of doc_id; this bounds the classifier's
    training only, and near copies among its toxic texts count once. A feature (a word, or its first 3 to 8 letters) is
    taken if at least min_support toxic texts have it, if its precision is at least min_precision by Wilson's lower
    bound, and if so many toxic texts among those with it would come about by chance for less than 0.05 of all features
    tried; a beginning, only if it covers a tenth more than any longer one. Rows with NULL label, id or text don't
    train; of repeated labels the highest counts. Without toxic labels the lexicon is empty and nothing is toxic.
    """
    lm = language_model(count_trigrams(docs))
    common = common_words(docs)
    y = narrow(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    ids = docs.sparkSession.createDataFrame(y.toPandas().astype({"doc_id": "int64", "toxic": "int32"}), "doc_id long, toxic int")
    d = narrow(docs, "doc_id", "text").dropna().join(F.broadcast(ids), "doc_id")  # bounded by max_labelled
    d = cut(d.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")))
    model = Model(lm, {}, threshold, common)
    kept = np.array(_distinct_enough(d), np.int64)
    if not len(kept):
        return model

    @lean
    def positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            texts = b.filter(pa.array(np.isin(b.column(0).to_numpy(), kept))).column(2)
            for lo, hi in slices(texts):
                u, n = np.unique(_doc_features(texts.slice(lo, hi - lo), lm, known, common)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(n)], names=["f", "pos"])

    found = d.where("toxic > 0").mapInArrow(positive, "f long, pos long").groupBy("f").agg(F.sum("pos").alias("pos"))
    tried, total = found.count(), max(1, d.count())
    found = found.where(F.col("pos") >= min_support).toPandas().sort_values("f", key=lambda f: f.to_numpy().view(np.uint64))
    f, pos = found["f"].to_numpy().view(np.uint64), found["pos"].to_numpy()
    if not len(f):
        return model

    @lean
    def negative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        n = np.zeros(len(f), np.int64)
        for b in batches:
            texts = b.column(2)
            for lo, hi in slices(texts):
                h = _doc_features(texts.slice(lo, hi - lo), lm, known, common)[1]
                i = np.searchsorted(f, h).clip(max=len(f) - 1)
                n += np.bincount(i[f[i] == h], minlength=len(f))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["at", "neg"])

    n = pos.copy()
    for r in d.where("toxic <= 0").mapInArrow(negative, "at int, neg long").groupBy("at").agg(F.sum("neg").alias("neg")).toLocalIterator():
        n[r["at"]] += r["neg"]
    rate = min(0.5, (len(kept) + 1) / total)
    # binomial tail, bounded by its first term times a geometric series
    log_tail = np.array([math.lgamma(b + 1) - math.lgamma(a + 1) - math.lgamma(b - a + 1) + a * math.log(rate) + (b - a) * math.log1p(-rate) for a, b in zip(pos, n)])
    keep = (_lower_bound(pos, n) >= min_precision - 0.2 * (pos < 8)) & (log_tail < math.log(0.05 / max(tried, 1)))
    order = np.argsort(f[keep])
    f, pos, n = f[keep][order], pos[keep][order], n[keep][order]
    if not len(f):
        return model

    @lean
    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            texts = b.column(2)
            for lo, hi in slices(texts):
                piece = texts.slice(lo, hi - lo)
                _, words = restored(piece, lm, known, common)
                for w in (Words(piece), Words(pa.array(words or [""]))):
                    grid = np.full((len(w.hash), len(PREFIXES) + 1), -1, np.int32)
                    for col, (_, h, at) in enumerate(features(w)):
                        i = np.searchsorted(f, h).clip(max=len(f) - 1)
                        grid[at, col] = np.where(f[i] == h, i, -1)
                    grid = np.unique(grid[(grid >= 0).any(1)], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(grid.tolist(), pa.list_(pa.int32()))], names=["chain"])

    lengths = (*PREFIXES, WHOLE)
    length, longer = np.zeros(len(f), np.int64), np.zeros(len(f))
    for r in d.where("toxic > 0").mapInArrow(chains, "chain array<int>").distinct().toLocalIterator():
        above = 0
        for k, i in reversed(list(zip(lengths, r["chain"]))):
            if i >= 0:
                length[i], longer[i] = k, max(longer[i], above)
                above = max(above, pos[i])
    for k in lengths:
        i = np.flatnonzero((length == k) & (pos > 1.1 * longer))
        if len(i):
            model.lexicon[k] = (f[i], (pos[i] + 1) / (n[i] + 2))
    return model


def _judge(texts: pa.Array, model: Model, known: dict) -> tuple[np.ndarray, list[list[str]]]:
    """By row: the probability that some distinct lexicon hit is right, and the restored readings that hit."""
    n = len(texts)
    said: list[list[str]] = [[] for _ in range(n)]
    if not model.lexicon:
        return np.zeros(n), said
    w = Words(texts)
    at, wt, h = lexicon_hits(w, model.lexicon)
    rows, weights, keys = [w.row[at]], [wt], [h]
    back, words = restored(texts, model.lm, known, model.common, w)
    if words:
        v = Words(pa.array(words))
        at, wt, h = lexicon_hits(v, model.lexicon)
        rows.append(np.array(back)[v.row[at]])
        weights.append(wt)
        keys.append(h)
        for i in np.unique(v.row[at]):
            said[back[i]].append(words[i])
    r, x, k = np.concatenate(rows), np.concatenate(weights), np.concatenate(keys)
    order = np.lexsort((k, r))
    r, x, k = r[order], x[order], k[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    logs = np.bincount(r[new], weights=np.log1p(-np.minimum(x[new], 0.999999)), minlength=n)
    return 1 - np.exp(logs), said


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (that at least one lexicon hit is right), toxic, restored (readings of disguised toxic words)."""

    @lean
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo, hi in slices(texts):
                p, said = _judge(texts.slice(lo, hi - lo), model, known)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(p), pa.array(p >= model.threshold), pa.array(said, pa.list_(pa.string()))], names=["doc_id", "score", "toxic", "restored"])

    return narrow(docs, "doc_id", "text").mapInArrow(part, "doc_id long, score double, toxic boolean, restored array<string>")


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Score of every row of docs (doc_id, text): fit() and score() in one.

    NULL and empty texts score 0 and aren't toxic; NULL ids and repeated rows are scored like any; whole texts are
    read, however long; empty tables give no rows or, for labels, a score of 0; other columns don't matter.
    """
    return score(docs, fit(docs, labels, **params))


def without_toxic(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs, with all their columns, whose text isn't toxic. The decision is by row, so nothing is shuffled."""
    model = fit(docs, labels, **params)
    s, old, at = shield(docs, "text")
    place = s.columns.index(at["text"])

    @lean
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            texts = b.column(place)
            keep = [_judge(texts.slice(lo, hi - lo), model, known)[0] < model.threshold for lo, hi in slices(texts)]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return s.mapInArrow(part, s.schema).toDF(*old)
