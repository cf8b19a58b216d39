"""Personal data by a linear-chain conditional random field over word shapes.

The field is trained here, on a small labelled table, by gradient ascent on its log-likelihood; texts are decoded by
Viterbi, all lines of a batch side by side in numpy.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._store import narrow
from ._text import codepoints, prefix_hash, slices, span_hash, spans, tables

TAGS = ("O", "B-EMAIL", "B-PHONE", "I-PHONE", "B-CARD", "I-CARD", "B-IP", "B-SSN")
_TRIM = ".,;:!?\"'()[]<>#$%&*"


def _sentences(n: int, seed: int) -> list[tuple[list[str], list[str]]]:
    """Made-up sentences with and without personal data, and tags."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèçñó"

    def word() -> str:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 11)))
        return rng.choice((w, w, w, w, w.capitalize(), w.upper(), w + rng.choice(".,;:!?"), w + rng.choice(("!!", "***", "###", "%%%", "$$$", "&&&"))))

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def hexes(k: int) -> str:
        return "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def other() -> str:
        return rng.choice((lambda: digits(rng.randint(1, 5)), lambda: f"{digits(1)}.{digits(1)}", lambda: f"{digits(1)}.{digits(1)}.", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}", lambda: "AKIA" + "".join(rng.choice("ABCDEFGHJK234567") for _ in range(16)), lambda: "password=" + hexes(18), lambda: f'"{hexes(40)}"', lambda: f"{rng.randint(1900, 2099)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"${digits(3)},{digits(3)}", lambda: f"({digits(1)})", lambda: f"[{digits(2)}]", lambda: f"https://{word().lower()}.org/{digits(3)}", lambda: "@" + word().lower(), lambda: "|", lambda: "-", lambda: "BY-NC", lambda: f"{digits(3)}%", lambda: f"+{digits(1)}", lambda: f"{digits(3)}-{digits(1)}", lambda: f"{digits(6)}", lambda: f"{digits(10)}", lambda: word() + digits(2)))()

    def name() -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))

    def email() -> tuple[list[str], list[str]]:
        user = rng.choice((name(), f"{name()}.{digits(2)}", f"{name()}.{name()}", f"{name()}_{digits(2)}", f"{name()}{digits(3)}", f"{name()}-{name()}", f"{name()}+{name()}", name().capitalize() + "." + name().capitalize()))
        host = rng.choice((f"mail{digits(1)}.example.com", f"{name()}.com", f"{name()}.co.uk", f"{name()}-{name()}.org", f"{name()}{digits(1)}.net"))
        return [f"{user}@{host}"], ["B-EMAIL"]

    def phone() -> tuple[list[str], list[str]]:
        t = rng.choice((f"+{rng.choice(('1', '1', '44', '49'))} ({digits(3)}) {digits(3)}-{digits(4)}", f"+1 ({digits(3)}) 555-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(4)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}")).split()
        return t, ["B-PHONE"] + ["I-PHONE"] * (len(t) - 1)

    def card() -> tuple[list[str], list[str]]:
        d = rng.choice("3456") + digits(15)
        t = rng.choice((d, d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)))).split()
        return t, ["B-CARD"] + ["I-CARD"] * (len(t) - 1)

    def ip() -> tuple[list[str], list[str]]:
        return [".".join(str(rng.randint(0, 255)) for _ in range(4))], ["B-IP"]

    def ssn() -> tuple[list[str], list[str]]:
        return [f"{digits(3)}-{digits(2)}-{digits(4)}"], ["B-SSN"]

    out = []
    for _ in range(n):
        tokens: list[str] = []
        tags: list[str] = []
        for _ in range(rng.randint(1, 4)):
            for _ in range(rng.randint(0, 4)):
                tokens.append(other() if rng.random() < 0.25 else word())
                tags.append("O")
            if rng.random() < 0.75:
                t, g = rng.choice((email, phone, phone, card, ip, ssn))()
                if rng.random() < 0.15:
                    t = [*t[:-1], t[-1] + rng.choice(".,;)")]
                tokens += t
                tags += g
        if tokens:
            out.append((tokens, tags))
    return out


def labelled_table(spark: SparkSession, sentences: int = 700, seed: int = 7) -> DataFrame:
    """The small labelled table: (sentence, tokens, tags), made up here; any table of this form trains as well."""
    rows = [(i, t, g) for i, (t, g) in enumerate(_sentences(sentences, seed))]
    return spark.createDataFrame(rows, "sentence int, tokens array<string>, tags array<string>")


def shape(token: str) -> str:
    """Letters as A or a with repetitions dropped, digits as 0 each, other characters as they are."""
    out = ""
    for c in token:
        k = "0" if c.isdigit() else ("a" if c.isalpha() and c == c.lower() else "A" if c.isalpha() else c)
        if k not in "aA" or not out.endswith(k):
            out += k
    return out


def shape_features(s: str) -> list[str]:
    """Features of a whole word shape: itself, without digit counts, without edge signs, its ends, and what it contains.

    Numbers of digits from 20, of dots from 5 and of dashes from 4 on are one value each.
    """
    core = s.strip(_TRIM)
    short = ""
    for c in core:
        if not short.endswith(c) or c not in "0":
            short += c
    n = sum(c == "0" for c in s)
    kind = "".join(sorted(set(core)))
    return [f"s={s}", f"core={core}", f"short={short}", f"kind={kind}", f"n={min(n, 20)}", f"first={s[:1]}", f"at={'@' in core and '.' in core.rpartition('@')[2]}", f"dots={min(core.count('.'), 5)}", f"dash={min(core.count('-'), 4)}", f"plain={not n and '@' not in s}"]


@dataclass
class Field:
    """Weights by feature for the token itself, the one before and the one after (features, 3, tags); transitions."""

    index: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def scores(self, shapes: list[str]) -> np.ndarray:
        """(shapes, 3, tags): what a shape adds to the scores of its own token, the next one and the previous one."""
        out = np.zeros((len(shapes), 3, len(TAGS)))
        for i, s in enumerate(shapes):
            for f in shape_features(s):
                if (k := self.index.get(f)) is not None:
                    out[i] += self.weights[k]
        return out


def _emissions(field: Field, shapes: list[list[str]], width: int) -> np.ndarray:
    names = sorted({s for x in shapes for s in x})
    at = {s: i for i, s in enumerate(names)}
    table = field.scores(names)
    out = np.zeros((len(shapes), width, len(TAGS)))
    for i, x in enumerate(shapes):
        k = [at[s] for s in x]
        out[i, : len(k)] = table[k, 0]
        out[i, 1 : len(k)] += table[k[:-1], 1]
        out[i, : len(k) - 1] += table[k[1:], 2]
    return out


def train(table: DataFrame, rounds: int = 120, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Fit the field to a labelled table (tokens, tags) by adaptive gradient ascent; the table is small and is collected."""
    rows = [(r["tokens"], r["tags"]) for r in table.orderBy("sentence").select("tokens", "tags").collect() if r["tokens"]]
    shapes = [[shape(t) for t in x] for x, _ in rows]
    feats = {s: shape_features(s) for x in shapes for s in x}
    names = sorted({f for x in feats.values() for f in x})
    index = {f: i for i, f in enumerate(names)}
    L, width = len(TAGS), max((len(x) for x in shapes), default=1)
    field = Field(index, np.zeros((len(names), 3, L)), np.zeros((L, L)), np.zeros(L))
    if not rows:
        return field
    kinds = sorted(feats)
    inc = np.zeros((len(kinds), len(names)))
    for i, s in enumerate(kinds):
        for f in feats[s]:
            inc[i, index[f]] += 1
    at = {s: i for i, s in enumerate(kinds)}
    n = len(rows)
    ids, tags, mask = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    for i, (x, (_, g)) in enumerate(zip(shapes, rows)):
        ids[i, : len(x)] = [at[s] for s in x]
        tags[i, : len(x)] = [TAGS.index(t) for t in g]
        mask[i, : len(x)] = True
    gold = np.eye(L)[tags] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_trans = np.einsum("nti,ntj->ij", gold[:, :-1] * both[..., None], gold[:, 1:] * both[..., None])
    square = [np.zeros_like(p) for p in (field.weights, field.trans, field.start)]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)

    for _ in range(rounds):
        t = np.einsum("sf,fkl->skl", inc, field.weights, optimize=True)
        em = t[ids, 0]
        em[:, 1:] += t[ids[:, :-1], 1] * both[..., None]
        em[:, :-1] += t[ids[:, 1:], 2] * both[..., None]
        alpha = np.zeros((n, width, L))
        beta = np.zeros((n, width, L))
        alpha[:, 0] = field.start + em[:, 0]
        for k in range(1, width):
            step = lse(alpha[:, k - 1, :, None] + field.trans, 1) + em[:, k]
            alpha[:, k] = np.where(mask[:, k, None], step, alpha[:, k - 1])
        for k in range(width - 2, -1, -1):
            step = lse(field.trans + (em[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(mask[:, k + 1, None], step, 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[..., None]
        pair = np.exp(np.minimum(alpha[:, :-1, :, None] + field.trans + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None], 0)) * both[..., None, None]
        diff = gold - p
        g = np.zeros_like(t)
        np.add.at(g[:, 0], ids[mask], diff[mask])
        np.add.at(g[:, 1], ids[:, :-1][both], diff[:, 1:][both])
        np.add.at(g[:, 2], ids[:, 1:][both], diff[:, :-1][both])
        grads = [np.einsum("sf,skl->fkl", inc, g, optimize=True), gold_trans - pair.sum((0, 1)), diff[:, 0].sum(0)]
        for param, sq, grad in zip((field.weights, field.trans, field.start), square, grads):
            grad = grad - decay * n * param
            sq += grad * grad
            param += rate * grad / (np.sqrt(sq) + 1e-8)
    # a continuation must follow its own kind
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            field.start[j] = -1e4
            for i, before in enumerate(TAGS):
                if before[2:] != tag[2:]:
                    field.trans[i, j] = -1e4
    return field


def viterbi(own: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tags of many sequences: own (tokens, tags), first where each sequence begins, and the total at the end.

    All sequences advance together, longest first, so that those at work are always a prefix.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    begin, size = first[:-1][order], size[order]
    tags = np.zeros(len(own), np.int8)
    if not len(order):
        return tags
    L = len(trans)
    back = np.zeros((len(own), L), np.int8)
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")  # sequences of at least t tokens
    score = start + own[begin]
    final = np.zeros(len(order), np.int64)
    for t in range(1, int(size[0])):
        k = active[t]
        final[k : len(score)] = score[k:].argmax(1)
        all_ = score[:k, :, None] + trans
        best = all_.argmax(1)
        at = begin[:k] + t
        back[at] = best
        score = np.take_along_axis(all_, best[:, None, :], 1)[:, 0] + own[at]
    final[: len(score)] = score.argmax(1)
    now = final
    for t in range(int(size[0]) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        tags[at] = now[:k]
        if t:
            now[:k] = back[at, now[:k]]
    return tags


class Decoder:
    """Tokens, shapes and tags of string columns; shapes once seen keep their scores."""

    def __init__(self, field: Field):
        self.field = field
        self.hash = np.zeros(0, np.uint64)
        self.table = np.zeros((0, 3, len(TAGS)))

    def __call__(self, texts: pa.Array) -> list[tuple[int, int, int, str, str]]:
        """(row, start, end, kind, value) of all personal data, in code points; edge signs are no part of it."""
        _, _, space = tables()
        cp, offs = codepoints(texts)
        if not len(cp):
            return []
        solid = ~space[cp]
        s, e = spans(solid, offs)
        if not len(s):
            return []
        kind = _kinds()[cp]
        keep = np.ones(len(cp), bool)
        keep[1:] = ~((kind[1:] == kind[:-1]) & (kind[1:] <= 2))
        keep[s] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        p, inv = prefix_hash(kind[keep])
        h = span_hash(p, inv, at[s], at[e])
        u, one, which = np.unique(h, return_index=True, return_inverse=True)
        known = np.searchsorted(self.hash, u).clip(max=max(len(self.hash) - 1, 0))
        new = np.ones(len(u), bool) if not len(self.hash) else self.hash[known] != u
        if new.any():
            shapes = [shape(cp[s[i] : e[i]].tobytes().decode("utf-32-le")) for i in one[new]]
            if len(self.hash) > 200_000:  # only a memory of what was scored
                self.hash, self.table, new = np.zeros(0, np.uint64), self.table[:0], np.ones(len(u), bool)
                shapes = [shape(cp[s[i] : e[i]].tobytes().decode("utf-32-le")) for i in one]
            hash_ = np.concatenate([self.hash, u[new]])
            order = np.argsort(hash_)
            self.table = np.concatenate([self.table, self.field.scores(shapes)])[order]
            self.hash = hash_[order]
        k = np.searchsorted(self.hash, u)[which]
        line = np.concatenate([[0], np.cumsum(cp == 10)])[s]
        row = np.searchsorted(offs, s, side="right") - 1
        cut = np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])])
        own = self.table[k, 0].copy()
        inner = ~cut[1:]
        own[1:][inner] += self.table[k[:-1][inner], 1]
        own[:-1][inner] += self.table[k[1:][inner], 2]
        tags = viterbi(own, np.concatenate([np.flatnonzero(cut), [len(s)]]), self.field.trans, self.field.start)
        out = []
        first = np.flatnonzero(tags)
        i = 0
        while i < len(first):
            a = b = int(first[i])
            name = TAGS[tags[a]][2:]
            while i + 1 < len(first) and first[i + 1] == b + 1 and TAGS[tags[b + 1]] == "I-" + name and not cut[b + 1]:
                i, b = i + 1, b + 1
            i += 1
            value = cp[s[a] : e[b]].tobytes().decode("utf-32-le")
            strip = _TRIM.replace("(", "").replace(")", "") if name == "PHONE" else _TRIM
            lead = len(value) - len(value.lstrip(strip))
            value = value.strip(strip)
            start = int(s[a] - offs[row[a]]) + lead
            if value:
                out.append((int(row[a]), start, start + len(value), name, value))
        return out


_kind: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """1 for letters that are lower case, 2 for others, 3 for digits, and each other character for itself."""
    if not _kind:
        t = np.arange(10, 0x110000 + 10, dtype=np.uint32)
        for i in range(0x110000):
            if 0xD800 <= i < 0xE000:
                continue
            c = chr(i)
            if c.isdigit():
                t[i] = 3
            elif c.isalpha():
                t[i] = 1 if c == c.lower() else 2
        _kind.append(t)
    return _kind[0]


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, start, end, kind, value) of all personal data in docs (doc_id, text); positions are in code points.

    Whole texts are decoded, line by line, however long. NULL, empty and blank texts have none; NULL ids stay NULL;
    repeated rows give repeated findings; other columns don't matter.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(field)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                got = decode(b.column(1).slice(lo, hi - lo))
                ids = b.column(0).slice(lo, hi - lo).take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.string()), pa.array([g[4] for g in got], pa.string())], names=["doc_id", "start", "end", "kind", "value"])

    return narrow(docs, "doc_id", "text").mapInArrow(part, "doc_id long, start int, end int, kind string, value string")


def personal_data(spark: SparkSession, docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """find() with a field trained on a labelled table, by default the one made up here."""
    return find(docs, train(labelled_table(spark) if table is None else table))
