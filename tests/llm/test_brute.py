"""Operators against brute force, SQL, exact round trips and held-out accuracy."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_queries import compare

import corpus_pipeline
from sievelake.llm import lines, packing, pii, quality, records, registry, secrets, simhash, toxicity


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, small, name):
    compare(spark, small, registry.QUERIES[name], registry.SQL[name])


def components(n: int, pairs) -> list[int]:
    """Least member of each member's component."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_line(t: str) -> str:
    return re.sub(r"\s+", " ", "".join(c.lower() if len(c.lower()) == 1 else c for c in t)).strip()


def repeated_lines(texts: dict[int, str]) -> set[tuple[int, int]]:
    """(doc_id, line_no) that all pairs of lines say go."""
    at = [(d, n, plain_line(t)) for d in sorted(texts) for n, t in enumerate((texts[d] or "").split("\n"))]
    at = [x for x in at if x[2]]
    k = lines.SHINGLE
    distinct = list(dict.fromkeys(x[2] for x in at))
    sets = [frozenset(t[i : i + k] for i in range(len(t) - k + 1)) if len(t) >= lines.MIN_CHARS else frozenset() for t in distinct]
    by: dict[str, list[int]] = {}
    pairs = set()
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in by.get(g, ()))
        pairs |= {(j, i) for j, c in common.items() if c >= lines.THRESHOLD * (len(s) + len(sets[j]) - c)}
        for g in s:
            by.setdefault(g, []).append(i)
    root = components(len(distinct), pairs)
    number = {t: i for i, t in enumerate(distinct)}
    seen, gone = set(), set()
    for d, n, t in at:
        r = root[number[t]]
        if r in seen:
            gone.add((d, n))
        seen.add(r)
    return gone


def without(texts: dict[int, str], gone: set[tuple[int, int]]) -> dict[int, str]:
    out = {}
    for d, t in texts.items():
        if any(g[0] == d for g in gone):
            t = "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)
            if not t.strip():
                continue
        out[d] = t
    return out


def keepers(texts: dict[int, str]) -> dict[int, int]:
    """Least id of the group of each document that has words, by all pairs of fingerprints."""
    ids = sorted(texts)
    prints, size = simhash.fingerprints(pa.array([texts[i] for i in ids]))
    some = np.flatnonzero(size > 0)
    pairs = [(i, j) for i in some for j in some if i < j and simhash.distance(prints[i], prints[j]) <= simhash.MAX_DISTANCE]
    root = components(len(ids), pairs)
    return {ids[i]: ids[root[i]] for i in some}


def test_lines(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = repeated_lines(texts)
    got = {(r["doc_id"], r["line_no"]) for r in lines.duplicate_lines(docs).collect()}
    assert want and got <= want and len(got) >= 0.9 * len(want)


def test_near_duplicates(docs):
    want = keepers({r["doc_id"]: r["text"] for r in docs.collect()})
    n = Counter(want.values())
    want = {(d, k) for d, k in want.items() if n[k] > 1}
    got = {(r["doc_id"], r["keeper"]) for r in simhash.near_duplicates(docs).collect()}
    assert want and len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)


def test_records(spark, docs, tmp_path):
    assert int(records.masked_crc([b"123456789"])[0]) == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 3, 4, 511, 512, 513, 5000)]
    assert records.unframe(records.frame(parts)) == parts
    bad = bytearray(records.frame(parts)[-1])
    bad[700] ^= 1
    with pytest.raises(ValueError):
        records.unframe([bytes(bad)])
    index = records.write_records(docs, f"{tmp_path}/r")
    enc = records.encoder(records.ranks(records.TOKENIZER))
    want = {r["doc_id"]: enc.encode_ordinary(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["tokens"] for r in records.shuffled(index, f"{tmp_path}/r", 3).collect()} == want


def test_personal_data(spark, docs):
    field = pii.train(pii.labelled_table(spark))
    held = pii._sentences(300, 99)
    d = spark.createDataFrame([(i, " ".join(t)) for i, (t, _) in enumerate(held)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["kind"]) for r in pii.find(d, field).collect())
    want = Counter((i, g[2:]) for i, (_, tags) in enumerate(held) for g in tags if g[0] == "B")
    hit = sum((got & want).values())
    assert hit >= 0.97 * sum(want.values()) and hit >= 0.97 * sum(got.values())
    mails = {(r["doc_id"], m) for r in docs.collect() for m in re.findall(r"[\w.+-]+@[\w-]+\.[\w.-]*\w", r["text"])}
    assert mails <= {(r["doc_id"], r["value"]) for r in pii.find(docs, field).where("kind = 'EMAIL'").collect()}


def test_viterbi():
    rng = np.random.default_rng(3)
    own, trans, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.array([0, 4, 4, 9])
    got = pii.viterbi(own, first, trans, start)
    for a, b in ((0, 4), (4, 9)):
        paths = np.stack(np.meshgrid(*[range(3)] * (b - a), indexing="ij"), -1).reshape(-1, b - a)
        best = max(paths.tolist(), key=lambda p: start[p[0]] + sum(own[a + i, x] for i, x in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:])))
        assert got[a:b].tolist() == best


def test_packing(docs):
    rng = random.Random(5)
    capacity, places = 50, 4
    p, open_, mine, theirs = packing.Packer(capacity, places), [], [], []
    for i in range(2000):
        n = rng.randint(1, 50)
        if (w := p.add(n, [(i, 0, n, "")])) is not None:
            theirs.append(sorted(s[0] for s in w.segments))
        fit = [w for w in open_ if sum(x[1] for x in w) + n <= capacity]
        if fit:
            w = max(fit, key=lambda w: sum(x[1] for x in w))
            w.append((i, n))
        else:
            w = [(i, n)]
            if n < capacity and len(open_) >= places:
                full = max(open_, key=lambda w: sum(x[1] for x in w))
                open_.remove(full)
                mine.append(full)
            open_.append(w)
        if sum(x[1] for x in w) == capacity:
            open_.remove(w)
            mine.append(w)
    load = lambda ws: sum(len(w) for w in ws)
    assert len(theirs) == len(mine) and abs(load(theirs) - load(mine)) <= 0.02 * load(mine)
    assert len(p.open) <= places
    got = packing.pack(docs, 128).collect()
    seen: dict[int, list] = {}
    for r in got:
        assert r["n_tokens"] == sum(r["lengths"]) <= 128
        for i, s, t in zip(r["doc_ids"], r["starts"], r["texts"]):
            seen.setdefault(i, []).append((s, t))
    assert {i: "".join(t for _, t in sorted(x)) for i, x in seen.items()} == {r["doc_id"]: r["text"] for r in docs.collect() if r["text"].strip()}
    assert sum(r["n_tokens"] for r in got) >= 0.9 * 128 * len(got)


def test_ledger_is_incremental(spark, tmp_path):
    key = "AKIA" + "C" * 16
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    v = spark.createDataFrame([(1, "p", "a " + key), (2, "p", "nothing"), (3, "q", "a " + key)], "doc_id long, path string, text string")
    assert sorted(r["doc_id"] for r in secrets.scan(v, ledger).collect()) == [1, 3]
    pairs = lambda: ledger.scanned().agg(F.sum(F.bit_count("mask"))).first()[0]
    n = pairs()
    assert n == 2 * len(secrets.RULES)  # two distinct blobs
    more = v.union(spark.createDataFrame([(4, "r", "a " + key), (5, "r", "new " + key)], v.schema))
    assert sorted(r["doc_id"] for r in secrets.scan(more, ledger).collect()) == [1, 3, 4, 5]
    assert pairs() == n + len(secrets.RULES)
    rules = (secrets.Rule("aws_access_key", 2, "AKIA"), *secrets.RULES[1:])
    assert {r["rule_version"] for r in secrets.scan(more, ledger, rules).collect()} == {2}
    assert pairs() == n + len(secrets.RULES) + 3
    assert secrets.scan(more, ledger, rules[::-1]).count() > 0 and pairs() == n + len(secrets.RULES) + 3  # the order doesn't matter


def test_toxicity(spark, docs):
    model = toxicity.count_trigrams(docs)
    assert model.agg(F.sum("n")).first()[0] > 0.8 * docs.agg(F.sum(F.length(F.regexp_replace("text", r"[^\p{L}]", "")))).first()[0]
    lm = toxicity.language_model(model)
    assert np.allclose(np.exp(lm.astype(float)).sum(2), 1, atol=1e-3)
    assert toxicity.decode("thaaaat", lm) == "that" and toxicity.decode("th1ng", lm) == "thing" and toxicity.decode("", lm) == ""
    at = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{at}/labels.parquet")
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    all_ = spark.read.parquet(f"{at}/documents.parquet")
    m = toxicity.fit(all_, lab.where(~odd))
    test = lab.where(odd).select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
    s = toxicity.score(all_, m)
    n = s.join(test, s["doc_id"] == test["id"]).groupBy("y", "toxic").count().collect()
    n = {(r["y"], r["toxic"]): r["count"] for r in n}
    assert n[1, True] >= 0.8 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) <= 0.03 * n[0, False]


def test_quality(spark):
    at = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{at}/labels.parquet")
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    q = quality.quality(spark.read.parquet(f"{at}/documents.parquet"), lab.where(~odd))
    test = lab.where(odd).select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    r = q.join(test, q["doc_id"] == test["id"]).agg(F.avg((F.col("keep") == (F.col("y") == 1)).cast("double"))).first()
    assert r[0] >= 0.95


def test_pipeline(spark, tiny, docs):
    got = corpus_pipeline.run(spark, tiny).collect()
    kept: dict[int, list] = {}
    for r in got:
        for i, s, t in zip(r["doc_ids"], r["starts"], r["texts"]):
            kept.setdefault(i, []).append((s, t))
    kept = {i: "".join(t for _, t in sorted(x)) for i, x in kept.items()}
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{tiny}/labels.parquet")).where("toxic").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    texts = without(texts, repeated_lines(texts))
    keep = keepers(texts)
    texts = {d: t for d, t in texts.items() if keep.get(d, d) == d}

    def grams(t: str) -> set:
        w = re.findall(r"\w+", t.lower())
        return set(zip(*(w[i:] for i in range(5))))

    items = [g for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect() if (g := grams(r["text"]))]
    want = {d: t for d, t in texts.items() if not any(len(g & grams(t)) >= 0.8 * len(g) for g in items) and t.strip()}
    assert len(kept.keys() & want.keys()) >= 0.95 * len(kept.keys() | want.keys())
    assert sum(kept[d] == want[d] for d in kept.keys() & want.keys()) >= 0.95 * len(want)
