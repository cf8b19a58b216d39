"""Every operator and every stage on NULLs, empty and very long texts, ties, repeated rows, empty tables and odd columns."""

from __future__ import annotations

import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from sievelake.llm import contamination, lines, packing, pii, quality, records, secrets, simhash, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} flows{i % 13}" for i in range(150_000))
PASSAGE = "the quick silver otters carried seven lanterns over frozen lakes before the midnight bells rang twice"
ROWS = [
    (None, None, None, None, None),
    (1, None, "en", "a", 0),
    (2, "", None, "a", 0),
    (3, " \t\n 　", "en", None, None),
    (None, "a text without an id, which says little", "en", "b", 5),
    (4, LONG, "en", "c", len(LONG)),
    (5, "x" * 300_000, "de", "c", 300_000),
    (6, f"intro words here {PASSAGE} and a tail\nline two is here with enough characters", "en", "a", 10),
    (7, f"intro words here {PASSAGE} and a tail\nline two is here with enough characters", "en", "a", 10),
    (7, f"intro words here {PASSAGE} and a tail\nline two is here with enough characters", "en", "a", 10),
    (8, "l1n3 \u0000 with nul and ퟿ odd \U0001f600 signs, k i l l 4@$!", "xx", "z", -3),
    (9, "short", "en", "a", 5),
]
CLASHES = ("h", "key", "g", "root", "node", "n", "path", "window", "toxic", "score", "line_no", "gone", "id", "__sl_hit", "__sl_id", "Text", "DOC_ID", "k.p")


@pytest.fixture(scope="module")
def odd(spark):
    """The rows with columns that clash with inner names, some just by case."""
    d = spark.createDataFrame(ROWS, DOCS)
    return d.select(*d.columns, *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE, "x"), (1, PASSAGE, "x"), (None, PASSAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "only four words here", "x")], "item_id long, text string, doc_id string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, None, None, "t"), (None, 1, 1, "t"), (6, 1, 0, "t"), (6, 1, 0, "t"), (7, 0, 1, None), (99, 1, 1, "t")], "doc_id long, quality int, toxic int, text string")


def test_contained(odd, none, items):
    got = {(r["doc_id"], r["item_id"], r["containment"]) for r in contamination.contained(odd, items).collect()}
    assert got == {(6, "1", 1.0), (7, "1", 1.0)}  # the item of four words is in no document
    assert contamination.contained(none, items).count() == 0
    assert contamination.contained(odd, items.limit(0)).count() == 0
    kept = contamination.decontaminate(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 3


def test_records(spark, odd, none, tmp_path):
    index = records.write_records(odd, f"{tmp_path}/a")
    assert index.count() == len(ROWS) - 2  # two texts are NULL
    back = sorted(((r["doc_id"], len(r["tokens"])) for r in records.read_records(index, f"{tmp_path}/a").collect()), key=str)
    assert back == sorted(((r["doc_id"], r["n_tokens"]) for r in index.collect()), key=str)
    assert records.write_records(none, f"{tmp_path}/b").count() == 0


def test_folders_of_records(spark, monkeypatch):
    assert records.resolved(spark, "/tmp/x y") == records.resolved(spark, "file:/tmp/x y")
    shared = records.shared_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert records.resolved(spark, f"{shared}/records").endswith("/records")
    with pytest.raises(ValueError):
        records.resolved(spark, "/tmp/elsewhere")


def test_pii(spark, odd, none):
    field = pii.train(pii.labelled_table(spark, 150), rounds=30)
    assert all(r["doc_id"] != 1 for r in pii.find(odd, field).collect())
    assert pii.find(none, field).count() == 0
    empty = pii.train(spark.createDataFrame([], "sentence int, tokens array<string>, tags array<string>"))
    assert pii.find(odd, empty).count() == 0


def test_pack(odd, none):
    got = packing.pack(odd, capacity=100, places=3).collect()
    assert all(0 < r["n_tokens"] <= 100 for r in got)
    assert sum(r["n_tokens"] for r in got) == sum(len((t or "").split()) for _, t, *_ in ROWS)
    assert packing.pack(none).count() == 0


def test_secrets(spark, odd, none):
    assert secrets.scan_fresh(spark, odd.drop("path", "PATH").withColumn("path", F.col("source"))).count() == 0
    assert secrets.scan_fresh(spark, none.withColumn("path", F.lit(None).cast("string"))).count() == 0
    key = "AKIA" + "B" * 16
    v = spark.createDataFrame([(None, None, key), (1, "p", key), (1, "p", key), (2, "p", key + key), (3, "q", None)], "doc_id long, path string, text string")
    got = sorted((str(r["doc_id"]), r["path"], r["occurrences"]) for r in secrets.scan_fresh(spark, v).collect() if r["rule"] == "aws_access_key" and r["path"])
    assert got == [("1", "p", 1), ("1", "p", 1), ("2", "p", 2)]


def test_toxicity(odd, none, labels):
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(ROWS) and all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).where("toxic").count() == 0
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == len(ROWS)


def test_lines(odd, none):
    out = lines.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == len(ROWS)
    by = {}
    for r in out.collect():
        by.setdefault(r[0], []).append(r[1])
    assert "otters" in by[6][0] and by[7] == ["", ""] and by[4] == [LONG] and by[1] == [None]
    assert lines.dedup_lines(odd, drop_emptied=True).count() == len(ROWS) - 2
    assert lines.dedup_lines(none).count() == 0
    assert lines.duplicate_lines(none).count() == 0


def test_top_k(spark):
    v = [(None, [1.0, 0.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [1.0], 1), (5, [], 1)]
    v += [(6, [1.0, 2.0], 1), (7, [1.0, 2.0], 1), (7, [1.0, 2.0], 1), (8, [0.0, 0.0], 1), (9, [-1.0, 2.0], 1), (10, [float("inf"), 1.0], 1), (11, [1.0, float("-inf")], 1)]
    got = {(r["vec_id"], r["rank"], r["neighbour"], r["score"]) for r in topk.top_k(spark.createDataFrame(v, "vec_id long, embedding array<float>, score int"), 2, every=1).collect()}
    assert got == {(6, 1, 7, 5.0), (6, 2, 9, 3.0), (7, 1, 6, 5.0), (7, 2, 9, 3.0), (8, 1, 6, 0.0), (8, 2, 7, 0.0), (9, 1, 6, 3.0), (9, 2, 7, 3.0)}
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [0.5])], "vec_id long, embedding array<float>")).count() == 0
    # each dimension by itself; queries are the ids that `every` divides
    v = [(i, [float(i), 1.0]) for i in range(4)] + [(i, [float(i)]) for i in range(4, 8)]
    got = {(r["vec_id"], r["neighbour"], r["score"]) for r in topk.top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>"), 1, every=3).collect()}
    assert got == {(0, 1, 1.0), (3, 2, 7.0), (6, 7, 42.0)}


def test_near_duplicates(odd, none):
    got = {(r["doc_id"], r["keeper"]) for r in simhash.near_duplicates(odd).collect()}
    assert got == {(6, 6), (7, 6)}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 2
    assert simhash.without_near_duplicates(none).count() == 0


def test_quality(odd, none, labels):
    got = quality.quality(odd, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality(none, labels).count() == 0
    assert {r["score"] for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, none, tiny, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for d in (odd, none):
        out = stage(spark, d, tiny)
        if name != "packing":
            assert out.columns == d.columns
        out.collect()


@pytest.mark.parametrize("kind", ["int", "smallint", "long"])
def test_whole_numbers_are_ids(spark, items, kind):
    d = spark.createDataFrame(ROWS, DOCS).withColumn("doc_id", F.col("doc_id").cast(kind))
    assert {(r["doc_id"], r["keeper"]) for r in simhash.near_duplicates(d).collect()} == {(6, 6), (7, 6)}
    assert simhash.without_near_duplicates(d).count() == len(ROWS) - 2
    assert lines.dedup_lines(d, drop_emptied=True).count() == len(ROWS) - 2
    assert contamination.decontaminate(d, items).count() == len(ROWS) - 3
    assert packing.pack(d).count() > 0


def test_other_ids_are_refused(spark, items, labels):
    d = spark.createDataFrame(ROWS, DOCS).withColumn("doc_id", F.col("doc_id").cast("string"))
    for f in (simhash.near_duplicates, lines.dedup_lines, packing.pack, lambda x: contamination.contained(x, items), lambda x: toxicity.toxicity(x, labels), lambda x: quality.quality(x, labels), lambda x: pii.find(x, None)):
        with pytest.raises(TypeError):
            f(d)


def test_short_lines(spark):
    d = spark.createDataFrame([(1, "Yes.\n\nbut no\n}"), (2, "yes.\n\n}\nother"), (3, "yes")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(d).collect()} == {1: "Yes.\n\nbut no\n}", 2: "\nother", 3: "yes"}
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(d, shortest=2).collect()} == {1: "Yes.\n\nbut no\n}", 2: "\n}\nother", 3: "yes"}
