"""What each stage of the pipeline keeps, on odd rows and with nothing to learn from."""

from __future__ import annotations

from pathlib import Path

import pytest
from test_edges import DOCS, PASSAGE, ROWS

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory) -> str:
    """A folder with empty labels and an empty benchmark."""
    at = tmp_path_factory.mktemp("bare")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory) -> str:
    """A folder whose labels know one toxic word, and whose benchmark holds the passage."""
    at = tmp_path_factory.mktemp("full")
    spark.createDataFrame([(i, 1, int(i < 1040)) for i in range(1000, 1400)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, DOCS)


def ids(df) -> list:
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_nothing_to_learn_from_drops_nothing(spark, rows, bare):
    for name in ("toxicity", "decontamination"):
        out = STAGES[name](spark, rows, bare)
        assert out.columns == rows.columns and ids(out) == ALL
    assert Path(bare).exists()


def test_toxicity_drops_what_labels_teach(spark, rows, full):
    words = "river stone cloud garden window silver basket paper candle marble velvet copper".split()
    made = [(i, " ".join(words[(i * k + k) % 12] for k in range(1, 30)) + (" zorgblat" if i < 1040 else "") + f" {i * 7919}", "en", "s", 9) for i in range(1000, 1400)]
    more = [(2000, "a z0rgblat here", "en", "s", 1), (2001, "a clean text here", "en", "s", 1)]
    docs = rows.unionByName(spark.createDataFrame(made + more, DOCS))
    out = ids(STAGES["toxicity"](spark, docs, full))
    assert out == sorted([*(r[0] for r in ROWS), *range(1040, 1400), 2001], key=lambda x: (x is None, x))


def test_line_dedup_keeps_the_first_of_equal_lines(spark, rows, bare):
    out = STAGES["line_dedup"](spark, rows, bare)
    assert ids(out) == [i for i in ALL if i != 7]
    assert {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] == 6} == {6: ROWS[7][1]}


def test_near_duplicates_keep_the_least_id(spark, rows, bare):
    assert ids(STAGES["near_duplicates"](spark, rows, bare)) == [i for i in ALL if i != 7]


def test_decontamination_drops_the_passage(spark, rows, full):
    assert ids(STAGES["decontamination"](spark, rows, full)) == [i for i in ALL if i not in (6, 7)]


def test_packing_holds_every_token(spark, rows, bare):
    out = STAGES["packing"](spark, rows, bare).collect()
    assert sum(r["n_tokens"] for r in out) == sum(len((r[1] or "").split()) for r in ROWS)


def test_no_rows(spark, rows, bare, full):
    for at in (bare, full):
        for stage in STAGES.values():
            assert stage(spark, rows.limit(0), at).count() == 0
