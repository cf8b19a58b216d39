"""Every query with SQL against DuckDB on the same tables: columns, rows and values."""

from __future__ import annotations

import importlib
import math
import sys
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest

from sievelake.plans import catalogue
from sievelake.sources import readers, samples


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return list(map(normal, v)) if isinstance(v, list) else v


def compare(spark, sf_dir: str, run, sql: str) -> None:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    df = run(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(normal(row[names.index(c)]) for c in order) for row in r.fetchall()), key=repr)
    got = sorted((tuple(normal(row[c]) for c in order) for row in df.collect()), key=repr)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, small, name):
    compare(spark, small, catalogue.QUERIES[name], catalogue.SQL[name])


def test_flagship(spark, tiny):
    got = {r["column"]: r for r in catalogue.flagship(spark, tiny).collect()}
    assert set(got) == {"event_id", "ts", "user_id", "event_type", "value", "props"}
    assert got["value"]["outlier_count"] > 0 and got["ts"]["outlier_count"] is None


def test_entry_without_the_training_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.SQL)
    monkeypatch.undo()
    importlib.reload(entry)


@pytest.mark.parametrize("name", ["image_small", "image_blurry", "image_issues", "image_metrics"])
def test_images_in_rounds(spark, tiny, name, tmp_path, monkeypatch):
    """Rows that repeat an id count each, and no read lists more files than a round has."""
    vectors = spark.read.parquet(f"{tiny}/embeddings.parquet").where("vec_id < 60")
    vectors.unionByName(vectors.where("vec_id < 7")).repartition(3).write.parquet(f"{tmp_path}/spark")
    pq.write_table(pq.read_table(f"{tmp_path}/spark"), f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(samples, "FOLDER_FILES", 4)
    monkeypatch.setattr(catalogue, "ROUND_FILES", 30)
    listed, read = [], readers.read_images

    def watched(spark, path):
        d = read(spark, path)
        listed.append(len(d.inputFiles()))
        return d

    monkeypatch.setattr(readers, "read_images", watched)
    compare(spark, str(tmp_path), catalogue.QUERIES[name], catalogue.SQL[name])
    assert sum(listed) == 67 and max(listed) <= 30


def test_no_images(spark, tiny, tmp_path):
    spark.read.parquet(f"{tiny}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalogue.image_issues(spark, str(tmp_path)).count() == 0
    assert tuple(catalogue.image_metrics(spark, str(tmp_path)).first()) == (0, 0.0)
