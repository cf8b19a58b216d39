"""Small fixtures: one case for each rule that the profile keeps or changes on purpose."""

from __future__ import annotations

import io
import json
import math
import zipfile

import numpy as np
import pytest

from pyspark.sql import functions as F

from sievelake.functions import quantiles
from sievelake.functions.constants import MISSING_TOKENS
from sievelake.operators import image, labels, table, text
from sievelake.plans import report
from sievelake.sources import readers, samples
from sievelake.sources.samples import png


def test_missing_and_outliers(spark):
    d = spark.createDataFrame([(float("nan"), None, None, True), (None, "b", None, False), (1.0, None, None, True)], "a double, b string, c long, flag boolean")
    assert {r["column"]: r["count"] for r in table.missing(d).collect()} == {"a": 2, "b": 2, "c": 3, "flag": 0}
    assert {r["column"]: r["dtype"] for r in table.data_types(d).collect()} == {"a": "float64", "b": "object", "c": "float64", "flag": "bool"}
    x = spark.createDataFrame([(float(i), 7) for i in [*range(1, 10), 100]], "x double, k int")
    (r,) = table.outliers(x).collect()
    assert (r["column"], r["count"], r["percentage"], r["lower"], r["upper"]) == ("x", 1, 10.0, -3.5, 14.5)
    assert table.outlier_rate(x).first()[0] == 10.0


def test_duplicates_and_empty(spark):
    d = spark.createDataFrame([(1.0, None), (1.0, None), (float("nan"), "x"), (float("nan"), "x"), (0.0, "y"), (-0.0, "y")], "a double, b string")
    assert tuple(table.duplicate_rows(d).first()) == (3, 50.0)
    assert tuple(table.metrics(d.limit(0)).first()) == (0, 2, 0.0, 0.0, 0.0)
    assert text.metrics(spark.createDataFrame([], "text string")).first()["duplicate_text_rate"] == 0.0


def test_texts(spark):
    d = readers.from_texts(spark, ["a", " a ", "", "  ", "　", None, "A", "é", "\U0001f600"])
    got = {(r["type"], r["row_id"], r["original_row_id"]) for r in text.issues(d).collect()}
    assert got == {("empty_text", i, None) for i in (2, 3, 4, 5)} | {("duplicate_text", 1, 0)} | {("duplicate_text", i, 2) for i in (3, 4, 5)}
    m = text.metrics(d).first()
    assert (m["total_texts"], m["min_length"], m["max_length"], m["average_length"]) == (9, 0.0, 3.0, 10 / 9)


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('n,q,w\n' + "".join(f'"{t}",{i},"a, ""b""\nc"\n' for i, t in enumerate(MISSING_TOKENS)) + "1.5,7,x\n")
    d = readers.read(spark, f"{tmp_path}/t.csv")
    assert dict(d.dtypes) == {"n": "double", "q": "bigint", "w": "string"} and d.where("n is null").count() == 19
    assert d.where("q = 3").first()["w"] == 'a, "b"\nc'
    (tmp_path / "x.txt").write_bytes("a\r\nb\x0bc d\n\ne\n".encode())
    assert [r["text"] for r in readers.read(spark, f"{tmp_path}/x.txt").orderBy("row_id").collect()] == ["a", "b", "c", "d", "", "e"]
    assert readers.modality_of("A.PNG") == "image"
    for bad, strict in (("a.doc", False), ("a.CSV", True)):
        with pytest.raises(readers.UnsupportedFormat):
            readers.modality_of(bad, strict)


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, (130, 120, 3), dtype=np.uint8)
    files = {"noise.png": png(noise), "flat.png": png(np.full((130, 50, 1), 9, np.uint8)), "junk.png": b"no image", "cut.png": png(noise)[:400]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    r = report.profile_images(readers.read_images(spark, str(tmp_path)))
    assert tuple(r.metrics.first()) == (4, 100.0)
    assert sorted(x["type"] for x in r.issues.collect()) == ["blurry_image", "corrupted_image", "corrupted_image", "small_image"]
    g = np.floor(noise @ np.array([0.299, 0.587, 0.114]) + 0.5)
    p = np.pad(g, 1, mode="reflect")
    want = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var()
    got = next(x["sharpness"] for x in r.parts["measured"].collect() if x["origin"].endswith("noise.png"))
    assert math.isclose(got, want, rel_tol=1e-3)
    grid = spark.createDataFrame([(0, 3, 3, [0, 0, 0, 0, 1, 0, 0, 0, 0]), (1, 1, 3, [5, 5, 5]), (2, 2, 2, None)], "row_id long, height int, width int, px array<int>")
    s = {x["row_id"]: x["sharpness"] for x in image.sharpness(grid).collect()}
    lap = np.array([0, 2, 0, 2, -4, 2, 0, 2, 0])
    assert math.isclose(s[0], lap.var()) and s[1] == 0.0 and s[2] is None


def test_many_small_images(spark, tmp_path):
    """Metrics measure an image once; small files share tasks."""
    for i in range(160):
        (tmp_path / f"{i}.png").write_bytes(png(np.full((3, 5, 1), i, np.uint8)) if i % 4 else b"no image")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
        d = readers.read_images(spark, str(tmp_path))
        assert d.rdd.getNumPartitions() <= readers.IMAGE_TASKS * spark.sparkContext.defaultParallelism
        m = image.metrics(image.measure(d).withColumn("row_id", F.xxhash64("origin")))
        assert tuple(m.first()) == (160, 175.0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert m._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def probabilities(spark):
    rows = [(0, 0, [0.9, 0.1]), (1, 0, [0.5, 0.5]), (2, 0, [0.2, 0.8]), (3, 0, [0.8, 0.2]), (4, 1, [0.1, 0.9]), (5, 1, [0.3, 0.7]), (6, 1, [0.95, 0.05]), (7, 1, [0.4, 0.6])]
    return rows, spark.createDataFrame(rows, "row_id long, y int, p array<double>")


def test_confident_learning(spark):
    rows, d = probabilities(spark)
    y = np.array([r[1] for r in rows])
    p = np.array([r[2] for r in rows])
    t = {c: np.percentile(p[y == c, c], 85) for c in (0, 1)}
    assert {r["class"]: round(r["threshold"], 12) for r in labels.thresholds(d).collect()} == {c: round(float(x), 12) for c, x in t.items()}
    joint = np.zeros((2, 2), int)
    for i in range(8):
        k = int(p[i].argmax())
        joint[y[i], k] += p[i, k] >= t[k]
    assert {(r["given"], r["predicted"]): r["n"] for r in labels.confident_joint(d).collect()} == {(i, j): joint[i, j] for i in (0, 1) for j in (0, 1)}
    assert sorted(r["row_id"] for r in labels.errors(d).collect()) == [1, 2, 6]
    assert {r["row_id"]: r["predicted"] for r in labels.scores(d).collect()}[1] == 0  # the first of equal ones
    s = labels.summary(d).first()
    assert (s["total_samples"], s["error_count"], s["error_rate"]) == (8, 3, 0.375)
    assert {r["row_id"] for r in labels.prune(d).collect()} == {2, 6}
    assert labels.summary(d.limit(0)).first()["error_rate"] == 0.0


def test_folds(spark):
    for name, values in (("string", ["b", "a", "c"]), ("int", [5, 0, 9])):
        d = spark.createDataFrame([(i * 7 - 50, values[i * i % 3]) for i in range(61)] + [(10_000, None)], f"row_id long, label {name}")
        got = labels.stratified_folds(labels.encode_label(d, "label")).orderBy("row_id").collect()
        y = [r["y"] for r in got]
        order = list(dict.fromkeys(y))
        sorted_y = sorted(order.index(c) for c in y)
        alloc = [[sum(v == k for v in sorted_y[f::5]) for f in range(5)] for k in range(len(order))]
        left = {k: [f for f in range(5) for _ in range(alloc[k][f])] for k in range(len(order))}
        assert [r["fold"] for r in got] == [left[order.index(c)].pop(0) for c in y]


def test_forest_and_report(spark, tmp_path):
    s = samples.noisy_labels(spark, 400, 100).persist()
    o = report.Options(label="label", row_id="id", exclude=("true_label",), trees=10, depth=4)
    r = report.profile_table(s, o)
    bad = r.issues.where("type = 'label_error'").select("row_id").join(s, F.col("row_id") == F.col("id"))
    assert bad.where("label <> true_label").count() >= 0.9 * 100
    assert r.parts["labels"].first()["total_samples"] == 400
    assert r.parts["joint"].agg(F.sum("n")).first()[0] <= 400 and r.parts["thresholds"].count() == 5
    assert report.profile_table(s, report.Options(label="no such column")).error is None
    wrong = {x["id"] for x in s.where("label <> true_label").collect()}
    found, quality = labels.clean_learning(s, "label", "id", ["true_label"], trees=10, depth=4)
    hit = {x["row_id"] for x in found.collect()}
    assert len(hit & wrong) >= 0.8 * len(hit) and len(hit & wrong) >= 0.6 * len(wrong)
    assert quality.count() == 400 and quality.where("quality < 0 or quality > 1").count() == 0


def test_labels_that_cant_be_checked(spark):
    d = spark.createDataFrame([(i, float(i), "x") for i in range(3)], "row_id long, v double, y string")
    assert report.profile_table(d, report.Options(label="y")).error == "labels of at least two classes are needed"
    d = spark.createDataFrame([(i, float(i), "xy"[i % 2]) for i in range(4)], "row_id long, v double, y string")
    assert "at least 5 rows" in report.profile_table(d, report.Options(label="y")).error


def test_a_forest_fold_without_a_class(spark):
    """One class has a single row, so that the fold that holds it is predicted by a forest that never saw the class."""
    d = spark.createDataFrame([(i, float(i % 2), "ab"[i % 2]) for i in range(40)] + [(99, 5.0, "c")], "row_id long, v double, y string")
    got = labels.label_issues(d, "y", trees=5, depth=3).collect()
    assert len(got) == 41 and all(len(r["p"]) == 3 and abs(sum(r["p"]) - 1) < 1e-9 for r in got)
    assert next(r["p"][2] for r in got if r["row_id"] == 99) == 0.0


def test_any_provider_of_probabilities(spark):
    d = spark.createDataFrame([(i, float(i % 2), "no" if i % 2 else "yes", i % 2) for i in range(20)] + [(20, 1.0, "yes", 1)], "id long, v double, label string, fold int")
    seen = []

    def by_sign(rows, features):
        seen.append((rows.columns, features))
        return rows.withColumn("p", F.when(F.col("x0") > 0, F.array(F.lit(0.9), F.lit(0.1))).otherwise(F.array(F.lit(0.2), F.lit(0.8))))

    got = labels.label_issues(d, "label", "id", by_sign, exclude=["fold"])
    assert seen == [(["row_id", "x0", "y", "fold"], ["x0"])] and got.columns == ["row_id", "y", "p"]
    assert [(r["row_id"], r["given"], r["predicted"]) for r in labels.errors(got).collect()] == [(20, 1, 0)]


def test_sinks(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n1,x\n2,\n2,\n")
    r = report.profile_file(spark, f"{tmp_path}/in.csv")
    rows = [(x["kind"], json.loads(x["json"])) for x in r.to_json().collect()]
    assert rows[0][0] == "metrics" and rows[0][1] == {"rows": 3, "columns": 2, "missing_value_rate": 2 / 6 * 100, "outlier_rate": 0.0, "duplicate_row_rate": 1 / 3 * 100, "file": "in.csv"}
    assert sorted((x["type"], x.get("column"), x["count"]) for k, x in rows if k == "issue") == [("duplicate_rows", None, 1), ("missing_value", "b", 2)]
    assert [x["type"] for x in r.ordered().collect()] == ["missing_value", "duplicate_rows"]
    for kind in ("json", "parquet", "csv"):
        r.write(f"{tmp_path}/{kind}", kind)
        back = spark.read.option("header", True).format(kind).load(f"{tmp_path}/{kind}/metrics").first()
        assert int(back["rows"]) == 3 and float(back["duplicate_row_rate"]) == 1 / 3 * 100
    report.write_csv(samples.clean_labels(spark, 20), f"{tmp_path}/one", ["id", "label"])
    (part,) = (tmp_path / "one").glob("*.csv")
    assert part.read_text().splitlines()[0] == "id,label" and len(part.read_text().splitlines()) == 21
    (tmp_path / "t.txt").write_text("a\n\na\n")
    t = report.profile_file(spark, f"{tmp_path}/t.txt")
    assert t.file == "t.txt" and sorted(x["type"] for x in t.issues.collect()) == ["duplicate_text", "empty_text"]


def test_samples(spark):
    s = samples.noisy_labels(spark).persist()
    assert len(s.columns) == 15 and s.count() == 2000 and s.where("label <> true_label").count() == 500
    h = {r["true_label"]: (r["n"], r["wrong"]) for r in samples.label_histogram(s).collect()}
    assert set(h) == {f"Class_{k}" for k in range(5)} and sum(w for _, w in h.values()) == 500 and all(330 < n < 470 for n, _ in h.values())
    for r in s.groupBy("true_label").agg(F.avg("feature_1"), F.stddev("feature_1"), F.avg("feature_2"), F.avg("feature_3"), F.avg("feature_9"), F.avg((F.col("cat_1") == "A").cast("int"))).collect():
        k = int(r[0][-1])
        assert abs(r[1] - 10 * (k + 1)) < 0.6 and abs(r[2] - 2) < 0.4 and abs(r[3] - 10 * (k + 1) - 5) < 0.9 and abs(r[4] - 10 * (k + 1) + 3) < 0.8 and abs(r[5] - 30) < 6
    near = s.where("label <> true_label").select(F.abs(F.substring("label", 7, 1).cast("int") - F.substring("true_label", 7, 1).cast("int")).alias("d")).groupBy("d").count().collect()
    assert {r["d"] for r in near} <= {1, 2, 3, 4} and next(r["count"] for r in near if r["d"] == 1) > 175
    assert s.where("round(feature_1, 2) <> feature_1").count() == 0 and s.where("feature_9 < 0").count() == 0
    assert samples.noisy_labels(spark).exceptAll(s).count() == 0
    c = samples.clean_labels(spark)
    assert c.count() == 100 and c.columns == ["id", "feature_1", "true_label", "label"] and c.where("label <> true_label").count() == 0


def test_csv_types_are_those_of_a_data_frame_library(spark, tmp_path):
    cells = {"yes": ["yes", "no", "yes"], "t": ["t", "f", "t"], "d": ["1d", "2f", "3"], "truth": ["True", "false", "TRUE"], "mixed": ["True", "yes", "false"], "real": ["1.", ".5", "-2e3"], "whole": ["+1", "-2", " 3 "], "inf": ["inf", "-Infinity", "1"], "large": ["9223372036854775808", "1", "2"], "gap": ["1", "NA", "3"], "day": ["2020-01-01", "1", "2"]}
    (tmp_path / "t.csv").write_text("\n".join(",".join(r) for r in [list(cells), *zip(*cells.values())]) + "\n")
    for multi in (True, False):
        d = readers.read_csv(spark, f"{tmp_path}/t.csv", multi_line=multi)
        assert dict(d.dtypes) == {"yes": "string", "t": "string", "d": "string", "truth": "boolean", "mixed": "string", "real": "double", "whole": "bigint", "inf": "double", "large": "double", "gap": "bigint", "day": "string"}
        assert [r["whole"] for r in d.collect()] == [1, -2, 3] and [r["real"] for r in d.collect()] == [1.0, 0.5, -2000.0]
        assert [r["truth"] for r in d.collect()] == [True, False, True] and d.first()["inf"] == math.inf


def workbook(rows: list[str]) -> bytes:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/first.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><t>n</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/first.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(f"<row>{r}</row>" for r in rows)}</sheetData></worksheet>')
    return out.getvalue()


def test_excel(spark, tmp_path):
    rows = ['<c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c><c r="D1" t="inlineStr"><is><t>ok</t></is></c><c r="F1" t="inlineStr"><is><t>e</t></is></c>', '<c r="A2" t="s"><v>2</v></c><c r="B2"><v>3</v></c><c r="C2"><v>0.5</v></c><c r="D2" t="b"><v>1</v></c>', '<c r="A3" t="inlineStr"><is><t>NA</t></is></c><c r="C3"><v>2</v></c><c r="D3" t="b"><v>0</v></c>']
    (tmp_path / "b.xlsx").write_bytes(workbook(rows))
    d = readers.read(spark, f"{tmp_path}/b.xlsx")
    assert d.dtypes == [("name", "string"), ("n", "bigint"), ("x", "double"), ("ok", "boolean"), ("Unnamed: 4", "double"), ("e", "double")]
    assert [tuple(r) for r in d.collect()] == [("ab", 3, 0.5, True, None, None), (None, None, 2.0, False, None, None)]
    (tmp_path / "none.xlsx").write_bytes(workbook([]))
    assert readers.read(spark, f"{tmp_path}/none.xlsx").columns == []


def test_ties_leave_one_row_unflagged(spark):
    d = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (2, "a", 2), (1, "b", 3), (None, None, 4), (None, None, 5), (5, None, 6)], "o int, k string, n int")
    got = table.flag_duplicates(d, ["o"], ["k"]).collect()
    assert len(got) == 7
    flags = lambda k: sorted(r["is_duplicate"] for r in got if r["k"] == k)
    assert flags("a") == [False, True, True] and flags("b") == [False] and flags(None) == [False, True, True]
    assert next(r["is_duplicate"] for r in got if r["n"] == 2)


@pytest.mark.parametrize("few", [20_000, 20])
def test_exact_quantiles(spark, monkeypatch, few):
    """With few=20, brackets must be narrowed again and again."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "ACCURACY", 10_000 if few > 20 else 100)
    rng = np.random.default_rng(3)
    sets = {0: rng.normal(size=30_000), 1: rng.integers(0, 3, 30_000).astype(float), 2: np.array([5.0]), 3: np.round(rng.exponential(size=4_000), 1), 4: np.concatenate([rng.normal(size=2000), [np.inf, -np.inf]]), 5: np.repeat([1.0, 2.0], 10_000)}
    import pandas as pd

    d = spark.createDataFrame(pd.concat(pd.DataFrame({"k": k, "x": v}) for k, v in sets.items())).repartition(5)
    d = d.unionByName(spark.createDataFrame([(0, None), (7, None)], d.schema))
    qs = [0.0, 0.25, 0.5, 0.75, 0.85, 1.0]
    got = quantiles.exact_quantiles(d, qs)
    assert set(got) == set(sets)
    for k, v in sets.items():
        assert got[k][0] == len(v)
        s = np.sort(v)
        for q, x in zip(qs, got[k][1]):
            at = q * (len(v) - 1)
            a, b = s[math.floor(at)], s[math.ceil(at)]
            assert x == a if a == b else math.isclose(x, a + (at - math.floor(at)) * (b - a), rel_tol=1e-12, abs_tol=1e-12), (k, q)
    assert quantiles.exact_quantiles(d.limit(0), qs) == {}
