"""Label errors by confident learning: encoding, folds, out-of-fold probabilities, thresholds, joint, scores, pruning.

Rows with a NULL label are left out. Label codes are dense, in the order of the labels, whatever their type. Windows
without a partition run over distinct classes or encoded values alone, never over rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CONFIDENCE_PERCENTILE, DEFAULT_THRESHOLD, FOLDS, QUALITY_LIMIT
from ..functions.quantiles import exact_quantiles
from ..functions.scalar import argmax, number
from ..sources.shared import shared_dir

#: Rows that a task of a forest's fit has, at least.
ROWS_A_TASK = 20_000
#: Stretches of row ids in which ranks are counted side by side.
STRETCHES = 1024


class LabelError(ValueError):
    """The labels don't allow cross-validation."""


def settled(df: DataFrame) -> DataFrame:
    """df computed once, by a reliable checkpoint, in as few tasks as its rows need: a fit is a chain of small jobs."""
    shared_dir(df.sparkSession)
    d = df.checkpoint()
    few = max(1, d.count() // ROWS_A_TASK)
    return d.coalesce(few) if few < d.rdd.getNumPartitions() else d


def codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code) of the distinct values that aren't NULL, in their order, from 0."""
    v = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    return v.select("value", (F.dense_rank().over(Window.orderBy("value")) - 1).cast("int").alias("code"))


def encode_label(df: DataFrame, label: str, out: str = "y") -> DataFrame:
    """df without rows that lack a label, with the label's code in a further column."""
    c = codes(df, label).toDF("__value", out)
    return df.join(c, F.col(label) == F.col("__value")).drop("__value")


def encode_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with these columns as codes of their text; NULL counts as 'missing'.

    Each column's codes come from df itself, so that the plan grows with the columns and doesn't double with each.
    """
    out = df
    for name in columns:
        v = F.coalesce(F.col(name).cast("string"), F.lit("missing"))
        c = codes(df.select(v.alias("v")), "v").toDF("__value", "__code")
        out = out.join(c, v == F.col("__value")).withColumn(name, F.col("__code")).select(*df.columns)
    return out


def standardize(df: DataFrame, columns: Sequence[str], scale: bool = True) -> DataFrame:
    """df with these numeric columns as DOUBLE, missing values replaced by the mean, and scaled by the deviation.

    The deviation is that of the population after replacement; where it is 0 it counts as 1, and a column without any
    value is 0. One aggregate serves all columns, and its single row is broadcast.
    """
    fields = {f.name: f for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(columns):
        x = number(fields[c])
        aggs += [F.avg(x).alias(f"m{i}"), (F.stddev_pop(x) * F.sqrt(F.count(x) / F.count(F.lit(1)))).alias(f"s{i}")]
    if not aggs:
        return df
    stats = df.agg(*aggs).select(F.struct("*").alias("__stats"))
    out = df.crossJoin(F.broadcast(stats))
    new = {}
    for i, c in enumerate(columns):
        mean, dev = F.col(f"__stats.m{i}"), F.col(f"__stats.s{i}")
        x = F.coalesce(number(fields[c]), mean, F.lit(0.0))
        new[c] = (x - F.coalesce(mean, F.lit(0.0))) / F.when(dev > 0, dev).otherwise(1.0) if scale else x
    return out.withColumns(new).drop("__stats")


def stratified_folds(df: DataFrame, row_id: str = "row_id", y: str = "y", folds: int = FOLDS) -> DataFrame:
    """df with a fold, stratified by class and without shuffling.

    Ordered by class, in the order of first appearance, every folds-th row adds one to a fold's share of its class; in
    a class, consecutive rows by id fill the shares. Shares follow from the class counts alone, and ranks are counted in
    stretches of ids side by side, so that a hot class is no bottleneck.
    """
    ends = df.agg(F.min(row_id).alias("__low"), F.max(row_id).alias("__high"))
    at = F.floor((F.col(row_id) - F.col("__low")).cast("double") * (STRETCHES - 1) / F.greatest(F.col("__high") - F.col("__low"), F.lit(1)))
    d = df.crossJoin(F.broadcast(ends)).withColumn("__at", at.cast("int")).drop("__low", "__high")
    part = d.groupBy(F.col(y).alias("__y"), F.col("__at").alias("__a")).agg(F.count(F.lit(1)).alias("__n"), F.min(row_id).alias("__first"))
    part = part.withColumn("__before", F.sum("__n").over(Window.partitionBy("__y").orderBy("__a")) - F.col("__n"))
    cls = part.groupBy("__y").agg(F.sum("__n").alias("__n"), F.min("__first").alias("__first"))
    cls = cls.withColumn("__start", F.sum("__n").over(Window.orderBy("__first")) - F.col("__n"))

    def below(place, fold: int):
        """Places under `place` that fall on this fold."""
        return F.floor((place + (folds - 1 - fold)) / folds)

    share = F.array(*(below(F.col("__start") + F.col("__n"), f) - below(F.col("__start"), f) for f in range(folds)))
    cls = cls.select(F.col("__y").alias("__c"), share.alias("__share"))
    part = part.select("__y", "__a", "__before").join(cls, F.col("__y") == F.col("__c")).drop("__c")
    rank = F.row_number().over(Window.partitionBy(y, "__at").orderBy(row_id)) - 1
    j = d.withColumn("__rank", rank).join(part, (F.col(y) == F.col("__y")) & (F.col("__at") == F.col("__a")))
    r = F.col("__rank") + F.col("__before")
    fold = sum(((r >= F.aggregate(F.slice("__share", 1, f + 1), F.lit(0).cast("long"), lambda a, x: a + x)).cast("int") for f in range(folds - 1)), F.lit(0))
    return j.withColumn("fold", fold).select(*df.columns, "fold")


def frequency_provider(df: DataFrame, key: str, classes: int, y: str = "y") -> DataFrame:
    """df with p: class probabilities given a key, from the other folds alone, with one added to every count."""
    n = F.array(*(F.count_if(F.col(y) == c) for c in range(classes)))
    own = df.groupBy(F.col(key).alias("__k"), F.col("fold").alias("__f")).agg(n.alias("__own"))
    whole = df.groupBy(F.col(key).alias("__w")).agg(n.alias("__all"))
    j = df.join(own, F.col(key).eqNullSafe(F.col("__k")) & (F.col("fold") == F.col("__f"))).join(whole, F.col(key).eqNullSafe(F.col("__w")))
    j = j.withColumn("__rest", F.zip_with("__all", "__own", lambda a, b: a - b))
    total = F.aggregate("__rest", F.lit(0).cast("long"), lambda a, x: a + x) + classes
    return j.withColumn("p", F.transform("__rest", lambda x: (x + 1).cast("double") / total.cast("double"))).select(*df.columns, "p")


def _forest(y: str, trees: int, depth: int, seed: int):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol="__x", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")


def _assembled(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="__x").transform(df).withColumn(y, F.col(y).cast("double"))


def forest_provider(df: DataFrame, features: Sequence[str], y: str = "y", trees: int = 200, depth: int = 10, seed: int = 42, folds: int = FOLDS) -> DataFrame:
    """df (with fold) and p: out-of-fold class probabilities of a random forest, one fit for each fold.

    The forest isn't bit-equal to any other implementation. A fold whose training rows lack the last class gives p of
    full length, with 0 for it.
    """
    from pyspark.ml.functions import vector_to_array

    d = _assembled(df, features, y).persist()
    k = int(d.agg(F.max(y)).first()[0] or 0) + 1
    with ThreadPoolExecutor(folds) as pool:  # a fit is a chain of small jobs; the folds' chains run side by side
        models = list(pool.map(lambda f: _forest(y, trees, depth, seed).fit(d.where(F.col("fold") != f)), range(folds)))
    out = None
    for f, m in enumerate(models):
        p = vector_to_array("probability")
        t = m.transform(d.where(F.col("fold") == f)).withColumn("p", F.concat(p, F.array_repeat(F.lit(0.0), k - m.numClasses)) if m.numClasses < k else p)
        t = t.withColumn(y, F.col(y).cast("int")).select(*df.columns, "p")
        out = t if out is None else out.unionByName(t)
    out = settled(out)  # thresholds, joint and scores all read it
    d.unpersist()
    return out


def refit(df: DataFrame, kept: DataFrame, features: Sequence[str], y: str = "y", trees: int = 200, depth: int = 10, seed: int = 42) -> DataFrame:
    """df with p and predicted of one forest that was fitted on the kept rows."""
    from pyspark.ml.functions import vector_to_array

    m = _forest(y, trees, depth, seed).fit(_assembled(kept, features, y))
    return m.transform(_assembled(df, features, y)).withColumn("p", vector_to_array("probability")).withColumn("predicted", F.col("prediction").cast("int")).withColumn(y, F.col(y).cast("int")).select(*df.columns, "p", "predicted")


def _own(p: str = "p", y: str = "y"):
    return F.get(F.col(p), F.col(y))


def thresholds(d: DataFrame, percentile: float = CONFIDENCE_PERCENTILE, approx: bool = False) -> DataFrame:
    """(class, threshold): a percentile of the probability that rows give their own class.

    Exact percentiles are computed when this is called, without a task that holds a class's distinct values.
    """
    if approx:
        return d.groupBy(F.col("y").alias("class")).agg(F.percentile_approx(_own(), percentile, 100_000).alias("threshold"))
    found = exact_quantiles(d.select(F.col("y").alias("k"), _own().alias("x")), [percentile])
    return d.sparkSession.createDataFrame([(k, q[0]) for k, (_, q) in found.items()], f"class {d.schema['y'].dataType.simpleString()}, threshold double")


def _grid(d: DataFrame) -> DataFrame:
    """(given, predicted) of all classes; what is paired are distinct classes."""
    c = d.select("y").distinct()
    return c.select(F.col("y").alias("given")).crossJoin(c.select(F.col("y").alias("predicted")))


def confident_joint(d: DataFrame, percentile: float = CONFIDENCE_PERCENTILE, approx: bool = False) -> DataFrame:
    """(given, predicted, n): rows whose greatest probability reaches the threshold of its class, the first on ties."""
    t = thresholds(d, percentile, approx).withColumnRenamed("class", "__c")
    x = d.select("y", argmax(F.col("p")).alias("pred"), F.array_max("p").alias("top")).join(t, F.col("pred") == F.col("__c"), "left")
    n = x.where(F.col("top") >= F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))).groupBy(F.col("y").alias("given"), F.col("pred").alias("predicted")).count()
    return _grid(d).join(n, ["given", "predicted"], "left").select("given", "predicted", F.coalesce("count", F.lit(0).cast("long")).alias("n"))


def class_prior(d: DataFrame) -> DataFrame:
    """(class, n, prior)."""
    c = d.groupBy(F.col("y").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(c.agg(F.sum("n").alias("__all"))).select("class", "n", (F.col("n").cast("double") / F.col("__all").cast("double")).alias("prior"))


def noise_matrix(d: DataFrame, percentile: float = CONFIDENCE_PERCENTILE, approx: bool = False) -> DataFrame:
    """(given, predicted, rate): the joint over the class counts; rows need not add up to 1."""
    c = d.groupBy(F.col("y").alias("given")).agg(F.count(F.lit(1)).alias("total"))
    return confident_joint(d, percentile, approx).join(c, "given").select("given", "predicted", (F.col("n").cast("double") / F.col("total").cast("double")).alias("rate"))


def scores(d: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, given, predicted, quality): the probability of the label that the row has."""
    return d.select(F.col(row_id).alias("row_id"), F.col("y").alias("given"), argmax(F.col("p")).alias("predicted"), _own().alias("quality"))


def errors(d: DataFrame, row_id: str = "row_id", limit: float = QUALITY_LIMIT) -> DataFrame:
    """scores() of the rows with a quality under the limit."""
    return scores(d, row_id).where(F.col("quality") < limit)


def summary(d: DataFrame, limit: float = QUALITY_LIMIT) -> DataFrame:
    """(total_samples, error_count, error_rate, mean_quality, min_quality, max_quality); error_rate is a fraction."""
    q = d.select(_own().alias("q"))
    n, bad = F.count(F.lit(1)), F.count_if(F.col("q") < limit)
    return q.agg(n.alias("total_samples"), bad.alias("error_count"), F.when(n > 0, bad.cast("double") / n.cast("double")).otherwise(0.0).alias("error_rate"), F.avg("q").alias("mean_quality"), F.min("q").alias("min_quality"), F.max("q").alias("max_quality"))


def worst(d: DataFrame, k: int, row_id: str = "row_id") -> DataFrame:
    """The k errors with the least quality; equal ones by id."""
    return errors(d, row_id).orderBy("quality", "row_id").limit(k)


def prune(d: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, given, suggested, margin): label errors of the published method, pruned by noise rate.

    Thresholds are means; a row counts for the most probable class that it reaches the threshold of; for every two
    classes, as many rows as the calibrated counts say go, those with the greatest margin, ties by id. A row that
    several classes claim is reported for the one with the greatest margin.
    """
    means = d.groupBy("y").agg(F.avg(_own()).alias("t")).agg(F.map_from_entries(F.collect_list(F.struct("y", "t"))).alias("__t"))  # one entry for each class
    x = d.select(F.col(row_id).alias("row_id"), F.col("y").alias("given"), "p").crossJoin(F.broadcast(means))
    reached = F.transform("p", lambda v, i: F.when(v >= F.element_at("__t", i.cast("int")), v).otherwise(F.lit(-1.0)))
    x = x.withColumn("__r", reached).withColumn("star", F.when(F.array_max("__r") >= 0, argmax(F.col("__r"))))
    total = x.groupBy("given").agg(F.count(F.lit(1)).alias("n"), F.count("star").alias("counted"))
    c = x.where("star is not null").groupBy("given", F.col("star").alias("suggested")).agg(F.count(F.lit(1)).alias("c")).where("given <> suggested")
    quota = c.join(total, "given").select("given", "suggested", F.floor(F.col("c") * F.col("n") / F.col("counted") + 0.5).alias("quota"))
    m = x.select("row_id", "given", F.posexplode("p").alias("suggested", "v"), F.get("p", F.col("given")).alias("own")).where("given <> suggested")
    m = m.join(quota, ["given", "suggested"]).withColumn("margin", F.col("v") - F.col("own"))
    m = m.withColumn("rank", F.row_number().over(Window.partitionBy("given", "suggested").orderBy(F.desc("margin"), "row_id"))).where("rank <= quota")
    best = m.groupBy("row_id").agg(F.max(F.struct("margin", (-F.col("suggested")).alias("s"), "given")).alias("b"))
    return best.select("row_id", "b.given", (-F.col("b.s")).alias("suggested"), "b.margin")


def check_labels(d: DataFrame, folds: int = FOLDS, y: str = "y") -> None:
    """LabelError with fewer than two classes, or if no class has a row for every fold."""
    r = d.groupBy(y).count().agg(F.count(F.lit(1)).alias("k"), F.max("count").alias("most")).first()
    if r["k"] < 2:
        raise LabelError("labels of at least two classes are needed")
    if r["most"] < folds:
        raise LabelError(f"a class with at least {folds} rows is needed")


def prepare(df: DataFrame, label: str, row_id: str, exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """(row_id, x0.., y, fold) and the names of the features x0..: all columns but the label, the id and the excluded ones.

    Features are encoded, completed and scaled; columns that are neither text nor numbers aren't among them. Their names
    are replaced, so that none can clash. The result is computed once, as many later steps read it.
    """
    wanted = [c for c in df.columns if c not in {label, row_id, *exclude}]
    d = df.select(F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{label}`").alias("__label"), *(F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(wanted)))
    feats = d.columns[2:]
    d = first = encode_label(d, "__label").persist()
    kinds = dict(d.dtypes)
    d = second = encode_categorical(d, [c for c in feats if kinds[c] == "string"]).persist()
    kinds = dict(d.dtypes)
    d = d.withColumns({c: F.col(c).cast("int") for c in feats if kinds[c] == "boolean"})
    feats = [c for c in feats if kinds[c] in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")]
    d = standardize(d, [c for c in feats if kinds[c] != "boolean"])
    folds = stratified_folds(d.select("row_id", "y")).select(F.col("row_id").alias("__id"), "fold")
    out = settled(d.join(folds, F.col("row_id") == F.col("__id")).select("row_id", *feats, "y", "fold"))
    first.unpersist()
    second.unpersist()
    return out, feats


def label_issues(df: DataFrame, label: str, row_id: str = "row_id", provider: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None, exclude: Sequence[str] = (), **forest) -> DataFrame:
    """(row_id, y, p): out-of-fold probabilities of every labelled row, for thresholds(), errors() and the others.

    The provider turns (rows, feature names) into rows with p; by default it is a random forest with these options.
    """
    d, feats = prepare(df, label, row_id, exclude)
    check_labels(d)
    got = provider(d, feats) if provider else forest_provider(d, feats, **forest)
    return got.select("row_id", "y", "p")


def clean_learning(df: DataFrame, label: str, row_id: str = "row_id", exclude: Sequence[str] = (), **forest) -> tuple[DataFrame, DataFrame]:
    """Issues (row_id, given, predicted, quality) by prune(), and quality (row_id, quality) of a forest fitted to the rest."""
    d, feats = prepare(df, label, row_id, exclude)
    check_labels(d)
    bad = prune(forest_provider(d, feats, **forest)).select(F.col("row_id").alias("__bad")).checkpoint()
    kept = settled(d.join(bad, F.col("row_id") == F.col("__bad"), "left_anti"))
    t = refit(d, kept, feats, **forest)
    all_ = t.select("row_id", F.col("y").alias("given"), "predicted", F.coalesce(_own(), F.lit(0.0)).alias("quality"))
    return all_.join(bad, F.col("row_id") == F.col("__bad"), "left_semi"), all_.select("row_id", "quality")
