"""Queries of the profiling operators by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import WHITE_SPACE
from ..operators import image, labels, table, text
from ..sources import readers, samples, shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of every column of events."""
    return table.profile(_t(spark, sf_dir, "events"))


def query(sql: str | None = None):
    """Register a function under its name, with the SQL of the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with missing values put in."""
    e = _t(spark, sf_dir, "events")
    return e.withColumn("event_type", F.nullif("event_type", F.lit("error"))).withColumn("value", F.when(F.col("value") >= 5, F.col("value")))


_GAPPY = "g AS (SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type, CASE WHEN value >= 5 THEN value END AS value, props FROM events)"
_EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def _missing_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS count, (count(*) - count({c})) / count(*) * 100.0 AS percentage FROM g" for c in _EVENT_COLUMNS)


def _bounds_sql(source: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source}" for c in columns)


def _outliers_sql(source: str, columns: tuple[str, ...]) -> str:
    one = [f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS count, count(*) FILTER (WHERE {c} < lo OR {c} > hi) / count(*) * 100.0 AS percentage, any_value(lo) AS lower, any_value(hi) AS upper FROM {source}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b WHERE \"column\" = '{c}')" for c in columns]
    return f"WITH b AS ({_bounds_sql(source, columns)}), o AS ({' UNION ALL '.join(one)}) SELECT * FROM o WHERE count > 0"


@query("SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns, 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS columns_list FROM lineitem")
def table_basic_info(spark, d):
    return table.basic_info(_t(spark, d, "lineitem"))


@query(f"WITH {_GAPPY} {_missing_sql()}")
def missing_per_column(spark, d):
    return table.missing(gappy_events(spark, d))


@query(f"WITH {_GAPPY}, m AS ({_missing_sql()}) SELECT CAST(sum(m.count) AS BIGINT) AS total, CAST(sum(m.count) AS DOUBLE) / (SELECT count(*) * 6 FROM g) * 100.0 AS percentage FROM m")
def missing_total(spark, d):
    return table.missing_total(gappy_events(spark, d))


_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"WITH b AS ({_bounds_sql('lineitem', _LINE)}) SELECT \"column\", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM b")
def iqr_bounds(spark, d):
    return table.iqr_bounds(_t(spark, d, "lineitem"))


@query(_outliers_sql("events", ("event_id", "user_id", "value")))
def iqr_outliers(spark, d):
    return table.outliers(_t(spark, d, "events"))


@query(_outliers_sql("documents", ("doc_id", "n_chars")))
def iqr_outliers_documents(spark, d):
    return table.outliers(_t(spark, d, "documents"))


@query(_outliers_sql("labels", ("doc_id", "quality", "toxic")))
def iqr_outliers_labels(spark, d):
    return table.outliers(_t(spark, d, "labels"))


@query(f"WITH b AS ({_bounds_sql('events', ('value',))}) SELECT event_id, value, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def iqr_outlier_rows(spark, d):
    return table.outlier_rows(_t(spark, d, "events"), "value").select("event_id", "value", "lower", "upper")


@query(f"SELECT CAST(sum(count) AS DOUBLE) / (SELECT count(*) FROM events) * 100.0 AS outlier_rate FROM ({_outliers_sql('events', ('event_id', 'user_id', 'value'))})")
def outlier_rate(spark, d):
    return table.outlier_rate(_t(spark, d, "events"))


_FLAGS = ("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
_FLAG_LIST = ", ".join(_FLAGS)


_REPEATED = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 7 = 0 UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 21 = 0)"


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of lineitem, some rows twice and some three times."""
    x = _t(spark, sf_dir, "lineitem")
    return x.unionByName(x.where("l_orderkey % 7 = 0")).unionByName(x.where("l_orderkey % 21 = 0"))


@query(f"SELECT CAST(sum(n) - count(*) AS BIGINT) AS count, (sum(n) - count(*)) / CAST(sum(n) AS DOUBLE) * 100.0 AS percentage FROM (SELECT count(*) AS n FROM {_REPEATED} GROUP BY ALL)".replace("count(*) AS n FROM", "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, count(*) AS n FROM"))
def duplicate_row_count(spark, d):
    return table.duplicate_rows(repeated_lines(spark, d))


@query(f"SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) > 1 AS is_duplicate FROM {_REPEATED}")
def duplicate_ties_flagged(spark, d):
    """Rows that equal another in the order columns as well: all but one are duplicates."""
    x = table.flag_duplicates(repeated_lines(spark, d), ["l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return x.select("l_orderkey", "l_linenumber", "is_duplicate")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey, l_linenumber, l_partkey, l_suppkey) <> min((l_orderkey, l_linenumber, l_partkey, l_suppkey)) OVER (PARTITION BY {_FLAG_LIST}) AS is_duplicate FROM lineitem")
def duplicate_rows_flagged(spark, d):
    x = table.flag_duplicates(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], list(_FLAGS))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "is_duplicate")


_TYPES_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'float64' ELSE CASE typeof(any_value({c})) WHEN 'BIGINT' THEN CASE WHEN count({c}) < count(*) THEN 'float64' ELSE 'int64' END WHEN 'DOUBLE' THEN 'float64'
        WHEN 'BOOLEAN' THEN 'bool' WHEN 'VARCHAR' THEN 'object' ELSE 'datetime64[ns]' END END AS dtype FROM t"""
    for c in ("event_id", "ts", "user_id", "event_type", "value", "late", "nothing")
)


@query(f"WITH t AS (SELECT event_id, ts, nullif(user_id, (SELECT min(user_id) FROM events)) AS user_id, event_type, value, value > 5 AS late, CAST(NULL AS BIGINT) AS nothing FROM events) {_TYPES_SQL}")
def data_types(spark, d):
    """Whole numbers with and without gaps, a truth value, a column without values."""
    e = _t(spark, d, "events").drop("props")
    least = e.agg(F.min("user_id").alias("least"))
    e = e.crossJoin(F.broadcast(least)).withColumn("user_id", F.nullif("user_id", "least")).drop("least")
    return table.data_types(e.withColumns({"late": F.col("value") > 5, "nothing": F.lit(None).cast("long")}))


_TWICE = _GAPPY.replace("g AS (", "h AS (") + ", g AS (SELECT * FROM h UNION ALL SELECT * FROM h WHERE event_id % 50 = 0)"


def twice_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gappy events, every fiftieth of them twice."""
    e = gappy_events(spark, sf_dir)
    return e.unionByName(e.where("event_id % 50 = 0"))


_DUP_EVENTS = "SELECT sum(n) - count(*) AS c, sum(n) AS n FROM (SELECT count(*) AS n FROM g GROUP BY ALL)".replace("count(*) AS n FROM g GROUP BY ALL", "count(*) AS n FROM g GROUP BY event_id, ts, user_id, event_type, value, props")
_TWICE_OUTLIERS = _outliers_sql("g", ("event_id", "user_id", "value")).replace("WITH b AS", f"WITH {_TWICE}, b AS", 1)


@query(
    f"WITH {_TWICE}, m AS ({_missing_sql()}), o AS ({_TWICE_OUTLIERS}), u AS ({_DUP_EVENTS}), n AS (SELECT count(*) AS n FROM g) "
    "SELECT n.n AS rows, CAST(6 AS BIGINT) AS columns, CAST((SELECT sum(count) FROM m) AS DOUBLE) / (n.n * 6) * 100.0 AS missing_value_rate, CAST(u.c AS DOUBLE) / u.n * 100.0 AS duplicate_row_rate, coalesce(CAST((SELECT sum(count) FROM o) AS DOUBLE), 0) / n.n * 100.0 AS outlier_rate FROM n, u"
)
def table_metrics(spark, d):
    return table.metrics(twice_events(spark, d))


@query(
    f"WITH {_TWICE}, m AS ({_missing_sql()}), o AS ({_TWICE_OUTLIERS}), u AS ({_DUP_EVENTS}) SELECT 'missing_value' AS type, \"column\", count, percentage FROM m WHERE count > 0 UNION ALL SELECT 'outlier', \"column\", count, percentage FROM o "
    "UNION ALL SELECT 'duplicate_rows', NULL, CAST(c AS BIGINT), CAST(c AS DOUBLE) / n * 100.0 FROM u WHERE c > 0"
)
def table_issues(spark, d):
    return table.issues(twice_events(spark, d))


_WS = "'" + WHITE_SPACE + "'"


def gappy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every fiftieth of them blank."""
    return _t(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 50 == 0, "  ").otherwise(F.col("text")))


_TEXTS = f"x AS (SELECT doc_id, lang, text, trim(text, {_WS}) AS k FROM (SELECT doc_id, lang, CASE WHEN doc_id % 50 = 0 THEN '  ' ELSE text END AS text FROM documents))"
_TEXT_DUPLICATES = "SELECT doc_id AS row_id, first AS original_row_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first FROM x) WHERE doc_id <> first"
_TEXT_METRICS = "count(*) AS total_texts, count(*) FILTER (WHERE k = '') / count(*) * 100.0 AS empty_text_rate, (count(*) - count(DISTINCT k)) / count(*) * 100.0 AS duplicate_text_rate, avg(length(text)) AS average_length, CAST(min(length(text)) AS DOUBLE) AS min_length, CAST(max(length(text)) AS DOUBLE) AS max_length FROM x"


@query(f"WITH {_TEXTS} SELECT doc_id AS row_id FROM x WHERE k = ''")
def text_empty(spark, d):
    return text.empty(gappy_texts(spark, d), "doc_id")


@query(f"WITH {_TEXTS} {_TEXT_DUPLICATES}")
def text_duplicates(spark, d):
    return text.duplicates(gappy_texts(spark, d), "doc_id")


@query(f"WITH {_TEXTS} SELECT {_TEXT_METRICS}")
def text_metrics(spark, d):
    return text.metrics(gappy_texts(spark, d))


@query(f"WITH {_TEXTS} SELECT lang, {_TEXT_METRICS} GROUP BY lang")
def text_metrics_by_lang(spark, d):
    return text.metrics(gappy_texts(spark, d), by="lang")


@query(f"WITH {_TEXTS} SELECT 'empty_text' AS type, doc_id AS row_id, CAST(NULL AS BIGINT) AS original_row_id FROM x WHERE k = '' UNION ALL SELECT 'duplicate_text', row_id, original_row_id FROM ({_TEXT_DUPLICATES})")
def text_issues(spark, d):
    return text.issues(gappy_texts(spark, d), "doc_id")


@query(
    r"WITH s AS (SELECT page_id, regexp_split_to_array(html, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS a FROM pages), "
    "k AS (SELECT page_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM s) "
    "SELECT page_id AS row_id, CAST(i - 1 AS INTEGER) AS line_no, a[i] AS line FROM (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS i FROM k)"
)
def text_splitlines(spark, d):
    return text.lines(_t(spark, d, "pages"), "page_id", "html")


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment FROM (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END, 'missing') AS c_mktsegment FROM customer)")
def encode_categorical(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return labels.encode_categorical(c, ["c_mktsegment"])


@query("SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS y FROM documents")
def encode_label(spark, d):
    return labels.encode_label(_t(spark, d, "documents").select("doc_id", "lang"), "lang").select("doc_id", "y")


_PART = "p AS (SELECT p_partkey, CAST(nullif(p_size, 1) AS DOUBLE) AS s, p_retailprice AS r FROM part), m AS (SELECT avg(s) AS ms, avg(r) AS mr FROM p)"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("p_size"), "p_retailprice")


@query(f"WITH {_PART} SELECT p_partkey, round(coalesce(s, ms), 6) AS p_size, round(coalesce(r, mr), 6) AS p_retailprice FROM p, m")
def impute_mean(spark, d):
    x = labels.standardize(_part(spark, d), ["p_size", "p_retailprice"], scale=False)
    return x.select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


@query(f"WITH {_PART}, i AS (SELECT p_partkey, coalesce(s, ms) AS s, coalesce(r, mr) AS r, ms, mr FROM p, m), v AS (SELECT stddev_pop(s) AS ds, stddev_pop(r) AS dr FROM i) SELECT p_partkey, round((s - ms) / ds, 6) + 0.0 AS p_size, round((r - mr) / dr, 6) + 0.0 AS p_retailprice FROM i, v")
def standardize(spark, d):
    x = labels.standardize(_part(spark, d), ["p_size", "p_retailprice"])
    return x.select("p_partkey", (F.round("p_size", 6) + 0.0).alias("p_size"), (F.round("p_retailprice", 6) + 0.0).alias("p_retailprice"))


def _folds_sql(rows: str) -> str:
    return f"""d AS ({rows}),
        e AS (SELECT row_id, k, CAST(dense_rank() OVER (ORDER BY lab) - 1 AS INTEGER) AS y FROM d),
        o AS (SELECT y, row_number() OVER (ORDER BY min(row_id)) AS code FROM e GROUP BY y),
        pos AS (SELECT y, (row_number() OVER (ORDER BY code, row_id) - 1) % 5 AS fold FROM e JOIN o USING (y)),
        al AS (SELECT y, fold, count(*) AS a FROM pos GROUP BY y, fold),
        lim AS (SELECT y, fold, sum(a) OVER (PARTITION BY y ORDER BY fold) - a AS lo, sum(a) OVER (PARTITION BY y ORDER BY fold) AS hi FROM al),
        rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY row_id) - 1 AS r FROM e),
        f AS (SELECT row_id, k, rk.y, CAST(fold AS INTEGER) AS fold FROM rk JOIN lim ON rk.y = lim.y AND r >= lo AND r < hi)"""


@query("WITH " + _folds_sql("SELECT vec_id AS row_id, 0 AS k, label AS lab FROM embeddings") + " SELECT row_id, y, fold FROM f")
def stratified_folds(spark, d):
    e = labels.encode_label(_t(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label"), "label")
    return labels.stratified_folds(e).select("row_id", "y", "fold")


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, y, fold, p): quality labels with out-of-fold probabilities by language."""
    j = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    e = labels.encode_label(j.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("k"), "quality"), "quality")
    # each step reads its input several times; cached, the plan stays flat
    f = labels.stratified_folds(e.select("row_id", "k", "y").persist()).persist()
    return labels.frequency_provider(f, "k", 2).select("row_id", "y", "fold", "p").persist()


_P = (
    "WITH "
    + _folds_sql("SELECT doc_id AS row_id, lang AS k, quality AS lab FROM labels JOIN documents USING (doc_id)")
    + """, c AS (SELECT row_id, y, fold, count(*) OVER (PARTITION BY k) - count(*) OVER (PARTITION BY k, fold) AS n,
            sum(y) OVER (PARTITION BY k) - sum(y) OVER (PARTITION BY k, fold) AS n1 FROM f),
        q AS (SELECT row_id, y, fold, CAST(n - n1 + 1 AS DOUBLE) / CAST(n + 2 AS DOUBLE) AS p0, CAST(n1 + 1 AS DOUBLE) / CAST(n + 2 AS DOUBLE) AS p1 FROM c),
        s AS (SELECT *, CASE WHEN y = 1 THEN p1 ELSE p0 END AS own, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS pred, greatest(p0, p1) AS top FROM q),
        th AS (SELECT y AS class, quantile_cont(own, 0.85) AS threshold FROM s GROUP BY y),
        cnt AS (SELECT s.y AS given, s.pred AS predicted, count(*) AS n FROM s LEFT JOIN th ON s.pred = th.class WHERE top >= coalesce(threshold, 0.5) GROUP BY ALL),
        jt AS (SELECT a.class AS given, b.class AS predicted, coalesce(n, 0) AS n FROM th a CROSS JOIN th b LEFT JOIN cnt ON cnt.given = a.class AND cnt.predicted = b.class),
        er AS (SELECT row_id, y AS given, CAST(pred AS INTEGER) AS predicted, own AS quality FROM s) """
)


@query(_P + "SELECT row_id, y, fold, round(p0, 9) AS p0, round(p1, 9) AS p1 FROM q")
def oof_probabilities(spark, d):
    return frequencies(spark, d).select("row_id", "y", "fold", F.round(F.col("p")[0], 9).alias("p0"), F.round(F.col("p")[1], 9).alias("p1"))


@query(_P + "SELECT class, round(threshold, 9) AS threshold FROM th")
def confidence_thresholds(spark, d):
    return labels.thresholds(frequencies(spark, d)).select("class", F.round("threshold", 9).alias("threshold"))


@query(_P + "SELECT given, predicted, n FROM jt")
def confident_joint(spark, d):
    return labels.confident_joint(frequencies(spark, d))


@query(_P + "SELECT given, predicted, round(CAST(n AS DOUBLE) / t, 9) AS rate FROM jt JOIN (SELECT y AS given, count(*) AS t FROM s GROUP BY y) USING (given)")
def noise_matrix(spark, d):
    return labels.noise_matrix(frequencies(spark, d)).withColumn("rate", F.round("rate", 9))


@query(_P + "SELECT y AS class, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM s), 9) AS prior FROM s GROUP BY y")
def class_prior(spark, d):
    return labels.class_prior(frequencies(spark, d)).withColumn("prior", F.round("prior", 9))


@query(_P + "SELECT row_id, given, predicted, round(quality, 9) AS quality FROM er")
def label_quality_scores(spark, d):
    return labels.scores(frequencies(spark, d)).withColumn("quality", F.round("quality", 9))


@query(_P + "SELECT row_id, given, predicted, round(quality, 9) AS quality FROM er WHERE quality < 0.6")
def label_errors(spark, d):
    return labels.errors(frequencies(spark, d)).withColumn("quality", F.round("quality", 9))


@query(_P + "SELECT count(*) AS total_samples, count(*) FILTER (WHERE quality < 0.6) AS error_count, round(count(*) FILTER (WHERE quality < 0.6) / CAST(count(*) AS DOUBLE), 9) AS error_rate, round(avg(quality), 9) AS mean_quality, round(min(quality), 9) AS min_quality, round(max(quality), 9) AS max_quality FROM er")
def label_error_summary(spark, d):
    s = labels.summary(frequencies(spark, d))
    return s.select("total_samples", "error_count", *(F.round(c, 9).alias(c) for c in s.columns[2:]))


@query(_P + "SELECT row_id, given, predicted, round(quality, 9) AS quality FROM er WHERE quality < 0.6 ORDER BY er.quality, row_id LIMIT 20")
def label_errors_topk(spark, d):
    return labels.worst(frequencies(spark, d), 20).withColumn("quality", F.round("quality", 9))


@query(
    _P.rstrip()
    + """, mt AS (SELECT max(t) FILTER (WHERE y = 0) AS t0, max(t) FILTER (WHERE y = 1) AS t1 FROM (SELECT y, avg(own) AS t FROM s GROUP BY y)),
        st AS (SELECT s.*, CASE WHEN p0 >= t0 - 1e-12 AND (p1 < t1 - 1e-12 OR p0 >= p1) THEN 0 WHEN p1 >= t1 - 1e-12 THEN 1 END AS star FROM s, mt),
        tot AS (SELECT y, count(*) AS n, count(star) AS counted FROM st GROUP BY y),
        quo AS (SELECT st.y, star, floor(count(*) * any_value(n) / CAST(any_value(counted) AS DOUBLE) + 0.5) AS quota FROM st JOIN tot USING (y) WHERE star IS NOT NULL AND star <> st.y GROUP BY st.y, star),
        mg AS (SELECT row_id, s.y, 1 - s.y AS star, CASE WHEN s.y = 0 THEN p1 - p0 ELSE p0 - p1 END AS margin FROM s),
        rr AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY margin DESC, row_id) AS rank FROM mg)
        SELECT row_id, rr.y AS given, CAST(rr.star AS INTEGER) AS suggested, round(margin, 9) AS margin FROM rr JOIN quo ON rr.y = quo.y AND rr.star = quo.star WHERE rank <= quota"""
)
def confident_prune(spark, d):
    return labels.prune(frequencies(spark, d)).withColumn("margin", F.round("margin", 9))


def mislabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a label that follows from their size, wrong for every twentieth."""
    p = _t(spark, sf_dir, "part")
    small, wrong = F.col("p_size") <= 25, F.col("p_partkey") % 20 == 0
    return p.select("p_partkey", F.floor((F.col("p_size") - 1) / 5).alias("step"), "p_retailprice", F.when(small != wrong, "small").otherwise("large").alias("label"))


@query("SELECT p_partkey AS row_id, CAST(CASE WHEN p_size <= 25 THEN 0 ELSE 1 END AS INTEGER) AS given, CAST(CASE WHEN p_size <= 25 THEN 1 ELSE 0 END AS INTEGER) AS predicted FROM part WHERE p_partkey % 20 = 0")
def label_errors_forest(spark, d):
    """Out-of-fold probabilities of a random forest find exactly the labels that don't follow from the size."""
    return labels.errors(labels.label_issues(mislabelled(spark, d), "label", "p_partkey", trees=20, depth=4)).select("row_id", "given", "predicted")


@query()
def clean_learning(spark, d):
    """Issues of the published method, with a forest fitted to the rest; what a forest gives can't be put in SQL."""
    return labels.clean_learning(mislabelled(spark, d), "label", "p_partkey", trees=20, depth=4)[0]


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 pixels."""
    px = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int"))
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), px.alias("px"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as gray images of various sizes, every fourth of one shade, and every 25th no image."""
    i = F.col("vec_id")
    px = F.transform("embedding", lambda x: (F.floor(x.cast("double") * (i % 4) * 40) + 128).cast("int"))
    px = F.transform(px, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), x)))
    return _t(spark, sf_dir, "embeddings").select(i.alias("row_id"), (i % 80 + 60).cast("int").alias("height"), (i % 50 + 80).cast("int").alias("width"), F.when(i % 25 != 0, px).alias("px"))


#: Files that the image source lists at once; their names are in the driver's memory.
ROUND_FILES = 50_000


def _rounds(folders: list[tuple[str, int]]) -> list[list[str]]:
    """Folders in groups of at most ROUND_FILES files, or of one folder."""
    out, n = [], 0
    for name, files in folders:
        if not out or n + files > ROUND_FILES:
            out.append([])
            n = 0
        out[-1].append(name)
        n += files
    return out


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and sharpness of the pictures, written as PNG files and read by the image source, in rounds, into a table."""
    folder, into = shared.new_folder(spark, "pictures"), shared.new_folder(spark, "measured")
    shared.forget(spark, folder)
    shared.forget(spark, into)
    kinds = "row_id long, height int, width int, sharpness double"
    rounds = _rounds(samples.write_images(pictures(spark, sf_dir), folder))
    for some in rounds:
        m = image.measure(readers.read_images(spark, some))
        m = m.select(F.regexp_extract("origin", r"(-?\d+)\.png$", 1).try_cast("long").alias("row_id"), "height", "width", F.round("sharpness", 6).alias("sharpness"))
        m.write.mode("append").parquet(into)
    return spark.read.schema(kinds).parquet(into) if rounds else spark.createDataFrame([], kinds)


_LAPLACIAN = """g AS (SELECT vec_id AS row_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS BIGINT)) AS px FROM embeddings),
    c AS (SELECT row_id, px, unnest(range(64)) AS i FROM g),
    l AS (SELECT row_id, px[CASE WHEN i // 8 > 0 THEN i - 7 ELSE i + 9 END] + px[CASE WHEN i // 8 < 7 THEN i + 9 ELSE i - 7 END]
        + px[CASE WHEN i % 8 > 0 THEN i ELSE i + 2 END] + px[CASE WHEN i % 8 < 7 THEN i + 2 ELSE i END] - 4 * px[i + 1] AS v FROM c),
    v AS (SELECT row_id, CAST(sum(v * v) AS DOUBLE) / 64.0 - (CAST(sum(v) AS DOUBLE) / 64.0) * (CAST(sum(v) AS DOUBLE) / 64.0) AS sharpness FROM l GROUP BY row_id)"""
_MEASURED = """WITH g AS (SELECT vec_id AS row_id, vec_id % 80 + 60 AS h, vec_id % 50 + 80 AS w, list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor(CAST(x AS DOUBLE) * (vec_id % 4) * 40) AS BIGINT) + 128))) AS px FROM embeddings WHERE vec_id % 25 <> 0),
    r AS (SELECT *, unnest(range(h)) AS r FROM g), c AS (SELECT *, unnest(range(w)) AS c FROM r),
    l AS (SELECT row_id, px[(7 * CASE WHEN r > 0 THEN r - 1 ELSE 1 END + 3 * c) % 64 + 1] + px[(7 * CASE WHEN r < h - 1 THEN r + 1 ELSE h - 2 END + 3 * c) % 64 + 1]
        + px[(7 * r + 3 * CASE WHEN c > 0 THEN c - 1 ELSE 1 END) % 64 + 1] + px[(7 * r + 3 * CASE WHEN c < w - 1 THEN c + 1 ELSE w - 2 END) % 64 + 1] - 4 * px[(7 * r + 3 * c) % 64 + 1] AS v FROM c),
    v AS (SELECT row_id, CAST(sum(v * v) AS DOUBLE) / count(*) - (CAST(sum(v) AS DOUBLE) / count(*)) * (CAST(sum(v) AS DOUBLE) / count(*)) AS sharpness FROM l GROUP BY row_id),
    m AS (SELECT vec_id AS row_id, CASE WHEN vec_id % 25 <> 0 THEN CAST(vec_id % 80 + 60 AS INTEGER) END AS height, CASE WHEN vec_id % 25 <> 0 THEN CAST(vec_id % 50 + 80 AS INTEGER) END AS width, round(sharpness, 6) AS sharpness FROM embeddings LEFT JOIN v ON vec_id = row_id)"""
_IMAGE_ISSUES = """SELECT 'small_image' AS type, row_id, height, width, CAST(NULL AS DOUBLE) AS sharpness, CAST(NULL AS VARCHAR) AS error FROM m WHERE height < 100 OR width < 100
    UNION ALL SELECT 'blurry_image', row_id, NULL, NULL, sharpness, NULL FROM m WHERE sharpness < 50
    UNION ALL SELECT 'corrupted_image', row_id, NULL, NULL, NULL, 'image can''t be decoded' FROM m WHERE sharpness IS NULL"""


@query(f"WITH {_LAPLACIAN} SELECT row_id, round(sharpness, 6) AS sharpness FROM v")
def image_laplacian_variance(spark, d):
    return image.sharpness(grids(spark, d)).select("row_id", F.round("sharpness", 6).alias("sharpness"))


@query(f"{_MEASURED} SELECT row_id, height, width FROM m WHERE height < 100 OR width < 100")
def image_small(spark, d):
    return image.issues(measured(spark, d)).where("type = 'small_image'").select("row_id", "height", "width")


@query(f"{_MEASURED} SELECT row_id, sharpness FROM m WHERE sharpness < 50")
def image_blurry(spark, d):
    return image.issues(measured(spark, d)).where("type = 'blurry_image'").select("row_id", "sharpness")


@query(f"{_MEASURED} {_IMAGE_ISSUES}")
def image_issues(spark, d):
    return image.issues(measured(spark, d))


@query(f"{_MEASURED} SELECT (SELECT count(*) FROM m) AS total_images, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM m) * 100.0 AS issue_rate FROM ({_IMAGE_ISSUES})")
def image_metrics(spark, d):
    return image.metrics(measured(spark, d))
