"""Profiling, encoding, classifier training and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granum import storage
from granum.operators import classification as K
from granum.functions.money import dsum
from granum.operators import features as X
from granum.operators import models as M
from granum.operators import networks as N
from granum.operators import profiling as P
from granum.plans.registry import query
from granum.sources.tables import parquet

#: Documents with labels; the positive class is toxic.
_L = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_SCORE = "(1.0 - 1.0 / (1.0 + n_chars / 2000.0))"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents without their text."""
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(parquet(spark, sf_dir, "labels"), "doc_id")


def _score() -> "F.Column":
    return 1.0 - 1.0 / (1.0 + F.col("n_chars") / 2000.0)


@query("attrition_summary", f"SELECT toxic, count(*) AS n, round(100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS pct FROM {_L} GROUP BY 1")
def attrition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of the target."""
    by = labelled(spark, sf_dir).groupBy("toxic").agg(F.count("*").alias("n"))
    return by.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("rate_by_category", f"SELECT lang, count(*) AS n, round(100.0 * avg(CAST(toxic = 1 AS INTEGER)), 4) AS rate FROM {_L} WHERE lang IS NOT NULL GROUP BY 1")
def rate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target rate by category."""
    return labelled(spark, sf_dir).where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.round(100.0 * F.avg((F.col("toxic") == 1).cast("int")), 4).alias("rate"))


@query(
    "mean_comparison",
    " UNION ALL ".join(
        f"SELECT '{c}' AS metric, round(avg({c}) FILTER (WHERE toxic = 0), 4) AS mean_0, round(avg({c}) FILTER (WHERE toxic = 1), 4) AS mean_1, round(100.0 * (avg({c}) FILTER (WHERE toxic = 1) - avg({c}) FILTER (WHERE toxic = 0)) / (avg({c}) FILTER (WHERE toxic = 0)), 4) AS diff_pct FROM {_L}"
        for c in ("n_chars", "quality")
    ),
)
def mean_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of two groups side by side, in one pass."""
    cols = ("n_chars", "quality")
    one = labelled(spark, sf_dir).agg(*[F.avg(F.when(F.col("toxic") == g, F.col(c))).alias(f"{c}_{g}") for c in cols for g in (0, 1)])
    row = lambda c: F.struct(F.lit(c).alias("metric"), F.round(f"{c}_0", 4).alias("mean_0"), F.round(f"{c}_1", 4).alias("mean_1"), F.round(100.0 * (F.col(f"{c}_1") - F.col(f"{c}_0")) / F.col(f"{c}_0"), 4).alias("diff_pct"))
    return one.select(F.inline(F.array(*map(row, cols))))


_PAIR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("corr_with_target", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, CAST(l_returnflag = 'R' AS INTEGER)), 4) AS r FROM lineitem" for c in _PAIR))
def corr_with_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each numeric column with a binary target."""
    y = (F.col("l_returnflag") == "R").cast("int")
    one = parquet(spark, sf_dir, "lineitem").agg(*[F.round(F.corr(c, y), 4).alias(c) for c in _PAIR])
    return one.unpivot([], list(_PAIR), "feature", "r")


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM lineitem" for i, a in enumerate(_PAIR) for b in _PAIR[i + 1 :]))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise correlations from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(_PAIR) for b in _PAIR[i + 1 :]]
    one = parquet(spark, sf_dir, "lineitem").agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 4).alias("r")) for a, b in pairs])))


@query(
    "corr_extremes",
    "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, CAST(l_returnflag = 'R' AS INTEGER)), 4) AS r FROM lineitem" for c in _PAIR)
    + ") SELECT 'top' AS side, * FROM (SELECT * FROM c ORDER BY r DESC, feature LIMIT 2) UNION ALL SELECT 'bottom', * FROM (SELECT * FROM c ORDER BY r, feature LIMIT 2)",
)
def corr_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest and the two smallest correlations."""
    c = corr_with_target(spark, sf_dir)
    top = c.orderBy(F.desc("r"), "feature").limit(2).select(F.lit("top").alias("side"), "*")
    return top.unionByName(c.orderBy("r", "feature").limit(2).select(F.lit("bottom").alias("side"), "*"))


_PRIO = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}


@query("encode_ordinal", "SELECT code, count(*) AS n FROM (SELECT CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _PRIO.items()) + " END AS code FROM orders) GROUP BY 1")
def encode_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal codes; a level without one is null."""
    return parquet(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).groupBy(X.recode("o_orderpriority", _PRIO).alias("code")).agg(F.sum("n").alias("n"))


_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS c_mktsegment_{s.lower()}" for s in _SEGS[1:]) + " FROM customer")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of the segment, first level dropped."""
    df = parquet(spark, sf_dir, "customer")
    return df.select("c_custkey", *X.one_hot(df, "c_mktsegment", _SEGS))


@query("impute_median", "WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer) SELECT c_custkey, round(coalesce(b, (SELECT median(b) FROM c)), 4) AS balance FROM c")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative balances as missing, filled with the median."""
    df = parquet(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("b"))
    return P.impute_median(df, "b", "balance").select("c_custkey", F.round("balance", 4).alias("balance"))


@query("standardize_train", "SELECT c_custkey, round((c_acctbal - m) / s, 4) AS z FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer WHERE c_custkey % 5 <> 0)")
def standardize_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance scaled by statistics of the training part only."""
    df = parquet(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return X.standardize(df, "c_acctbal", F.col("c_custkey") % 5 != 0, "z").select("c_custkey", F.round("z", 4).alias("z"))


@query("stratified_split", f"SELECT toxic, count(*) AS n, CAST(floor(count(*) * 0.8) AS BIGINT) AS n_train FROM {_L} GROUP BY 1")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of an exact 80/20 split of each class."""
    split = X.stratified_split(labelled(spark, sf_dir).select("doc_id", "toxic"), "toxic", F.xxhash64("doc_id"), 0.8, "train")
    return split.groupBy("toxic").agg(F.count("*").alias("n"), F.count_if("train").alias("n_train"))


@query("class_weights", f"SELECT toxic, count(*) AS n, round(sum(count(*)) OVER () / CAST(count(*) OVER () * count(*) AS DOUBLE), 6) AS weight FROM {_L} GROUP BY 1")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced class weights."""
    return X.class_weights(labelled(spark, sf_dir), "toxic")


@query(
    "binary_metrics",
    f"""SELECT tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS "precision", round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1
        FROM (SELECT count(*) FILTER (WHERE toxic = 1 AND {_SCORE} >= 0.5) AS tp, count(*) FILTER (WHERE toxic = 0 AND {_SCORE} >= 0.5) AS fp, count(*) FILTER (WHERE toxic = 1 AND {_SCORE} < 0.5) AS fn, count(*) FILTER (WHERE toxic = 0 AND {_SCORE} < 0.5) AS tn FROM {_L})""",
)
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and metrics of a length-based score."""
    return K.binary_metrics(labelled(spark, sf_dir), F.col("toxic") == 1, _score() >= 0.5)


@query(
    "roc_auc",
    f"""WITH b AS (SELECT {_SCORE} AS s, count(*) FILTER (WHERE toxic = 1) AS p, count(*) FILTER (WHERE toxic = 0) AS q FROM {_L} GROUP BY 1),
             r AS (SELECT p, q, sum(q) OVER (ORDER BY s) - q + q / 2.0 AS w FROM b)
        SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, round(CAST(sum(p * w) AS DOUBLE) / CAST(sum(p) * sum(q) AS DOUBLE), 6) AS auc FROM r""",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact AUC of the score."""
    return K.roc_auc(labelled(spark, sf_dir), F.col("toxic") == 1, _score())


_T = [round(0.1 + 0.01 * i, 2) for i in range(80)]


@query(
    "f1_threshold",
    f"""WITH t AS (SELECT unnest({_T}) AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE toxic = 1 AND s >= threshold) AS tp, count(*) FILTER (WHERE toxic = 0 AND s >= threshold) AS fp, count(*) FILTER (WHERE toxic = 1 AND s < threshold) AS fn
          FROM t, (SELECT toxic, {_SCORE} AS s FROM {_L}) GROUP BY 1)
        SELECT CAST(threshold AS DOUBLE) AS threshold, round(coalesce(2.0 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), 6) AS f1 FROM c ORDER BY f1 DESC, threshold LIMIT 1""",
)
def f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of greatest F1, 0.10 to 0.89."""
    return K.f1_sweep(labelled(spark, sf_dir), F.col("toxic") == 1, _score(), _T)


#: Nearest-centroid prediction on all components, in rounded arithmetic.
_E = """(SELECT vec_id, label, CAST(arg_min(c, struct_pack(d, c)) AS INTEGER) AS pred, round(1 / (1 + min(d)), 6) AS conf FROM (
          SELECT e.vec_id, e.label, m.label AS c, round(sqrt(sum(power(CAST(e.embedding[m.i] AS DOUBLE) - m.v, 2))), 6) AS d
          FROM embeddings e, (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2) m GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, pred, conf`` by nearest class centroid (few classes, one broadcast row)."""
    e = parquet(spark, sf_dir, "embeddings")
    return K.nearest_centroid(e, "vec_id", "label", "embedding")


@query("confusion_pairs", f"SELECT label AS true, pred, count(*) AS n FROM {_E} WHERE label <> pred GROUP BY 1, 2")
def confusion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off-diagonal confusion counts."""
    return K.confusion(predicted(spark, sf_dir), "label", "pred")


@query("per_class_accuracy", f"SELECT label, count(*) AS n, count(*) FILTER (WHERE label <> pred) AS errors, round(1 - count(*) FILTER (WHERE label <> pred) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM {_E} GROUP BY 1")
def per_class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by class."""
    return K.per_class(predicted(spark, sf_dir), "label", "pred")


@query("reliability_bins", f"SELECT CAST(floor(conf * 10) AS INTEGER) AS bin, count(*) AS n, round(avg(conf), 6) AS mean_conf, round(avg(CAST(label = pred AS INTEGER)), 6) AS accuracy FROM {_E} WHERE conf >= 0 AND conf < 1 GROUP BY 1")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence against accuracy in ten bins."""
    return K.reliability(predicted(spark, sf_dir), F.col("conf"), F.col("label") == F.col("pred"))


@query("confident_errors", f"SELECT vec_id, label, pred, conf FROM {_E} WHERE label <> pred ORDER BY conf DESC, vec_id LIMIT 20")
def confident_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most confident errors."""
    return K.top_errors(predicted(spark, sf_dir), 20, "label", "pred", "conf", "vec_id")


def _text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parquet(spark, sf_dir, "documents").select("doc_id", "text").join(parquet(spark, sf_dir, "labels"), "doc_id")
    return df.select("doc_id", "text", F.col("quality").cast("double").alias("label"))


def _text_features(spark: SparkSession, sf_dir: str, n: int = 1024) -> DataFrame:
    return M.hashed_words(_text_labels(spark, sf_dir), n).select("doc_id", "label", "features")


def _scored(estimator, data: DataFrame) -> DataFrame:  # noqa: ANN001
    return M.scored(estimator.fit(data), data).select("doc_id", "label", "prediction", F.round("p_1", 6).alias("p_1"))


def _tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a few numbers; the label is whether the balance is negative."""
    orders = parquet(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), dsum("o_totalprice").alias("spent"), F.max("o_totalprice").alias("largest"))
    c = parquet(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).cast("double").alias("label"), F.col("c_nationkey").cast("double").alias("nation"))
    return c.join(orders, "c_custkey", "left").fillna(0).withColumnRenamed("c_custkey", "doc_id")


_TABULAR = ["nation", "n_orders", "spent", "largest"]


@query("ml_logreg")
def ml_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 logistic regression with C = 1 on the sum of losses."""
    data = _text_features(spark, sf_dir)
    return _scored(M.logistic(data), data)


@query("ml_forest")
def ml_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest of 300 trees of depth 8 with leaves of 5."""
    return _scored(M.forest(), M.assembled(_tabular(spark, sf_dir), _TABULAR))


@query("ml_gbt")
def ml_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred rounds of gradient-boosted trees of depth 4."""
    return _scored(M.boosted(), M.assembled(_tabular(spark, sf_dir), _TABULAR))


@query("ml_importances")
def ml_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most important features of two hundred rounds of boosting."""
    return M.importances(M.boosted().fit(M.assembled(_tabular(spark, sf_dir), _TABULAR)), _TABULAR, spark)


@query("ml_naive_bayes")
def ml_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multinomial naive Bayes with smoothing 0.1."""
    return _scored(M.naive_bayes(), _text_features(spark, sf_dir))


@query("ml_holdout")
def ml_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, best threshold and F1 of two text models on the fifth of the rows that they were not fitted on."""
    data = M.stored(_text_features(spark, sf_dir), "features")  # the penalty counts its rows
    return M.held_out(data, {"logistic": M.logistic(data, rounds=200), "naive_bayes": M.naive_bayes()})


def text_pipeline(spark: SparkSession, sf_dir: str):  # noqa: ANN201
    """The fitted pipeline from text to label, for batches and streams alike."""
    return M.text_pipeline(M.naive_bayes()).fit(_text_labels(spark, sf_dir).where("text is not null"))


@query("cv_auc")
def cv_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact AUC of three models in each of five stratified folds."""
    data = M.stored(_text_features(spark, sf_dir, 256), "features")  # the penalty counts its rows
    return M.fold_auc(data, {"naive_bayes": M.naive_bayes(), "logistic": M.logistic(data, rounds=50), "forest": M.forest(trees=20, depth=6)})


@query("cv_summary")
def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the folds' AUC."""
    return M.fold_summary(M.fold_auc(_text_features(spark, sf_dir, 256), {"naive_bayes": M.naive_bayes()}))


@query("cv_tabular")
def cv_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the exact AUC in five stratified folds: logistic regression, a forest, and boosting of thirty rounds."""
    data = M.stored(M.assembled(_tabular(spark, sf_dir), _TABULAR).select("doc_id", "label", "features"), "tabular")
    return M.fold_summary(M.fold_auc(data, {"logistic": M.logistic(data, rounds=100), "forest": M.forest(trees=100), "boosted": M.boosted(rounds=30)}))


@query("columns_by_type", "SELECT CAST(sum(l_orderkey) AS BIGINT) AS l_orderkey, CAST(sum(l_partkey) AS BIGINT) AS l_partkey, CAST(sum(l_suppkey) AS BIGINT) AS l_suppkey FROM lineitem")
def columns_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the numeric columns whose name ends in ``key``, picked by type and suffix."""
    from granum.operators.profiling import select_by

    lines = parquet(spark, sf_dir, "lineitem")
    return lines.agg(*[F.sum(c).alias(c) for c in select_by(lines, ("number",), suffix="key")])


@query("network_scores")
def network_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and confidence of every vector, by a network fitted on four fifths of them, saved and loaded again."""
    rows = parquet(spark, sf_dir, "embeddings")
    width = rows.agg(F.mode(F.size("embedding"))).first()[0]
    path = storage.new_folder(spark, "network")
    held_out = F.crc32(F.col("vec_id").cast("string")) % 5 == 0
    N.save(spark, N.fit(rows.where(~held_out), "embedding", "label", width), path)
    return N.scores(rows, "embedding", N.load(spark, path)).select("vec_id", "label", held_out.alias("held_out"), "predicted", F.round("confidence", 6).alias("confidence"))
