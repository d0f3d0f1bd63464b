"""Classical models at their usual sizes: estimators, folds, importances, scoring."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granum.operators.classification import f1_sweep, roc_auc, stratified_folds
from granum.storage import new_folder

#: Models that are fitted side by side; each waits for many short jobs.
SIDE_BY_SIDE = 4


def hashed_words(df: DataFrame, n: int = 1024, text: str = "text") -> DataFrame:
    """``df`` with ``features``: hashed counts of lower-cased words."""
    from pyspark.ml.feature import HashingTF

    words = df.withColumn("_words", F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))
    return HashingTF(numFeatures=n, inputCol="_words", outputCol="features").transform(words).drop("_words")


def text_pipeline(estimator, n: int = 1024):  # noqa: ANN001, ANN201
    """Text to words to hashed counts to a model, as one pipeline that can be saved."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    words = RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\s+")
    return Pipeline(stages=[words, HashingTF(numFeatures=n, inputCol="_words", outputCol="features"), estimator])


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with its numbers as one vector."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def logistic(data: DataFrame, c: float = 1.0, rounds: int = 1000):  # noqa: ANN201
    """L2 logistic regression with inverse strength ``c`` on the sum of losses over ``data``."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(regParam=1.0 / (c * max(1, data.count())), elasticNetParam=0.0, standardization=False, maxIter=rounds)


def forest(trees: int = 300, depth: int = 8, leaf: int = 5, seed: int = 42):  # noqa: ANN201
    """Random forest."""
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)


def boosted(rounds: int = 200, depth: int = 4, rate: float = 0.05, share: float = 0.8, seed: int = 42):  # noqa: ANN201
    """Gradient-boosted trees on a share of the rows in each round."""
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=seed, checkpointInterval=10)


def naive_bayes(smoothing: float = 0.1):  # noqa: ANN201
    """Multinomial naive Bayes."""
    from pyspark.ml.classification import NaiveBayes

    return NaiveBayes(smoothing=smoothing)


def scored(model, data: DataFrame) -> DataFrame:  # noqa: ANN001
    """``data`` with ``prediction`` and ``p_1``, the probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(data)
    return out.select(*[F.col(f"`{c}`") for c in data.columns if c not in ("prediction", "p_1")], "prediction", vector_to_array("probability")[1].alias("p_1"))


def importances(model, names: list[str], spark: SparkSession, k: int = 15) -> DataFrame:  # noqa: ANN001
    """``feature, importance`` of the ``k`` most important features of a tree model."""
    values = [float(x) for x in model.featureImportances.toArray()]
    return spark.createDataFrame(list(zip(names, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what reads it many times makes it once."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _side_by_side(spark: SparkSession, run, tasks: list) -> list:  # noqa: ANN001
    """``run`` of each of ``tasks``, in their order, ``SIDE_BY_SIDE`` at a time."""
    with ThreadPool(min(SIDE_BY_SIDE, len(tasks))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), tasks, 1)


def fold_auc(data: DataFrame, estimators: dict[str, object], folds: int = 5, key: str = "doc_id") -> DataFrame:
    """``model, fold, auc`` of each estimator on stratified folds of ``label``, exact on each held-out part."""
    dealt = stored(stratified_folds(data, "label", key, folds, "fold"), "folds")

    def run(task: tuple[str, int]) -> DataFrame:
        name, k = task
        held = scored(estimators[name].fit(dealt.where(F.col("fold") != k)), dealt.where(F.col("fold") == k))
        held = stored(held.select("label", "p_1"), "scored")
        return roc_auc(held, F.col("label") == 1, F.col("p_1")).select(F.lit(name).alias("model"), F.lit(k).alias("fold"), "auc")

    return reduce(DataFrame.unionByName, _side_by_side(data.sparkSession, run, [(name, k) for name in estimators for k in range(folds)]))


def held_out(data: DataFrame, estimators: dict[str, object], folds: int = 5, key: str = "doc_id") -> DataFrame:
    """``model, n_train, n_test, auc, threshold, f1``: each estimator fitted on all but one stratified fold, judged on that one.

    The area is exact, and the threshold is the first of 0.10 to 0.89 with the greatest F1 of
    the rows that the model has not seen.
    """
    dealt = stored(stratified_folds(data, "label", key, folds, "fold"), "folds")
    train, test = dealt.where("fold <> 0"), dealt.where("fold = 0")
    sizes = dealt.agg(F.count_if(F.col("fold") != 0).alias("n_train"), F.count_if(F.col("fold") == 0).alias("n_test"))

    def run(name: str) -> DataFrame:
        held = stored(scored(estimators[name].fit(train), test).select("label", "p_1"), "scored")
        area = roc_auc(held, F.col("label") == 1, F.col("p_1")).select("auc")
        best = f1_sweep(held, F.col("label") == 1, F.col("p_1"), [round(0.1 + 0.01 * i, 2) for i in range(80)])
        return sizes.join(F.broadcast(area)).join(F.broadcast(best.select("threshold", "f1"))).select(F.lit(name).alias("model"), "n_train", "n_test", "auc", "threshold", "f1")

    return reduce(DataFrame.unionByName, _side_by_side(data.sparkSession, run, list(estimators)))


def fold_summary(scores: DataFrame) -> DataFrame:
    """``model, mean_auc, std_auc`` over folds, with the population deviation."""
    return scores.groupBy("model").agg(F.round(F.avg("auc"), 4).alias("mean_auc"), F.round(F.stddev_pop("auc"), 4).alias("std_auc"))
