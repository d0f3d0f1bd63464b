"""Classifier evaluation: exact AUC, threshold sweeps, confusion, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granum.operators.ranking import ranked_sums


def binary_metrics(df: DataFrame, label: Column, pred: Column) -> DataFrame:
    """Accuracy, precision, recall and F1 in one pass; undefined ones are 0."""
    tp, fp, fn, tn = (F.count_if(c) for c in (label & pred, ~label & pred, label & ~pred, ~label & ~pred))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    return df.agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_auc(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """Exact AUC with ties as half, from counts by distinct score and their running sums."""
    by = df.select(score.alias("s"), label.alias("y")).where("s is not null and y is not null").groupBy("s").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("q"))
    run = ranked_sums(by, [("s", False)], F.col("q"))
    wins = F.sum(F.col("p") * (F.col("run") - F.col("q") + F.col("q") / 2.0))
    return run.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.round(wins / F.nullif(F.sum("p") * F.sum("q"), F.lit(0)), 6).alias("auc"))


def f1_sweep(df: DataFrame, label: Column, score: Column, thresholds: list[float]) -> DataFrame:
    """The first threshold of greatest F1 (``score >= threshold``), all in one pass."""
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(label & (score >= t)).alias(f"tp{i}"), F.count_if(~label & (score >= t)).alias(f"fp{i}"), F.count_if(label & (score < t)).alias(f"fn{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.round(F.coalesce(2.0 * F.col(f"tp{i}") / F.nullif(2 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}"), F.lit(0)), F.lit(0.0)), 6).alias("f1")) for i, t in enumerate(thresholds)])
    return one.select(F.inline(rows)).orderBy(F.desc("f1"), "threshold").limit(1)


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    """``true, pred, n`` of the off-diagonal pairs."""
    return df.where(F.col(true) != F.col(pred)).groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Rows, errors and accuracy of each class."""
    wrong = F.count_if(F.col(true) != F.col(pred))
    return df.groupBy(F.col(true).alias("label")).agg(F.count("*").alias("n"), wrong.alias("errors"), F.round(1 - wrong / F.count("*"), 6).alias("accuracy"))


def reliability(df: DataFrame, conf: Column, right: Column, bins: int = 10) -> DataFrame:
    """Mean confidence and accuracy of left-closed bins; a confidence of 1 is in none."""
    return (
        df.select(conf.alias("c"), right.alias("r")).where((F.col("c") >= 0) & (F.col("c") < 1))
        .groupBy(F.floor(F.col("c") * bins).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean_conf"), F.round(F.avg(F.col("r").cast("int")), 6).alias("accuracy"))
    )


def top_errors(df: DataFrame, k: int, true: str, pred: str, conf: str, key: str) -> DataFrame:
    """The ``k`` most confident errors."""
    return df.where(F.col(true) != F.col(pred)).orderBy(F.desc(conf), key).limit(k)


def stratified_folds(df: DataFrame, label: str, key: str, k: int, out: str) -> DataFrame:
    """``df`` with a fold number that deals each class out evenly, in hash order of the key."""
    w = Window.partitionBy(label, F.pmod(F.hash(key), F.lit(64))).orderBy(F.hash(key), key)
    return df.withColumn(out, ((F.row_number().over(w) + F.pmod(F.hash(key), F.lit(64))) % k).cast("int"))


def nearest_centroid(df: DataFrame, key: str, label: str, vector: str, digits: int = 6) -> DataFrame:
    """``key, label, pred, conf``: the class of nearest mean vector, ties to the smaller label.

    Means are taken by class and component with map-side combine and gathered in one row,
    so classes and components must be few.
    """
    parts = df.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("i", "v"))
    mean = parts.groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    one = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("m"))
    centres = one.agg(F.array_sort(F.collect_list(F.struct(label, "m"))).alias("_centres"))
    x = F.transform(vector, lambda v: v.cast("double"))
    gap = lambda c: F.round(F.sqrt(F.aggregate(F.zip_with("_x", c["m"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)), digits)
    best = F.array_min(F.transform("_centres", lambda c: F.struct(gap(c).alias("d"), c[label].alias("c"))))
    held = df.select(key, label, x.alias("_x")).join(F.broadcast(centres)).withColumn("_b", best)
    return held.select(key, label, F.col("_b.c").alias("pred"), F.round(1 / (1 + F.col("_b.d")), digits).alias("conf"))
