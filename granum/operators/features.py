"""Feature operators: encoders, scaling, splits, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recode(column: str, mapping: dict[str, int]) -> Column:
    """Dictionary recode; values without an entry become null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def one_hot(df: DataFrame, column: str, levels: list[str]) -> list[Column]:
    """Indicators of the sorted levels but the first; null gives zeros."""
    return [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v.lower()}") for v in sorted(levels)[1:]]


def standardize(df: DataFrame, column: str, train: Column, out: str) -> DataFrame:
    """``df`` with the column scaled by mean and population deviation of the training rows."""
    x = F.when(train, F.col(column))
    stats = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    return df.join(F.broadcast(stats)).withColumn(out, (F.col(column) - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).drop("m", "s")


def stratified_split(df: DataFrame, label: str, order: Column, share: float, out: str) -> DataFrame:
    """``df`` with an exact share of each class marked as training, first in an order.

    A class is ranked from counts of hash ranges, so a large class is not one task.
    """
    part = F.pmod(F.hash(order), F.lit(64))
    parts = df.withColumn("_p", part)
    counts = parts.groupBy(label, "_p").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(label).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(label, "_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_o"), F.sum("_n").over(Window.partitionBy(label)).alias("_t"))
    inside = Window.partitionBy(label, "_p").orderBy(order)
    ranked = parts.withColumn("_r", F.row_number().over(inside)).join(F.broadcast(offsets), [label, "_p"])
    return ranked.withColumn(out, F.col("_r") + F.col("_o") <= F.floor(F.col("_t") * share)).drop("_p", "_r", "_o", "_t")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, weight`` with balanced weights ``total / (classes * n)``."""
    by = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return by.withColumn("weight", F.round(F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")), 6))
