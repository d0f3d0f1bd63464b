"""Customer value operators: Pareto, RFM, segments, lifetime value, campaign grids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granum.operators.ranking import quantile_columns, ranked_sums

DAY_US, YEAR = 86_400_000_000, 365.0


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole days (floor of the difference, not of calendar dates)."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / DAY_US)


def pareto(df: DataFrame, key: str, amount: str) -> DataFrame:
    """``df`` with running revenue and customer percentages by descending amount, ties by key."""
    out = ranked_sums(df, [(amount, True), (key, False)], F.col(amount).cast("decimal(18,2)"))
    return out.withColumn("cum_revenue_pct", F.round(100.0 * F.col("run").cast("double") / F.col("total").cast("double"), 6)).withColumn("cum_customer_pct", F.round(100.0 * F.col("pos") / F.col("n"), 6))


def rfm(df: DataFrame, customer: str, order: str, at: str, amount: str) -> DataFrame:
    """``customer, recency, frequency, monetary``; recency counts from a day after the last order."""
    ref = df.agg((F.max(at) + F.expr("INTERVAL 1 DAY")).alias("ref")).scalar()
    by = df.groupBy(customer, order).agg(F.max(at).alias("at"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("m")).groupBy(customer).agg(F.max("at").alias("at"), F.count("*").alias("frequency"), F.sum("m").cast("double").alias("monetary"))
    return by.select(F.col(customer).alias("customer"), whole_days(ref, F.col("at")).alias("recency"), "frequency", "monetary")


def quintile(df: DataFrame, column: str, out: str, descending: bool = False) -> DataFrame:
    """Right-closed bins between the distinct linear quintile edges, numbered from 1.

    Equal edges collapse, so the top label may be below 5; ``descending`` reverses labels.
    """
    return quintiles(df, [(column, out, descending)])


def quintiles(df: DataFrame, scores: list[tuple[str, str, bool]]) -> DataFrame:
    """:func:`quintile` for several ``(column, out, descending)``, their edges from one aggregate."""
    edges = quantile_columns(df, {c: [i / 5 for i in range(6)] for c, _, _ in scores})
    every = df.agg(F.struct(*[F.array_sort(F.array_distinct(F.array(*edges[c]))).alias(c) for c, _, _ in scores]).alias("e")).scalar()
    held = df.withColumn("_edges", every)
    for column, out, descending in scores:
        own = F.col("_edges")[column]
        bin_ = F.greatest(F.lit(1), F.size(F.filter(own, lambda e: e < F.col(column))))  # noqa: B023
        held = held.withColumn(out, (F.size(own) - bin_ if descending else bin_).cast("int"))
    return held.drop("_edges")


def rfm_scores(df: DataFrame) -> DataFrame:
    """RFM rows with ``r_score`` (recent is high), ``f_score``, ``m_score`` and their sum."""
    out = quintiles(df, [("recency", "r_score", True), ("frequency", "f_score", False), ("monetary", "m_score", False)])
    return out.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))


def segments(scored: DataFrame) -> DataFrame:
    """Four segments by rank of score, then monetary value, then customer."""
    out = ranked_sums(scored, [("rfm_score", True), ("monetary", True), ("customer", False)], F.lit(1))
    r, n = F.col("pos"), F.col("n")
    return out.withColumn("segment", F.when(r <= 0.25 * n, "Champions").when(r <= 0.5 * n, "Loyal").when(r <= 0.75 * n, "At-Risk").otherwise("Lost")).drop("pos", "run", "n", "total")


def lifetime_value(df: DataFrame, customer: str, order: str, at: str, amount: str) -> DataFrame:
    """Order value x orders a year x lifespan; a lifespan is a twelfth of a year at least."""
    span = df.agg((whole_days(F.max(at), F.min(at)) / YEAR).alias("y")).scalar()
    by = df.groupBy(customer, order).agg(F.max(at).alias("b"), F.min(at).alias("a"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("m")).groupBy(customer).agg(F.max("b").alias("b"), F.min("a").alias("a"), F.count("*").alias("frequency"), F.sum("m").cast("double").alias("m"))
    aov = F.col("m") / F.col("frequency")
    life = F.greatest(whole_days(F.col("b"), F.col("a")).cast("double"), F.lit(YEAR / 12)) / YEAR
    return by.select(F.col(customer).alias("customer"), F.round(aov, 6).alias("aov"), "frequency", F.round(life, 6).alias("lifespan"), F.round(aov * (F.col("frequency") / span) * life, 4).alias("ltv"))


def roi_grid(one: DataFrame, n: str, worth: str, cost: float, steps: int = 10) -> DataFrame:
    """Profit at conversion rates of 5 %, 10 %, ...; converted customers are whole."""
    i = F.col("step")
    won = F.floor(F.col(n) * i / 20.0)
    return one.select(n, worth, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).select(
        "step", F.round(i * 0.05, 2).alias("rate"), won.alias("converted"), F.round(won * F.col(worth), 2).alias("recovered"), F.round(won * F.col(worth) - F.col(n) * cost, 2).alias("profit")
    )


def _points(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, features``: columns scaled by mean and population deviation."""
    from pyspark.ml.feature import VectorAssembler

    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    scaled = df.join(F.broadcast(stats)).select(key, *[F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns])
    return VectorAssembler(inputCols=columns, outputCol="features").transform(scaled).select(key, "features")


def _best_fit(points: DataFrame, k: int, seed: int, starts: int):  # noqa: ANN202
    """The K-means model of least cost over some starts."""
    from pyspark.ml.clustering import KMeans

    fits = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(points) for i in range(starts)]
    return min(fits, key=lambda m: m.summary.trainingCost)


def kmeans(df: DataFrame, key: str, columns: list[str], k: int, seed: int = 42, starts: int = 10) -> DataFrame:
    """``key, cluster`` by K-means, the best of ``starts`` starts, on standardised columns."""
    points = _points(df, key, columns).cache()
    out = _best_fit(points, k, seed, starts).transform(points).select(key, "cluster")
    return out


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette by Euclidean distance; rows of one-row clusters count 0."""
    gap = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T, 0))
    own = label[:, None] == np.unique(label)[None, :]
    size = own.sum(axis=0)
    total = gap @ own
    inside = total[own] / np.maximum(size[own.argmax(axis=1)] - 1, 1)
    outside = np.where(own, np.inf, total / size).min(axis=1)
    real = (size[own.argmax(axis=1)] > 1) & np.isfinite(outside)
    score = np.zeros(len(real))
    score[real] = (outside - inside)[real] / np.maximum(np.maximum(inside, outside)[real], 1e-300)
    return float(score.mean()) if len(size) > 1 else 0.0


def cluster_sweep(df: DataFrame, key: str, columns: list[str], ks: Sequence[int] = range(2, 9), seed: int = 42, starts: int = 3, sample: int = 2000) -> DataFrame:
    """``k, inertia, silhouette`` for numbers of clusters; the silhouette is of ``sample`` rows of smallest key hash."""
    points = _points(df, key, columns).cache()
    few = points.orderBy(F.xxhash64(key)).limit(sample).cache()
    rows = []
    for k in ks:
        model = _best_fit(points, k, seed, starts)
        held = model.transform(few).select("features", "cluster").collect()
        x, label = np.array([r[0].toArray() for r in held]), np.array([r[1] for r in held])
        rows.append((int(k), float(model.summary.trainingCost), silhouette(x, label) if len(x) else None))
    points.unpersist()
    few.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")
