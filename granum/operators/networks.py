"""Networks over vectors: fitted by Spark, kept as a table of weights, scored in batches on the workers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

#: Bytes of input that a batch holds at most, and weights that a network has at most (each worker keeps one copy).
BATCH_BYTES, MOST_WEIGHTS = 8 << 20, 20_000_000


@dataclass(frozen=True)
class Network:
    """Layers ``x @ weights + bias`` with a sigmoid between them and a softmax behind the last; ``classes`` by position."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    classes: list[int]

    @property
    def width(self) -> int:
        """Components of an input."""
        return len(self.weights[0])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One row of class probabilities for each row of ``x``."""
        for i, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            x = x @ w + b
            if i + 1 < len(self.weights):
                x = np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), 1 - 1 / (1 + np.exp(-np.abs(x))))
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def usable(vector: str, width: int) -> Column:
    """Whether a vector has ``width`` finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(v) == width) & ~bad, F.lit(False))


def fit(df: DataFrame, vector: str, label: str, width: int, hidden: tuple[int, ...] = (16,), rounds: int = 100, seed: int = 42) -> Network:
    """A network of ``label`` by the vector, by Spark's distributed gradient steps.

    Rows without a label or a whole vector take no part; labels are integers, their distinct
    values the classes (at most 10,000).
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(label).isNotNull() & usable(vector, width)).select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("long").alias("y"))
    classes = [r[0] for r in rows.select("y").distinct().orderBy("y").limit(10_001).collect()]
    if not 2 <= len(classes) <= 10_000:
        raise ValueError(f"a network needs 2 to 10,000 classes, not {len(classes)}")
    sizes = [width, *hidden, len(classes)]
    if sum((a + 1) * b for a, b in zip(sizes, sizes[1:], strict=False)) > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} weights")
    ranked = rows.select(array_to_vector("x").alias("features"), (F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1).cast("double").alias("label"))
    flat = MultilayerPerceptronClassifier(layers=sizes, maxIter=rounds, seed=seed, tol=1e-6).fit(ranked).weights.toArray()
    weights, biases, at = [], [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        weights.append(flat[at : at + a * b].reshape(a, b))
        biases.append(flat[at + a * b : at + (a + 1) * b])
        at += (a + 1) * b
    return Network(weights, biases, classes)


def save(spark: SparkSession, network: Network, path: str) -> None:
    """Write a network as rows of weights: ``layer, row, cells``; row -1 is the bias, layer -1 the classes."""
    rows = [(-1, 0, [float(c) for c in network.classes])]
    for i, (w, b) in enumerate(zip(network.weights, network.biases, strict=True)):
        rows += [(i, -1, b.tolist()), *((i, k, r.tolist()) for k, r in enumerate(w))]
    spark.createDataFrame(rows, "layer int, row int, cells array<double>").coalesce(1).write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> Network:
    """Read a saved network."""
    table = spark.read.parquet(path)
    if table.agg(F.sum(F.size("cells"))).first()[0] > MOST_WEIGHTS + 10_000:
        raise ValueError(f"more than {MOST_WEIGHTS} weights")
    rows = sorted((r["layer"], r["row"], r["cells"]) for r in table.collect())
    layers = range(rows[-1][0] + 1)
    return Network([np.array([c for i, k, c in rows if i == layer and k >= 0]) for layer in layers], [np.array(next(c for i, k, c in rows if i == layer and k == -1)) for layer in layers], [int(c) for c in rows[0][2]])


def scores(df: DataFrame, vector: str, network: Network) -> DataFrame:
    """``df`` with ``predicted`` (of equal classes the first) and ``confidence``.

    A worker unpacks the network once; a batch holds ``BATCH_BYTES`` of input.  Rows whose vector is
    null, of another length or not finite have null results.
    """
    from pyspark.ml.functions import predict_batch_udf

    width, classes = network.width, network.classes

    def make() -> Callable[[np.ndarray], dict[str, np.ndarray]]:
        own = network

        def predict(x: np.ndarray) -> dict[str, np.ndarray]:
            p = own.probabilities(x.astype(np.float64))
            return {"at": p.argmax(axis=1).astype(np.float64), "confidence": p.max(axis=1)}

        return predict

    score = predict_batch_udf(make, return_type=StructType().add("at", DoubleType()).add("confidence", DoubleType()), batch_size=max(1, BATCH_BYTES // (8 * width)), input_tensor_shapes=[[width]])
    held = F.when(usable(vector, width), F.col(vector).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), width))
    out = df.withColumn("_good", usable(vector, width)).withColumn("_got", score(held))
    names = F.array(*[F.lit(c).cast("long") for c in classes])
    predicted, confidence = F.element_at(names, F.col("_got.at").cast("int") + 1), F.col("_got.confidence")
    return out.withColumn("predicted", F.when(F.col("_good"), predicted)).withColumn("confidence", F.when(F.col("_good"), confidence)).drop("_good", "_got")
