"""Networks over vectors: weights, storage and scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granum.operators import networks as N


def _plain(net: N.Network, x: list[float]) -> np.ndarray:
    """One input through the layers, component by component."""
    for i, (w, b) in enumerate(zip(net.weights, net.biases, strict=True)):
        x = [sum(a * w[k][j] for k, a in enumerate(x)) + b[j] for j in range(len(b))]
        if i + 1 < len(net.weights):
            x = [1 / (1 + np.exp(-a)) for a in x]
    e = np.exp(np.array(x) - max(x))
    return e / e.sum()


@pytest.fixture(scope="module")
def points(spark):  # noqa: ANN001, ANN201
    """Three rings of points, which no straight line parts, with labels 3, 7 and 40."""
    rng = np.random.default_rng(6)
    ring = rng.integers(0, 3, 900)
    angle = rng.uniform(0, 2 * np.pi, 900)
    far = 1 + 1.5 * ring + rng.normal(0, 0.12, 900)
    return spark.createDataFrame(pd.DataFrame({"id": range(900), "v": [[float(a), float(b)] for a, b in zip(far * np.cos(angle), far * np.sin(angle), strict=True)], "y": np.array([3, 7, 40])[ring]}))


def test_scores_equal_a_plain_forward_pass_and_sparks_own(spark, points, tmp_path) -> None:  # noqa: ANN001
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    net = N.fit(points, "v", "y", 2, (12,), rounds=200, seed=1)
    N.save(spark, net, f"{tmp_path}/net")
    again = N.load(spark, f"{tmp_path}/net")
    assert again.classes == net.classes == [3, 7, 40] and all((a == b).all() for a, b in zip(again.weights + again.biases, net.weights + net.biases, strict=True))
    got = N.scores(points.repartition(3), "v", again).orderBy("id").collect()
    for r in got[::30]:
        p = _plain(net, r["v"])
        assert r["predicted"] == net.classes[int(p.argmax())] and abs(r["confidence"] - p.max()) < 1e-9
    assert np.mean([r["predicted"] == r["y"] for r in got]) > 0.95
    ranked = points.select("id", array_to_vector("v").alias("features"), F.when(F.col("y") == 3, 0.0).when(F.col("y") == 7, 1.0).otherwise(2.0).alias("label"))
    own = MultilayerPerceptronClassifier(layers=[2, 12, 3], maxIter=200, seed=1, tol=1e-6).fit(ranked).transform(ranked).select(vector_to_array("probability").alias("p")).orderBy("id").collect()
    assert np.abs(np.array([max(r["p"]) for r in own]) - np.array([r["confidence"] for r in got])).max() < 1e-6
    with pytest.raises(Exception, match="already exists"):
        N.save(spark, net, f"{tmp_path}/net")


def test_rows_without_a_whole_vector(spark) -> None:  # noqa: ANN001
    net = N.Network([np.array([[1.0, -1.0], [0.5, 2.0]])], [np.array([0.0, 0.1])], [5, 9])
    rows = [(1, [1.0, 0.0], "a"), (2, None, "b"), (3, [1.0], "c"), (4, [float("nan"), 1.0], "d"), (5, [None, 1.0], "e"), (6, [float("inf"), 1.0], "f"), (7, [], "g"), (8, [800.0, -900.0], "h"), (1, [1.0, 0.0], "a"), (9, [0.0, 1.0, 2.0], "i")]
    got = N.scores(spark.createDataFrame(rows, "id int, v array<double>, at string"), "v", net).orderBy("id").collect()
    assert [r["predicted"] for r in got] == [5, 5, None, None, None, None, None, None, 5, None] and [r["confidence"] is None for r in got] == [r["predicted"] is None for r in got]
    assert got[0]["at"] == "a" and got[0]["confidence"] == got[1]["confidence"]
    assert abs(got[0]["confidence"] - np.exp(1.0) / (np.exp(1.0) + np.exp(-0.9))) < 1e-12
    empty = N.scores(spark.createDataFrame([], "id int, v array<float>"), "v", net)
    assert empty.count() == 0 and empty.columns == ["id", "v", "predicted", "confidence"]


def test_fits_refuse_what_they_cannot_learn(spark) -> None:  # noqa: ANN001
    one = spark.createDataFrame([([1.0, 2.0], 1), ([1.0, 3.0], None), (None, 2), ([1.0], 3)], "v array<double>, y int")
    with pytest.raises(ValueError, match="classes, not 1"):
        N.fit(one, "v", "y", 2)
    two = one.unionByName(spark.createDataFrame([([0.0, 1.0], 4)], "v array<double>, y int"))
    with pytest.raises(ValueError, match="weights"):
        N.fit(two, "v", "y", 2, hidden=(5_000, 5_000))
    net = N.fit(two, "v", "y", 2, hidden=(), rounds=5)
    assert net.classes == [1, 4] and net.width == 2 and len(net.weights) == 1
