"""Whitened vectors from an exact integer scatter.

Components become integers.  Tasks subtract a shift and add up sums and cross-products of
the distinct vectors as integers of any size; partial sums travel as limbs of 40 bits and
are merged by a grouped shuffle.  The driver forms ``n * X'X - S S'`` exactly, a matrix of
dimensions by dimensions whatever the table's size, and only then turns to floating point:
its eigenvectors are the components.  Rows are whitened where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granum.llm.common import materialize
from granum.llm.vectors import integers, matrix, usual_length

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Components are held to 61 bits.
LIMIT = 1 << 61
#: Bits of a limb and limbs of a partial sum, the last one signed: sums of up to 260 bits.
BITS, LIMBS = 40, 6
MASK = (1 << BITS) - 1
NAMES = [f"l{i}" for i in range(LIMBS)]


# ---------------------------------------------------------------- exact sums


def _limbs(value: int) -> list[int]:
    return [*[value >> (BITS * i) & MASK for i in range(LIMBS - 1)], value >> (BITS * (LIMBS - 1))]


def products(y: np.ndarray) -> np.ndarray:
    """``y' y`` of a matrix of 64-bit integers, exact, as Python integers."""
    n, d = y.shape
    top = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    if top * top >= 1 << 62:
        wide = y.astype(object)
        return wide.T @ wide if n else np.full((d, d), 0, dtype=object)
    step = max(1, ((1 << 62) - 1) // max(1, top * top))
    out = np.full((d, d), 0, dtype=object)
    for lo in range(0, n, step):
        part = y[lo : lo + step]
        out = out + (part.T @ part).astype(object)
    return out


def column_sums(y: np.ndarray) -> np.ndarray:
    """Exact sums of the columns, as Python integers."""
    high, low = y >> 32, y & 0xFFFFFFFF  # each adds up within 64 bits
    return high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)


def scatter(fit: DataFrame, d: int, shift: np.ndarray) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and cross-products of the vectors ``x - shift`` of ``fit``, exact."""
    shared = fit.sparkSession.sparkContext.broadcast(shift)
    upper = np.triu_indices(d)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.full(d, 0, dtype=object), np.full((d, d), 0, dtype=object)
        for batch in batches:
            y = matrix(batch.column(0), d) - shared.value
            n, sums, cross = n + len(y), sums + column_sums(y), cross + products(y)
        # a sum is in row d, the number of vectors at (d, d)
        values = [(int(i), int(j), cross[i, j]) for i, j in zip(*upper, strict=True)] + [(d, i, sums[i]) for i in range(d)] + [(d, d, n)]
        columns = [[v[0] for v in values], [v[1] for v in values], *zip(*[_limbs(int(v[2])) for v in values], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "j", *NAMES])

    found = fit.select("x").mapInArrow(each, "i long, j long" + "".join(f", {c} long" for c in NAMES))
    sums, cross, n = [0] * d, [[0] * d for _ in range(d)], 0
    for r in found.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in NAMES]).collect():
        value = sum(int(r[c]) << (BITS * k) for k, c in enumerate(NAMES))
        if r["i"] < d:
            cross[r["i"]][r["j"]] = cross[r["j"]][r["i"]] = value
        elif r["j"] < d:
            sums[r["j"]] = value
        else:
            n = value
    shared.destroy()
    return n, sums, cross


# ---------------------------------------------------------------- components


@dataclass(frozen=True)
class Whitening:
    """A fitted map: ``weights[dimension, component]`` takes ``x - sums / n`` to whitened coordinates."""

    n: int
    sums: list[int]
    weights: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: 64-bit integers where they fit, else Python integers."""
        top = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums), default=0)
        return x * self.n - np.array(self.sums, dtype=np.int64) if top < 1 << 63 else x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def apply(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates of centred rows."""
        return (centred / self.n).astype(np.float64) @ self.weights


def deviations(centred: np.ndarray) -> np.ndarray:
    """The sum of squares of each row, exact, held to 64 bits."""
    top = int(abs(centred).max(initial=0))
    if top <= isqrt(((1 << 63) - 1) // max(1, centred.shape[1])):
        return (centred * centred).sum(axis=1).astype(np.int64)
    wide = centred.astype(object)
    return np.array([min(v, (1 << 63) - 1) for v in (wide * wide).sum(axis=1)], dtype=np.int64)


def fitted(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the vectors ``x`` of ``fit``, all of length ``d``; there must be one at least.

    Components whose variance is zero but for rounding are left out.
    """
    shift = np.array(fit.first()["x"], dtype=np.int64)
    n, s, q = scatter(fit, d, shift)
    exact = [[n * q[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)]
    # a common power of two keeps any size within floating point, and changes no digit
    drop = max(0, max((abs(v).bit_length() for row in exact for v in row), default=0) - 1000)
    v = np.array([[float(x >> drop) if drop else float(x) for x in row] for row in exact], dtype=np.float64).reshape(d, d)
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1], vectors[:, ::-1]
    real = int((e[:components] > 16 * d * np.finfo(np.float64).eps * max(e.max(initial=0), 0)).sum())
    e, vectors = e[:real], vectors[:, :real]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(real)]) if real else np.ones(0)
    scale = np.sqrt(e) / n * 2.0 ** (drop / 2)
    return Whitening(n, [a + n * int(b) for a, b in zip(s, shift, strict=True)], vectors * signs / scale, e / np.trace(v))


def identity_error(fit: DataFrame, d: int, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, measured over ``fit``."""
    shared = fit.sparkSession.sparkContext.broadcast(model)
    k = model.weights.shape[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            z = shared.value.apply(shared.value.centred(matrix(batch.column(0), d)))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["at", "v"])

    found = fit.select("x").mapInArrow(each, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    shared.destroy()
    cov = np.zeros(k * k)
    for r in found:
        cov[r["at"]] = r["v"] / model.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max(initial=0))


def whitened(rows: DataFrame, d: int, model: Whitening) -> DataFrame:
    """``id, component, deviation, whitened, explained`` of each row and component, made where the rows are."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind, k = rows.schema["id"].dataType.simpleString(), model.weights.shape[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = shared.value.centred(matrix(batch.column(1), d))
            m = len(u)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.repeat(deviations(u), k)), pa.array(shared.value.apply(u).ravel()), pa.array(np.tile(shared.value.explained, m)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "deviation", "whitened", "explained"])

    return rows.select("id", "x").mapInArrow(each, f"id {kind}, component int, deviation long, whitened double, explained double")


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``<id_col>, component, n, deviation, whitened, explained, identity_error`` of every row and component.

    Components of a vector become ``floor(scale * c) + shift``, the floor held to 61 bits;
    vectors that are null, hold a null or non-finite component, or have another length than
    most do not take part.  The map is fitted on each distinct integer vector once, so hot
    copies weigh as one; all rows are mapped, repeated ones each.  Only components of
    positive variance have coordinates, so a table of one distinct vector, like an empty
    one, gives no rows.  Of either sign of a component the one with a positive largest entry
    is taken.  ``deviation`` is held to 64 bits.  Null ids stay; other columns are ignored.
    """
    rows = embeddings.select(F.col(f"`{id_col}`").alias("id"), integers(F.col(f"`{vec_col}`"), scale, LIMIT, shift).alias("x"))
    rows = materialize(rows.where("x is not null"), "vectors")
    d = usual_length(rows)
    rows = rows.where(F.size("x") == (d or 0))
    if d is None:
        model, error = Whitening(0, [], np.zeros((0, 0)), np.zeros(0)), 0.0
    else:
        fit = materialize(rows.select("x").distinct(), "distinct")
        model = fitted(fit, d, components)
        error = identity_error(fit, d, model)
    out = whitened(rows, d or 0, model)
    return out.select(F.col("id").alias(id_col), "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


def report(embeddings: DataFrame) -> DataFrame:
    """Per kept vector and component up to 16: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    return whiten(embeddings)
