"""Tables of integer vectors, and Arrow batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granum.llm.topk import quantised


def integers(embedding: Column, scale: int, limit: int, shift: int = 0) -> Column:
    """``floor(scale * x) + shift`` of each component, its floor held to ``limit`` either way; null unless all are finite."""
    return F.transform(quantised(embedding, scale), lambda v: F.greatest(F.lit(-limit), F.least(F.lit(limit), v)) + F.lit(shift).cast("bigint"))


def usual_length(rows: DataFrame, col: str = "x") -> int | None:
    """The most frequent length of a table's vectors, the smallest of several; None for an empty table."""
    first = rows.groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return first["d"] if first else None


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """The vectors of an Arrow column, all of length ``d``, as rows of 64-bit integers."""
    return column.flatten().to_numpy().astype(np.int64, copy=False).reshape(len(column), d)
