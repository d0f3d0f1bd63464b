"""Optimal length buckets and token-budget batches.

The global histogram of lengths is exact, and dynamic programming over it finds the bucket
upper lengths that minimise padding.  ``L`` different lengths need documents of
``L * (L - 1) / 2`` tokens in all, so the histogram has at most ``sqrt(2 * tokens) + 1``
rows: five million for 10^13 tokens.  The cost of a bucket has the quadrangle inequality, so
the best boundary moves along with the bucket's end, and each round of the programme is
solved by bisection in ``L log L`` steps.

Inside each bucket a batch holds as many documents as fit the token budget at the
bucket's padded length.  The place of a document in its bucket is its rank by id: rows are
dealt to ranges of the order (bucket, id, length, row number), as many as the table's size
asks for, numbered inside each and offset by the totals of the ranges before, so neither a
bucket nor a hot id meets in one task.  Only the order's own columns are dealt to ranges and
numbered; the documents' columns join their places once, unsorted and without leaving the JVM.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granum.llm.common import free_name, materialize
from granum.operators.ranking import numbered

#: Rows of a range on average.
PER_RANGE = 1 << 18


def _step(best: np.ndarray, docs: np.ndarray, tokens: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the first ``j`` lengths with one more bucket, and where that bucket starts.

    Ends are solved at ever finer strides; each start lies between those of the two ends
    around it.  Of equal costs the smallest start is taken.
    """
    n = len(x)
    out, start = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    stride = 1 << max(0, n - 1).bit_length()
    solved = np.array([0])
    while stride:
        ends = np.setdiff1d(np.arange(stride, n + 1, stride), solved, assume_unique=True)
        if len(ends):
            left = np.searchsorted(solved, ends) - 1
            lo = start[solved[left]]
            right = np.minimum(left + 1, len(solved) - 1)
            hi = np.where(left + 1 < len(solved), start[solved[right]], ends - 1)
            hi = np.maximum(lo, np.minimum(hi, ends - 1))
            width = hi - lo + 1
            first = np.cumsum(width) - width
            i = np.arange(width.sum()) - np.repeat(first - lo, width)
            j = np.repeat(ends, width)
            cost = best[i] + (docs[j] - docs[i]) * x[j - 1] - (tokens[j] - tokens[i])
            least = np.minimum.reduceat(cost, first)
            hits = np.flatnonzero(cost == np.repeat(least, width))
            start[ends] = i[hits[np.searchsorted(hits, first)]]
            out[ends] = least
            solved = np.union1d(solved, ends)
        stride >>= 1
    return out, start


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascend and differ.  Of equally good choices the one with the smallest
    bounds, read from the largest down, is returned.
    """
    n = len(lengths)
    if not n:
        return []
    x, c = lengths.astype(np.int64), counts.astype(np.int64)
    docs, tokens = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(c * x)))
    best = np.concatenate(([0], docs[1:] * x - tokens[1:]))
    back = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(min(buckets, n) - 1):
        best, start = _step(best, docs, tokens, x)
        back.append(start)
    out, j = [], n
    for start in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(start[j])
    return out[::-1]


def pack(docs: DataFrame, length: Column, buckets: int = 8, budget: int = 16384, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_tokens, bucket_len, batch, slot, n_pad``.

    ``length`` counts a row's tokens (null: 0).  ``bucket_len`` is the padded length,
    ``batch`` numbers the batches of a bucket from 0 in order of id, ``slot`` the rows of
    a batch; a batch holds ``max(1, budget div bucket_len)`` rows, so a document longer
    than the budget is a batch of its own.  Empty texts form rows of the smallest bucket.
    Ids may be of any orderable type; rows of equal id are ordered by length, those of equal
    length too by chance; null ids come first.  An empty table gives an empty result.  Columns of ``docs``
    with the added names are replaced.
    """
    names = ("n_tokens", "bucket_len", "batch", "slot", "n_pad")
    size = free_name(docs, "n_tokens_")
    src = docs.withColumn(size, F.coalesce(length.cast("bigint"), F.lit(0).cast("bigint")))
    keep = [c for c in docs.columns if c.lower() not in names]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row")
    held = src.select(row, F.col(f"`{id_col}`").alias("id"), F.col(size).alias("n"), F.monotonically_increasing_id().alias("number"))
    held = materialize(held, "lengths")  # lengths are counted once for all that follows
    hist = sorted((int(r[0]), int(r[1])) for r in held.groupBy("n").agg(F.count("*")).collect())
    bounds = best_bounds(np.array([h[0] for h in hist]), np.array([h[1] for h in hist]), buckets) or [0]

    def place(n: str) -> Column:
        out = F.lit(bounds[-1])
        for b in reversed(bounds[:-1]):
            out = F.when(F.col(n) <= b, b).otherwise(out)
        return out.cast("bigint")

    sizes: dict[int, int] = {}
    for n, c in hist:
        bucket = next((b for b in bounds if n <= b), bounds[-1])
        sizes[bucket] = sizes.get(bucket, 0) + c
    first = dict(zip(sizes, accumulate(sizes.values(), initial=0)))  # noqa: B905
    parts = 1 + sum(h[1] for h in hist) // PER_RANGE
    order = held.select(place("n").alias("bucket"), "id", "n", "number")
    dealt = materialize(numbered(order, ["bucket", "id", "n", "number"], None, parts).drop("id", "run_"), "ranges")
    totals = sorted(map(tuple, dealt.groupBy("part_").agg(F.count("*")).collect()))
    offsets = [(p, o) for (p, _), o in zip(totals, accumulate((t[1] for t in totals), initial=0))]  # noqa: B905
    dealt = dealt.join(F.broadcast(src.sparkSession.createDataFrame(offsets, "part_ int, rows_ long")), "part_")
    start = F.lit(0).cast("bigint")
    for b, o in first.items():
        start = F.when(F.col("bucket") == b, o).otherwise(start)
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1))))
    at = F.col("rows_") + F.col("at_") - start
    places = dealt.select("number", "n", "bucket", at.alias("at"), rows.alias("rows"))
    return held.select("row", "number").join(places.hint("shuffle_hash"), "number").select(
        *[F.col("row").getField(c).alias(c) for c in keep],
        F.col("n").alias("n_tokens"), F.col("bucket").alias("bucket_len"), F.floor(F.col("at") / F.col("rows")).alias("batch"),
        (F.col("at") % F.col("rows")).cast("bigint").alias("slot"), (F.col("bucket") - F.col("n")).alias("n_pad"),
    )


def word_count(text: Column) -> Column:
    """The number of maximal runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def report(docs: DataFrame, buckets: int = 8, budget: int = 16384) -> DataFrame:
    """Per document: ``doc_id, n_tokens, bucket_len, batch, slot, n_pad``; tokens are words."""
    lengths = docs.select("doc_id", word_count(F.col("text")).cast("bigint").alias("words"))
    return pack(lengths, F.col("words"), buckets, budget).drop("words")
