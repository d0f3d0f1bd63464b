"""Total orders without one big window: rows dealt to ranges between fixed cut points.

The cut points are literals taken from a bounded sample, so every branch of a plan, and
every retry of a task, puts a row in the same range.  They only set how even the ranges
are; ranks and sums are exact whatever the sample was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled rows for each cut point, and rows that a range holds on average at least.
PER_CUT, LEAST_ROWS = 32, 20_000
#: Most ranges of an order.
MOST = 256
#: Estimated bytes up to which a table is ordered, or its values kept, in one task.
SMALL_BYTES = 16 << 20

#: Columns of an order with whether each descends; nulls are first ascending, last descending.
Order = list[tuple[str, bool]]


def sort_keys(order: Order) -> list[Column]:
    """The order as sort expressions."""
    return [F.desc(c) if down else F.asc(c) for c, down in order]


def small(df: DataFrame) -> bool:
    """Whether the optimiser's estimate of a table's size is at most ``SMALL_BYTES``; runs nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES


def cut_points(df: DataFrame, order: Order, parts: int) -> list[tuple]:
    """At most ``parts - 1`` ascending rows of the order that cut it in even ranges."""
    if parts <= 1:
        return []
    names = [c for c, _ in order]
    spread = F.xxhash64(*names, F.monotonically_increasing_id())
    few = df.select(*names).withColumn("_spread", spread).orderBy("_spread").limit(PER_CUT * parts).drop("_spread")
    rows = [tuple(r) for r in few.orderBy(*sort_keys(order)).collect()]
    picked = rows[PER_CUT - 1 :: PER_CUT] if len(rows) >= 2 * PER_CUT else []
    return [p for i, p in enumerate(picked) if not i or p != picked[i - 1]]


def _up_to(order: Order, bound: tuple) -> Column:
    """Whether a row is at or before a bound."""
    out = F.lit(True)
    for (name, down), value in reversed(list(zip(order, bound, strict=True))):
        c, b = F.col(name), F.lit(value)
        before = (F.lit(False) if value is None else c.isNull() | (c < b)) if not down else (c.isNotNull() if value is None else F.coalesce(c > b, F.lit(False)))
        out = before | (c.eqNullSafe(b) & out)
    return out


def part_of(order: Order, points: list[tuple]) -> Column:
    """The number of a row's range, found by bisection."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_up_to(order, points[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(points))


def ranked_sums(df: DataFrame, order: Order, amount: Column, parts: int = 64) -> DataFrame:
    """``df`` with ``pos, run, n, total``: rank, running sum, count and sum in an order.

    Rows are dealt in ranges of the order, summed per range, and offset by the ranges
    before, so the window of an order that is not small never meets in one task.  ``order`` must tell all rows
    apart for ranks to be repeatable, and ``df`` must give the same rows each time.
    """
    part = part_of(order, cut_points(df, order, 1 if small(df) else min(parts, MOST)))
    dealt = df.withColumn("_part", part)
    sums = dealt.groupBy("_part").agg(F.count("*").alias("_c"), F.sum(amount).alias("_s"))
    ahead = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    offsets = sums.select("_part", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_s0"), F.sum("_c").over(every).alias("n"), F.sum("_s").over(every).alias("total"))
    w = Window.partitionBy("_part").orderBy(*sort_keys(order))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.withColumn("_r", F.row_number().over(w)).withColumn("_x", F.sum(amount).over(run)).join(F.broadcast(offsets), "_part")
        .withColumn("pos", F.col("_r") + F.col("_c0")).withColumn("run", F.col("_x") + F.col("_s0")).drop("_part", "_r", "_x", "_c0", "_s0")
    )


def numbered(df: DataFrame, order: list[str], amount: str | None, parts: int) -> DataFrame:
    """``df`` in ranges of an ascending order (nulls first), with ``part_, at_, run_``.

    ``part_`` is the range, ``at_`` the row's place in it from 0 and ``run_`` the sum of ``amount``
    (a long, never null) over the rows before it in the range.  One shuffle; the number of
    ranges is the caller's, so it can follow the size of the table.  The ranges come from a
    sample: write the result and read it back before anything is built on it.  ``order`` must
    tell rows apart, down to a row number, or a hot key stays in one range.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("part_", T.IntegerType()), T.StructField("at_", T.LongType()), T.StructField("run_", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, done = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            size = np.zeros(n, dtype=np.int64) if amount is None else batch.column(amount).to_numpy()
            run = np.cumsum(size)
            added = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(rows, rows + n)), pa.array(run - size + done)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)
            rows, done = rows + n, done + (int(run[-1]) if n else 0)

    keys = [F.asc_nulls_first(c) for c in order]
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of numeric columns; null where a column has no value.

    Values are cut in ranges, counted, and only the ranges that hold a wanted rank are cut
    again, until they hold few rows; so no task keeps all distinct values, as an exact
    percentile aggregate does.  Nulls and NaN take no part.
    """
    out: dict[str, list[float | None]] = {}
    columns = list(wanted)
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    totals = df.agg(*[F.count(x[c]).alias(str(i)) for i, c in enumerate(columns)]).first()
    for i, c in enumerate(columns):
        n = totals[i]
        if not n:
            out[c] = [None] * len(wanted[c])
            continue
        at = [p * (n - 1) for p in wanted[c]]
        ranks = sorted({int(a) for a in at} | {min(int(a) + 1, n - 1) for a in at})
        values = _at_ranks(df.select(x[c].alias("x")).where("x is not null"), ranks, n)
        out[c] = [values[int(a)] + (a - int(a)) * (values[min(int(a) + 1, n - 1)] - values[int(a)]) for a in at]
    return out


def _at_ranks(values: DataFrame, ranks: list[int], n: int) -> dict[int, float]:
    """The values at ranks (from 0) of the ``n`` rows of column ``x``."""
    counted = values.groupBy("x").agg(F.count("*").alias("k"))
    if n <= LEAST_ROWS:
        rows = sorted((r["x"], r["k"]) for r in counted.collect())
        return _pick(rows, ranks)
    points = cut_points(values, [("x", False)], MOST)
    part = part_of([("x", False)], points)
    sums = values.groupBy(part.alias("part")).agg(F.count("*").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    out, done = {}, 0
    for r in sorted(sums.collect()):
        own = [t for t in ranks if done <= t < done + r["k"]]
        if own and r["lo"] == r["hi"]:
            out |= dict.fromkeys(own, r["lo"])
        elif own:
            inside = values.where((F.col("x") >= r["lo"]) & (F.col("x") <= r["hi"]))
            out |= {t + done: v for t, v in _at_ranks(inside, [t - done for t in own], r["k"]).items()}
        done += r["k"]
    return out


def _pick(rows: list[tuple[float, int]], ranks: list[int]) -> dict[int, float]:
    out, done = {}, 0
    for value, k in rows:
        out |= {t: value for t in ranks if done <= t < done + k}
        done += k
    return out


#: Rows up to which one aggregate may keep the values of a column.
BUFFERED = 1_000_000


def few(df: DataFrame, rows: int = BUFFERED) -> bool:
    """Whether ``df`` is small, or has at most ``rows`` rows; counts no further."""
    return small(df) or df.limit(rows + 1).count() <= rows


def quantile_columns(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[Column]]:
    """Exact quantiles as aggregate expressions of ``df`` where it is small, else as literals."""
    if few(df):
        x = {c: F.col(c).cast("double") for c in wanted}
        return {c: [F.percentile(x[c], F.array(*map(F.lit, ps)))[i] for i in range(len(ps))] for c, ps in wanted.items()}
    return {c: [F.lit(v).cast("double") for v in vs] for c, vs in quantiles(df, wanted).items()}


def quantiles_by(df: DataFrame, keys: list[str], column: str, ps: list[float]) -> DataFrame:
    """``keys, n, q``: exact linear quantiles of a column in each group, as an array.

    Small tables keep a group's values in one aggregate.  Else values are dealt to ranges
    by literal cut points, ranges are counted, and only those that hold a wanted rank are
    ordered, so neither a group nor its values meet in one task.  Nulls take no part; a group
    without a value has none.
    """
    held = df.select(*keys, F.col(column).cast("double").alias("_x")).where("_x is not null")
    if few(held):
        return held.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("_x", F.array(*map(F.lit, ps))).alias("q"))
    order: Order = [("_x", False)]
    held = held.withColumn("_part", part_of(order, cut_points(held, order, MOST)))
    counts = held.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    own = Window.partitionBy(*keys)
    counts = counts.withColumn("_done", F.sum("_c").over(own.orderBy("_part")) - F.col("_c")).withColumn("n", F.sum("_c").over(own))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(ps)])
    ends = counts.withColumn("_r", F.explode(ranks)).withColumn("_rank", F.explode(F.array(F.floor("_r.at"), F.ceil("_r.at"))))
    ends = ends.where((F.col("_rank") >= F.col("_done")) & (F.col("_rank") < F.col("_done") + F.col("_c")))
    wanted = ends.select(*keys, "_part", "_done", "n", F.col("_r.i").alias("_i"), F.col("_r.at").alias("_at"), "_rank")
    parts = wanted.select(*keys, "_part", "_done").distinct()
    same = lambda a, b, names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    inside = held.alias("h").join(parts.alias("p"), same("h", "p", [*keys, "_part"])).select("h.*", "p._done")
    placed = inside.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_x")) - 1 + F.col("_done"))
    values = wanted.alias("w").join(placed.alias("v"), same("w", "v", [*keys, "_rank"])).select("w.*", "v._x")
    low, high = F.min_by("_x", "_rank"), F.max_by("_x", "_rank")
    each = values.groupBy(*keys, "n", "_i").agg((low + (F.first("_at") - F.floor(F.first("_at"))) * (high - low)).alias("_q"))
    return each.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias("q"))
