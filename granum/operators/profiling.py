"""Data-quality operators; each is one pass over its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granum.operators.ranking import quantile_columns


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that meet each rule (null does not)."""
    return df.agg(*[F.count_if(r).alias(n) for n, r in rules.items()])


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the number of nulls of each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def clean_report(df: DataFrame, keep: Column) -> DataFrame:
    """Rows before and after a filter, and the share removed; a null condition removes."""
    before, after = F.count("*"), F.count_if(keep)
    return df.agg(before.alias("n_before"), after.alias("n_after"), F.round(100.0 * (before - after) / F.when(before > 0, before), 4).alias("removed_pct"))


def _per_column(df: DataFrame, stats: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate over all columns, turned into a row for each."""
    one = df.agg(*[F.struct(*[v.alias(k) for k, v in s.items()]).alias(c) for c, s in stats.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in stats])).alias("x")).select("x.column_name", "x.s.*")


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, n_missing, pct_missing`` of each column."""
    n = F.count("*")
    return _per_column(df, {c: {"n_missing": F.count_if(F.col(c).isNull()), "pct_missing": F.round(100.0 * F.count_if(F.col(c).isNull()) / F.when(n > 0, n), 2)} for c in columns})


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, n_distinct`` of each column with one distinct non-null value.

    A column has a single value exactly when its least and greatest agree, so no distinct
    count is gathered.
    """
    stats = {c: {"lo": F.min(c).cast("string"), "hi": F.max(c).cast("string")} for c in columns}
    return _per_column(df, stats).where("lo = hi").select("column_name", F.lit(1).cast("bigint").alias("n_distinct"))


def describe(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact linear quartiles of each column."""
    stats, ps = {}, (0.25, 0.5, 0.75)
    quartiles = quantile_columns(df, {c: list(ps) for c in columns})
    for c in columns:
        x = F.col(c).cast("double")
        q = {f"q{int(100 * p)}": F.round(v, digits) for p, v in zip(ps, quartiles[c], strict=True)}
        stats[c] = {"n": F.count(x), "mean": F.round(F.avg(x), digits), "std": F.round(F.stddev_samp(x), digits), "min": F.min(x), **q, "max": F.max(x)}
    return _per_column(df, stats)


def impute_median(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the column's nulls replaced by its exact median."""
    return df.withColumn(out, F.coalesce(F.col(column), _quantile(df, column, 0.5)))


def capped(df: DataFrame, column: str, quantile: float, out: str) -> DataFrame:
    """``df`` with the column capped at its linear quantile."""
    return df.withColumn(out, F.least(F.col(column), _quantile(df, column, quantile)))


def _quantile(df: DataFrame, column: str, p: float) -> Column:
    """A quantile of the whole column, as a scalar subquery or a literal."""
    value = quantile_columns(df, {column: [p]})[column][0]
    return df.agg(value.alias("q")).scalar()


def select_by(df: DataFrame, dtypes: tuple[str, ...] = (), prefix: str = "", suffix: str = "") -> list[str]:
    """Names of the columns of some types (``number`` for any numeric one; none: all) with a prefix and suffix."""
    number = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    wanted = tuple(t for d in dtypes for t in (number if d == "number" else (d,)))
    return [c for c, t in df.dtypes if c.startswith(prefix) and c.endswith(suffix) and (not wanted or t.split("(")[0] in wanted)]
