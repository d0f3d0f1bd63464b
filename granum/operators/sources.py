"""Integration of sources: unions, latest rows, anti-joins, review overrides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdict words of a review sheet.
CONFIRM, DISCARD = ("si", "sí", "ok", "yes"), ("no", "descartar", "fuera")


def union_records(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows with the name of their source; fields a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select(F.lit(n).alias("source"), "*") for n, df in parts.items()])


def latest(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """The row of greatest ``order`` of each key, by map-side maxima."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *payload)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}") for c in [*order, *payload]])


def arrays_to_rows(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Parallel arrays as rows, shorter ones padded with nulls."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.inline(F.arrays_zip(*arrays)))


def cell(x: Column) -> Column:
    """A free-text cell, trimmed and lower-cased; null is empty."""
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def review_override(rows: DataFrame, sheet: DataFrame, key: str, allowed: set[str]) -> DataFrame:
    """``key, label, origin`` after manual review.

    A correction replaces the label; a confirming verdict marks the row as confirmed, even
    when it was corrected; a discarding verdict drops it.  A correction outside
    ``allowed`` stops the query.  Of repeated sheet rows of a key the greatest counts.
    """
    one = sheet.groupBy(key).agg(F.max(F.struct("correction", "verdict")).alias("s")).select(key, cell(F.col("s.correction")).alias("c"), cell(F.col("s.verdict")).alias("v"))
    known = F.col("c").isin("", *sorted(allowed))
    checked = one.withColumn("c", F.when(known, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("unknown correction: "), F.col("c")))))
    out = rows.join(checked, key, "left").fillna("", ["c", "v"]).where(~F.col("v").isin(*DISCARD))
    origin = F.when(F.col("v").isin(*CONFIRM), "confirmado").when(F.col("c") != "", "revision_manual").otherwise("clasificador")
    return out.select(key, F.coalesce(F.nullif("c", F.lit("")), F.col("label")).alias("label"), origin.alias("origin"))


def incremental(new: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``done``."""
    return new.join(done.select(*keys).distinct(), keys, "left_anti")


def without_nulls(entries: Column) -> Column:
    """A map without its entries of null value."""
    return F.map_filter(entries, lambda k, v: v.isNotNull())
