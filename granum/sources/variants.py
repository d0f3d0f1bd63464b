"""JSON captures of drifting shape: read as VARIANT without a schema, typed by paths afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Result column: its type, the paths to try in order, and the default where none of them holds such a value.
Fields = dict[str, tuple[str, list[str], object]]


def parsed(df: DataFrame, text: str, body: str = "body", valid: str = "valid") -> DataFrame:
    """``df`` with JSON column ``text`` as VARIANT ``body``, and whether it is JSON.

    What is not (broken, empty or null text) has a null body and keeps its text, so
    ``where("not valid")`` are the rows to set apart; others have no text any more.
    """
    held = df.withColumn(body, F.try_parse_json(text))
    return held.withColumn(valid, F.col(body).isNotNull()).withColumn(text, F.when(~F.col(valid), F.col(text)))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of a glob as ``path, text, body, valid`` (see :func:`parsed`)."""
    held = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value as text")
    return parsed(held, "text")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as ``path, text, body, valid``; blank lines are left out."""
    held = spark.read.text(path).where("trim(value) <> ''").selectExpr("_metadata.file_path as path", "value as text")
    return parsed(held, "text")


def _at(body: str, path: str, kind: str) -> Column:
    """A value at a path; objects and arrays are no strings, and what cannot be cast is null."""
    got = F.try_variant_get(body, path, kind)
    if kind != "string":
        return got
    shape = F.schema_of_variant(F.try_variant_get(body, path, "variant"))
    return F.when(~(shape.startswith("OBJECT") | shape.startswith("ARRAY")), got)


def typed(df: DataFrame, fields: Fields, body: str = "body") -> DataFrame:
    """``df`` with a column for each field: the first of its paths that holds a value of its type."""
    wanted = {name: F.coalesce(*[_at(body, p, kind) for p in paths], F.lit(default).cast(kind)) for name, (kind, paths, default) in fields.items()}
    return df.withColumns(wanted)


def elements(df: DataFrame, path: str, body: str = "body", outer: bool = False) -> DataFrame:
    """One row for each element of the array, or value of the object, at ``path``: ``pos, key, value``.

    A row without such a place gives none, or one of nulls if ``outer``.
    """
    explode = df.sparkSession.tvf.variant_explode_outer if outer else df.sparkSession.tvf.variant_explode
    return df.withColumn("_at", F.try_variant_get(body, path, "variant")).lateralJoin(explode(F.col("_at").outer())).drop("_at")


def shapes(df: DataFrame, by: list[str] | None = None, body: str = "body") -> DataFrame:
    """``shape, n``: the merged schema of all bodies, of each group ``by``; merged map-side, so no group is held."""
    return df.where(F.col(body).isNotNull()).groupBy(*(by or [])).agg(F.schema_of_variant_agg(body).alias("shape"), F.count("*").alias("n"))
