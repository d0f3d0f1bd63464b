"""Table readers: Parquet folders, with explicit schemas for text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granum import storage
from granum.sources import sheets


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: StructType | str, **options: str) -> DataFrame:
    """CSV files with a header line and a declared schema (no inference pass)."""
    return spark.read.options(header=True, mode="PERMISSIVE", **options).schema(schema).csv(path)


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(schema).json(path)


def captures(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Whole-file JSON captures matched by a glob."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def capture_rows(spark: SparkSession, path: str, schema: StructType | str, rows: str, captured_at: str = "captured_at") -> DataFrame:
    """The elements of array ``rows`` of every capture as rows, with its date and the latest date of all."""
    held = captures(spark, path, schema).select(captured_at, F.explode(rows).alias("_r")).select(captured_at, "_r.*")
    last = captures(spark, path, schema).agg(F.max(captured_at).alias("m")).scalar()
    return held.withColumn("last_captured_at", last)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole HTML files with their path, and ticker and year from names like ``ABC_FY2024.html``, one row each.

    Keys of other names are null.
    """
    held = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value as html")
    key = lambda i: F.nullif(F.regexp_extract("path", r"([^/]+)_FY(\d{4})\.html?$", i), F.lit(""))
    return held.select("path", key(1).alias("ticker"), key(2).cast("int").alias("fiscal_year"), "html")


def newest_review(spark: SparkSession, csv_path: str, book_path: str, sheet: str) -> DataFrame:
    """The manual review from whichever file is newer, the CSV at equal times; neither is an error."""
    there = [(storage.hadoop_path(spark, p)[0].getFileStatus(storage.hadoop_path(spark, p)[1]).getModificationTime(), p) for p in (book_path, csv_path) if storage.exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"{csv_path}, {book_path}")
    pick = max(there, key=lambda t: (t[0], t[1] == csv_path))[1]
    if pick == book_path:
        return sheets.read_sheet(spark, book_path, sheet)
    held = spark.read.options(header=True, multiLine=True).csv(csv_path)
    return held.toDF(*[c.lstrip("\ufeff") for c in held.columns])


def yaml_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A YAML list of maps as rows of a declared schema; needs PyYAML on the driver."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the package PyYAML") from e
    text = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame(yaml.safe_load(text[0]) if text else [], schema)
