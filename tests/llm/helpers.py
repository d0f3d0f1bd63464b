"""Small document tables with awkward rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, texts: list[str | None], start: int = 0) -> DataFrame:
    """One row for each text, partitioned so that order is not kept."""
    rows = [(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd(spark: SparkSession) -> DataFrame:
    """Nulls, empties, a long text, repeated rows, and columns that clash with outputs."""
    rows = [(1, None, 1), (None, "alpha beta gamma", 2), (2, "", 3), (3, "x" * 50_000, 4), (4, "alpha beta gamma", 5), (4, "alpha beta gamma", 5), (5, " \n\t\n ", 6), (6, "a\U0001F600b é\n\nq", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    for name in ("score", "keep", "h", "id", "key", "n_words", "spans", "lines_", "verdict", "batch", "lang_pred", "n_lines"):
        df = df.withColumn(name, df["rank"])
    return df


def long_texts(spark: SparkSession) -> DataFrame:
    """Texts of many lines and of many words, twice each under their own ids, and a short one."""
    lines = "\n".join(f"line {i} of a very long text {i * i}" for i in range(20_000))
    words = " ".join(f"w{i}" for i in range(120_000))
    return documents(spark, [lines, lines, words, words, "a short text of its own"])
