"""Writers: CSV, JSON lines, snapshots with capture columns, vectors, arrays, report sheets, models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granum.sources.versioned import VersionedTable

#: Longest text of a report cell.
CELL = 32_000


def csv(df: DataFrame, path: str, mode: str = "overwrite", bom: bool = False) -> None:
    """CSV part files with a header line; ``bom`` puts a byte order mark before each file's first name."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode(mode).option("header", True).csv(path)


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines part files."""
    df.write.mode(mode).json(path)


def snapshot(df: DataFrame, path: str, captured_at: str, source: str) -> None:
    """JSON lines with the capture date and source on every row, one folder a date."""
    stamped = df.withColumns({"captured_at": F.lit(captured_at), "capture_source": F.lit(source)})
    stamped.write.mode("overwrite").json(f"{path}/captured_at={captured_at}")


def upsert_vectors(df: DataFrame, path: str, id_col: str, order_col: str | None = None) -> None:
    """Rows of ``df`` replace those of equal id in the versioned table at ``path``, or are added; safe to repeat.

    Of repeated ids in ``df`` the row of greatest ``order_col`` counts (then of greatest other columns);
    against the table the later call wins.  Read it with ``VersionedTable(...).read()``.
    """
    rest = [c for c in df.columns if c not in (id_col, order_col)]
    best = F.max(F.struct(*([order_col] if order_col else []), *rest)).alias("_b")
    fresh = df.groupBy(id_col).agg(best).select(*[F.col(c) if c == id_col else F.col(f"_b.{c}").alias(c) for c in df.columns])
    VersionedTable(df.sparkSession, path, [id_col]).merge(fresh)


def arrays(df: DataFrame, path: str) -> None:
    """Predictions and other arrays as Parquet, in order of their first column."""
    df.sortWithinPartitions(df.columns[0]).write.mode("overwrite").parquet(path)


def report(sheets: dict[str, DataFrame], path: str) -> None:
    """One CSV folder for each sheet, long texts cut to what a cell holds, and a data dictionary."""
    for name, df in sheets.items():
        cut = df.select(*[F.substring(c, 1, CELL).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
        csv(cut, f"{path}/{name}")
    any_df = next(iter(sheets.values()))
    rows = [(n, c, t) for n, df in sheets.items() for c, t in df.dtypes]
    csv(any_df.sparkSession.createDataFrame(rows, "sheet string, column_name string, type string"), f"{path}/dictionary")


def save_model(model, path: str) -> None:  # noqa: ANN001
    """A fitted pipeline or model, overwriting what is there; load it with its class's ``load``."""
    model.write().overwrite().save(path)


def load_model(path: str):  # noqa: ANN201
    """The pipeline that :func:`save_model` wrote."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
