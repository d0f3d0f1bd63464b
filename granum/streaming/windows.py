"""Event-time windows and incremental loads, for batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from granum import storage
from granum.sources.versioned import VersionedTable


def hourly_counts(events: DataFrame, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """``hour, n`` of events; a stream gets a watermark and drops what is later.

    Time stamps without a zone are read in the session's zone first, as watermarks need one.
    """
    at = events.withColumn("_at", F.col(ts).cast("timestamp")).where(F.col("_at").isNotNull())
    if events.isStreaming:
        at = at.withWatermark("_at", late)
    by = at.groupBy(F.window("_at", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return by.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "n")


def sliding_counts(events: DataFrame, size: str, slide: str, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """``start, n`` of overlapping windows."""
    at = events.withColumn("_at", F.col(ts).cast("timestamp")).where(F.col("_at").isNotNull())
    if events.isStreaming:
        at = at.withWatermark("_at", late)
    return at.groupBy(F.window("_at", size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, gap: str, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """``key, start, stop, n`` of sessions with gaps below ``gap``."""
    at = events.withColumn("_at", F.col(ts).cast("timestamp")).where(F.col("_at").isNotNull())
    if events.isStreaming:
        at = at.withWatermark("_at", late)
    by = at.groupBy(key, F.session_window("_at", gap).alias("w")).agg(F.count("*").alias("n"))
    return by.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def append_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append rows whose key the versioned table ``target`` lacks; run until the source is read.

    Of repeated keys in a batch the least row counts, whatever order they come in.  A batch is
    one commit that bears its number, so one that is repeated after a failure adds nothing.
    """

    def load(batch: DataFrame, number: int) -> None:
        VersionedTable(batch.sparkSession, target, keys).append_new(batch, (checkpoint, number))

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """The Parquet file or folder ``path`` as a stream, ``files`` at a time, with the schema it has now."""
    schema = spark.read.parquet(path).schema
    fs, p = storage.hadoop_path(spark, path)
    at, own = (path, "*") if fs.getFileStatus(p).isDirectory() else path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", own).parquet(at)


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream until its source is read and return what it gave, from the shared folder.

    ``complete`` keeps the whole result of the last batch, ``append`` all finished rows.  Each
    batch is written under its number, so one that is repeated after a failure replaces itself.
    """
    spark = stream.sparkSession
    base, state = storage.new_folder(spark, "stream"), storage.new_folder(spark, "state")
    seen: list[int] = []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={number}")
        seen.append(number)

    query = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    held = spark.read.parquet(*[f"{base}/batch={n}" for n in (seen[-1:] if mode == "complete" else sorted(set(seen)))])
    return held.select(*stream.columns)


def latest_per_key(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the row of greatest ``order`` of each key in the versioned table ``target``; of equal ones the last one wins.

    A batch is one commit (see :mod:`granum.sources.versioned`): it writes its own rows, is seen
    whole or not at all, and changes nothing when it is repeated.
    """

    def merge(batch: DataFrame, number: int) -> None:
        VersionedTable(batch.sparkSession, target, keys, order).merge(batch, (checkpoint, number))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Latest(StatefulProcessor):
    """Keeps the greatest row of a key in state and gives it whenever it changes."""

    def __init__(self, keys: list[str], order: list[str], schema: T.StructType, idle_ms: int | None) -> None:
        self.keys, self.order, self.schema, self.idle_ms = keys, order, schema, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", self.schema, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        rank = lambda r: tuple((r[c] is not None, r[c]) for c in self.order)
        held = self.best.get() if self.best.exists() else None
        best = None if held is None else dict(zip(self.schema.names, held, strict=True))
        changed = False
        for frame in rows:
            for r in frame[self.schema.names].astype(object).where(frame.notna(), None).to_dict("records"):
                if best is None or rank(r) >= rank(best):
                    best, changed = r, True
        if changed:
            self.best.update(tuple(best[c] for c in self.schema.names))
            yield pd.DataFrame([best], columns=self.schema.names)

    def close(self) -> None:
        pass


def latest_in_state(stream: DataFrame, keys: list[str], order: list[str], idle_ms: int | None = None) -> DataFrame:
    """The stream of each key's greatest row by ``order``, given anew when it changes; an older row changes nothing.

    The row of a key is kept in the state store, also over restarts from a checkpoint; one
    that has not changed for ``idle_ms`` is evicted.  Needs the RocksDB state store and the
    output mode ``update``.
    """
    processor = _Latest(keys, order, stream.schema, idle_ms)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, stream.schema, "update", "processingTime" if idle_ms else "none")


def score(rows: DataFrame, model, probability: str = "probability") -> DataFrame:  # noqa: ANN001
    """Rows of a batch or a stream with the ``prediction`` and ``confidence`` of a fitted pipeline."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows)
    most: Column = F.array_max(vector_to_array(F.col(probability)))
    return out.select(*rows.columns, "prediction", F.round(most, 4).alias("confidence"))
