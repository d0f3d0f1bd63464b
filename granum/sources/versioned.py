"""A keyed table that changes by whole versions: bucketed files behind a log of manifests.

A commit writes its rows beside what is there and then publishes a manifest, one small file
that names the folders of every bucket, by a rename that fails if the version exists.  A
reader takes the newest manifest, so it sees all of a commit or nothing, and a failure at
any step leaves the table as it was.  A commit writes its own rows; a bucket is rewritten
when what was added since has grown to its size, so the bytes written follow the batches.
Of rows with one key the greatest in the table's order counts, then the latest committed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granum import storage

#: Buckets of a new table.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has published the version that a commit was to become."""


@dataclass
class Manifest:
    """One version: the table's shape, its buckets ``{number: [base rows, added rows, folders]}`` and the last batch of each stream."""

    version: int
    keys: list[str]
    order: list[str]
    schema: str
    buckets: int
    held: dict[str, list] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """The table at ``path``; the first commit makes it."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str] | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order or [], buckets

    # ------------------------------------------------------------ reading

    def versions(self) -> list[int]:
        """The published versions, ascending."""
        fs, log = storage.hadoop_path(self.spark, f"{self.path}/log")
        if not fs.exists(log):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of a version (the newest), None if there is no table."""
        every = self.versions()
        if not every:
            return None
        text = storage.read_text(self.spark, f"{self.path}/log/{every[-1] if version is None else version:012d}.json")
        return Manifest(**json.loads(text))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the newest), one for each key; None if there is no table."""
        m = self.manifest(version)
        return None if m is None else self._latest(self._rows(m, list(m.held)), m).select(*T.StructType.fromJson(json.loads(m.schema)).names)

    def _rows(self, m: Manifest, buckets: list[str]) -> DataFrame:
        """All stored rows of some buckets, with ``_version``."""
        schema = T.StructType.fromJson(json.loads(m.schema))
        stored = T.StructType([*schema.fields, T.StructField("_version", T.LongType())])
        folders = sorted({f"{self.path}/data/{f}/_bucket={b}" for b in buckets for f in m.held[b][2]})
        return self.spark.read.schema(stored).parquet(*folders) if folders else self.spark.createDataFrame([], stored)

    @staticmethod
    def _latest(rows: DataFrame, m: Manifest) -> DataFrame:
        rest = [c for c in rows.columns if c not in m.keys and c != "_version"]
        if not rest:
            return rows.groupBy(*m.keys).agg(F.max("_version").alias("_version"))
        best = F.max_by(F.struct(*rest, "_version"), F.struct(*m.order, "_version")).alias("_row")
        return rows.groupBy(*m.keys).agg(best).select(*m.keys, "_row.*")

    # ------------------------------------------------------------ writing

    def merge(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int | None:
        """Add or replace rows by key and return the new version; None if the stream's batch is in already."""
        return self._commit(df, batch, only_new=False)

    def append_new(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int | None:
        """Add rows whose key the table lacks; of repeated keys in ``df`` the least row counts."""
        return self._commit(df, batch, only_new=True)

    def _commit(self, df: DataFrame, batch: tuple[str, int] | None, only_new: bool) -> int | None:
        m = self.manifest() or Manifest(-1, self.keys, self.order, df.schema.json(), self.buckets)
        if batch is not None and m.batches.get(batch[0], -1) >= batch[1]:
            return None
        version, names = m.version + 1, T.StructType.fromJson(json.loads(m.schema)).names
        rest = [c for c in names if c not in m.keys and c not in m.order]
        pick = F.min if only_new else F.max
        fresh = df.select(*names)
        fresh = fresh.groupBy(*m.keys).agg(pick(F.struct(*m.order, *rest)).alias("_row")).select(*m.keys, "_row.*") if m.order or rest else fresh.distinct()
        fresh = fresh.select(*names, F.lit(version).cast("long").alias("_version"), F.pmod(F.xxhash64(*m.keys), F.lit(m.buckets)).cast("string").alias("_bucket"))
        if only_new and m.held:
            mine = [r["_bucket"] for r in fresh.select("_bucket").distinct().collect() if r["_bucket"] in m.held]
            old = self._rows(m, mine).select(*[F.col(k).alias(f"_{k}") for k in m.keys]).distinct()
            fresh = fresh.join(old, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in m.keys], "left_anti")
        # written first, so that counts, files and retries agree
        folder = uuid.uuid4().hex
        self._write(fresh, f"{folder}-a")
        written = self.spark.read.schema(fresh.schema).parquet(f"{self.path}/data/{folder}-a")
        counts = {r["_bucket"]: r["count"] for r in written.groupBy("_bucket").count().collect()}
        full = [b for b, n in counts.items() if b in m.held and m.held[b][1] + n >= m.held[b][0]]
        held = {b: list(v) for b, v in m.held.items()}
        for b, n in counts.items():
            base, added, folders = held.get(b, [0, 0, []])
            held[b] = [base, added + n, [*folders, f"{folder}-a"]] if folders else [n, 0, [f"{folder}-a"]]
        if full:
            parts = [self._latest(self._rows(Manifest(**{**m.__dict__, "held": held}), full), m).select(*names, "_version")]
            whole = reduce(DataFrame.unionByName, parts).withColumn("_bucket", F.pmod(F.xxhash64(*m.keys), F.lit(m.buckets)).cast("string"))
            self._write(whole, f"{folder}-b")
            sizes = self.spark.read.schema(whole.schema).parquet(f"{self.path}/data/{folder}-b").groupBy("_bucket").count().collect()
            held |= {r["_bucket"]: [r["count"], 0, [f"{folder}-b"]] for r in sizes}
        batches = m.batches | ({batch[0]: batch[1]} if batch else {})
        self._publish(Manifest(version, m.keys, m.order, m.schema, m.buckets, held, batches))
        return version

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")

    def _publish(self, m: Manifest) -> None:
        """Make a version the newest one, whole or not at all."""
        jvm = self.spark._jvm
        draft = f"{self.path}/log/.{uuid.uuid4().hex}"
        storage.write_text(self.spark, draft, json.dumps(m.__dict__))
        _, source = storage.hadoop_path(self.spark, draft)
        fs, target = storage.hadoop_path(self.spark, f"{self.path}/log/{m.version:012d}.json")
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        if fs.exists(target):
            raise Conflict(f"version {m.version} of {self.path} is there")
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, options)

    def vacuum(self, keep: int = 2) -> int:
        """Remove folders that none of the ``keep`` newest versions names, and older manifests; tell how many folders went."""
        every = self.versions()
        for v in every[:-keep]:
            storage.remove(self.spark, f"{self.path}/log/{v:012d}.json")
        used = {f for v in every[-keep:] for _, _, folders in self.manifest(v).held.values() for f in folders}
        fs, data = storage.hadoop_path(self.spark, f"{self.path}/data")
        gone = [f.getPath().getName() for f in fs.listStatus(data) if f.getPath().getName() not in used] if fs.exists(data) else []
        for name in gone:
            storage.remove(self.spark, f"{self.path}/data/{name}")
        return len(gone)
