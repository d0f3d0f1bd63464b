"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a session on the local master gets a temporary folder; on a cluster
    that is an error, as executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="granum-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def hadoop_path(spark: SparkSession, path: str):  # noqa: ANN201
    """The JVM's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Folders of intermediate tables that are still there, by application.
HELD: dict[str, set[str]] = {}


def new_folder(spark: SparkSession, tag: str) -> str:
    """A free path in the shared folder, which :func:`release` removes."""
    path = f"{shared_dir(spark)}/granum-{tag}-{uuid.uuid4().hex}"
    HELD.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path with all it holds."""
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def release(spark: SparkSession) -> int:
    """Remove every intermediate table of this application and tell how many.

    Results are lazy and read them, so an application calls this once its results are written.
    """
    held = HELD.pop(spark.sparkContext.applicationId, set())
    for path in held:
        remove(spark, path)
    return len(held)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file with a text; it must not be there yet."""
    fs, p = hadoop_path(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return spark.read.text(path, wholetext=True).first()[0]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there."""
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def newest(spark: SparkSession, pattern: str, by_name: bool = False) -> str:
    """The file that a glob matches and that was changed last, or whose name is greatest; none is an error."""
    fs, p = hadoop_path(spark, pattern)
    found = fs.globStatus(p) or []
    if not found:
        raise FileNotFoundError(pattern)
    return max((f.getPath().getName() if by_name else f.getModificationTime(), f.getPath().toString()) for f in found)[1]
