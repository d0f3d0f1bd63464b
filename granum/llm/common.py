"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granum.storage import HELD, new_folder, release, remove

__all__ = ["bitmap", "bitmap_has", "components", "discard", "free_name", "materialize", "release", "table"]

#: Bits of a key bitmap of few keys.
BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files are replicated by the shared store, so a lost executor costs only the
    tasks it was running.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files behind a frame that :func:`materialize` returned."""
    spark = df.sparkSession
    held = HELD.get(spark.sparkContext.applicationId, set())
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/granum-" in path:
            remove(spark, path)
            held -= {h for h in held if h.rsplit("/", 1)[1] == path.rsplit("/", 1)[1]}


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever its letter case."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


def bitmap(df: DataFrame, key: str) -> tuple[Column, int] | None:
    """A bitmap of the long keys of ``df``, as an array of longs, and its number of bits.

    It has ``BITS`` bits, or eight times as many (16 MB) beyond ``BITS / 8`` keys; a crowded one only
    lets more rows through, and one that would let most through is left out (None).  ``df``
    should be a written table, as its rows are counted first.
    """
    n = df.count()
    bits = BITS if n <= BITS // 8 else 8 * BITS
    if n > bits:
        return None
    bit = F.pmod(F.col(key), F.lit(bits))
    words = df.groupBy((bit / 64).cast("long").alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")).alias("b"))
    dense = df.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("bits")).scalar(), bits


def bitmap_has(held: tuple[Column, int] | None, key: Column) -> Column:
    """Whether the key's bit is set; true where there is no bitmap."""
    if held is None:
        return F.lit(True)
    words, bits = held
    word = F.get(words, (F.pmod(key, F.lit(bits)) / 64).cast("int"))
    return F.coalesce(F.getbit(word, F.pmod(key, F.lit(64)).cast("int")) == 1, F.lit(False))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating star contraction.

    ``edges`` has two columns of the same orderable type, in any order and with any
    repeats; self loops are allowed.  Returns ``node, root`` for every node of an edge
    that is not a self loop, ``root`` being the smallest node of its component.  Null
    ends are ignored and no edges give no rows.  Each round makes the two linear star
    passes and writes its edges to the shared folder; hub nodes only meet in joins,
    which adaptive execution splits, and in map-side combined minima.
    """
    a, b = edges.columns[:2]
    cur = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    cur = materialize(cur, "cc")
    mark = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        big = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        down = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            big.join(down, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        nxt = materialize(small, "cc")
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = nxt
        if tuple(seen) == mark:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
