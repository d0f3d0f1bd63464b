"""Contiguous shards of near equal bytes, cut from global prefix sums.

Rows are dealt to ranges of the order (id, then size, checksum and row number), and each
range is summed on its own.  The totals of the ranges, a few rows, give every range its
offset, so a row's place in the global byte count is its offset plus the sum inside its
range.  The count is cut at equal targets: a row belongs to the shard that its middle byte
lies in, so a cut misses its target by half a document at most.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granum.llm.common import discard, materialize
from granum.operators.ranking import numbered

#: Rows and bytes of text that a range holds on average.
PER_RANGE, RANGE_BYTES = 1 << 18, 256 << 20


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes plus 1) and ``text_crc32`` (unsigned); a null text has no bytes.

    Columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("size", "text_crc32")]
    return docs.select(*rest, (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def place(rows: DataFrame, shards: int, id_col: str, carried: bool) -> DataFrame:
    """``rows`` (with ``size`` and ``text_crc32``) and their ``shard`` and ``slot``; ``carried`` if they hold their texts."""
    rest = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{id_col}`").alias("id"), "size", "text_crc32", F.monotonically_increasing_id().alias("number"))
    held = materialize(keyed, "sized")
    n, total = held.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = 1 + max(n // PER_RANGE, total // RANGE_BYTES if carried else 0)
    dealt = materialize(numbered(held, ["id", "size", "text_crc32", "number"], "size", parts), "ranges")
    discard(held)

    totals = sorted(map(tuple, dealt.groupBy("part_").agg(F.count("*"), F.sum("size")).collect()))
    before = [list(accumulate((t[i] for t in totals), initial=0)) for i in (1, 2)]
    offsets = [(t[0], r, b) for t, r, b in zip(totals, *before)]  # noqa: B905
    offset = dealt.sparkSession.createDataFrame(offsets, "part_ int, rows_ long, bytes_ long")
    dealt = dealt.join(F.broadcast(offset), "part_")

    middle = 2 * (F.col("bytes_") + F.col("run_")) + F.col("size")  # twice the byte it lies at
    targets = [-(-2 * total * k // shards) for k in range(1, shards)]
    shard = sum(((middle >= t).cast("int") for t in targets), F.lit(0))
    starts = [0, *(dealt.agg(*[F.count_if(middle < t) for t in targets]).first() if targets else ())]
    first: Column = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("shard") + 1)
    out = dealt.withColumn("shard", shard).withColumn("slot", F.col("rows_") + F.col("at_") - first)
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest], "shard", "slot")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``size, text_crc32, shard, slot``; shards are contiguous in order of id and near equal in bytes.

    Null ids come first, rows of equal id follow by size and checksum, and rows that repeat
    whole are told apart by number, so a hot id or text is cut like any other stretch; ``slot``
    counts a shard's rows from 0 without gaps.  Null and empty texts have size 1.  A text
    longer than a shard's share leaves shards beside it empty.  An empty table gives an
    empty result; columns of the added names are replaced, all others pass through.  The
    input is written once with row numbers, so it need not come in the same order twice.
    """
    return place(sized(docs, text_col), shards, id_col, carried=True)


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows of :func:`shard` as Parquet, a folder ``shard=N`` each; rows stay in order inside a file."""
    shard(docs, shards, id_col, text_col).write.partitionBy("shard").parquet(path)


def report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` under the law ``bytes``; texts are not dealt out.

    Copies of a text go where their ids do.  ``grown_shard`` is null, as it is another law's.
    """
    rows = place(sized(docs.select("doc_id", "text")).drop("text"), shards, "doc_id", carried=False)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
