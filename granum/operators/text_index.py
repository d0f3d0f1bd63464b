"""A lexical index that is built once: postings in blocks with their largest impact.

A block holds one term's postings in one range of 16 stored documents.  The impact of a
posting is what BM25 makes of its frequency and document length, without the term's weight.
A search first reads terms, ranges and impacts only.  Summed over a question's terms they
bound the score of every document of a range; ranges whose bound stays below what ``k``
documents certainly reach are skipped, and postings are read for the others alone.
Results are those of :func:`granum.operators.search.bm25`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from granum.functions.text import tokens
from granum.operators.search import B, EPSILON, K1, TOP_K, few_words, top
from granum.operators.sizes import broadcast_if_small
from granum.storage import new_folder, read_text, write_text

#: Binary digits of the documents in a range, folders of postings, and steps that impacts are counted in.
RANGE_BITS, SHARDS, STEPS = 4, 16, 256
#: What rounded scores and sums of floating numbers may be off by.
SLACK = 1e-5


def _shard(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


def _block_schema(kind: T.DataType) -> T.StructType:
    posting = T.StructType([T.StructField("id", kind), T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType())])
    return T.StructType([T.StructField("term", T.StringType()), T.StructField("range", T.LongType()), T.StructField("n", T.LongType()), T.StructField("most", T.DoubleType()), T.StructField("postings", T.ArrayType(posting))])


def _block_maker(rows: T.StructType, avgdl: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows ``id, w, range``, those of a range together, to blocks."""
    names, kind = rows.fieldNames(), to_arrow_type(rows["id"].dataType)

    def blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, within = batch.column(1), batch.column(2).to_numpy()
        dl = pc.list_value_length(words).to_numpy()
        coded = words.flatten().dictionary_encode()
        width = max(1, len(words))
        pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * width + np.repeat(np.arange(len(words)), dl), return_counts=True)
        term, row = np.divmod(pair, width)
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (within[row][1:] != within[row][:-1])))[: len(pair)])
        ends = np.concatenate((first, [len(pair)]))
        impact = tf / (tf + K1 * (1 - B + B * dl[row] / avgdl))
        most = np.maximum.reduceat(impact, first) if len(first) else impact
        fields = [batch.column(0).take(pa.array(row)).cast(kind), pa.array(tf.astype(np.int64)), pa.array(dl[row].astype(np.int32))]
        postings = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(fields, names=["id", "tf", "dl"]))
        columns = [coded.dictionary.take(pa.array(term[first])), pa.array(within[row[first]]), pa.array(np.diff(ends).astype(np.int64)), pa.array(most), postings]
        return pa.RecordBatch.from_arrays(columns, names=["term", "range", "n", "most", "postings"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in few_words(batches):
            now = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            within = now.column(names.index("range")).to_numpy()
            whole = int(np.searchsorted(within, within[-1]))  # the last range may go on
            if whole:
                yield blocks(now.slice(0, whole))
            held = now.slice(whole)
        if held is not None and held.num_rows:
            yield blocks(held)

    return each


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", scope: list[str] | None = None) -> None:
    """Write the index of ``docs`` to ``path``; texts are tokenised once, null ones as empty.

    It has ``blocks`` (``term, range, n, most, postings``, a folder for each shard of terms),
    ``levels`` (how many blocks of a term reach each step of impact), ``documents`` (``id``
    and the columns ``scope``) and ``statistics.json``.  A common term is many blocks, so
    none is gathered.  Ids must be unique, as what bounds a document is its range.
    """
    spark = docs.sparkSession
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"), *(scope or []))
    held = f"{path}/words"
    words.write.parquet(held)
    words = spark.read.schema(words.schema).parquet(held)
    words.select("id", *(scope or [])).write.parquet(f"{path}/documents")
    n_docs, avgdl = words.agg(F.count("*"), F.avg(F.size("w"))).first()

    # a range is rows that follow each other in one task, so blocks are made where the rows are and nothing is dealt out
    placed = words.select("id", "w", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS).alias("range"))
    blocks = placed.mapInArrow(_block_maker(placed.schema, avgdl or 1.0), _block_schema(placed.schema["id"].dataType))
    blocks = blocks.withColumn("shard", _shard()).sortWithinPartitions("shard", "term", "range")
    blocks.write.partitionBy("shard").parquet(f"{path}/blocks")

    kept = spark.read.schema(blocks.schema).parquet(f"{path}/blocks").select("term", "n", "most", "shard")
    step = F.least(F.floor(F.col("most") * STEPS), F.lit(STEPS - 1)).alias("step")
    levels = kept.groupBy("shard", "term", step).agg(F.count("*").alias("blocks"), F.sum("n").alias("df"))
    levels.write.partitionBy("shard").parquet(f"{path}/levels")
    raw = F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = spark.read.schema(levels.schema).parquet(f"{path}/levels").groupBy("term").agg(F.sum("df").alias("df")).agg(F.avg(raw)).first()[0]
    write_text(spark, f"{path}/statistics.json", json.dumps({"n_docs": n_docs, "avgdl": avgdl or 1.0, "mean": mean or 0.0, "schemas": {"blocks": blocks.schema.json(), "levels": levels.schema.json()}}))


class TextIndex:
    """An index that :func:`build` wrote."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        held = json.loads(read_text(spark, f"{path}/statistics.json"))
        self.n_docs, self.avgdl, self.mean, self.schemas = held["n_docs"], held["avgdl"], held["mean"], held["schemas"]

    def _read(self, part: str, shards: list[int]) -> DataFrame:
        """The rows of some folders of a part; one without a row has no file to tell its schema."""
        schema = T.StructType.fromJson(json.loads(self.schemas[part]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}").where(F.col("shard").isin(shards))

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, list[int]]:
        """``qid, term, qn`` of the asked terms, and the folders they are in."""
        asked = queries.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))
        shards = sorted(r["s"] for r in asked.select(_shard().alias("s")).distinct().collect())
        return asked, shards

    def _terms(self, asked: DataFrame, shards: list[int], k: int) -> DataFrame:
        """``term, idf, sure``: the weight of each asked term, and an impact that ``k`` of its documents reach."""
        own = self._read("levels", shards)
        own = own.join(broadcast_if_small(asked.select("term").distinct()), "term", "left_semi")
        down = Window.partitionBy("term").orderBy(F.desc("step"))  # STEPS rows of a term at most
        reach = own.withColumn("so_far", F.sum("blocks").over(down))
        each = reach.groupBy("term").agg(F.sum("df").alias("df"), F.max(F.when(F.col("so_far") >= k, F.col("step") / STEPS)).alias("sure"))
        raw = F.log(F.lit(self.n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return each.select("term", F.when(raw < 0, EPSILON * self.mean).otherwise(raw).alias("idf"), F.coalesce("sure", F.lit(0.0)).alias("sure"))

    def plan(self, queries: DataFrame, k: int = TOP_K, skip: bool = True) -> DataFrame:
        """``qid, term, weight, range, n, read``: the blocks of each question, and whether their postings must be read."""
        asked, shards = self._asked(queries)
        weight = (F.col("qn") * F.col("idf") * (K1 + 1)).alias("weight")
        known = asked.join(broadcast_if_small(self._terms(asked, shards, k)), "term").select("qid", "term", weight, "sure")
        # one term alone puts k documents at this score, unless terms of negative weight take from it
        bar = known.groupBy("qid").agg((F.max(F.greatest("weight", F.lit(0.0)) * F.col("sure")) + F.sum(F.least("weight", F.lit(0.0)))).alias("bar"))
        heads = self._read("blocks", shards).select("term", "range", "n", "most")
        met = heads.join(broadcast_if_small(known.select("qid", "term", "weight")), "term")
        if not skip:
            return met.select("qid", "term", "weight", "range", "n", F.lit(True).alias("read"))
        bound = met.groupBy("qid", "range").agg(F.sum(F.greatest("weight", F.lit(0.0)) * F.col("most")).alias("bound"))
        read = bound.join(broadcast_if_small(bar), "qid").select("qid", "range", (F.col("bound") >= F.col("bar") - SLACK).alias("read"))
        return met.join(read, ["qid", "range"]).select("qid", "term", "weight", "range", "n", "read")

    def search(self, queries: DataFrame, k: int = TOP_K, scope: Column | None = None) -> DataFrame:
        """``qid, rank, id, score`` of the ``k`` best documents of each question ``qid, query``.

        Statistics cover the whole corpus; ``scope`` (a condition on the stored columns)
        filters after scoring, and with it no range is skipped, as the bar is proved by
        documents of any scope.  Documents without a query word score 0 and fill up by id.
        """
        _, shards = self._asked(queries)
        todo = self.plan(queries, k, skip=scope is None).where("read").select("qid", "term", "weight", "range")
        blocks = self._read("blocks", shards).select("term", "range", "postings")
        each = blocks.join(todo, ["term", "range"]).select("qid", "weight", F.inline("postings"))
        score = F.col("weight") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(self.avgdl)))
        scores = each.groupBy("qid", "id").agg(F.round(F.sum(score), 6).alias("score"))
        inside = self.spark.read.parquet(f"{self.path}/documents")
        if scope is not None:
            inside = inside.where(scope)
            scores = scores.join(inside.select("id").distinct(), "id", "left_semi")
        fill = queries.select("qid").join(F.broadcast(inside.select("id").orderBy("id").limit(2 * k)))
        every = scores.unionByName(fill.select("qid", "id", F.lit(None).cast("double").alias("score"))).groupBy("qid", "id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
        return top(every, k)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: list[str] | None = None) -> TextIndex:
    """An index of ``docs`` in the shared folder, kept until :func:`granum.storage.release`."""
    path = new_folder(docs.sparkSession, "postings")
    build(docs, path, id_col, text_col, scope)
    return TextIndex(docs.sparkSession, path)
