"""Approximate dense search: an inverted file of cells with product-quantised residuals.

The index is built once and written by cell.  Its centres and codebooks are trained on a
bounded sample; every row is then assigned to its nearest centre and its residual coded in
a byte a part.  A search reads codes of the probed cells only, scores them from tables of
the query's products with the codebook entries, and rescores the best of those exactly.

How many cells a search probes is measured, not guessed: at training, sampled rows look up
their neighbours in the sample, and the share of cells that holds nearly all of them is
stored by depth.  A narrow scope makes the neighbours in it lie deeper, and so probes more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from granum.operators import best
from granum.operators.search import TOP_K, top
from granum.operators.sizes import broadcast_if_small
from granum.storage import read_text, write_text

#: Rows that train the index at most, and rounds of k-means.
SAMPLE, ROUNDS = 32_768, 12
#: Parts of a residual and entries of a part's codebook.
PARTS, ENTRIES = 16, 256
#: Cells of an index at most, and rows of a cell that are aimed at.
CELLS, PER_CELL = 4096, 128
#: Share of neighbours that the probed cells should hold, rows that measure it, and depths it is measured at.
AIM, ASKING, DEPTHS = 0.97, 512, (8, 16, 32, 64, 128, 256, 512)
#: Candidates rescored for each result asked for.
RESCORED = 16
#: Bytes of queries that one broadcast may hold, and rows scored together.
QUERY_BYTES, ROWS = 16 << 20, best.ROWS


@dataclass(frozen=True)
class Model:
    """Centres ``[cell, dimension]``, codebooks ``[part, entry, dimension of the part]`` and shares of cells by ``DEPTHS``."""

    centres: np.ndarray
    books: np.ndarray
    shares: np.ndarray

    def share(self, k: int, inside: float) -> float:
        """The share of cells to probe for ``k`` rows of a scope that holds ``inside`` of all rows."""
        deep = k / max(inside, 1e-9)
        return float(self.shares[np.searchsorted(DEPTHS, deep)]) if deep <= DEPTHS[-1] else 1.0

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code bytes of unit rows."""
        cell = _nearest(x, self.centres)
        rest = (x - self.centres[cell]).reshape(len(x), *self.books.shape[::2])
        code = np.stack([_nearest(rest[:, p], b) for p, b in enumerate(self.books)], axis=1)
        return cell, code.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """``[query, part, entry]``: products of each query with the codebook entries."""
        return np.einsum("qpw,pew->qpe", q.reshape(len(q), *self.books.shape[::2]), self.books)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from different sampled rows; an empty centre takes the row farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        far = np.argsort(-((x - centres[own]) ** 2).sum(axis=1))
        empty = np.flatnonzero(n == 0)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        centres[empty] = x[far[: len(empty)]]
    return centres


def _shares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each depth, the share of cells that holds ``AIM`` of the sample's neighbours up to it."""
    q = x[:ASKING]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-near, axis=1)[:, : DEPTHS[-1]]
    rank = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)  # of each cell in the order of probing
    place = np.take_along_axis(rank, _nearest(x, centres)[near], axis=1)
    return np.array([np.quantile(place[:, :d], AIM, method="higher") + 1 for d in DEPTHS]) / len(centres)


def unit(vec_col: str) -> Column:
    """The vector scaled to length one; null unless it is finite and not zero."""
    x = F.transform(vec_col, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    fine = F.coalesce((norm > 0) & (norm < float("inf")), F.lit(False))
    return F.when(fine, F.transform(x, lambda v: v / norm))


def train(rows: DataFrame, n: int) -> Model | None:
    """A model for ``n`` rows ``id, x`` of unit vectors, from ``SAMPLE`` of them at most; None for an empty table."""
    few = rows.select("x").orderBy(F.xxhash64("id", "x")).limit(SAMPLE).collect()
    if not few:
        return None
    x = np.array([r["x"] for r in few])
    centres = _means(x, max(1, min(CELLS, n // PER_CELL, len(x) // 8)), 1)
    rest = x - centres[_nearest(x, centres)]
    parts = max(p for p in range(1, PARTS + 1) if x.shape[1] % p == 0)
    cut = rest.reshape(len(x), parts, -1)
    books = [_means(cut[:, p], ENTRIES, p + 2) for p in range(parts)]
    size = max(map(len, books))
    full = np.stack([np.concatenate((b, np.repeat(b[:1], size - len(b), axis=0))) for b in books])
    return Model(centres, full, _shares(x, centres))


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", scope: list[str] | None = None) -> None:
    """Write the index of ``vectors`` to ``path``: ``id, code, x`` and the columns ``scope``, a folder for each cell.

    Rows whose vector is null, zero or holds a null or non-finite component have no place in
    it; nor have those of another length than most.  A hot cell is spread over files.
    """
    spark = vectors.sparkSession
    scope = scope or []
    rows = vectors.select(F.col(id_col).alias("id"), unit(vec_col).alias("x"), *scope).where("x is not null")
    first = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if first is None:
        write_text(spark, f"{path}/model.json", "null")
        return
    rows = rows.where(F.size("x") == first["d"])
    model = train(rows, first["count"])
    write_text(spark, f"{path}/model.json", json.dumps({"centres": model.centres.tolist(), "books": model.books.tolist(), "shares": model.shares.tolist()}))
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                cell, code = shared.value.assign(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=schema.names)

    files = 1 + first["count"] // 1_000_000
    spread = F.pmod(F.xxhash64("id"), F.lit(files))
    placed = rows.mapInArrow(each, schema).repartition("cell", spread).sortWithinPartitions("cell")
    placed.write.partitionBy("cell").parquet(f"{path}/rows")


def load(spark: SparkSession, path: str) -> tuple[Model | None, DataFrame | None]:
    """The model and the rows of an index."""
    held = json.loads(read_text(spark, f"{path}/model.json"))
    if held is None:
        return None, None
    return Model(*(np.array(held[c]) for c in ("centres", "books", "shares"))), spark.read.parquet(f"{path}/rows")


def probes(model: Model, q: np.ndarray, sizes: np.ndarray, share: float, least: int) -> list[np.ndarray]:
    """For each query its nearest cells that hold rows: ``share`` of them, and as many as have ``least`` rows."""
    held = np.flatnonzero(sizes)
    near = held[np.argsort(-(q @ model.centres[held].T), axis=1, kind="stable")]
    most = max(2, int(np.ceil(share * len(held))))
    return [c[: max(most, int(np.searchsorted(np.cumsum(sizes[c]), least)) + 1)] for c in near]


def search(
    spark: SparkSession, path: str, queries: DataFrame, k: int = TOP_K, scope: Column | None = None, share: float | None = None,
) -> DataFrame:
    """``qid, rank, id, score`` of the rows nearest by cosine, found in the probed cells of an index.

    ``scope`` is a condition on the index's columns; it comes first, so cells are probed
    for the rows in it.  ``share`` of the cells are probed, by default what the index has measured.  Queries are a stated set that is broadcast in bounded chunks; a
    query that is null, zero, non-finite or of another length finds nothing.  Scores are
    exact (six decimals, ties by id); which rows are found is approximate.
    """
    kind = queries.schema["qid"].dataType
    model, rows = load(spark, path)
    if model is None:
        return spark.createDataFrame([], T.StructType([T.StructField("qid", kind), T.StructField("rank", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())]))
    inside = rows if scope is None else rows.where(scope)
    sizes = np.zeros(len(model.centres), dtype=np.int64)
    for r in inside.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    if share is None:
        share = model.share(k, sizes.sum() / max(1, rows.count() if scope is not None else sizes.sum()))
    asked = queries.select("qid", unit("v").alias("q")).where(F.col("q").isNotNull() & (F.size("q") == model.centres.shape[1]))
    keep = RESCORED * k
    found, ids, vectors = [], [], []

    def flush() -> None:
        if ids and sizes.any():
            q = np.array(vectors)
            asks = np.zeros((len(model.centres), len(q)), dtype=bool)
            for lo in range(0, len(q), best.QUERIES):
                for i, cells in enumerate(probes(model, q[lo : lo + best.QUERIES], sizes, share, 4 * k)):
                    asks[cells, lo + i] = True
            found.append(_scanned(inside, model, list(ids), q, asks, keep, kind))
        ids.clear()
        vectors.clear()

    for qid, q in asked.toLocalIterator():
        ids.append(qid)
        vectors.append(q)
        if len(ids) * 8 * len(q) >= QUERY_BYTES or len(ids) * keep >= best.HELD:
            flush()
    flush()
    if not found:
        return inside.select(F.lit(None).cast(kind).alias("qid"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    few = top(every, keep).select("qid", "id")
    met = inside.select("id", "x").join(broadcast_if_small(few), "id").join(asked, "qid")
    cosine = F.aggregate(F.zip_with("x", "q", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return top(met.select("qid", "id", F.round(cosine, 6).alias("score")).distinct(), k)


def _scanned(inside: DataFrame, model: Model, ids: list, q: np.ndarray, asks: np.ndarray, keep: int, kind: T.DataType) -> DataFrame:
    """``qid, id, score``: each task's best rows of the probed cells (``asks[cell, query]``) by the codes alone.

    A block of queries meets a block of rows at a time, so tables of products are those of one block.
    """
    shared = inside.sparkSession.sparkContext.broadcast((model, q, asks))
    part = inside.where(F.col("cell").isin(np.flatnonzero(asks.any(axis=1)).tolist())).select("id", "cell", "code")
    schema = T.StructType([T.StructField("at", T.LongType()), part.schema["id"], T.StructField("score", T.DoubleType())])
    id_kind = to_arrow_type(part.schema["id"].dataType)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, q, asks = shared.value
        found = best.Best(keep)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                batch = batch.take(pc.array_sort_indices(batch.column(0), null_placement="at_start"))
                cell = batch.column(1).to_numpy()
                code = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(cell), -1)
                rows_of = [(c, np.flatnonzero(cell == c)) for c in np.unique(cell)]
                for first in range(0, len(q), best.QUERIES):
                    block = q[first : first + best.QUERIES]
                    tables = model.tables(block)
                    score = np.full((len(block), len(cell)), np.nan)
                    for c, own in rows_of:
                        who = np.flatnonzero(asks[c, first : first + best.QUERIES])
                        near = np.repeat((block[who] @ model.centres[c])[:, None], len(own), axis=1)
                        for p in range(code.shape[1]):
                            near += tables[who, p][:, code[own, p]]
                        score[np.ix_(who, own)] = near
                    found.add(first, best.points(score), batch.column(0))
        for at, names, score in found.rows():
            yield pa.RecordBatch.from_arrays([pa.array(at), names.cast(id_kind), pa.array(score)], names=schema.names)

    names = inside.sparkSession.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("at", T.LongType()), T.StructField("qid", kind)]))
    return part.mapInArrow(each, schema).join(F.broadcast(names), "at").select("qid", "id", "score")
