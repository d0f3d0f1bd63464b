"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Vectors are quantised to integers.  Candidates stay where they are: each task packs its rows
in blocks and lays a block out as postings ``(row, component)``, sorted by descending
quantised impact (the magnitude of the component), then dimension.  Queries come by broadcast
in chunks of bounded size.  For a group of queries the posting segments of one impact are
added to the rows' accumulators; what a row can still gain or lose is bounded by the norm of
its postings not yet taken.  Rows that provably stay below the ``k`` best, of this block or
of those before in the task, take no part in later segments.  Scoring stops when few rows
are possible members, or at the last segment; those are rescored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granum.llm.common import materialize

#: Rows of a candidate block, and queries scored together.
BLOCK, GROUP = 8192, 64
#: Impacts that components are quantised to.
IMPACTS = 8
#: Scoring stops when at most this share of rows and queries may still be members.
POSSIBLE = 0.02
#: Bytes of queries that one broadcast may hold.
BROADCAST_BYTES = 32 << 20


def quantised(embedding: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component as a long (the nearest one beyond 64 bits); null unless all are finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    finite = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return F.when(finite, F.transform(x, lambda v: F.floor(v * scale)))


class ImpactIndex:
    """The postings of one block of rows, in segments of equal quantised impact.

    Impacts are the magnitudes cut at even shares of the postings, so segments are alike in
    size; zeros have no posting.  ``rest[l]`` is each row's norm over the postings after
    impact ``l``, which bounds by Cauchy-Schwarz what the row can still gain or lose.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        n, d = rows.shape
        size = np.abs(rows.astype(np.float64))
        self.top = float(size.max(initial=0))
        row, dim = np.nonzero(rows)
        held = size[row, dim]
        cuts = np.quantile(held, np.arange(IMPACTS - 1, 0, -1) / IMPACTS) if len(held) else np.zeros(IMPACTS - 1)
        impact = np.searchsorted(-cuts, -held, side="left") if len(held) else np.zeros(0, dtype=np.int64)
        order = np.lexsort((row, dim, impact))
        self.row, self.value = row[order], rows[row[order], dim[order]]
        self.starts = np.searchsorted(impact[order] * d + dim[order], np.arange(IMPACTS * d + 1))
        energy = np.zeros((IMPACTS + 1, n))
        np.add.at(energy, (impact, row), held * held)
        self.rest = np.sqrt(np.maximum(energy.sum(axis=0) - np.cumsum(energy[:IMPACTS], axis=0), 0)) * (1 + 1e-9)
        self.rest[-1] = 0
        self.taken = self.total = 0

    def members(self, queries: np.ndarray, barred: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and queries of all pairs that may be among a query's ``k`` best.

        ``barred`` pairs are none; ``bar`` is a score that each query has ``k`` rows at or above.
        """
        n, d = self.rows.shape
        bound = float(np.abs(queries.astype(np.float64)).sum(axis=1).max(initial=0)) * max(1.0, self.top)
        if bound >= 1 << 53:  # floating sums prove nothing about wider integers
            return np.nonzero(~barred)
        kind = np.float32 if bound < 1 << 24 else np.float64
        asked = np.ascontiguousarray(queries.T.astype(kind))
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        acc, member, live = np.zeros((n, len(queries)), dtype=kind), ~barred, np.ones(n, dtype=bool)
        self.total += len(self.row) * len(queries)
        for level in range(IMPACTS):
            for at in range(level * d, (level + 1) * d):
                lo, hi = self.starts[at], self.starts[at + 1]
                if lo < hi:
                    row, value = self.row[lo:hi], self.value[lo:hi].astype(kind)
                    if level and not live.all():
                        keep = live[row]
                        row, value = row[keep], value[keep]
                    acc[row] += value[:, None] * asked[at - level * d]
                    self.taken += len(row) * len(queries)
            if level < IMPACTS // 4:
                continue
            slack = np.ceil(np.outer(self.rest[level], norms))
            low = bar
            if n > k and not np.isfinite(bar).all():
                sure = np.where(member, acc - slack, -np.inf)
                low = np.maximum(bar, np.partition(sure, n - k, axis=0)[n - k])
            member &= acc + slack >= low
            live = member.any(axis=1)
            if member.sum() <= POSSIBLE * member.size:
                break
        return np.nonzero(member)


def exact_scores(rows: np.ndarray, queries: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs ``rows[i]``, ``queries[j]``, held to the range of a long."""
    bound = float(np.abs(queries.astype(np.float64)).sum(axis=1).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0))
    if bound < 1 << 62:
        parts = [np.einsum("pd,pd->p", rows[i[lo : lo + 65536]], queries[j[lo : lo + 65536]]) for lo in range(0, len(i), 65536)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    limit = (1 << 63) - 1
    return np.array([max(-limit - 1, min(limit, sum(int(x) * int(y) for x, y in zip(rows[a], queries[b], strict=True)))) for a, b in zip(i, j, strict=True)], dtype=np.int64)


class Best:
    """The running ``k`` best ``(score, id)`` of some queries of one length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.found = np.zeros((3, 0), dtype=np.int64)  # query number, score, id
        self.bar = np.full(len(ids), -np.inf)

    def meet(self, index: ImpactIndex) -> None:
        """Take in a block of rows."""
        new = [self.found]
        for lo in range(0, len(self.ids), GROUP):
            own, q = self.ids[lo : lo + GROUP], self.queries[lo : lo + GROUP]
            i, j = index.members(q, index.ids[:, None] == own[None, :], self.bar[lo : lo + GROUP], self.k)
            score = exact_scores(index.rows, q, i, j)
            ok = score >= self.bar[lo + j]
            new.append(np.stack((lo + j[ok], score[ok], index.ids[i[ok]])))
        every = np.concatenate(new, axis=1)
        every = every[:, np.lexsort((every[2], -every[1].astype(object) if (every[1] == -(1 << 63)).any() else -every[1], every[0]))]
        first = np.searchsorted(every[0], np.arange(len(self.ids) + 1))
        place = np.arange(every.shape[1]) - first[every[0]]
        self.found = every[:, place < self.k]
        last = self.found[:, place[place < self.k] == self.k - 1]
        bar = last[1].astype(np.float64)
        self.bar[last[0]] = np.where(np.abs(bar) < 1 << 53, bar, np.nextafter(bar, -np.inf))


def _chunks(vectors: DataFrame, limit: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The vectors ``id, v`` as arrays by length, in chunks of at most ``limit`` bytes, one at a time."""
    held: dict[int, tuple[list, list]] = {}
    size = 0
    for i, v in vectors.toLocalIterator():
        ids, rows = held.setdefault(len(v), ([], []))
        ids.append(i)
        rows.append(np.array(v, dtype=np.int64))
        size += 8 * (len(v) + 1)
        if size >= limit:
            yield {d: (np.array(a), np.array(b, dtype=np.int64).reshape(len(a), d)) for d, (a, b) in held.items()}
            held, size = {}, 0
    if held:
        yield {d: (np.array(a), np.array(b, dtype=np.int64).reshape(len(a), d)) for d, (a, b) in held.items()}


def _searched(candidates: DataFrame, chunk: dict[int, tuple[np.ndarray, np.ndarray]], k: int, block: int) -> DataFrame:
    """``query_id, id, score``: each task's ``k`` best rows of each query of a chunk."""
    shared = candidates.sparkSession.sparkContext.broadcast(chunk)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "id", "score")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(ids, rows, k) for d, (ids, rows) in shared.value.items()}
        held: dict[int, tuple[list, list]] = {d: ([], []) for d in best}

        def flush(d: int) -> None:
            ids, rows = held[d]
            if ids:
                best[d].meet(ImpactIndex(np.concatenate(ids), np.concatenate(rows)))
            held[d] = ([], [])

        for batch in batches:
            ids, v = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.values.to_numpy()[v.offsets[0].as_py() : v.offsets[-1].as_py()]
            first = np.cumsum(sizes) - sizes
            for d in np.unique(sizes):
                if int(d) not in best:
                    continue
                own = np.flatnonzero(sizes == d)
                for lo in range(0, len(own), block):
                    some = own[lo : lo + block]
                    held[int(d)][0].append(ids[some])
                    held[int(d)][1].append(flat[first[some][:, None] + np.arange(d)])
                    if sum(map(len, held[int(d)][0])) >= block:
                        flush(int(d))
        for d in best:
            flush(d)
            q, score, i = best[d].found
            yield pa.RecordBatch.from_arrays([pa.array(best[d].ids[q], pa.int64()), pa.array(i, pa.int64()), pa.array(score, pa.int64())], names=schema.names)

    return candidates.mapInArrow(search, schema)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
    block: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the ``k`` best other rows of each query row.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component,
    take no part; an empty vector scores 0 with other empty ones; vectors of different
    lengths never meet.  Repeated ids are all candidates, except those equal to the query's
    own id; repeated query ids are one query with the best of their results.  Scores beyond
    64 bits are held at the range's end.  An empty table gives an empty result; other
    columns are ignored.  Each chunk of queries is one map-only pass over the candidates,
    which are never shuffled; only each task's ``k`` best rows of a query are.
    """
    clean = vectors.select(F.col(id_col).cast("bigint").alias("id"), quantised(F.col(vec_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    candidates = clean.select("id", "v")
    chunks = _chunks(clean.where("q").select("id", "v"), broadcast_bytes)
    chunk, more = next(chunks, {}), next(chunks, None)
    best = _searched(candidates, chunk, k, block)
    if more is not None:
        parts = [materialize(_ranked(best, k), "topk")]
        while more is not None:
            parts.append(materialize(_ranked(_searched(candidates, more, k, block), k), "topk"))
            more = next(chunks, None)
        best = parts[0]
        for p in parts[1:]:
            best = best.unionByName(p)
        best = best.select("query_id", "id", "score")
    return _ranked(best, k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def report(embeddings: DataFrame) -> DataFrame:
    """The five best other vectors of every row whose ``vec_id`` is divisible by 50."""
    return top_k(embeddings, F.col("vec_id") % 50 == 0)
