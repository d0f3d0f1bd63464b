"""SimHash clusters over Golay-code keys.

A 64-bit fingerprint is cut in three segments of 22, 21 and 21 bits.  Two fingerprints
that differ in at most three bits have two segments with at most one differing bit each
(were it otherwise, two segments would differ in two bits or more).  Every segment is a
word of the perfect (23, 12) Golay code, whose spheres of radius three tile the space, so
it decodes to one codeword index; the indices that a segment and its one-bit neighbours
decode to are its near indices, six of them or one.  A fingerprint is stored under its own
indices for each pair of segments and looked up under all pairs of near indices, so each
pair within reach meets; the meeting is then verified on all bits.

Crowded buckets are split by exact agreement in further blocks of bits, which loses no pair
(:mod:`granum.llm.buckets`).  Within a task links go through a union-find, so a dense bucket
gives a spanning forest, not all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granum.llm.buckets import Forest, deal, prints_split, starts, whole_cells
from granum.llm.common import components, materialize

# The generator polynomial of the Golay code, and the segments (shift, bits).
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Products up to this are expanded at once; larger buckets go row by row.
SMALL = 4096
#: Seed of the shingle hashes of the plain fingerprint.
SEED = 42
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))


# ---------------------------------------------------------------- fingerprints


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lowered, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], n: int, seed: int = SEED) -> list[int]:
    """XXH64 of each ``n``-word shingle (fewer words: of the whole sequence; none: none)."""
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        return [h(b" ".join(words), seed)]
    flat = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    return [h(flat[a : b - 1], seed) for a, b in zip([0, *ends], ends[n - 1 :])]  # noqa: B905


def majority(hashes: list[int]) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(ones).tobytes(), "big")


def fingerprint(text: str | None, n: int = 3) -> int:
    """SimHash of a text over its ``n``-word shingles, repeats included."""
    return majority(shingle_hashes(words_of(text), n))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---------------------------------------------------------------- Golay keys


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word, and the error of each syndrome."""

    def remainder(w: int) -> int:
        for bit in range(22, 10, -1):
            if w >> bit & 1:
                w ^= GENERATOR << (bit - 11)
        return w

    low = np.array([remainder(w) for w in range(1 << 12)], dtype=np.uint32)
    high = np.array([remainder(w << 12) for w in range(1 << 11)], dtype=np.uint32)
    error = np.zeros(1 << 11, dtype=np.uint32)
    for k in range(4):
        for bits in itertools.combinations(range(23), k):
            e = sum(1 << b for b in bits)
            error[remainder(e)] = e
    return low, high, error


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    low, high, error = _golay()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def near_indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Own index of each segment, and its distinct near indices padded with -1, own first."""
    own = codeword_index(words).astype(np.int64)
    flips = codeword_index(words[:, None] ^ (np.uint32(1) << np.arange(bits, dtype=np.uint32))[None, :]).astype(np.int64)
    flips = np.sort(np.where(flips == own[:, None], -1, flips), axis=1)
    flips[:, 1:][flips[:, 1:] == flips[:, :-1]] = -1
    flips = -np.sort(-flips, axis=1)
    width = int((flips >= 0).sum(axis=1).max(initial=0))
    return own, np.concatenate((own[:, None], flips[:, :width]), axis=1)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Storage and look-up keys: ``(row, key)`` of each kind, for unsigned fingerprints."""
    near = [near_indices((prints >> np.uint64(s) & np.uint64((1 << b) - 1)).astype(np.uint32), b) for s, b in SEGMENTS]
    rows = np.arange(len(prints))
    store, look_rows, look = [], [], []
    for p, (i, j) in enumerate(PAIRS):
        store.append(p << 24 | near[i][0] << 12 | near[j][0])
        a, b = near[i][1][:, :, None], near[j][1][:, None, :]
        real = (a >= 0) & (b >= 0)
        look.append((p << 24 | (a << 12) | b)[real])
        look_rows.append(np.nonzero(real)[0])
    return np.tile(rows, len(PAIRS)), np.concatenate(store), np.concatenate(look_rows), np.concatenate(look)


def golay_entries(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and side (look-up or not) of every entry of unsigned fingerprints."""
    sr, sk, lr, lk = keys(prints)
    return np.concatenate((sr, lr)), np.concatenate((sk, lk)), np.repeat([False, True], [len(sr), len(lr)])


# ---------------------------------------------------------------- linking


def _meet(prints: np.ndarray, ids: np.ndarray, look: np.ndarray, first: np.ndarray, last: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows (stored, looked up) of sorted rows of whole cells."""

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(prints[a] ^ prints[b]) <= reach) & (ids[a] != ids[b])

    stored = np.add.reduceat((~look).astype(np.int64), first)
    asked = last - first - stored
    small = (stored > 0) & (asked > 0) & (stored * asked <= SMALL)
    f, s, n = first[small], stored[small], asked[small]
    for lo in range(0, len(f), 2048):
        ff, ss, nn = f[lo : lo + 2048], s[lo : lo + 2048], n[lo : lo + 2048]
        size = ss * nn
        group = np.repeat(np.arange(len(ff)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        a = ff[group] + at % ss[group]
        b = ff[group] + ss[group] + at // ss[group]
        ok = near(a, b)
        yield a[ok], b[ok]
    for g in np.flatnonzero(stored * asked > SMALL):
        middle = first[g] + stored[g]
        asked_rows = np.arange(middle, last[g])
        for a in range(first[g], middle):
            hits = asked_rows[near(np.array([a]), asked_rows)]
            yield np.full(len(hits), a), hits


def link(prints: DataFrame, reach: int) -> DataFrame:
    """Edges ``a, b`` between ids whose fingerprints differ in at most ``reach`` bits.

    ``prints`` has ``id`` and ``print``.  Each task returns a spanning forest of what it
    linked, which has the same components.
    """

    def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return golay_entries(batch.column("print").to_numpy().view(np.uint64))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()
        for t in whole_cells(batches):
            ids = t["id"].to_numpy()
            for a, b in _meet(t["print"].to_numpy().view(np.uint64), ids, t["look"].to_numpy(), *starts(t), reach):
                if len(a):
                    pairs = np.stack((ids[a], ids[b]))
                    for x, y in np.unique(pairs, axis=1).T.tolist() if len(a) > 1 else pairs.T.tolist():
                        trees.join(x, y)
        a, b = trees.edges()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return deal(prints, entries, ["id", "print"], prints_split("print")).mapInArrow(each, "a long, b long")


# ---------------------------------------------------------------- the operator


def clusters(docs: DataFrame, n: int = 3, reach: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id`` of every row of ``docs``.

    ``fingerprint`` is the SimHash over ``n``-word shingles as 16 hex digits; rows whose
    fingerprints differ in at most ``reach`` (3 at most) bits are linked, and
    ``component_id`` is the smallest non-null id reachable (null if there is none).  Null,
    empty and wordless texts have fingerprint zero and are linked like any other; repeated
    rows come back as often as they are there.  Equal fingerprints are one node, so
    copies never meet pairwise.
    """
    if not 0 <= reach <= 3:
        raise ValueError("Golay keys reach three bits")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [signed(fingerprint(t.as_py(), n)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["id", "print"])

    kind = src.schema["id"].dataType.simpleString()
    found = materialize(src.mapInArrow(prints, f"id {kind}, print long"), "prints")
    nodes = found.groupBy("print").agg(F.min("id").alias("low"))
    nodes = materialize(nodes, "nodes")
    roots = components(link(nodes.select(F.col("print").alias("id"), "print"), reach))
    rooted = nodes.join(roots, F.col("print") == F.col("node"), "left").select("print", "low", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("print", "component_id")
    return found.join(named, "print").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def report(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, fingerprint, component_id``."""
    return clusters(docs.select("doc_id", "text"))
