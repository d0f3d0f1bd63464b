"""Product codes of vectors: integer codebooks by rounds of assignment and averaging.

Vectors become integers and are cut in equal parts; each part has a codebook of its own.
A round broadcasts the codebooks (a few thousand integers), and each task finds the nearest
entry of every part from norms and exact integer matrix products, keeping only sums and
counts by entry.  A grouped shuffle adds those up, and the driver divides a hundred
or so rows.  Vectors are written once as integers and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granum.llm.common import materialize
from granum.llm.vectors import integers, matrix, usual_length

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are held to 61 bits.
LIMIT = 1 << 61
#: Labels whose sums are broadcast; beyond, rows meet them under so many salts.
LABELS, SALTS = 1_000_000, 64


def prepared(embeddings: DataFrame, parts: int, scale: int, id_col: str, vec_col: str, label_col: str | None) -> tuple[DataFrame, int]:
    """The kept rows ``id, label, x`` as a written table, and the width of a part.

    Kept are vectors of finite components and of the table's usual length; a length that
    ``parts`` does not divide is filled up with zeros, which no distance notices.
    """
    label = F.lit(None).cast("int") if label_col is None else F.col(f"`{label_col}`")
    rows = embeddings.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), integers(F.col(f"`{vec_col}`"), scale, LIMIT).alias("x"))
    rows = materialize(rows.where("x is not null"), "vectors")
    d = usual_length(rows) or 0
    width = -(-d // parts)
    fill = F.array_repeat(F.lit(0).cast("bigint"), width * parts - d)
    return rows.where(F.size("x") == d).withColumn("x", F.concat("x", fill)), width


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are if sums of squared differences over a row fit 64 bits, else of Python integers."""
    top = max(max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) for a in arrays)
    d = arrays[0].shape[1] * arrays[0].shape[2]
    return list(arrays) if 4 * d * top * top < 1 << 62 else [a.astype(object) for a in arrays]


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows ``x[row, part, :]``: the first nearest entry of each part's codebook, and the row's squared distance (held to 64 bits)."""
    x, books = _exact(x, books)
    entry, far = np.zeros(x.shape[:2], dtype=np.int64), np.zeros(len(x), dtype=x.dtype)
    for p, book in enumerate(books):
        own = x[:, p]
        gap = (book * book).sum(axis=1) - 2 * (own @ book.T)
        entry[:, p] = gap.argmin(axis=1)
        far += gap.min(axis=1) + (own * own).sum(axis=1)
    return entry, np.minimum(far, (1 << 63) - 1).astype(np.int64)


def first_books(rows: DataFrame, parts: int, width: int, entries: int) -> np.ndarray:
    """The parts of the rows of smallest id (null ids last, ties by vector) as codebooks ``[part, entry, position]``."""
    few = rows.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()
    return np.array([r["x"] for r in few], dtype=np.int64).reshape(len(few), parts, width).swapaxes(0, 1)


def next_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: the floored mean of each entry's parts; an unused entry stays."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)
    sums = [f"s{i}" for i in range(width)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        count, total = np.zeros((parts, entries), dtype=np.int64), np.full((parts, entries, width), 0, dtype=object)
        for batch in batches:
            x = matrix(batch.column(0), parts * width).reshape(batch.num_rows, parts, width)
            entry = nearest(x, held)[0]
            for p in range(parts):
                chosen = (entry[:, p, None] == np.arange(entries)).astype(np.int64)
                count[p] += chosen.sum(axis=0)
                total[p] += sum(((chosen.T @ half).astype(object) << by for half, by in ((x[:, p] >> 32, 32), (x[:, p] & 0xFFFFFFFF, 0))))
        p, e = np.nonzero(count)
        columns = [pa.array([Decimal(v) for v in total[p, e, i]], pa.decimal128(38)) for i in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), *columns], names=["p", "e", "n", *sums])

    found = rows.select("x").mapInArrow(each, "p long, e long, n long" + "".join(f", {s} decimal(38,0)" for s in sums))
    merged = found.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect()
    shared.destroy()
    out = books.copy()
    for r in merged:
        out[r["p"], r["e"]] = [int(r[s]) // r["n"] for s in sums]
    return out


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, code, error`` of each row: its entries in part order, two hex digits each, and its squared distance."""
    parts, _, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, far = nearest(matrix(batch.column(2), parts * width).reshape(batch.num_rows, parts, width), shared.value)
            code = [r.tobytes().hex() for r in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(far)], names=["id", "label", "code", "error"])

    return rows.select("id", "label", "x").mapInArrow(each, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def fit(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``[part, entry, position]`` of prepared rows, which must not be empty."""
    books = first_books(rows, parts, width, entries)
    for _ in range(rounds):
        books = next_books(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, as integers (with the zeros a last part was filled with)."""
    return np.concatenate([book[e] for book, e in zip(books, bytes.fromhex(code), strict=True)])


def compress(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
) -> DataFrame:
    """``<id_col>, code, error, label_error, codebooks_sha256`` of every row whose vector can be coded.

    Components become ``floor(scale * x)``, held to 61 bits.  Vectors that are null, hold a
    null or non-finite component, or have another length than most do not take part; an
    empty vector has the code of zeros.  Each codebook starts with the parts of the
    ``entries`` smallest ids (null ids last; fewer rows, fewer entries) and takes ``rounds``
    rounds; ties go to the lower entry; errors are held to 64 bits.  Repeated rows and ids count and come back each.
    ``label_error`` adds up the errors of equal labels (null is a label; held to 64 bits).
    An empty table gives an empty result; other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry is two hex digits")
    rows, width = prepared(embeddings, parts, scale, id_col, vec_col, label_col)
    if rows.isEmpty():
        books, coded = np.zeros((parts, 0, 0), dtype=np.int64), rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    else:
        books = fit(rows, width, parts, entries, rounds)
        coded = materialize(encoded(rows, books), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1)).cast("bigint").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.limit(LABELS + 1).count() <= LABELS:
        out = coded.join(F.broadcast(sums), same)
    else:  # a hot label is dealt out under salts
        copies = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = coded.withColumn("own", F.pmod(F.xxhash64("id", "code", "error"), F.lit(SALTS)).cast("int")).join(copies, same & (F.col("own") == F.col("salt")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def report(embeddings: DataFrame) -> DataFrame:
    """Per kept vector: ``vec_id, code, error, label_error, codebooks_sha256``."""
    return compress(embeddings)
