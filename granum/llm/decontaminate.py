"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are the maximal runs of ASCII digits, ASCII letters (A-Z lowered) and all
non-ASCII characters.  Every window of ``n`` consecutive words of a test item is a
test n-gram; an item of fewer words is one window.  A map-only pass hashes the word
windows of each document with a polynomial over word numbers, looks the hashes up in
the broadcast set, verifies each hit word by word, and marks the words inside.

What is broadcast is a part of the test set of at most ``BROADCAST_BYTES`` of text.  A
set of one part is one map-only pass.  Larger sets are scanned part after part: the driver
holds one part at a time, each pass writes only the documents it hit, and the hits are
merged by document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from granum.llm.common import bitmap, bitmap_has, discard, free_name, materialize

#: Largest test set, in UTF-8 bytes, that one broadcast may hold (about five times as many
#: bytes when packed); larger sets are cut in parts.
BROADCAST_BYTES = 8 << 20
#: ASCII upper case to lower, all other ASCII but digits and letters to a space.
WORD_TABLE = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


class WindowSet:
    """The distinct windows of some runs of test words, by length, with the items that hold each.

    ``pieces`` are ``(item id, words, window length)``.  Words are kept once as one array of
    word numbers; a window is a place in it, and windows are sorted by hash.
    """

    def __init__(self, pieces: Iterable[tuple[object, list[bytes], int]]) -> None:
        self.vocab: dict[bytes, int] = {}
        number: dict[object, int] = {}
        flat: list[int] = []
        places: dict[int, list[tuple[int, int, int]]] = {}
        for item, held, k in pieces:
            if k:
                places.setdefault(k, []).append((len(flat), len(held) - k + 1, number.setdefault(item, len(number))))
                flat += [self.vocab.setdefault(x, len(self.vocab) + 1) for x in held]
        self.items = list(number)
        self.flat = np.array(flat, dtype=np.uint32)
        self.index = {k: self._windows(k, np.array(p, dtype=np.int64)) for k, p in places.items()}

    def _windows(self, k: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash and place of each distinct window, and its items as offsets into a list."""
        first, n, item = places.T
        at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(item, n).astype(np.int32)
        h = self._hash([self.flat[at + j] for j in range(k)])
        order = np.lexsort((owner, h))
        if not self._same_words(at[order], h[order], k).all():  # different windows of one hash
            order = np.lexsort((owner, *[self.flat[at + j] for j in range(k)], h))
        at, owner, h = at[order], owner[order], h[order]
        new = ~self._same_words(at, h, k)
        lead = np.flatnonzero(new)
        once = new | np.concatenate(([True], owner[1:] != owner[:-1]))
        offsets = np.concatenate((np.cumsum(once)[lead] - 1, [once.sum()]))
        return h[lead], at[lead].astype(np.int32), offsets.astype(np.int32), owner[once]

    def _same_words(self, at: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
        """Whether each window is the one before it; raises no claim where hashes differ."""
        same = np.concatenate(([False], h[1:] == h[:-1]))
        for j in range(k):
            same[1:] &= self.flat[at[1:] + j] == self.flat[at[:-1] + j]
        return same

    @staticmethod
    def _hash(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            h = (h ^ c) * _MULT
            h ^= h >> np.uint64(29)
        return h

    def scan(self, doc: list[bytes]) -> tuple[np.ndarray, list]:
        """For each word whether an occurrence of a window covers it, and the ids of the items hit."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in doc), dtype=np.uint32, count=len(doc))
        hit, owners = np.zeros(len(doc) + 1, dtype=np.int64), set()
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for k, (hashes, places, offsets, items) in self.index.items():
            m = len(doc) - k + 1
            if m <= 0:
                continue
            at = np.nonzero(known[k:] - known[:m] == k)[0]
            if not len(at):
                continue
            h = self._hash([ids[at + j] for j in range(k)])
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            while True:
                live = lo < hi
                if not live.any():
                    break
                at, lo, hi = at[live], lo[live], hi[live]
                same = np.ones(len(at), dtype=bool)
                for j in range(k):
                    same &= self.flat[places[lo] + j] == ids[at + j]
                for i in np.unique(lo[same]):
                    owners.update(items[offsets[i] : offsets[i + 1]].tolist())
                np.add.at(hit, at[same], 1)
                np.add.at(hit, at[same] + k, -1)
                lo = lo + 1
        return np.cumsum(hit[:-1]) > 0, sorted_ids(self.items[i] for i in owners)


def sorted_ids(ids: Iterable) -> list:
    """Distinct ids in order, null last."""
    return sorted(set(ids), key=lambda x: (x is None, 0 if x is None else x))


def test_parts(benchmark: DataFrame, n: int, id_col: str, text_col: str, limit: int = BROADCAST_BYTES) -> Iterator[WindowSet]:
    """The test items as window sets of at most ``limit`` text bytes each, one after the other.

    Rows come to the driver partition by partition.  A longer item is cut in pieces that
    share ``n - 1`` words, so each of its windows is whole in one of them.
    """
    held, size = [], 0
    for item, text in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        w = words(text)
        k = min(n, len(w))
        step = len(w) or 1
        if len(text) > limit:
            step = max(1, limit // (1 + len(text) // len(w))) if w else 1
        for lo in range(0, len(w) - k + 1 if w else 0, step):
            piece = w[lo : lo + step + k - 1]
            grown = sum(map(len, piece)) + len(piece)
            if held and size + grown > limit:
                yield WindowSet(held)
                held, size = [], 0
            held.append((item, piece, k))
            size += grown
    if held:
        yield WindowSet(held)


def spans_of(cover: np.ndarray) -> list[list[int]]:
    """``[first, end)`` of each run of covered words."""
    return np.flatnonzero(np.diff(np.concatenate(([0], cover.view(np.int8), [0])))).reshape(-1, 2).tolist()


def merged_spans(spans: list[list[int]]) -> list[list[int]]:
    """The union of ``[first, end)`` pairs as ordered pairs that do not touch."""
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


_SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))


def _scanned(src: DataFrame, part: WindowSet, text_col: str, item_type: T.DataType, hits_only: bool) -> DataFrame:
    """``src`` with ``n_words, n_hit, item_ids, hit_spans`` against one part; ``hits_only`` drops the rest."""
    names = ("n_words", "n_hit", "item_ids", "hit_spans")
    kinds = (T.LongType(), T.LongType(), T.ArrayType(item_type), _SPANS)
    keep = [c for c in src.columns if not (hits_only and c == text_col)]
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(a, b) for a, b in zip(names, kinds, strict=True)])
    shared, ids = src.sparkSession.sparkContext.broadcast(part), pa.list_(to_arrow_type(item_type))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            rows, some = [], []
            for text in batch.column(batch.schema.get_field_index(text_col)):
                w = words(text.as_py())
                cover, items = held.scan(w)
                rows.append((len(w), int(cover.sum()), items, spans_of(cover)))
                some.append(not hits_only or bool(items))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            extra = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), ids, pa.list_(pa.list_(pa.int32()))), strict=True)]
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *extra], names=[*keep, *names])
            yield out.filter(pa.array(some, pa.bool_())) if hits_only else out

    return src.mapInArrow(scan, schema)


def overlap(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, item_ids, hit_spans`` of each text against the test items.

    ``hit_spans`` are ``[first word, end word)`` pairs of covered runs.  Null and
    wordless texts get zeros and empty lists; items with a null or wordless text are
    ignored, those of null id mark words and are listed as one null; repeated items and
    documents are each treated alone; an empty table on either side is no error.  Ids may
    be of any orderable type.  Columns of ``docs`` with these names are replaced.
    """
    item_type = benchmark.schema[item_id_col].dataType
    names = ("n_words", "n_hit", "item_ids", "hit_spans")
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    parts = test_parts(benchmark, n, item_id_col, item_text_col, broadcast_bytes)
    part, more = next(parts, WindowSet([])), next(parts, None)
    if more is None:
        return _scanned(src, part, text_col, item_type, False)

    k1, k2, g1, g2 = (free_name(src, x) for x in ("text_key", "text_key2", "hit_key", "hit_key2"))
    keyed = src.withColumn(k1, F.xxhash64(text_col)).withColumn(k2, F.xxhash64(F.lit(7), text_col))
    texts = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(text_col).alias("text"))
    hits = []
    while part is not None:
        found = _scanned(texts, part, "text", item_type, True)
        hits.append(materialize(found.dropDuplicates(["k1", "k2"]), "hits"))
        part, more = more, next(parts, None)
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    gathered = every.groupBy(F.col("k1").alias(g1), F.col("k2").alias(g2)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"))
    union = F.udf(merged_spans, _SPANS, useArrow=True)
    gathered = materialize(gathered.withColumn("hit_spans", union("hit_spans")), "hits")
    for h in hits:
        discard(h)
    n_words = F.udf(lambda t: len(words(t)), T.LongType(), useArrow=True)
    some = bitmap_has(bitmap(gathered, g1), F.col(k1))
    columns = [F.col(f"`{c}`") for c in src.columns]
    none = [F.lit(0).cast("bigint").alias("n_hit"), F.array().cast(T.ArrayType(item_type)).alias("item_ids"), F.array().cast(_SPANS).alias("hit_spans")]
    clear = keyed.where(~some).select(*columns, n_words(text_col).alias("n_words"), *none)
    joined = keyed.where(some).join(gathered, (F.col(k1) == F.col(g1)) & (F.col(k2) == F.col(g2)), "left")
    size = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda s, x: s + F.get(x, F.lit(1)) - F.get(x, F.lit(0)))
    hit = joined.select(*columns, n_words(text_col).alias("n_words"), F.coalesce(size, F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("item_ids", none[1]).alias("item_ids"), F.coalesce("hit_spans", none[2]).alias("hit_spans"))
    return clear.unionByName(hit)


def removed_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """``text`` without the bytes from the first to the last word of each span."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(WORD_TABLE), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0]))))
    starts, ends, out, done = edge[::2], edge[1::2], [], 0
    for first, end in spans:
        out.append(raw[done : starts[first]])
        done = ends[end - 1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", drop_share: float = 0.5,
    item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with test passages cut out, and without documents mostly made of them.

    A document with a share of covered words above ``drop_share`` is removed; any other
    loses exactly its covered spans.  Untouched documents, null texts included, come
    back unchanged.  The columns stay those of ``docs``; repeated rows fare alike.
    """
    parts = test_parts(benchmark, n, item_id_col, item_text_col, broadcast_bytes)
    part, more = next(parts, WindowSet([])), next(parts, None)
    if more is not None:
        at = [free_name(docs, c) for c in ("own_words", "own_hit", "own_items", "own_spans")]
        held = docs.withColumnsRenamed({c: f"{c}__" for c in docs.columns})  # the added names may be among them
        found = overlap(held, benchmark, n, f"{text_col}__", item_id_col, item_text_col, broadcast_bytes)
        src = found.toDF(*docs.columns, *at)
        shared = None
    else:
        src, shared = docs, docs.sparkSession.sparkContext.broadcast(part)
    column = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(docs_columns)
        for batch in batches:
            texts, stay = [], []
            for i, value in enumerate(batch.column(column)):
                text = value.as_py()
                if shared is not None:
                    w = words(text)
                    spans, size = spans_of(shared.value.scan(w)[0]), len(w)
                else:
                    spans, size = batch.column(width + 3)[i].as_py(), batch.column(width)[i].as_py()
                hit = sum(end - first for first, end in spans)
                stay.append(hit <= drop_share * size)
                texts.append(removed_spans(text, spans) if hit else text)
            columns = [pa.array(texts, pa.string()) if i == column else batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns).filter(pa.array(stay, pa.bool_()))

    docs_columns = docs.columns
    return src.mapInArrow(clean, docs.schema)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    marked = overlap(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), n)
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
