"""Rows dealt out to the buckets of their keys; crowded buckets are split by further keys.

A bucket of more than ``CELL`` rows is never gathered.  Each of its rows goes to a few
narrower buckets instead, one for each further key that a caller gives: pairs that matter
agree in one of them.  What is still crowded is split again, as deep as the caller's keys go.
A row is written once for each narrow bucket, a number that does not depend on how many
rows the bucket has, so written rows stay linear in a bucket and no cell outgrows ``CELL``.

Beyond the last key, a bucket is dealt to parts by chance.  If all but ``CELL`` of its rows
bear one label, the others go to every part, so each meets each row of another label; else
``ANCHORS`` rows go to every part, and two rows meet in it or through those.

Which buckets are crowded is found before rows are dealt: counts over a fixed table of slots
tell where a crowded bucket can be, and only keys in those slots are counted one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of the table of slot counts, and rows that a cell may hold.
SLOTS, CELL = 1 << 16, 4096
#: Rows of a crowd that meet all others of it, where it has many labels.
ANCHORS = 64
#: Rows whose keys are made at once, and most crowded buckets a level that are known by name (24 bytes each).
STEP, MOST = 512, 1 << 22

#: From a batch to the row number and key of each entry, and whether it looks up (None: rows meet among themselves).
Keys = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


@dataclass(frozen=True)
class Split:
    """Further keys: ``into(batch, row, key, path, level)`` gives ``(values, paths)``, a row of each for each entry; ``levels`` deep.

    ``path`` is 0 at first and then what ``into`` gave with the key, to tell which keys an entry has gone through.
    """

    into: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]
    levels: int


def mix(*values: np.ndarray) -> np.ndarray:
    """One 64-bit hash of arrays of 64-bit integers."""
    h = np.uint64(0x243F6A8885A308D3)
    for v in values:
        h = (h ^ v.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ h >> np.uint64(32)
    return h.view(np.int64)


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, STEP):
            yield whole.slice(start, STEP)


@dataclass(frozen=True)
class Crowds:
    """The crowded keys of one level, ascending: their rows, their most frequent label and how many rows bear others."""

    key: np.ndarray
    n: np.ndarray
    label: np.ndarray
    others: np.ndarray

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are crowded, and where each stands."""
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.key[at] == key, at


Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _entries(batch: pa.RecordBatch, keys: Keys, split: Split | None, crowds: list[Crowds]) -> Entries:
    """Row, key, side and path of each entry, crowded keys replaced by narrower ones."""
    row, key, look = keys(batch)
    key, look, path = key.astype(np.int64), np.zeros(len(row), dtype=bool) if look is None else look, np.zeros(len(row), dtype=np.int64)
    alone = _column(batch, "label") is not None
    for level in range(min(len(crowds), split.levels if split else 0)):
        hot, at = crowds[level].find(key)
        if not hot.any():
            continue
        cold, met = ~hot, hot & ~(alone & (crowds[level].others[at] == 0))  # rows of one label have nothing to find
        values, paths = split.into(batch, row[met], key[met], path[met], level)
        fan = values.shape[1]
        more = mix(np.repeat(key[met], fan), paths.ravel(), values.ravel())
        row, look = np.concatenate((row[cold], np.repeat(row[met], fan))), np.concatenate((look[cold], np.repeat(look[met], fan)))
        key, path = np.concatenate((key[cold], more)), np.concatenate((path[cold], paths.ravel()))
    return row, key, look, path


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray | None:
    i = batch.schema.get_field_index(name)
    return None if i < 0 else batch.column(i).to_numpy()


def _crowds(src: DataFrame, keys: Keys, split: Split | None, found: list[Crowds]) -> Crowds | None:
    """The crowded keys that entries have after ``found``; None if there are none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        for batch in _steps(batches):
            counts += np.bincount(_slot(_entries(batch, keys, split, found)[1]), minlength=SLOTS)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], names=["slot", "n"])

    slots = src.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    full = np.zeros(SLOTS, dtype=bool)
    full[[r["slot"] for r in slots.where(F.col("n") > CELL).collect()]] = True
    if not full.any():
        return None

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            row, key, _, _ = _entries(batch, keys, split, found)
            here = full[_slot(key)]
            label = _column(batch, "label")
            pair = np.stack((key[here], np.zeros(here.sum(), dtype=np.int64) if label is None else label[row[here]]))
            pair, n = np.unique(pair, axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(n)], names=["key", "label", "n"])

    every = src.mapInArrow(named, "key long, label long, n long").groupBy("key", "label").agg(F.sum("n").alias("n"))
    best = every.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("label"), F.max("n").alias("own"))
    rows = best.where(F.col("n") > CELL).orderBy(F.desc("n"), "key").limit(MOST).collect()
    if not rows:
        return None
    table = np.array(sorted((r["key"], r["n"], r["label"], r["n"] - r["own"]) for r in rows), dtype=np.int64).T
    return Crowds(*table)


def deal(src: DataFrame, keys: Keys, carry: list[str], split: Split | None = None) -> DataFrame:
    """Entries ``key, cell, look`` with the columns ``carry`` of ``src``, sorted by the first three.

    ``src`` must have a long ``id``, and may have a long ``label``: a crowded bucket of one
    label is left out then, as its rows have no link to find.  Rows of equal key and cell
    are in one task.
    """
    crowds: list[Crowds] = []
    while len(crowds) <= (split.levels if split else 0) and (more := _crowds(src, keys, split, crowds)) is not None:
        crowds.append(more)
    shared = src.sparkSession.sparkContext.broadcast(crowds)
    levels = split.levels if split else 0
    kinds = {f.name: f for f in src.schema.fields}
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("look", T.BooleanType()), *[kinds[c] for c in carry]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            row, key, look, _ = _entries(batch, keys, split, shared.value)
            cell = np.zeros(len(row), dtype=np.int64)
            if len(shared.value) > levels:
                row, key, look, cell = _parted(batch, shared.value[levels], row, key, look)
            taken = batch.select(carry).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cell), pa.array(look), *taken.columns], names=schema.names)

    return src.mapInArrow(place, schema).repartition("key", "cell").sortWithinPartitions("key", "cell", "look")


def _parted(batch: pa.RecordBatch, crowds: Crowds, row: np.ndarray, key: np.ndarray, look: np.ndarray) -> Entries:
    """Row, key, side and cell of entries, those of crowded keys dealt to parts."""
    hot, at = crowds.find(key)
    ids, label = _column(batch, "id")[row], _column(batch, "label")
    others = crowds.others[at]
    if label is not None:
        keep = ~(hot & (others == 0))
        row, key, look, hot, at, ids, others = (x[keep] for x in (row, key, look, hot, at, ids, others))
    chance = mix(ids, key).view(np.uint64)
    parts = np.where(hot, -(-crowds.n[at] // CELL), 1)
    few = (others > 0) & (others <= CELL)
    rare = few & (label[row] != crowds.label[at]) if label is not None else np.zeros(len(row), dtype=bool)
    anchor = ~few & ((chance >> np.uint64(20)) % crowds.n[at].astype(np.uint64) < np.uint64(ANCHORS))
    copies = np.where(hot & (rare | anchor), parts, 1)
    rep = np.repeat(np.arange(len(row)), copies)
    nth = np.arange(len(rep)) - np.repeat(np.cumsum(copies) - copies, copies)
    own = (chance % parts.astype(np.uint64)).astype(np.int64)
    return row[rep], key[rep], look[rep], np.where(copies[rep] > 1, nth, own[rep])


def prints_split(column: str) -> Split:
    """Narrower buckets for 64-bit fingerprints that may differ in three bits.

    The bits that are not yet agreed on are cut in four blocks, one of which two such
    fingerprints agree in.  After six levels 11 bits are left, so a bucket of different
    fingerprints has at most 2,048 of them (stored and looking up: ``CELL`` rows).
    """
    masks = [np.zeros(1, dtype=np.uint64)]
    for _ in range(6):
        wider = []
        for m in masks[-1].tolist():
            free = [b for b in range(64) if not m >> b & 1]
            wider += [m | sum(1 << b for b in free[i::4]) for i in range(4)]
        masks.append(np.array(wider, dtype=np.uint64))

    def into(batch: pa.RecordBatch, row: np.ndarray, key: np.ndarray, path: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        fp = batch.column(column).to_numpy().view(np.uint64)[row]
        child = 4 * path[:, None] + np.arange(4)
        return (fp[:, None] & masks[level + 1][child]).view(np.int64), child

    return Split(into, 6)


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells from batches sorted by key and cell."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if not now.num_rows:
            continue
        key, cell = now["key"].to_numpy(), now["cell"].to_numpy()
        tail = int(np.flatnonzero((key == key[-1]) & (cell == cell[-1]))[0])
        if tail:
            yield now.slice(0, tail).combine_chunks()
        held = now.slice(tail)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def starts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """First row of each cell and the row behind its last."""
    key, cell = table["key"].to_numpy(), table["cell"].to_numpy()
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
    return first, np.concatenate((first[1:], [len(key)]))


class Forest:
    """Union-find over the ids met in one task; a root is the smallest id of its tree."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (parent := up.get(root, root)) != root:
            root = parent
        while (parent := up.get(x, x)) != root:
            up[x] = root
            x = parent
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.up[x] != x]
        return nodes, [self.find(x) for x in nodes]
