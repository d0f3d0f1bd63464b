"""A paged JSON connector on the Python Data Source API.

The fetch function is injected, so the connector works with any client and is tested
without a network.  With ``pages`` given, every range of ``pagesPerTask`` pages is one
partition; without it each endpoint is one partition, read to its first empty page.  A page
that fails after its retries gives a row with the error, and reading goes on.

With ``perSecond`` the whole source keeps to that rate: all pages are dealt to ``tasks`` partitions,
and each of them keeps to its share, however many run at once, across retries, batches and restarts.

As a stream (with ``size``, which tells how many pages an endpoint has now) offsets are page numbers: a
batch reads the pages that came, and a query that starts again from its checkpoint goes on
behind the last batch that was finished.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Fetch = Callable[[str, int], list[dict] | None]


@dataclass
class PageRange(InputPartition):
    """Pages ``first`` to ``last`` (exclusive; None: to the end) of one endpoint."""

    endpoint: str
    first: int
    last: int | None


@dataclass
class Share(InputPartition):
    """What one task reads, with ``gap`` seconds before every request."""

    ranges: list[PageRange]
    gap: float


def pace(per_second: float, tasks: int) -> tuple[int, float]:
    """How many of ``tasks`` may ask, and the gap between requests of each.

    In no second are there more than ``per_second`` requests of all together: with ``k`` tasks each
    sends ``floor(per_second / k)`` in a second at most, so no more tasks ask than the rate has whole requests.
    """
    if per_second <= 0 or tasks < 1:
        raise ValueError("perSecond and tasks are to be positive")
    k = max(1, min(tasks, int(per_second)))
    return k, 1 / (per_second // k) if per_second >= 1 else 1 / per_second


def dealt(ranges: list[PageRange], shares: int) -> list[list[PageRange]]:
    """Ranges of known ends in ``shares`` parts of near equal pages; open ones go round."""
    open_ = [r for r in ranges if r.last is None]
    known = [r for r in ranges if r.last is not None and r.last > r.first]
    out: list[list[PageRange]] = [open_[i::shares] for i in range(shares)]
    total, done = sum(r.last - r.first for r in known), 0
    for r in known:
        at = r.first
        while at < r.last:
            i = done * shares // total
            end = min(r.last, at + -(-total * (i + 1) // shares) - done)
            out[i].append(PageRange(r.endpoint, at, end))
            done, at = done + end - at, end
    return [o for o in out if o]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch) -> None:
        self.endpoints = options.get("path", "").split(",")
        self.pages, self.width = int(options["pages"]) if "pages" in options else None, int(options.get("pagesPerTask", "5"))
        self.pause, self.retries, self.failures = float(options.get("pause", "1")), int(options.get("retries", "2")), int(options.get("failures", "3"))
        self.tasks, self.gap = pace(float(options["perSecond"]), int(options.get("tasks", "4"))) if "perSecond" in options else (None, 0.0)
        self.fetch = fetch

    def partitions(self) -> list[InputPartition]:
        if self.tasks:
            return [Share(r, self.gap) for r in dealt([PageRange(e, 0, self.pages) for e in self.endpoints], self.tasks)]
        if self.pages is None:
            return [PageRange(e, 0, None) for e in self.endpoints]
        return [PageRange(e, a, min(a + self.width, self.pages)) for e in self.endpoints for a in range(0, self.pages, self.width)]

    def _page(self, endpoint: str, page: int) -> tuple[list[dict], str | None]:
        error = None
        for attempt in range(self.retries + 1):
            time.sleep(self.gap)  # before, so that whatever asked last is that far away
            try:
                return self.fetch(endpoint, page) or [], None
            except Exception as e:  # noqa: BLE001  reported as a row
                error = f"{type(e).__name__}: {e}"
                if attempt < self.retries and not self.gap:
                    time.sleep(self.pause)
        return [], error

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for part in partition.ranges if isinstance(partition, Share) else [partition]:
            yield from self._range(part)

    def _range(self, partition: PageRange) -> Iterator[tuple]:
        failed = 0
        for page in count(partition.first) if partition.last is None else range(partition.first, partition.last):
            rows, error = self._page(partition.endpoint, page)
            if error is not None:
                yield partition.endpoint, page, None, error
                failed += 1
                if partition.last is None and failed >= self.failures:  # nothing tells where such an endpoint ends
                    return
                continue
            if not rows:
                return
            failed = 0
            for r in rows:
                yield partition.endpoint, page, json.dumps(r), None
            if not self.gap:
                time.sleep(self.pause)


class _StreamReader(DataSourceStreamReader):
    """Offsets are ``{endpoint: pages}``; an endpoint's number of pages never falls."""

    def __init__(self, options: dict, fetch: Fetch, size: Callable[[str], int]) -> None:
        self.reader, self.size, self.seen = _Reader(options, fetch), size, {}
        if not self.reader.tasks:
            raise ValueError("a stream of pages needs the option perSecond")

    def initialOffset(self) -> dict:  # noqa: N802
        return {e: 0 for e in self.reader.endpoints}

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = {e: max(self.seen.get(e, 0), self.size(e)) for e in self.reader.endpoints}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [PageRange(e, start.get(e, 0), last) for e, last in sorted(end.items())]
        return [Share(r, self.reader.gap) for r in dealt(new, self.reader.tasks)]

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.reader.read(partition)


def register(spark: SparkSession, name: str, fetch: Fetch, size: Callable[[str], int] | None = None) -> None:
    """Register the connector as format ``name``: rows are ``endpoint, page, body`` (JSON) and ``error``.

    ``size`` makes it a source of streams, too.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "endpoint string, page int, body string, error string"

        def reader(self, schema) -> _Reader:  # noqa: ANN001, ARG002
            return _Reader(self.options, fetch)

        def streamReader(self, schema) -> _StreamReader:  # noqa: ANN001, ARG002, N802
            if size is None:
                raise ValueError(f"{name} was registered without size and is no stream")
            return _StreamReader(self.options, fetch, size)

    spark.dataSource.register(Paged)
