"""Files and JSON over HTTP, throttled and with credentials, from the standard library."""

from __future__ import annotations

import io
import json
import time
import urllib.request
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Throttle:
    """At most ``per_second`` calls a second, spaced evenly."""

    def __init__(self, per_second: float) -> None:
        self.gap, self.next = 1.0 / per_second, 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if now < self.next:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def get(url: str, headers: dict[str, str] | None = None, timeout: float = 30) -> bytes:
    """The body of a URL; a status beyond 2xx is an error."""
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
        return r.read()


def json_pages(base: str, headers: dict[str, str] | None = None, per_second: float = 10.0, rows: str = "data") -> Callable[[str, int], list[dict] | None]:
    """A fetch function for the paged connector: ``base/endpoint?page=n``, rows under one key or the whole list."""
    state: dict[str, Throttle] = {}

    def fetch(endpoint: str, page: int) -> list[dict] | None:
        state.setdefault("t", Throttle(per_second)).wait()  # one for each worker
        body = json.loads(get(f"{base}/{endpoint}?page={page}", headers))
        return body.get(rows) if isinstance(body, dict) else body

    return fetch


def csv_url(spark: SparkSession, url: str, schema: StructType | str, dates: list[str] | None = None, **options: object) -> DataFrame:
    """A CSV file at a URL, read on the driver, with a declared schema."""
    frame = pd.read_csv(io.BytesIO(get(url)), parse_dates=dates or [], **options)
    plain = lambda v: None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v
    return spark.createDataFrame([tuple(map(plain, row)) for row in frame.itertuples(index=False, name=None)], schema)


def download(urls: dict[str, str], folder: str, headers: dict[str, str] | None = None, per_second: float = 10.0) -> list[str]:
    """Fetch the files that ``folder`` lacks, by name, and tell which were fetched; safe to repeat."""
    throttle, done = Throttle(per_second), []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, url in urls.items():
        target = Path(folder) / name
        if not target.exists():
            throttle.wait()
            part = target.with_name(f".{name}.part")
            part.write_bytes(get(url, headers))
            part.rename(target)
            done.append(name)
    return done
