"""Readers, writers and the paged connector."""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.error
import urllib.request
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from granum import serving, storage
from granum.operators import models
from granum.sources import paged, sheets, sinks, tables, web
from granum.sources.versioned import VersionedTable


def test_round_trips(spark, tmp_path) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, "a,é\"x"), (2, None)], "id int, t string")
    sinks.csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, tables.csv(spark, f"{tmp_path}/c", "id int, t string").collect())) == [(1, "a,é\"x"), (2, None)]
    sinks.jsonl(df, f"{tmp_path}/j")
    assert sorted(map(tuple, tables.jsonl(spark, f"{tmp_path}/j", "id int, t string").collect())) == [(1, "a,é\"x"), (2, None)]
    sinks.snapshot(df, f"{tmp_path}/s", "2026-01-02", "board")
    assert {r["capture_source"] for r in spark.read.json(f"{tmp_path}/s").collect()} == {"board"}


def test_upsert_is_repeatable(spark, tmp_path) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, [0.5]), (1, [0.5]), (2, [0.1])], "id int, v array<double>")
    for _ in range(2):
        sinks.upsert_vectors(df, f"{tmp_path}/v", "id")
    assert VersionedTable(spark, f"{tmp_path}/v", ["id"]).read().count() == 2


def test_report_cuts_long_cells(spark, tmp_path) -> None:  # noqa: ANN001
    df = spark.createDataFrame([("x" * 40_000,)], "t string")
    sinks.report({"one": df}, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(f"{tmp_path}/r/one").select(F.length("t")).first()[0] == 32_000
    assert spark.read.option("header", True).csv(f"{tmp_path}/r/dictionary").count() == 1


def test_paged_connector(spark) -> None:  # noqa: ANN001
    def fetch(endpoint: str, page: int) -> list[dict] | None:
        if endpoint == "down":
            raise OSError("no route")
        return [{"id": 10 * page + i} for i in range(3)] if page < 4 else None

    paged.register(spark, "fake_board", fetch)
    df = spark.read.format("fake_board").option("pages", 6).option("pagesPerTask", 3).option("pause", 0).load("jobs,down")
    rows = df.where("error is null").select("endpoint", F.get_json_object("body", "$.id").cast("int").alias("id")).collect()
    assert sorted(r["id"] for r in rows) == sorted(10 * p + i for p in range(4) for i in range(3)) and {r["endpoint"] for r in rows} == {"jobs"}
    assert sorted((r["endpoint"], r["page"], r["error"]) for r in df.where("error is not null").collect()) == [("down", p, "OSError: no route") for p in range(6)]


def test_paged_connector_goes_on_behind_a_failed_page(spark) -> None:  # noqa: ANN001
    def fetch(endpoint: str, page: int) -> list[dict] | None:
        if endpoint == "down" or page == 2:
            raise ValueError("bad gateway")
        return [{"id": page}] if page < 14 else None

    paged.register(spark, "shaky_board", fetch)
    rows = spark.read.format("shaky_board").option("pause", 0).option("retries", 0).load("jobs,down").collect()
    assert [r["page"] for r in rows if r["endpoint"] == "jobs" and r["error"] is None] == [p for p in range(14) if p != 2]
    assert [r["page"] for r in rows if r["error"]] == [2, 0, 1, 2] and all(r["body"] is None for r in rows if r["error"])


def test_upsert_updates(spark, tmp_path) -> None:  # noqa: ANN001
    path = f"{tmp_path}/v"
    sinks.upsert_vectors(spark.createDataFrame([(1, [0.5], 1), (2, [0.1], 1)], "id int, v array<double>, at int"), path, "id", "at")
    new = spark.createDataFrame([(2, [0.2], 3), (2, [0.9], 2), (3, [0.3], 1)], "id int, v array<double>, at int")
    for _ in range(2):
        sinks.upsert_vectors(new, path, "id", "at")
        assert sorted(map(tuple, VersionedTable(spark, path, ["id"]).read().collect())) == [(1, [0.5], 1), (2, [0.2], 3), (3, [0.3], 1)]


def test_workbooks(spark, tmp_path) -> None:  # noqa: ANN001
    a = spark.createDataFrame([(1, "a & <b>\n é", 0.5, True, None), (2, "x" * 40_000, None, False, None)], "id int, `long text` string, v double, ok boolean, e string")
    path = f"{tmp_path}/book.xlsx"
    sinks_path = f"file://{path}"
    sheets.write_workbook({"first/sheet": a, "empty": a.limit(0)}, sinks_path)
    got = sheets.read_sheet(spark, sinks_path, "first_sheet")
    assert got.columns == a.columns and [tuple(r)[:1] + tuple(r)[2:] for r in got.collect()] == [("1", "0.5", "true", None), ("2", None, "false", None)]
    assert [r[1] for r in got.collect()] == ["a & <b>\n é", "x" * 32_000]
    assert sheets.read_sheet(spark, sinks_path, "empty").columns == a.columns and sheets.read_sheet(spark, sinks_path, "dictionary").count() == 10


def test_reviews_newest_files_and_keys(spark, tmp_path) -> None:  # noqa: ANN001
    df = spark.createDataFrame([("7", "si")], "id string, verdict string")
    book, text = tmp_path / "r.xlsx", tmp_path / "r.csv"
    with pytest.raises(FileNotFoundError):
        tables.newest_review(spark, str(text), str(book), "s")
    sheets.write_workbook({"s": df}, str(book), dictionary=False)
    assert [tuple(r) for r in tables.newest_review(spark, str(text), str(book), "s").collect()] == [("7", "si")]
    text.write_text("\ufeffid,verdict\n8,no\n", encoding="utf-8")
    os.utime(book, (1, 1))
    assert [tuple(r) for r in tables.newest_review(spark, str(text), str(book), "s").select("id", "verdict").collect()] == [("8", "no")]
    assert storage.newest(spark, f"{tmp_path}/r.*").endswith("r.csv") and storage.newest(spark, f"{tmp_path}/r.*", by_name=True).endswith("r.xlsx")
    (tmp_path / "AB_FY2024.html").write_text("<p>x</p>")
    (tmp_path / "other.html").write_text("y")
    assert sorted((r["ticker"] or "", r["fiscal_year"]) for r in tables.html_files(spark, f"{tmp_path}/*.html").collect()) == [("", None), ("AB", 2024)]
    for i, day in enumerate(("2026-01-02", "2026-01-05")):
        (tmp_path / f"cap{i}.json").write_text(json.dumps({"captured_at": day, "jobs": [{"id": i}, {"id": i + 10}]}, indent=1))
    rows = tables.capture_rows(spark, f"{tmp_path}/cap*.json", "captured_at string, jobs array<struct<id:int>>", "jobs").collect()
    assert sorted(r["id"] for r in rows) == [0, 1, 10, 11] and {r["last_captured_at"] for r in rows} == {"2026-01-05"}
    sinks.csv(df, f"{tmp_path}/bom", bom=True)
    assert next((tmp_path / "bom").glob("part-*.csv")).read_bytes().startswith(b"\xef\xbb\xbfid")
    sinks.arrays(df, f"{tmp_path}/arrays")
    assert spark.read.parquet(f"{tmp_path}/arrays").count() == 1


def test_yaml_question_set(spark, tmp_path) -> None:  # noqa: ANN001
    pytest.importorskip("yaml")
    (tmp_path / "q.yaml").write_text("- id: q1\n  scope: {year: 2024}\n- id: q2\n")
    rows = tables.yaml_rows(spark, f"{tmp_path}/q.yaml", "id string, scope map<string,int>").collect()
    assert [(r["id"], r["scope"]) for r in rows] == [("q1", {"year": 2024}), ("q2", None)]


@pytest.fixture
def site(tmp_path):  # noqa: ANN001, ANN201
    """A local server of two pages of JSON, which want a key, and of the files of a folder."""

    class Handler(SimpleHTTPRequestHandler):
        def __init__(self, *args: object) -> None:
            super().__init__(*args, directory=str(tmp_path))

        def do_GET(self) -> None:  # noqa: N802
            if not self.path.startswith("/api/"):
                super().do_GET()
                return
            page = int(self.path.rsplit("=", 1)[1])
            good = self.headers.get("X-Key") == "k"
            self.send_response(200 if good else 403)
            self.end_headers()
            self.wfile.write(json.dumps({"data": [{"id": page}] if page < 2 else []}).encode())

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_web_sources(spark, tmp_path, site) -> None:  # noqa: ANN001
    (tmp_path / "t.csv").write_text("id,day,x\n1,2024-02-03,0.5\n2,2024-02-04,\n")
    rows = web.csv_url(spark, f"{site}/t.csv", "id long, day timestamp, x double", dates=["day"]).collect()
    assert [(r["id"], str(r["day"])[:10], r["x"]) for r in rows] == [(1, "2024-02-03", 0.5), (2, "2024-02-04", None)]
    paged.register(spark, "web_board", web.json_pages(f"{site}/api", {"X-Key": "k"}, per_second=200))
    assert [json.loads(r["body"])["id"] for r in spark.read.format("web_board").option("pause", 0).load("jobs").orderBy("page").collect()] == [0, 1]
    with pytest.raises(OSError, match="403"):
        web.json_pages(f"{site}/api")("jobs", 0)
    files = {"a.csv": f"{site}/t.csv", "b.csv": f"{site}/t.csv"}
    assert web.download(files, f"{tmp_path}/got") == ["a.csv", "b.csv"] and web.download(files, f"{tmp_path}/got") == []
    began = time.monotonic()
    throttle = web.Throttle(50)
    for _ in range(6):
        throttle.wait()
    assert time.monotonic() - began >= 0.095


@pytest.fixture
def counted():  # noqa: ANN201
    """A local server whose number of pages can grow, with the time of each request of a page."""
    held = {"pages": 0, "asked": [], "fail": set()}

    class Handler(SimpleHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            if self.path.endswith("/size"):
                body, status = held["pages"], 200
            else:
                key = (self.path.split("?")[0], int(self.path.rsplit("=", 1)[1]))
                held["asked"].append((time.monotonic(), key))
                status = 500 if key in held["fail"] and sum(k == key for _, k in held["asked"]) == 1 else 200
                body = [{"id": key[1]}] if key[1] < held["pages"] else []
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", held
    server.shutdown()


def _most_in_a_second(asked: list) -> int:  # noqa: ANN001
    at = sorted(t for t, _ in asked)
    return max(sum(a <= t < a + 0.99 for t in at) for a in at)  # the server's clock lags the client's by some thousandths


def test_pages_as_a_stream_resume_and_keep_one_rate(spark, tmp_path, counted) -> None:  # noqa: ANN001
    base, held = counted
    fetch = lambda e, p: json.loads(web.get(f"{base}/{e}?page={p}"))
    paged.register(spark, "grown_board", fetch, lambda e: json.loads(web.get(f"{base}/{e}/size")))

    def run() -> None:
        rows = spark.readStream.format("grown_board").option("perSecond", 20).option("tasks", 4).load("jobs,more")
        rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)

    for pages in (13, 13, 21):
        held["pages"] = pages
        run()
        assert sorted(k for _, k in held["asked"]) == sorted((f"/{e}", p) for e in ("jobs", "more") for p in range(pages))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["endpoint"], r["page"]) for r in got.where("error is null").collect()) == sorted((e, p) for e in ("jobs", "more") for p in range(21))
    assert _most_in_a_second(held["asked"]) <= 20


def test_pages_in_one_read_keep_one_rate(spark, counted) -> None:  # noqa: ANN001
    base, held = counted
    held["pages"], held["fail"] = 10, {("/jobs", 3)}
    paged.register(spark, "paced_board", lambda e, p: json.loads(web.get(f"{base}/{e}?page={p}")))
    for pages in (10, None):
        held["asked"].clear()
        reader = spark.read.format("paced_board").option("perSecond", 13).option("tasks", 4)
        rows = (reader.option("pages", pages) if pages else reader).load("jobs,more").collect()
        assert sorted((r["endpoint"], r["page"]) for r in rows if r["error"] is None) == sorted((e, p) for e in ("jobs", "more") for p in range(10))
        assert _most_in_a_second(held["asked"]) <= 13


def test_shares_of_pages() -> None:
    R = paged.PageRange  # noqa: N806
    for sizes, shares in (((10,), 4), ((1, 1), 4), ((7, 0, 30, 2), 3), ((5, 5), 1)):
        got = paged.dealt([R(str(i), 2, 2 + n) for i, n in enumerate(sizes)], shares)
        assert sorted((r.endpoint, p) for g in got for r in g for p in range(r.first, r.last)) == sorted((str(i), p + 2) for i, n in enumerate(sizes) for p in range(n))
        counts = [sum(r.last - r.first for r in g) for g in got]
        assert len(got) <= shares and max(counts) - min(counts) <= 1
    assert paged.dealt([], 3) == [] and paged.dealt([R("a", 0, None), R("b", 0, None), R("c", 0, None)], 2) == [[R("a", 0, None), R("c", 0, None)], [R("b", 0, None)]]
    assert paged.pace(10, 4) == (4, 0.5) and paged.pace(2, 4) == (2, 1.0) and paged.pace(0.5, 4) == (1, 2.0) and paged.pace(13, 4) == (4, 1 / 3)
    with pytest.raises(ValueError, match="positive"):
        paged.pace(0, 1)


def test_service(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(w * 3, float(i)) for i, w in enumerate(("bad poor ", "good fine ")) for _ in range(5)], "text string, label double")
    server = serving.serve(serving.Service(spark, models.text_pipeline(models.naive_bayes(), 64).fit(df)))
    base = f"http://127.0.0.1:{server.server_port}"

    def post(body: bytes) -> tuple[int, dict]:
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{base}/predict", data=body), timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        status, answer = post(b'{"text": "good good fine"}')
        assert (status, answer["sentiment"]) == (200, "positive") and 0.5 < answer["confidence"] <= 1
        assert [post(b)[0] for b in (b"{}", b"no json", b'{"text": "  "}', b"[1]")] == [400] * 4
        assert json.loads(web.get(f"{base}/health")) == {"status": "ok", "model_loaded": True} and "usage" in json.loads(web.get(f"{base}/info"))
        with pytest.raises(OSError, match="404"):
            web.get(f"{base}/other")
    finally:
        server.shutdown()
