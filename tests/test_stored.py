"""What is built once and kept: versioned tables, streams over them, indexes."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from granum import storage
from granum.operators import evaluation as E
from granum.operators import search as R
from granum.operators import text_index, vector_index
from granum.sources import versioned
from granum.sources.versioned import Conflict, VersionedTable
from granum.streaming import windows as W

SF = "/root/testdata/sf0.001"


def rows_of(df) -> list[tuple]:  # noqa: ANN001
    return sorted(map(tuple, df.collect()), key=str)


def batch(spark, rows: list[tuple]):  # noqa: ANN001, ANN201
    return spark.createDataFrame(rows, "k long, at int, v string")


def test_versions_equal_a_plain_dictionary(spark, tmp_path) -> None:  # noqa: ANN001
    rng = random.Random(5)
    t = VersionedTable(spark, f"file://{tmp_path}/t", ["k"], ["at"], buckets=4)
    plain: dict = {}
    for number in range(7):
        rows = [(rng.choice([None, *range(30)]), rng.randrange(9), f"b{number}.{i}") for i in range(rng.choice([0, 3, 20]))]
        assert t.merge(batch(spark, rows), ("s", number)) == number
        assert t.merge(batch(spark, rows), ("s", number)) is None  # a repeated batch changes nothing
        best: dict = {}
        for k, at, v in rows:
            best[k] = max(best.get(k, (at, v)), (at, v))
        for k, (at, v) in best.items():
            if k not in plain or at >= plain[k][0]:
                plain[k] = (at, v)
        assert rows_of(t.read()) == sorted(((k, *x) for k, x in plain.items()), key=str)
    assert rows_of(t.read(0)) != rows_of(t.read())
    t.vacuum(keep=1)
    assert t.versions() == [6]
    assert rows_of(t.read()) == sorted(((k, *x) for k, x in plain.items()), key=str)


def test_a_failure_at_any_step_loses_nothing(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    """Every step of a commit that touches files fails once; the table reads as before, and the repeat goes through."""
    old, new = [(k, 0, "old") for k in range(20)], [(k, 1, "new") for k in range(5, 25)]
    want_old, want_new = sorted(old, key=str), sorted(old[:5] + new, key=str)
    steps = 0
    for fail_at in itertools.count():
        t = VersionedTable(spark, f"file://{tmp_path}/t{fail_at}", ["k"], ["at"], buckets=3)
        t.merge(batch(spark, old), ("s", 0))
        seen = itertools.count()

        def trap(f, seen=seen, fail_at=fail_at):  # noqa: ANN001, ANN202
            def step(*a, **b):  # noqa: ANN002, ANN003, ANN202
                if next(seen) == fail_at:
                    raise OSError("lost")
                out = f(*a, **b)
                if next(seen) == fail_at:
                    raise OSError("lost")
                return out

            return step

        with monkeypatch.context() as m:
            m.setattr(VersionedTable, "_write", trap(VersionedTable._write))
            m.setattr(storage, "write_text", trap(storage.write_text))
            try:
                t.merge(batch(spark, new), ("s", 1))
                break
            except OSError:
                steps += 1
        assert rows_of(t.read()) == want_old
        assert t.merge(batch(spark, new), ("s", 1)) == 1
        assert rows_of(t.read()) == want_new
        assert t.vacuum() >= 0
        assert rows_of(t.read()) == want_new
    assert steps >= 4


def test_two_writers_conflict(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    a, b = (VersionedTable(spark, f"file://{tmp_path}/t", ["k"]) for _ in range(2))
    a.merge(batch(spark, [(1, 1, "a")]))
    stale = b.manifest()
    a.merge(batch(spark, [(2, 1, "a")]))
    monkeypatch.setattr(b, "manifest", lambda version=None: stale)
    with pytest.raises(Conflict):
        b.merge(batch(spark, [(3, 1, "b")]))
    assert a.read().count() == 2


def test_written_rows_follow_the_batches(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    t = VersionedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=8)
    t.merge(batch(spark, [(k, 0, "x") for k in range(4000)]))
    written = []
    write = VersionedTable._write
    monkeypatch.setattr(VersionedTable, "_write", lambda self, rows, folder: written.append(rows.count()) or write(self, rows, folder))
    for n in range(5):
        t.merge(batch(spark, [(k, 0, f"y{n}") for k in range(n * 10, n * 10 + 40)]))
    assert sum(written) == 200
    assert t.read().where("v <> 'x'").count() == 80


def test_appends_keep_the_least_row_of_a_repeated_key(spark, tmp_path) -> None:  # noqa: ANN001
    t = VersionedTable(spark, f"file://{tmp_path}/t", ["k"])
    t.append_new(batch(spark, [(1, 2, "b"), (1, 1, "z"), (None, 1, "n")]))
    t.append_new(batch(spark, [(1, 0, "a"), (None, 0, "m"), (2, 5, "c")]))
    assert rows_of(t.read()) == sorted([(1, 1, "z"), (None, 1, "n"), (2, 5, "c")], key=str)


def test_late_events_are_dropped_and_sessions_equal_the_batch(spark, tmp_path) -> None:  # noqa: ANN001
    at = lambda h, m=0: f"2024-01-01 {h:02d}:{m:02d}:00"
    files = [[("a", at(1)), ("a", at(1, 20)), ("b", at(2))], [("a", at(9)), ("b", at(9, 10))], [("a", at(1, 25)), ("c", at(10)), ("a", at(8, 50))], [("z", at(23))]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "user_id string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/f{i}")
    out = []
    base = f"file://{tmp_path}/out"
    stream = None
    for i in range(len(files)):  # one file a run, restarted from the checkpoint
        spark.read.parquet(f"{tmp_path}/f{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = W.sessions(W.read_stream(spark, f"{tmp_path}/in", files=1), "user_id", "30 minutes", late="2 hours")
        stream.writeStream.format("parquet").option("path", base).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    out = rows_of(spark.read.parquet(base).select("user_id", F.date_format("start", "HH:mm"), "n"))
    # 01:25 of a comes when the watermark is at 07:10: its session is closed, so it is dropped; 08:50 is in time
    assert out == sorted([("a", "01:00", 2), ("b", "02:00", 1), ("a", "08:50", 2), ("b", "09:10", 1), ("c", "10:00", 1)], key=str)


def test_latest_rows_are_kept_in_state_over_restarts(spark, tmp_path) -> None:  # noqa: ANN001
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got: list = []
        for rows in ([(1, 5, "a"), (2, 1, "b"), (1, 4, "x")], [(1, 3, "old"), (2, 1, "tie"), (3, None, "n")], [(3, 0, "m"), (1, 9, "new")]):
            batch(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = W.latest_in_state(W.read_stream(spark, f"{tmp_path}/in"), ["k"], ["at"])
            given: list = []
            stream.writeStream.foreachBatch(lambda df, _, given=given: given.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/ck").outputMode("update").trigger(availableNow=True).start().awaitTermination(120)
            got.append(sorted(given, key=str))
        assert got == [[(1, 5, "a"), (2, 1, "b")], [(2, 1, "tie"), (3, None, "n")], [(1, 9, "new"), (3, 0, "m")]]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


# ---------------------------------------------------------------- indexes


def test_vector_index_recall_and_scope(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(vector_index, "PER_CELL", 25)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = spark.createDataFrame([(9001, None, 3), (9002, [0.0] * 64, 3), (9003, [float("nan")] * 64, 3), (9004, [1.0], 3)], "vec_id long, embedding array<float>, label int")
    path = f"file://{tmp_path}/cells"
    vector_index.build(e.unionByName(odd), path, scope=["label"])
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    queries = queries.unionByName(odd.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")))
    for scope, held in ((None, e), (F.col("label") == 3, e.where("label = 3"))):
        want = {(r["qid"], r["id"]): r["score"] for r in R.dense(held, queries.where("qid < 9000")).collect()}
        rows = vector_index.search(spark, path, queries, scope=scope).collect()
        got = {(r["qid"], r["id"]): r["score"] for r in rows}
        assert len(want.keys() & got.keys()) >= 0.9 * len(want)
        assert all(abs(got[p] - want[p]) <= 2e-6 for p in want.keys() & got.keys())
        assert {r["qid"] for r in rows} <= {q for q, _ in want}
        labels = {r["vec_id"]: r["label"] for r in e.collect()}
        assert scope is None or all(labels[i] == 3 for _, i in got)
    model, _ = vector_index.load(spark, path)
    assert len(model.centres) > 1
    everything = vector_index.search(spark, path, queries, share=1.0).count()
    assert everything == 8 * queries.where("qid < 9000").count()
    assert vector_index.search(spark, path, queries.limit(0)).count() == 0
    assert vector_index.search(spark, path, queries, scope=F.col("label") == 77).count() == 0
    vector_index.build(e.limit(0), f"{path}-none")
    assert vector_index.search(spark, f"{path}-none", queries).count() == 0


def test_text_index_skips_ranges_and_equals_the_plain_search(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(text_index, "RANGE_BITS", 2)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(400)], k=rng.choice([3, 30, 200]))) for _ in range(600)]
    rows = [(i, t, "fr" if i % 3 else "en") for i, t in enumerate(texts)] + [(700, None, "fr"), (701, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    asked = spark.createDataFrame([(1, "w7 w150"), (2, "w0 w1"), (3, "w399 w399 w3 w3"), (4, "nothing here"), (5, ""), (6, None)], "qid int, query string")
    held = text_index.index(docs, scope=["lang"])
    assert rows_of(held.search(asked, 8)) == rows_of(R.bm25(docs, asked, 8))
    assert rows_of(held.search(asked, 3, F.col("lang") == "fr")) == rows_of(R.bm25(docs, asked, 3, F.col("lang") == "fr"))
    plan = held.plan(asked, 2).agg(F.count("*"), F.count_if("read")).first()
    assert 0 < plan[1] < plan[0]
    empty = text_index.index(docs.limit(0))
    assert empty.search(asked).count() == 0
    assert storage.release(spark) >= 2


def test_content_match_carries_no_bodies_beside_runs(spark) -> None:  # noqa: ANN001
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (1, "x y"), (2, "b c d e f z")], "id int, body string")
    win = spark.createDataFrame([(7, "a b c d e f"), (8, "b c d e f z"), (9, "b c d e f g"), (10, "x y")], "gold int, window string")
    assert rows_of(E.content_match(docs, win)) == sorted([(7, 1), (8, 2), (9, 1), (10, 1)], key=str)
    assert versioned.BUCKETS > 0


def test_text_index_blocks_are_made_without_a_shuffle(spark, tmp_path) -> None:  # noqa: ANN001
    docs = spark.createDataFrame([(i, f"red w{i % 5} red") for i in range(100)], "doc_id long, text string").repartition(3)
    text_index.build(docs.localCheckpoint(), str(tmp_path / "index"))
    blocks = spark.read.parquet(str(tmp_path / "index" / "blocks"))
    assert blocks.groupBy("term", "range").count().where("count > 1").count() == 0
    assert blocks.agg(F.sum("n")).first()[0] == 200 and blocks.where("n <> size(postings)").count() == 0
    # no task gathers blocks of several tasks: each range is in the files of one
    files = blocks.select("range", F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1).alias("task"))
    assert files.distinct().groupBy("range").count().where("count > 1").count() == 0
