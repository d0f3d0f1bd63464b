"""Captures of drifting shape, pages that are not well formed, and one row to many from SQL."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from granum.functions import html as H
from granum.operators import documents as D
from granum.operators import table_functions as TF
from granum.plans import retrieval
from granum.sources import variants as V

PAGES = {
    "<p>a<p>b": "a b", "a</p>b": "a b", "a<br/>b<img src=x alt='>'>c": "a b c", "<a/ b / c>x": "x",
    "a<!-- <b>x</b> -->b": "a b", "a<!-- never": "a", "<!-->a": "a", "<!--->b": "b", "<!doctype html><?php 1 ?>t": "t", "a</>b</ x>c": "a b c",
    '<a title="x > y">t</a>': "t", "<a title='1<2'>t": "t", "<a t=it's>q</a>": "q", "<a href=>x": "x", "<a b c='": "", '<a ="x>y">z': 'y">z', '<a b="c"="d">z': "z", "<a b=c'd>z": "z", "a<b": "a",
    "<script>if(a<b)'</p>'</script>z": "z", "<SCRIPT >x</ScRiPt\n>z": "z", "<style>p{}": "", "<title>a<b>&amp;c</title>d": "a<b>&c d", "<textarea><p></textarea>q": "<p> q", "<xmp>&amp;<b></xmp>": "&amp;<b>",
    "<template><p>x<template>y</template>z</template>w": "w", "<template><img><br>x</template>y": "y", "<template><div>x</p></template>y": "y",
    "x < y <3 z": "x < y <3 z", "&lt;b&gt;": "<b>", "a&nbsp;&nbsp;b": "a b", "<": "<", "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_broken_pages(page: str) -> None:
    assert " ".join(" ".join(H.visible(page)).split()) == PAGES[page]


@pytest.mark.parametrize("piece", ["<", "<a ", "<a b='", "</p>", "<!--", "<script>", '<a b="x" ', "<template>", "<a b=c>&", "<a\t=", "</x y='>"])
def test_pages_take_time_in_proportion(piece: str) -> None:
    begin = time.process_time()
    H.visible(piece * (2_000_000 // len(piece)))
    H.visible("<a" + piece * (1_000_000 // len(piece)) + ">")
    H.visible("<template>" * 100_000 + "<b></i>" * 100_000)
    assert time.process_time() - begin < 10


def test_visible_text_of_a_column(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, None), (2, "<p>a&amp;b <i>c"), (3, "")], "i int, page string")
    assert [r[0] for r in df.orderBy("i").select(H.visible_text(F.col("page"))).collect()] == ["", "a&b c", ""]


def test_captures_without_a_schema(spark, tmp_path) -> None:  # noqa: ANN001
    files = {"a.json": '{"jobs":[{"id":1,"pay":{"min":10}},{"id":"2","pay":"20"}]}', "b.json": '{"jobs":[{"id":3,"pay":{"min":null}}],"n":1}', "c.json": '{"jobs":[', "d.json": "", "e.json": '{"other":true}'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = V.captures(spark, f"{tmp_path}/*.json")
    bad = {r["path"].rsplit("/", 1)[1]: r["text"] for r in got.where("not valid").collect()}
    assert bad["c.json"] == files["c.json"] and set(bad) <= {"c.json", "d.json"}
    assert got.where("valid and text is not null").count() == 0
    rows = V.typed(V.elements(got, "$.jobs").drop("body", "valid"), {"id": ("int", ["$.id"], None), "pay": ("int", ["$.pay.min", "$.pay"], 0)}, "value").orderBy("id").collect()
    assert [(r["id"], r["pos"], r["pay"]) for r in rows] == [(1, 0, 10), (2, 1, 20), (3, 0, 0)]
    assert V.elements(got.where("valid"), "$.jobs", outer=True).where("pos is null").count() == 1
    shape = V.shapes(got).first()
    assert shape["n"] == 3 and "jobs: ARRAY<" in shape["shape"] and "other: BOOLEAN" in shape["shape"]


def test_objects_are_no_strings(spark) -> None:  # noqa: ANN001
    df = V.parsed(spark.createDataFrame([(1, '{"a":{"b":1}}'), (2, '{"a":"x"}'), (3, '{"a":[1]}'), (4, None), (5, "nope"), (6, '{"a":7}'), (7, "[]")], "i int, t string"), "t")
    got = V.typed(df, {"a": ("string", ["$.a"], "-"), "n": ("bigint", ["$.a.b", "$.a"], None)}).orderBy("i").collect()
    assert [(r["a"], r["n"], r["valid"]) for r in got] == [("-", 1, True), ("x", None, True), ("-", None, True), ("-", None, False), ("-", None, False), ("7", 7, True), ("-", None, True)]
    assert V.typed(df.limit(0), {"a": ("string", ["$.a"], "-")}).count() == 0 and V.shapes(df.limit(0)).first()["n"] == 0


def test_lines_of_json(spark, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{"a":"b"}\n{broken\n')
    assert sorted((r["valid"], r["text"]) for r in V.lines(spark, str(tmp_path)).collect() if not r["valid"]) == [(False, "{broken")]


def test_chunks_from_sql_equal_those_of_frames(spark) -> None:  # noqa: ANN001
    sf = "/root/testdata/sf0.001"
    for a, b in ((retrieval.chunk_fixed_sql, retrieval.chunk_fixed), (retrieval.chunk_structural_sql, retrieval.chunk_structural)):
        got, want = a(spark, sf), b(spark, sf)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = retrieval.chunk_fixed_sql(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    plan = retrieval.chunk_structural_sql(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_chunks_from_sql_of_odd_rows(spark) -> None:  # noqa: ANN001
    TF.register(spark)
    rows = [(1, None, "n"), (2, "", None), (3, "   ", "b"), (4, "It\'s \"one\". Two\u2019s \\ here! (Three) Inc. Four", "x"), (4, "word " * 3000, "x"), (5, "A. " * 900, "y")]
    df = spark.createDataFrame(rows, "id int, body string, extra string")
    fixed = spark.sql("SELECT id, c.* FROM (SELECT id, fixed_chunks(body, 1500, 1300, 300) AS chunks FROM {t}) AS d, LATERAL inline(d.chunks) AS c", t=df)
    assert sorted(map(tuple, fixed.collect())) == sorted(map(tuple, D.fixed_chunks(df, "id", "body").collect()))
    packed = spark.sql("SELECT id, extra, chunk_index, text FROM sentence_chunks(TABLE(SELECT extra, bounded_sentences(body) AS parts, id FROM {t}), 'parts')", t=df)
    assert sorted(map(tuple, packed.drop("extra").collect())) == sorted(map(tuple, D.structural_chunks(df, "id", "body").collect()))
    assert {r["extra"] for r in packed.collect()} == {"x", "y"}
    null = spark.sql("SELECT * FROM sentence_chunks(TABLE(SELECT id, CAST(NULL AS ARRAY<STRING>) AS parts FROM {t}), 'parts')", t=df)
    assert null.count() == 0 and null.columns == ["id", "chunk_index", "text"]
    for call, word in (("TABLE(SELECT 1 AS a), 'parts'", "names one of"), ("TABLE(SELECT 'x' AS parts), 'parts'", "one array"), ("TABLE(SELECT array('x') AS parts, 1 AS text), 'parts'", "those of the result"), ("array('x'), 'parts'", "first argument")):
        with pytest.raises(AnalysisException, match=word):
            spark.sql(f"SELECT * FROM sentence_chunks({call})")


def test_sentence_patterns_are_the_plain_ones_and_quick(spark) -> None:  # noqa: ANN001
    """The guarded patterns cut as those without a guard do, on any mixture of breaks, and in a fraction of their time."""
    gap = rf"(?:\s+(?=[{D.OPENERS}])|\s*(?={D.BULLET}))"
    plain = rf"(?U){D._ABBREVIATED}{gap}", rf"(?U){D._NOT_ABBREVIATED}(?:(?<=[.!?])\s+(?=[{D.OPENERS}])|\s*(?={D.BULLET}))"
    rng = random.Random(3)
    bits = ["Inc", "inc.", "u.s.", "e.g", ".", "..", "!", "?", " ", "  ", "\n", " ", " ", "•", "•", "A", "The", "word", "(", '"', "“", "a", "5", "No.", "x.inc."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)

    def cut(joined: str, parting: str):  # noqa: ANN202
        return F.split(F.regexp_replace("t", joined, " "), parting)

    guarded = D.sentence_patterns()[:2]
    assert rows.where(~cut(*guarded).eqNullSafe(cut(*plain))).count() == 0
    prose = spark.createDataFrame([(" ".join(rng.choice(["some", "words", "of", "prose", "Inc.", "end.", "Then"]) for _ in range(60_000)),)], "t string")

    def seconds(patterns: tuple[str, str]) -> float:
        began = time.monotonic()
        prose.select(F.size(cut(*patterns))).collect()
        return time.monotonic() - began

    seconds(guarded)
    assert seconds(guarded) < seconds(plain) / 2


def test_visible_text_gives_a_batch_back_in_pieces() -> None:
    pages = pa.array([f"<p>{i}</p>" if i % 5 else None for i in range(3 * H.PAGES + 1)])
    out = list(H._visible.func(iter([pages, pages[:0]])))
    assert [len(x) for x in out] == [H.PAGES] * 3 + [1]
    assert [t for x in out for t in x.to_pylist()] == [str(i) if i % 5 else "" for i in range(len(pages))]
