"""The pipeline's stages and the registered queries."""

from __future__ import annotations

import random

import __spark_entry__
import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import documents, odd

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_and_remove_planted(spark, tmp_path) -> None:  # noqa: ANN001
    rng = random.Random(11)
    vocab = [*["the", "of", "and", "to", "in"] * 9, *[f"{a}{b}{c}" for a in "stormbl" for b in "aeiou" for c in ("nd", "rk", "sten", "lo")]]
    prose = lambda n: "\n".join(" ".join(rng.choice(vocab) for _ in range(12)).capitalize() + "." for _ in range(n))
    item = " ".join(rng.choice(vocab) for _ in range(30))
    clean = [prose(rng.randint(3, 9)) for _ in range(60)]
    shout = [t.upper().replace(" ", "!! ") for t in (prose(4) for _ in range(8))]
    near = clean[0].rsplit(" ", 1)[0] + " changed."  # one five-word shingle differs
    leak = f"{prose(4)}\n{item}\n{prose(3)}"
    df = documents(spark, [*clean, *shout, clean[1], near, leak])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sum(i in rows for i in range(1, 60)) >= 58
    assert not any(i in rows for i in range(60, 68))
    assert 68 not in rows and 0 in rows
    assert 69 not in rows or len(rows[69]["text"]) < len(near)  # line dedup comes first
    assert item not in rows[70]["text"] and rows[70]["n_chars"] == len(rows[70]["text"])


def test_stage_columns(spark) -> None:  # noqa: ANN001
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert (out.columns == docs.columns) == (name != "packing")


def test_stages_take_odd_tables(spark, tmp_path) -> None:  # noqa: ANN001
    spark.createDataFrame([(1, "some passage of a test")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = odd(spark).withColumn("n_chars", F.length("text")).withColumn("cuts", F.lit("x")).withColumn("root", F.lit(1)).withColumn("n_tokens", F.lit("y"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (df, df.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            if name == "packing":
                assert set(out.columns) >= set(docs.columns) and out.count() == docs.count()
            else:
                assert out.columns == docs.columns and out.count() <= docs.count()
    kept = corpus_pipeline.near_dedup(spark, df, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "3", "4", "6"] and all(r["cuts"] == "x" for r in kept)


@pytest.mark.parametrize("name", [k for k in __spark_entry__.llm.QUERIES])
def test_registered_queries_cover_their_tables(spark, name) -> None:  # noqa: ANN001
    df = __spark_entry__.queries()[name](spark, SF).cache()
    op = int(name[2:].split("_")[0])
    t = spark.read.parquet(f"{SF}/{ {5: 'embeddings', 10: 'pages', 12: 'embeddings', 13: 'embeddings'}.get(op, 'documents')}.parquet")
    n = 5 * t.where("vec_id % 50 = 0").count() if op == 5 else 16 * t.count() if op == 13 else t.count()
    assert df.count() == n
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cols = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, df.select(cols).collect())) == sorted(want)
