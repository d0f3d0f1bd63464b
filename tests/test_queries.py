"""Every registered query against its oracle, and under another partitioning."""

from __future__ import annotations

import math
import os

import __spark_entry__
import duckdb
import pytest

from granum.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
#: Fits of iterative models, checked by rows only and slow.
SLOW = {"cv_auc", "cv_tabular", "ml_importances", "ml_forest", "ml_gbt", "ml_logreg", "logit_grid", "kmeans_segments"}


@pytest.fixture(scope="module")
def duck():  # noqa: ANN201
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def cell(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else round(v, 4) + 0.0
    return str(v) if v is not None else ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name) -> None:  # noqa: ANN001
    if name in SLOW and not os.environ.get("GRANUM_SLOW"):
        pytest.skip("slow fit; set GRANUM_SLOW")
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    sql = registry.oracles().get(name)
    if sql is None:
        assert rows
        return
    cols = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({sql})").fetchall()
    key = lambda r: tuple(str(cell(v)) for v in r)
    got = sorted((tuple(r[c] for c in cols) for r in rows), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(abs(a - b) <= 1e-3 * max(1, abs(b)) if isinstance(a, float) and isinstance(b, float) else cell(a) == cell(b) for a, b in zip(g, w, strict=True)), (g, w)


def test_entry(spark) -> None:  # noqa: ANN001
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_order_of_rows_does_not_matter(spark, tmp_path) -> None:  # noqa: ANN001
    for f in os.listdir(SF):
        spark.read.parquet(f"{SF}/{f}").repartition(5).write.parquet(f"{tmp_path}/{f}")
    for name in ("pareto_curve", "rfm_segments", "bm25_topk", "dedup_last_wins", "country_revenue", "roc_auc"):
        a, b = QUERIES[name](spark, SF), QUERIES[name](spark, str(tmp_path))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name


def test_toc_runs_take_a_heading_without_rank_last(spark, tmp_path) -> None:  # noqa: ANN001
    rows = [(1, 0, 5, 1), (1, 0, None, 1), (1, 0, 7, 2), (1, 0, 9, 3), (2, 0, None, 1), (2, 0, 2, 1), (2, 0, 3, 2), (2, 0, 4, 2), (2, 0, 5, 3), (3, None, 1, 1), (3, 0, 2, 1), (3, 0, 4, 2), (3, 0, 6, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(registry.oracles()["toc_runs"]).fetchall()
    assert sorted(map(tuple, QUERIES["toc_runs"](spark, str(tmp_path)).collect())) == sorted(want) == [(2, 600, 900, 3), (3, 300, 900, 3)]
