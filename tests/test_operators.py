"""Operators against hand-checked values."""

from __future__ import annotations

import math
import random
import struct
import zlib
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granum.functions import special
from granum.functions import text as X
from granum.operators import classification as K
from granum.operators import cleaning
from granum.operators import customers as C
from granum.operators import documents as D
from granum.operators import evaluation as E
from granum.operators import features as G
from granum.operators import images
from granum.operators import models
from granum.operators import profiling as P
from granum.operators import ranking
from granum.operators import search as R
from granum.operators import sources as I
from granum.operators import statistics as S
from granum.operators import timeseries as T
from granum.plans import retrieval
from granum.sources import corpora, sinks
from granum.streaming import windows as W
from granum.sources.versioned import VersionedTable


def one(df):  # noqa: ANN001, ANN201
    return df.first().asDict()


def test_null_dropping_filter(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1,), (0,), (None,), (2,)], "p int")
    assert one(P.clean_report(df, F.col("p") > 0)) == {"n_before": 4, "n_after": 2, "removed_pct": 50.0}
    assert one(P.rule_counts(df, {"zero": F.col("p") == 0})) == {"zero": 1}
    assert one(P.null_counts(df, ["p"])) == {"p": 1}
    assert P.clean_report(df.limit(0), F.col("p") > 0).first()["removed_pct"] is None


def test_missing_and_constant_columns(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, None, "x"), (1, "a", None), (1, "a", "y")], "a int, b string, c string")
    assert {r["column_name"]: (r["n_missing"], r["pct_missing"]) for r in P.missing_report(df, ["a", "b", "c"]).collect()} == {"a": (0, 0.0), "b": (1, 33.33), "c": (1, 33.33)}
    assert {r["column_name"] for r in P.constant_columns(df, ["a", "b", "c"]).collect()} == {"a", "b"}


def test_describe_uses_sample_deviation(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(float(v),) for v in (2, 4, 4, 4, 5, 5, 7, 9)], "x double")
    r = one(P.describe(df, ["x"], 6))
    assert (r["std"], r["q50"], r["n"]) == (2.13809, 4.5, 8)
    z = G.standardize(df, "x", F.lit(True), "z")
    assert one(z.agg(F.round(F.min("z"), 6).alias("m"))) == {"m": -1.5}


@pytest.mark.parametrize(
    ("values", "descending", "want"),
    [([1, 1, 1, 1, 1, 2, 2, 3, 5, 9], False, [1, 1, 1, 1, 1, 1, 1, 2, 3, 3]), (list(range(1, 11)), True, [5, 5, 4, 4, 3, 3, 2, 2, 1, 1])],
)
def test_quintiles(spark, values, descending, want) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double").repartition(3)
    assert [r["q"] for r in C.quintile(df, "x", "q", descending).orderBy("i").collect()] == want


def test_recency_counts_elapsed_days(spark) -> None:  # noqa: ANN001
    rows = [(1, 1, datetime(2011, 12, 8, 13, 0), 5.0), (2, 2, datetime(2011, 12, 9, 12, 50), 7.0)]
    df = spark.createDataFrame(rows, "c int, o int, t timestamp_ntz, m double")
    assert {r["customer"]: r["recency"] for r in C.rfm(df, "c", "o", "t", "m").collect()} == {1: 1, 2: 1}


def test_pareto(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame(list(enumerate([30.0, 50.0, 4.0, 10.0, 6.0])), "k int, r double").repartition(4)
    rows = C.pareto(df, "k", "r").orderBy("pos").collect()
    assert [r["cum_revenue_pct"] for r in rows] == [50.0, 80.0, 90.0, 96.0, 100.0]
    assert rows[int(5 * 0.2)]["cum_revenue_pct"] == 80.0
    assert C.pareto(df.limit(0), "k", "r").count() == 0


def test_roi_grid_truncates(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(100, 20.0)], "n long, m double")
    assert [r["converted"] for r in C.roi_grid(df, "n", "m", 15.0).orderBy("step").collect()] == list(range(5, 55, 5))


def test_auc_with_ties_and_threshold(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame(list(zip([0.1, 0.4, 0.35, 0.8, 0.4], [0, 0, 1, 1, 1], strict=True)), "p double, y int")
    assert one(K.roc_auc(df, F.col("y") == 1, F.col("p")))["auc"] == 0.75
    assert one(K.f1_sweep(df, F.col("y") == 1, F.col("p"), [0.3, 0.4, 0.5])) == {"threshold": 0.3, "f1": 0.857143}
    assert one(K.binary_metrics(df, F.col("y") == 1, F.col("p") >= 0.4))["f1"] == 0.666667


def test_auc_equals_pair_count(spark) -> None:  # noqa: ANN001
    rows = [((i * 37 % 11) / 11, int(i * 17 % 5 < 2)) for i in range(50)]
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = one(K.roc_auc(spark.createDataFrame(rows, "p double, y int"), F.col("y") == 1, F.col("p")))["auc"]
    assert got == round(want, 6)


def test_full_confidence_is_in_no_bin(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1.0, True), (0.95, False), (0.1, True)], "c double, r boolean")
    assert {r["bin"] for r in K.reliability(df, F.col("c"), F.col("r")).collect()} == {9, 1}


def test_stratified_split_is_exact(spark) -> None:  # noqa: ANN001
    df = spark.range(103).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    by = G.stratified_split(df, "y", F.xxhash64("id"), 0.8, "t").groupBy("y").agg(F.count_if("t").alias("n")).collect()
    assert {r["y"]: r["n"] for r in by} == {0: math.floor(92 * 0.8), 1: math.floor(11 * 0.8)}


def test_t_and_anova_and_ols(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(float(v), 1) for v in (1, 2, 3, 4)] + [(float(v), 0) for v in (2, 4, 6, 9)], "x double, g int")
    r = one(S.ttest(df, F.col("x"), F.col("g") == 1))
    assert (r["t"], r["df"]) == (-1.690641, 6)
    an = spark.createDataFrame([(float(v), g) for g, vs in (("a", (1, 2, 3)), ("b", (2, 3, 4)), ("c", (5, 6, 7))) for v in vs], "x double, g string")
    assert one(S.anova(an, F.col("x"), "g")) == {"df_between": 2, "df_within": 6, "f": 13.0}
    ols = spark.createDataFrame(list(zip([1, 1, 2, 3, 3], [20, 30, 40, 25, 50], [80, 90, 30, 10, 12], strict=True)), "a int, b int, y int")
    got = {r["term"]: (r["coef"], r["r2"]) for r in S.ols(ols, "y", ["a", "b"]).collect()}
    assert got == {"const": (120.8673, 0.947287), "a": (-36.2478, 0.947287), "b": (-0.1204, 0.947287)}


def test_tail_probabilities() -> None:
    assert abs(special.t_two_sided(2.0, 10) - 0.07338803) < 1e-6
    assert abs(special.f_upper(13.0, 2, 6) - 0.00659) < 1e-5
    assert abs(special.t_quantile(0.95, 9) - 2.262157) < 1e-4


def test_decomposition(spark) -> None:  # noqa: ANN001
    season = [1.0, -1.0, 2.0, -2.0]
    df = spark.createDataFrame([("s", t, t + season[(t - 1) % 4]) for t in range(1, 13)], "series string, t int, y double")
    rows = T.decompose(df, "y", 4).orderBy("t").collect()
    assert [r["trend"] for r in rows] == [None, None, *[float(v) for v in range(3, 11)], None, None]
    assert [round(r["seasonal"], 9) for r in rows[:4]] == season
    assert all(abs(r["resid"]) < 1e-9 for r in rows if r["resid"] is not None)


@pytest.mark.parametrize(("b", "c", "p"), [(12, 0, 0.0005), (11, 1, 0.0063), (6, 0, 0.0312), (3, 0, 0.25), (6, 3, 0.5078), (0, 0, 1.0)])
def test_mcnemar(spark, b, c, p) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(True, False)] * b + [(False, True)] * c + [(True, True)], "a boolean, b boolean")
    assert abs(one(E.mcnemar(df, F.col("a"), F.col("b")))["p"] - p) < 6e-5


def test_mcnemar_counts_all_discordant_labels(spark, tmp_path) -> None:  # noqa: ANN001
    labels = [(i, 1, 0) for i in range(1, 1300)] + [(i, 0, 1) for i in range(2000, 3200)] + [(4000, 1, 1), (4001, 0, 0), (4002, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    r = one(retrieval.mcnemar(spark, str(tmp_path)))
    exact = sum(math.comb(2499, i) for i in range(1201)) / (1 << 2498)
    assert (r["b"], r["c"]) == (1299, 1200) and abs(r["p"] - exact) < 1e-6


def test_kappa(spark) -> None:  # noqa: ANN001
    rows = [("f", "f")] * 20 + [("f", "u")] * 5 + [("u", "f")] * 10 + [("u", "u")] * 15 + [("unsure", "f")]
    r = one(E.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b"))
    assert (r["n"], r["observed"], r["expected"], r["kappa"], r["band"]) == (50, 0.7, 0.5, 0.4, "fair")


def test_citations(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([("x [1] y [9] [1]",)], "a string").select(E.citations(F.col("a"), F.lit(8)).alias("c"))
    assert (df.first()["c"]["cited"], df.first()["c"]["invalid"]) == ([1, 9], [9])


def test_rrf(spark) -> None:  # noqa: ANN001
    run = lambda ids: spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(ids)], "qid int, rank int, id string")
    rows = R.rrf({"dense": run("abc"), "bm25": run("bda")}).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in rows] == [("b", 0.45), ("a", 0.416667), ("d", 0.2), ("c", 0.166667)]
    assert rows[0]["engines"] == "bm25+dense"


def test_bm25(spark) -> None:  # noqa: ANN001
    docs = spark.createDataFrame([(1, "chip supply risk"), (2, "chip act"), (3, "revenue growth chip chip"), (4, "market risk")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "chip risk")], "qid long, query string")
    got = {r["id"]: r["score"] for r in R.bm25(docs, q).collect()}
    for k, v in {1: 0.116285, 2: 0.137976, 3: 0.150875, 4: 0.0}.items():
        assert abs(got[k] - v) < 2e-6
    assert [r["id"] for r in R.bm25(docs, q, 2, F.col("doc_id") > 2).orderBy("rank").collect()] == [3, 4]


def test_tfidf(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, ["good", "film"]), (2, ["bad", "film", "bad"])], "doc_id long, w array<string>")
    got = {(r["id"], r["term"]): r["weight"] for r in R.tfidf(df, F.col("w"), min_df=1).collect()}
    assert ("good film" in {t for _, t in got}) and abs(sum(v * v for (d, _), v in got.items() if d == 1) - 1) < 1e-5


@pytest.mark.parametrize(("n", "want"), [(0, []), (200, [200]), (1500, [1500, 200][:1]), (1600, [1500, 300]), (2900, [1500, 1500, 300]), (3200, [1500, 1500, 600])])
def test_fixed_chunks(spark, n, want) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, "x" * n)], "doc_id long, text string")
    assert [len(r["text"]) for r in D.fixed_chunks(df, "doc_id", "text").orderBy("chunk_index").collect()] == want


def _sentences(spark, texts: list) -> list:  # noqa: ANN001
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["s"] for r in df.select("i", D.sentences(F.col("t")).alias("s")).orderBy("i").collect()]


def test_sentences(spark) -> None:  # noqa: ANN001
    cases = {
        "We paid Mr. Smith. Then Acme Inc. left. ok": ["We paid Mr. Smith.", "Then Acme Inc. left. ok"], "": [], " \n ": [], None: [],
        "It ended.  Then! “Why?” (Yes) done? a b": ["It ended.", "Then!", "“Why?” (Yes) done? a b"], "In the U.S.\n\nCongress met. No": ["In the U.S. Congress met.", "No"],
        "risks: • one •two\u2003• three": ["risks:", "• one", "•two", "• three"], "Acme Corp.•One": ["Acme Corp. •One"], "It is zinc. Next": ["It is zinc.", "Next"], "10inc. Next": ["10inc. Next"],
        "a.inc. Next": ["a.inc.", "Next"], "etc.. Next": ["etc.. Next"],
    }
    assert _sentences(spark, list(cases)) == list(cases.values())


def test_chunk_bounds_are_greedy_with_the_longest_overlap() -> None:
    rng = random.Random(5)
    for _ in range(300):
        n = [rng.choice([5, 60, 150, 400, 900, 1490, 1999, 2000]) if rng.random() < 0.5 else rng.randint(1, 300) for _ in range(rng.randint(0, 40))]
        bounds = D.chunk_bounds(n)
        size = lambda a, b: sum(n[a:b]) + max(0, b - a - 1)  # noqa: B023, E731
        assert [b for _, b in bounds][-1:] == ([len(n)] if n else []) and [a for a, _ in bounds][:1] == ([0] if n else [])
        for k, (a, b) in enumerate(bounds):
            new = bounds[k - 1][1] if k else 0
            assert a <= new < b and (size(a, b) < D.TARGET or b == new + 1)
            assert b == len(n) or size(a, b + 1) >= D.TARGET  # the next part did not fit
            if k:
                fits = [c for c in range(bounds[k - 1][0], new + 1) if size(c, new) <= D.OVERLAP or c == new]
                assert a == (min(fits) if size(min(fits), new) + (min(fits) < new) + n[new] <= D.MAXIMUM else new)


def test_structural_chunks_are_bounded(spark) -> None:  # noqa: ANN001
    parts = [f"Sentence number {i} is about so long and no longer than this." for i in range(120)]
    chunks = D.pack_sentences(parts)
    assert all(len(c) <= D.MAXIMUM for c in chunks) and len(chunks) > 4
    assert set(parts) == {p for c in chunks for p in parts if p in c}
    assert D.pack_sentences([]) == [] and D.pack_sentences(["a" * 1490, "b" * 20]) == ["a" * 1490 + " " + "b" * 20]
    df = spark.createDataFrame([(1, " ".join(parts)), (2, None), (3, ""), (4, "x" * 4500)], "id long, text string")
    rows = [(r["id"], r["chunk_index"], r["text"]) for r in D.structural_chunks(df, "id", "text").orderBy("id", "chunk_index").collect()]
    assert [t for i, _, t in rows if i == 1] == chunks and [len(t) for i, _, t in rows if i == 4] == [2000, 2000, 500] and {i for i, _, _ in rows} == {1, 4}


def test_sections(spark) -> None:  # noqa: ANN001
    toc = " ".join(f"Item {i}. Title" for i in D.ITEMS[:12])
    body = "".join(f"\nItem {i}. " + "word " * 120 for i in ("1", "1A", "7"))
    text = f"{toc} {'x' * 500} {body} see Item 3. for more"
    df = spark.createDataFrame([(0, text), (1, "no headings"), (2, None), (3, f"{'ITEM 1 a: ' + 'w' * 500} refer to “Item 7. more {'w' * 500} item 1C - {'w' * 500}")], "id long, text string")
    rows = D.section_split(df, "id", "text").orderBy("id", "start").collect()
    got = [r for r in rows if r["id"] == 0]
    assert [g["item"] for g in got] == ["1", "1A", "7"] and all(a["stop"] == b["start"] for a, b in zip(got, got[1:]))  # noqa: B905
    assert all(r["body"] == text[r["start"] : r["stop"]].strip() for r in got)
    assert [(r["id"], r["item"], r["parsed_by"]) for r in rows if r["id"] in (1, 2)] == [(1, "FULL", "size_fallback"), (2, "FULL", "size_fallback")]
    assert [(r["item"], r["parsed_by"]) for r in rows if r["id"] == 3] == [("1A", "items"), ("1C", "items")]


def test_best_chain_by_brute_force() -> None:
    rng = random.Random(6)
    for _ in range(400):
        n = rng.randint(1, 9)
        pos = np.array(sorted(rng.sample(range(3000), n)))
        rank = np.array([rng.randint(0, 6) for _ in range(n)])
        end = int(pos[-1]) + rng.choice([10, 900])
        worth = {}
        for mask in range(1, 1 << n):
            chain = [i for i in range(n) if mask >> i & 1]
            if all(rank[a] < rank[b] for a, b in zip(chain, chain[1:])):  # noqa: B905
                stops = [*pos[chain[1:]], end]
                worth[tuple(chain)] = (sum(b - pos[a] >= D.SECTION_MIN for a, b in zip(chain, stops, strict=True)), len(chain))
        assert worth[tuple(D.best_chain(pos, rank, end))] == max(worth.values())
    pos, rank = np.array([*range(0, 1200, 100), 5000]), np.array([*range(12), 0])
    assert D.without_contents_page(pos, rank).tolist() == [False] * 12 + [True]
    assert D.without_contents_page(pos[:9], rank[:9]).all() and len(D.without_contents_page(pos[:0], rank[:0])) == 0


def test_context_header(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([("AB", 2024, "1A"), ("AB", 2023, None), ("AB", 2023, "X")], "t string, y int, i string")
    got = [r[0] for r in df.select(D.context_header(F.col("t"), F.col("y"), F.col("i"))).collect()]
    assert got == ["AB fiscal year 2024 10-K, Item 1A. Risk Factors", "AB fiscal year 2023 10-K, full filing", "AB fiscal year 2023 10-K, Item X"]


def test_windows_are_clamped(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([("a" * 150,), ("".join(chr(97 + i % 26) for i in range(200)),)], "t string").select(D.windows(F.col("t")).alias("w"))
    short, long = (r["w"] for r in df.collect())
    assert short == ["a" * 150] and all(len(w) == 160 for w in long) and len(long) == 1


def test_content_match_long_and_short(spark) -> None:  # noqa: ANN001
    docs = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh"), (2, "zz aa bb"), (3, "nothing here at all today")], "id long, body string")
    win = spark.createDataFrame([(7, "a bb cc dd ee ff g"), (8, "aa bb")], "gold long, window string")
    assert sorted(map(tuple, E.content_match(docs, win).collect())) == [(7, 1), (8, 1), (8, 2)]


def test_text_rules(spark) -> None:  # noqa: ANN001
    get = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c.alias("y")).first()["y"]
    x = F.col("x")
    assert get(X.html_text(x), '<script>var t="</p>";</script><p>a&amp;b</p>') == "a&b"
    assert [get(X.least_years(x, r"(\d+)\s*(?:to|yrs?|years?|anos)"), v) for v in ("3 to 5 years", "25 years", "7 yrs or 2 anos", "")] == [3, None, 2, None]
    assert get(X.normalize(x), None) == "" and get(X.normalize(x), "<b>Ñandú</b>  &amp; co") == " nandu & co"  # a tag is a space, and ends are not trimmed
    rules = [("latin america|mexico", "LATAM"), ("new york|america", "US/Canada"), ("berlin", "Europe")]
    assert [get(X.first_match(F.lower(x), rules, "Other"), v) for v in ("Remote, Mexico", "Berlin; New York, NY", "Latin America", "")] == ["LATAM", "US/Canada", "LATAM", "Other"]
    assert get(X.lookup(x, {"sr": "senior"}, [("jun", "junior")]), " SR ") == "senior" and get(X.lookup(x, {}, [("jun", "junior")]), "x") is None


@pytest.mark.parametrize(("counts", "want"), [((0, 0), "none"), ((1, 0), "weak"), ((3, 1), "a"), ((3, 2), "mixed"), ((2, 2), "mixed")])
def test_task_profile(spark, counts, want) -> None:  # noqa: ANN001
    vocab = {"a": ["a1", "a2", "a3"], "b": ["b1", "b2", "b3"]}
    text = " ".join([*vocab["a"][: counts[0]], *vocab["b"][: counts[1]], "z" * 90])
    df = spark.createDataFrame([(text,)], "x string").select(X.task_profile(F.col("x"), vocab, F.lit("")).alias("p"))
    assert df.first()["p"]["profile"] == want


def test_review_override(spark) -> None:  # noqa: ANN001
    rows = spark.createDataFrame([(i, "old") for i in range(4)], "id int, label string")
    sheet = spark.createDataFrame([(0, "new", " SI "), (1, "new", "no"), (2, None, None)], "id int, correction string, verdict string")
    got = {r["id"]: (r["label"], r["origin"]) for r in I.review_override(rows, sheet, "id", {"new"}).collect()}
    assert got == {0: ("new", "confirmado"), 2: ("old", "clasificador"), 3: ("old", "clasificador")}
    with pytest.raises(Exception, match="unknown correction"):
        I.review_override(rows, spark.createDataFrame([(0, "??", "")], "id int, correction string, verdict string"), "id", {"new"}).collect()


def test_latest_and_last_wins(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(7, 1, "a"), (7, 2, "b"), (8, 1, "c")], "k int, seq int, v string").repartition(3)
    assert {r["k"]: r["v"] for r in I.latest(df, ["k"], ["seq"], ["v"]).collect()} == {7: "b", 8: "c"}


def test_stream_equals_batch(spark, tmp_path) -> None:  # noqa: ANN001
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = W.hourly_counts(stream, late="3650 days").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, W.hourly_counts(events).collect()))
    for _ in range(2):
        W.append_new(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), ["event_id"], str(tmp_path / "ck")).awaitTermination(120)
    assert VersionedTable(spark, str(tmp_path / "out"), ["event_id"]).read().count() == events.select("event_id").distinct().count()


def test_dense_topk_takes_every_twentieth_vector(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(R, "QUERY_BYTES", 100)
    monkeypatch.setattr(R, "ROWS", 9)
    rng = random.Random(3)
    x = {i: [rng.gauss(0, 1) for _ in range(6)] for i in range(130)}
    spark.createDataFrame(list(x.items()), "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["qid"], r["rank"]): r["id"] for r in retrieval.dense_topk(spark, str(tmp_path)).collect()}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    want = {}
    for q in range(0, 130, 20):
        best = sorted(x, key=lambda i: (-round(dot(x[q], x[i]) / math.sqrt(dot(x[q], x[q]) * dot(x[i], x[i])), 6), i))  # noqa: B023
        want |= {(q, k + 1): i for k, i in enumerate(best[:8])}
    assert got == want


def test_dense_ties_and_odd_vectors(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [1.0, 0.0, 0.0]), (7, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 0.0]), ("c", None)], "qid string, v array<double>")
    assert sorted(map(tuple, R.dense(df, q, 2).collect())) == [("a", 1, 1, 1.0), ("a", 2, 2, 1.0)]
    assert R.dense(df.limit(0), q).count() == R.dense(df, q.limit(0)).count() == 0


def test_best_stretch_by_brute_force(spark) -> None:  # noqa: ANN001
    rng = random.Random(9)
    for _ in range(200):
        places = sorted(rng.sample(range(2000), rng.randint(0, 30)))
        width = rng.choice([40, 120, 321])
        starts = [max(0, p - width // 4) for p in places] or [0]
        shown = [sum(a <= p < a + width for p in places) for a in starts]
        assert R.best_stretch(np.array(places, dtype=np.int64), width) == starts[shown.index(max(shown))]
    text = "the filler words " * 40 + "net  revenue grew\n in cloud revenue " + "other words " * 60
    df = spark.createDataFrame([(text, "what is the cloud revenue"), ("short  text", "x"), (None, "x"), (text, "nothing")], "t string, q string")
    got = [r[0] for r in df.select(R.best_window(df, "t", "q", 80)).collect()]
    flat = " ".join(text.split())
    assert got[0] in flat and got[0].count("revenue") == 2 and "cloud" in got[0] and got[1:] == ["short text", None, flat[:80]]


def test_retrievers_by_name(spark) -> None:  # noqa: ANN001
    rows = [(1, "en", "solar power plants", [1.0, 0.0]), (2, "en", "wind power and solar", [0.6, 0.8]), (3, "fr", "solar solar", [0.0, 1.0])] + [(10 + i, "de", f"filler {i}", [0.0, -1.0]) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, e array<double>")
    corpus = R.Corpus(docs, docs.select(F.col("doc_id").alias("vec_id"), F.col("e").alias("embedding")))
    q = spark.createDataFrame([(9, "solar", [0.0, 1.0])], "qid long, query string, v array<double>")
    ids = lambda name, scope=None: [r["id"] for r in R.search(name, corpus, q, 3, scope).orderBy("rank").collect()]
    assert ids("dense") == [3, 2, 1] and ids("dense", {"lang": "en", "x": None}) == [2, 1] and set(ids("bm25", {"lang": "en"})) == {1, 2} and ids("bm25")[0] == ids("hybrid")[0] == 3
    with pytest.raises(ValueError, match="no retriever"):
        R.search("other", corpus, q)


def test_stop_words_leave_by_one_expression(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([("The theory of <br/>it isn't 3-D; ANY\tanyone\n a2z as2",), (None,)], "t string")
    a, b = df.select(X.clean_words(F.col("t")), X.tokens(F.col("t"))).collect()
    assert list(a) == [["theory", "isnt", "anyone"], ["theory", "br", "isn", "t", "3", "d", "any", "anyone", "a2z", "as2"]] and list(b) == [[], []]


def test_ranks_of_a_large_order_do_not_depend_on_partitions(spark) -> None:  # noqa: ANN001
    n = 600_000
    base = spark.range(n).selectExpr("id", "cast(pmod(xxhash64(id), 1000) as double) / 7 as x", "uuid() is null as other", "cast(id % 97 as string) as note")
    want = {}
    for i, r in enumerate(base.orderBy(F.desc("x"), "id").select("id").toLocalIterator()):
        want[r["id"]] = i + 1
    for df in (base, base.repartition(13)):
        out = ranking.ranked_sums(df, [("x", True), ("id", False)], F.lit(1))
        got = {r["id"]: (r["pos"], r["run"]) for r in out.select("id", "note", "pos", "run").collect()}
        assert len(got) == n and all(got[i] == (p, p) for i, p in want.items())
    assert ranking.ranked_sums(base.limit(0), [("x", False)], F.lit(1)).count() == 0


def test_auc_of_many_distinct_scores(spark) -> None:  # noqa: ANN001
    df = spark.range(1_000_000).selectExpr("pmod(xxhash64(id), 1000003) / 1000003.0 as s", "pmod(xxhash64(id, 5), 100) < 20 + 30 * pmod(xxhash64(id), 1000003) / 1000003.0 as y")
    got = K.roc_auc(df, F.col("y"), F.col("s")).first()
    rows = np.array(df.selectExpr("s", "cast(y as int) as y").collect(), dtype=float)
    values, at = np.unique(rows[:, 0], return_inverse=True)
    p, q = np.bincount(at, rows[:, 1]), np.bincount(at, 1 - rows[:, 1])
    assert abs(got["auc"] - round((p * (np.cumsum(q) - q / 2)).sum() / (p.sum() * q.sum()), 6)) < 2e-6


def test_quantiles_are_exact(spark) -> None:  # noqa: ANN001
    df = spark.range(150_000).selectExpr("cast(pmod(xxhash64(id), 90001) as double) as a", "if(id % 3 = 0, 5, id % 1000) as b", "cast(null as double) as c", "if(id = 7, double('nan'), id) as d")
    got = ranking.quantiles(df, {c: [0.0, 0.25, 0.5, 0.333, 1.0] for c in "abcd"})
    rows = np.array([[float("nan") if v is None else v for v in r] for r in df.collect()], dtype=float)
    for i, c in enumerate("abd"):
        x = rows[:, "abcd".index(c)]
        assert np.allclose(got[c], np.quantile(x[~np.isnan(x)], [0.0, 0.25, 0.5, 0.333, 1.0]), rtol=0, atol=1e-9), c
    assert got["c"] == [None] * 5


def test_grouped_quantiles_are_exact(spark, monkeypatch) -> None:  # noqa: ANN001
    df = spark.range(40_000).selectExpr("if(id % 5 = 4, null, id % 5) as k", "if(id % 11 = 0, null, if(id % 3 = 0, 2.5, cast(pmod(xxhash64(id), 777) as double))) as x")
    ps = [0.0, 0.25, 0.5, 0.9, 1.0]
    rows: dict = {}
    for r in df.collect():
        if r["x"] is not None:
            rows.setdefault(r["k"], []).append(r["x"])
    for limit in (1_000_000, 100):
        monkeypatch.setattr(ranking.few, "__defaults__", (limit,))
        got = {r["k"]: (r["n"], r["q"]) for r in ranking.quantiles_by(df, ["k"], "x", ps).collect()}
        assert set(got) == set(rows) and all(got[k][0] == len(v) and np.allclose(got[k][1], np.quantile(v, ps), atol=1e-9) for k, v in rows.items())
        assert ranking.quantiles_by(df.limit(0), ["k"], "x", ps).count() == 0
        one = P.describe(df, ["x"]).first()
        assert (one["q25"], one["q50"], one["q75"]) == tuple(np.round(np.quantile(np.concatenate(list(map(np.array, rows.values()))), [0.25, 0.5, 0.75]), 4))
    assert P.select_by(spark.createDataFrame([(1, 2.0, "x", "y")], "a_i int, a_d double, a_s string, b string"), ("number",), "a_") == ["a_i", "a_d"]


def test_studentised_range_and_other_tails() -> None:
    for q, k, df, p in ((3.877, 3, 10, 0.05), (3.958, 4, 20, 0.05), (3.314, 3, 1e6, 0.05), (5.270, 3, 10, 0.01)):  # of published tables
        assert abs(special.range_upper(q, k, df) - p) < 3e-4 * p / 0.05 + 1e-4
    assert abs(special.range_upper(2.5 * math.sqrt(2), 2, 17) - special.t_two_sided(2.5, 17)) < 1e-5
    assert abs(special.range_quantile(0.95, 3, 10) - 3.877) < 2e-3
    assert abs(special.chi2_upper(3.841459, 1) - 0.05) < 1e-6 and abs(special.chi2_upper(18.307, 10) - 0.05) < 1e-5 and special.chi2_upper(0, 3) == 1
    assert abs(special.normal_two_sided(1.959964) - 0.05) < 1e-6
    assert abs(special.adf_p(-2.86) - 0.05) < 2e-3 and abs(special.adf_p(-3.43) - 0.01) < 1e-3 and special.adf_p(5) == 1 and special.adf_p(-40) == 0  # its critical values


def test_tukey_ols_and_logit_tables(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(3)
    n = 400
    x, z = rng.normal(size=n), rng.integers(0, 2, n)
    y = 2 + 0.5 * x - z + rng.normal(size=n)
    won = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + x - 0.5 * z)))).astype(int)
    df = spark.createDataFrame(list(zip(x.tolist(), z.tolist(), y.tolist(), won.tolist(), ["abc"[i % 3] for i in range(n)], strict=True)), "x double, z int, y double, won int, g string")
    a = np.column_stack((np.ones(n), x, z))
    coef = np.linalg.solve(a.T @ a, a.T @ y)
    rss = ((y - a @ coef) ** 2).sum()
    se = np.sqrt(rss / (n - 3) * np.diag(np.linalg.inv(a.T @ a)))
    rows = S.ols_summary(df, "y", ["x", "z"]).collect()
    assert [r["term"] for r in rows] == ["const", "x", "z"] and np.allclose([r["coef"] for r in rows], coef, atol=1e-4) and np.allclose([r["std_err"] for r in rows], se, atol=1e-4)
    r2 = 1 - rss / ((y - y.mean()) ** 2).sum()
    assert abs(rows[0]["f"] - (r2 / 2) / ((1 - r2) / (n - 3))) < 1e-3 and abs(rows[0]["high"] - rows[0]["low"] - 2 * 1.96595 * se[0]) < 3e-4
    got = S.logit_summary(df, "won", ["x", "z"]).collect()
    b = np.array([r["coef"] for r in got])
    p = 1 / (1 + np.exp(-a @ b))
    cov = np.linalg.inv((a * (p * (1 - p))[:, None]).T @ a)
    ll, null = (won * np.log(p) + (1 - won) * np.log(1 - p)).sum(), n * (won.mean() * np.log(won.mean()) + (1 - won.mean()) * np.log(1 - won.mean()))
    assert np.abs(a.T @ (won - p)).max() < 1e-6 and np.allclose([r["std_err"] for r in got], np.sqrt(np.diag(cov))) and abs(got[0]["pseudo_r2"] - (1 - ll / null)) < 1e-9
    pairs = S.tukey_hsd(df, F.col("y"), "g").collect()
    assert [(r["group_1"], r["group_2"]) for r in pairs] == [("a", "b"), ("a", "c"), ("b", "c")] and all(r["low"] < r["diff"] < r["high"] and r["reject"] == (r["low"] > 0 or r["high"] < 0) for r in pairs)


def test_bootstraps(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(5)
    x = np.round(rng.gamma(2, 10, 800), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    a, b = ({r["statistic"]: (r["low"], r["high"]) for r in S.bootstrap_ci(d, "x", 2000).collect()} for d in (df, df.repartition(7)))
    assert all(np.allclose(a[k], b[k]) for k in ("mean", "median"))
    se = x.std() / np.sqrt(len(x))
    assert np.allclose(a["mean"], (x.mean() - 1.96 * se, x.mean() + 1.96 * se), atol=0.25 * se) and a["median"][0] <= np.median(x) <= a["median"][1]
    mean, mid = S.bootstrap(df, "x", S.weighted_mean, 2000).first(), S.bootstrap(df, "x", S.weighted_quantile, 2000).first()
    assert abs(mean["estimate"] - x.mean()) < 1e-9 and np.allclose((mean["low"], mean["high"]), a["mean"], atol=0.25 * se) and np.allclose((mid["low"], mid["high"]), a["median"], atol=0.6)
    assert mean["bags"] == 1 and tuple(S.bootstrap(df.limit(0), "x", S.weighted_mean).first()) == (None,) * 4


def test_weighted_statistics() -> None:
    rng = np.random.default_rng(3)
    x, w = np.unique(rng.integers(0, 50, 400), return_counts=True)
    plain = np.repeat(x, w)
    assert abs(S.weighted_mean(x, w) - plain.mean()) < 1e-9 and S.weighted_quantile(x, w) == plain[199] and S.weighted_quantile(x, w, 1.0) == plain[-1]
    assert abs(S.weighted_trimmed_mean(x, w) - plain[40:360].mean()) < 1e-9 and S.weighted_trimmed_mean(np.array([7.0]), np.array([3])) == 7.0


def test_little_bootstraps_agree_with_the_whole_one(spark) -> None:  # noqa: ANN001
    """Forty bags of 500 rows: bounds are within a tenth of the interval's width of those of resampled tables."""
    rng = np.random.default_rng(8)
    x = np.round(np.concatenate((rng.lognormal(1, 0.6, 13_000), np.full(7_000, 2.5))), 3)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.permutation(x)})).union(spark.sql("select cast(null as double) union all select double('nan')"))
    values, counts = np.unique(x, return_counts=True)
    for stat in (S.weighted_mean, S.weighted_trimmed_mean):
        full = np.percentile([stat(values, w) for w in rng.multinomial(len(x), counts / len(x), 2000)], [2.5, 97.5])
        got = S.bootstrap(df, "x", stat, 4000, room=500).first()
        width = full[1] - full[0]
        assert got["bags"] == 40 and abs(got["estimate"] - stat(values, counts)) < 0.1 * width and np.abs(np.array([got["low"], got["high"]]) - full).max() < 0.1 * width, (full, got)
        assert got == S.bootstrap(df.repartition(9), "x", stat, 4000, room=500).first()


def test_every_row_is_in_one_bag() -> None:
    for n, bags in ((3, 10), (10, 10), (100_000, 7)):
        at, each = S._dealt(1.5, n, bags, 42)
        assert each.sum() == n and len(set(at)) == len(at) and at.max() < bags and (each > 0).all()
        assert (at == S._dealt(1.5, n, bags, 42)[0]).all()


def test_forecasts_follow_a_seasonal_series(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(1)
    t = np.arange(96)
    y = np.exp(4 + 0.01 * t + 0.2 * np.sin(2 * np.pi * t / 12) + 0.01 * rng.normal(size=96))
    df = spark.createDataFrame([("s", f"{2000 + i // 12}-{i % 12 + 1:02}", float(v)) for i, v in enumerate(y)], "series string, t string, y double")
    got = {r["model"]: r for r in T.holdout_scores(df).collect()}
    assert got["sarima"]["mape"] < 4 < got["arima"]["mape"] and got["sarima"]["mae"] < got["naive"]["mae"]
    path, sd = T.arima_path(np.log(y[:84]), 12, 12)
    assert np.abs(path - np.log(y[84:])).max() < 0.08 and (np.diff(sd) > 0).all()
    assert T.arima_forecast(df.limit(5)).count() == 0


def test_texts_with_rare_characters_and_entities(spark) -> None:  # noqa: ANN001
    texts = ["plain Text", "caf\u00e9 &amp; &copy; &notin; &#8364;", "ﬁne \u00bd ① Ａ", "a\x1fb\u2003c &nbsp;", "Ｘ&amp;lt;y <b>Z</b>", None, "  é  ", "&amp;copy;", "İstanbul ß"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [tuple(r) for r in df.select("i", X.normalize(F.col("t")), X.unescape(F.col("t"))).orderBy("i").collect()]
    assert [g[1] for g in got] == ["" if t is None else X.normalized(t) for t in texts]
    assert got[1][1] == "cafe & © ∈ €" and got[2][1] == "fine 1⁄2 1 a" and got[7][1:] == ("&copy;", "&copy;") and got[1][2] == "café & © ∉ €"
    assert [r[0] for r in df.select(X.slug(F.col("t"))).orderBy("i").limit(2).collect()] == ["plain-text", "caf-amp-copy-notin-8364"]


def test_lemmas(spark) -> None:  # noqa: ANN001
    known = frozenset("church bus wolf box quiz man city dog glass leave wolve".split())
    words = ["churches", "buses", "wolves", "boxes", "quizzes", "men", "cities", "dogs", "glass", "mice", "unknowns", "leaves"]
    df = spark.createDataFrame([(words,), (None,)], "w array<string>")
    got = [r[0] for r in df.select(X.lemmatise(F.col("w"), known, {"mice": "mouse"})).collect()]
    assert got == [["church", "bus", "wolf", "box", "quizzes", "man", "city", "dog", "glass", "mouse", "unknowns", "leave"], None]


def test_cleaning_by_joins_equals_word_by_word(spark) -> None:  # noqa: ANN001
    rng = random.Random(2)
    stems = "church bus wolf box quiz man city dog glass leave wolve axe fly class".split()
    known, odd = frozenset(stems), {"mice": "mouse", "dogs": "hound"}
    pool = [s + e for s in stems for e in ("", "s", "es", "ves", "men")] + ["cities", "flies", "wolves", "women", "mice", "unknowns"]
    texts: list[str | None] = [None, "", "<b>The</b> 12 of", *[" ".join(rng.choice(pool).title() + rng.choice(["", ",", "<br/>"]) for _ in range(rng.randint(1, 40))) for _ in range(40)]]
    rows = [*enumerate(texts), (None, "Churches and mice"), (7, "boxes boxes dogs"), (7, "boxes boxes dogs")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3).withColumn("clean", F.lit("x")).withColumn("word", F.lit(1))
    lexicon = spark.createDataFrame([(w,) for w in [*stems, None]], "word string")
    words = dict(df.select("text", X.clean_words(F.col("text"))).distinct().collect())
    want = sorted(str((i, " ".join(X.lemma(w, known, odd) for w in words[t]))) for i, t in rows)
    assert sorted(str(tuple(r)) for r in cleaning.clean_text(df, "id", "text", lexicon, odd).collect()) == want
    own = frozenset(w for ws in words.values() for w in ws)
    assert sorted(str(tuple(r)) for r in cleaning.clean_text(df, "id", "text").collect()) == sorted(str((i, " ".join(X.lemma(w, own, {}) for w in words[t]))) for i, t in rows)
    assert cleaning.clean_text(df.limit(0), "id", "text", lexicon).count() == 0
    arrays = spark.createDataFrame([(1, None, "k"), (2, ["dogs", None], "l")], "id int, ws array<string>, kept string")
    some = cleaning.changed_words(spark.createDataFrame([("dogs",), (None,)], "word string"), lexicon)
    assert sorted(map(tuple, cleaning.lemmatised(arrays, "id", "ws", some).collect())) == [(1, None, "k"), (2, ["dog", None], "l")]


def test_citations_names_and_maps(spark) -> None:  # noqa: ANN001
    rows = [([1, 3, 9], ["gold  text here", "b", "other"], ["gold text"]), ([2], ["a", "b"], []), ([7], ["a"], ["a"])]
    df = spark.createDataFrame(rows, "c array<int>, g array<string>, w array<string>")
    got = [tuple(r) for r in df.select(E.cited_texts(F.col("c"), F.col("g")), E.citation_precision(F.col("c"), F.col("g"), F.col("w"))).collect()]
    assert got == [(["gold  text here", "other"], 0.5), (["b"], None), ([], None)]
    names = {"AB": ["Alpha Beta", "AlphaB"], "CD": ["Cedar"]}
    texts = spark.createDataFrame([("what did alpha beta and CEDAR say",), ("cedar?",), ("nobody",), (None,)], "t string")
    assert [r[0] for r in texts.select(E.named(F.col("t"), names)).collect()] == [["AB", "CD"], ["CD"], ["AB", "CD"], ["AB", "CD"]]
    assert spark.sql("select map('a', 1, 'b', null) as m").select(I.without_nulls(F.col("m"))).first()[0] == {"a": 1}


def test_browse(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(i, f"text {i} " + ("needle in hay" if i % 5 == 0 else "hay") + " end") for i in range(50)], "id int, t string")
    assert [r["id"] for r in D.browse(df, "id", "t", skip=3, limit=4).collect()] == [3, 4, 5, 6]
    hits = D.browse(df, "id", "t", where=F.col("id") > 4, grep="need?le", around=8).collect()
    assert [r["id"] for r in hits] == list(range(5, 50, 5)) and all("needle" in r["hit"] and len(r["hit"]) <= 16 for r in hits)
    a, b = ([r["id"] for r in D.browse(x, "id", "t", shuffle=3, limit=10).collect()] for x in (df, df.repartition(7)))
    assert a == b != sorted(a)


def test_silhouette_and_sweep(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    label = np.repeat([0, 1, 2], 60)
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(len(x)):
        inside = gap[i][(label == label[i]) & (np.arange(len(x)) != i)].mean()
        outside = min(gap[i][label == c].mean() for c in range(3) if c != label[i])
        want.append((outside - inside) / max(inside, outside))
    assert abs(C.silhouette(x, label) - np.mean(want)) < 1e-9 and C.silhouette(x[:5], np.zeros(5)) == 0.0
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    rows = {r["k"]: r for r in C.cluster_sweep(df, "id", ["a", "b"], ks=(2, 3, 5), starts=2).collect()}
    assert max(rows, key=lambda k: rows[k]["silhouette"]) == 3 and rows[2]["inertia"] > rows[3]["inertia"] > rows[5]["inertia"]


def test_models_and_streamed_scores(spark, tmp_path) -> None:  # noqa: ANN001
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("good fine nice".split() if i % 2 else "bad poor sad".split()) for _ in range(6)), float(i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label double")
    model = models.text_pipeline(models.naive_bayes(), 64).fit(df)
    sinks.save_model(model, f"{tmp_path}/m")
    df.select("doc_id", "text").repartition(4).write.parquet(f"{tmp_path}/in")
    scored = W.run_to_table(W.score(W.read_stream(spark, f"{tmp_path}/in", files=2), sinks.load_model(f"{tmp_path}/m")), "append")
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == 80 and all(got[i]["prediction"] == y and 0.5 <= got[i]["confidence"] <= 1 for i, _, y in rows)
    one = models.fold_summary(models.fold_auc(models.hashed_words(df, 64).select("doc_id", "label", "features"), {"nb": models.naive_bayes()}, folds=3)).first()
    assert (one["mean_auc"], one["std_auc"]) == (1.0, 0.0)
    table = models.assembled(df.withColumn("n", F.pmod(F.xxhash64("doc_id"), F.lit(7)).cast("double")).withColumn("y", F.col("label")), ["n", "y"])
    assert models.importances(models.forest(trees=5).fit(table), ["n", "y"], spark).first()["feature"] == "y"


def test_streamed_latest_rows_and_sliding_windows(spark, tmp_path) -> None:  # noqa: ANN001
    rows = [(k, at, f"v{k}.{at}") for k in range(5) for at in range(8)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "k int, at int, v string").repartition(4).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        W.latest_per_key(W.read_stream(spark, f"{tmp_path}/in", files=1), f"{tmp_path}/out", ["k"], ["at"], f"{tmp_path}/ck").awaitTermination(120)
        assert sorted(map(tuple, VersionedTable(spark, f"{tmp_path}/out", ["k"]).read().collect())) == [(k, 7, f"v{k}.7") for k in range(5)]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    got = W.run_to_table(W.sliding_counts(W.read_stream(spark, f"{tmp_path}/events", files=1), "2 hours", "1 hour", late="3650 days"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, W.sliding_counts(events, "2 hours", "1 hour").collect()))
    assert W.run_to_table(W.read_stream(spark, f"{tmp_path}/events").where("false"), "append").count() == 0


def test_arima_matches_published_errors(spark) -> None:  # noqa: ANN001
    """Published errors of the airline series' last year: 68.40, 95.42, 12.77 % without a season, 10.87, 14.76, 2.31 % with one."""
    got = {r["model"]: r for r in T.holdout_scores(corpora.air_passengers(spark)).collect()}
    assert abs(got["arima"]["mae"] - 68.40) < 0.02 and abs(got["arima"]["rmse"] - 95.42) < 0.02 and abs(got["arima"]["mape"] - 12.77) < 0.01
    assert abs(got["sarima"]["mae"] - 10.87) < 0.01 and abs(got["sarima"]["rmse"] - 14.76) < 0.01 and abs(got["sarima"]["mape"] - 2.31) < 0.01
    x = T.simplex(lambda p: float((p[0] - 3) ** 2 + 10 * (p[1] + 1) ** 2 + p[0] * p[1] * 0), np.zeros(2))
    assert np.allclose(x, [3, -1], atol=1e-3)
    rng = np.random.default_rng(0)
    long = np.cumsum(rng.normal(size=900)) + 100
    path, sd = T.arima_path(long, 0, 6)
    assert np.abs(path - long[-1]).max() < 3 and abs(sd[0] - 1) < 0.15


def test_filter_equals_the_density_of_all_points() -> None:
    """The filter's likelihood and forecasts are those of the joint normal of differences, gaps left out."""
    rng = np.random.default_rng(2)
    z = np.cumsum(rng.normal(size=60))
    p = np.array([0.6, 0.4])
    psi = np.array([1.0, *[(p[0] + p[1]) * p[0] ** k for k in range(400)]])
    gamma = np.array([psi[: 401 - k] @ psi[k:] for k in range(70)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(70), np.arange(70)))]
    root = np.linalg.cholesky(cov[:59, :59])
    e = np.linalg.solve(root, np.diff(z))
    want = 59 / 2 * np.log(e @ e / 59) + np.log(np.diag(root)).sum()
    got, path, sd = T.kalman(T._space(p, 0), z - z[0], 5)
    assert abs(got - want) < 1e-4
    steps = cov[59:64, :59] @ np.linalg.solve(cov[:59, :59], np.diff(z))
    assert np.abs(path - (z[-1] - z[0] + np.cumsum(steps))).max() < 1e-4 and abs(sd[0] - np.sqrt(e @ e / 59)) < 1e-4
    gaps = z.copy()
    gaps[[7, 30, 31]] = np.nan
    known = np.flatnonzero(np.isfinite(gaps))
    total = np.tril(np.ones((60, 59)), -1) @ cov[:59, :59] @ np.tril(np.ones((60, 59)), -1).T
    some = np.linalg.cholesky(total[np.ix_(known[1:], known[1:])])
    e = np.linalg.solve(some, gaps[known[1:]] - gaps[0])
    assert abs(T.kalman(T._space(p, 0), gaps - gaps[0])[0] - (len(e) / 2 * np.log(e @ e / len(e)) + np.log(np.diag(some)).sum())) < 1e-4


def test_seasonal_forecasts_with_gaps_and_short_series(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(1)
    t = np.arange(96)
    y = np.exp(4 + 0.01 * t + 0.2 * np.sin(2 * np.pi * t / 12) + 0.01 * rng.normal(size=96))
    rows = [("gaps", int(i), None if i in (20, 50, 51) else float(v)) for i, v in enumerate(y[:84])] + [("short", int(i), float(v)) for i, v in enumerate(y[:36])] + [("null", i, None) for i in range(60)]
    got = T.arima_forecast(spark.createDataFrame(rows, "series string, t int, y double")).orderBy("step").collect()
    assert {r["series"] for r in got} == {"gaps"} and np.abs(np.log([r["forecast"] for r in got]) - np.log(y[84:])).max() < 0.08
    assert all(r["low"] < r["forecast"] < r["high"] for r in got)


def _png(x: np.ndarray, filters: list[int]) -> bytes:
    """A PNG whose lines take the given filters in turn."""
    kind = {1: 0, 3: 2, 4: 6}[x.shape[2]]
    lines, h, w, c = b"", *x.shape
    p = np.zeros((h + 1, w + 1, c), dtype=int)
    p[1:, 1:] = x
    for y in range(1, h + 1):
        f = filters[y % len(filters)]
        left, up, corner = p[y, :-1], p[y - 1, 1:], p[y - 1, :-1]
        guess = left + up - corner
        near = np.stack([left, up, corner])
        paeth = np.take_along_axis(near, np.abs(near - guess).argmin(axis=0)[None], axis=0)[0]
        lines += bytes([f]) + bytes(((p[y, 1:] - [0 * left, left, up, (left + up) // 2, paeth][f]) & 255).astype(np.uint8).ravel())
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def test_images(spark, tmp_path) -> None:  # noqa: ANN001
    rng = np.random.default_rng(4)
    for c in (1, 3, 4):
        x = rng.integers(0, 256, (13, 17, c), dtype=np.uint8)
        for filters in ([0], [1], [2], [3], [4], [4, 1, 3, 0, 2]):
            assert (images.decode_png(_png(x, filters)) == x[:, :, : min(c, 3)]).all()
    plain = np.zeros((56, 56, 1), dtype=np.uint8)
    plain[20:40, 18:38] = 255
    dark, light = images.preprocessed(_png(plain, [0])), images.preprocessed(_png(255 - plain, [2]))
    assert np.allclose(dark, light) and dark.shape == (28, 28) and abs(dark.max() - (1 - 0.1307) / 0.3081) < 1e-6
    assert np.allclose(images.resized(np.full((50, 9), 7.0)), 7.0) and np.allclose(images.resized(np.eye(28)), np.eye(28))
    (tmp_path / "a.png").write_bytes(_png(plain, [1]))
    (tmp_path / "b.pgm").write_bytes(b"P5 56 56 255\n" + plain.tobytes())
    (tmp_path / "c.png").write_bytes(b"no picture")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.digits(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert np.allclose(rows["a.png"]["pixels"], dark.ravel(), atol=1e-5) and np.allclose(rows["b.pgm"]["pixels"], dark.ravel(), atol=1e-5)
    assert rows["c.png"]["pixels"] is None and rows["c.png"]["error"] == "no PNG"
    empty = spark.createDataFrame([(1, None), (2, bytearray())], "error int, content binary")
    assert [tuple(r) for r in images.digits(empty).collect()] == [(None, "empty file")] * 2


def test_boosting_in_folds_and_its_importances(spark) -> None:  # noqa: ANN001
    rng = random.Random(8)
    rows = [(i, float(x > 0.6), x, rng.random()) for i in range(300) for x in [rng.random()]]
    data = models.assembled(spark.createDataFrame(rows, "doc_id long, label double, decides double, noise double"), ["decides", "noise"]).cache()
    top = [tuple(r) for r in models.importances(models.boosted(rounds=3, share=1.0).fit(data), ["decides", "noise"], spark).collect()]
    assert top[0][0] == "decides" and top[0][1] > 0.9 and abs(sum(t[1] for t in top) - 1) < 1e-9
    aucs = models.fold_auc(data, {"boosted": models.boosted(rounds=3, share=1.0)}, folds=3)
    got = [r["auc"] for r in aucs.orderBy("fold").collect()]
    assert len(got) == 3 and min(got) > 0.97
    summary = models.fold_summary(aucs).first()
    assert summary["mean_auc"] == round(float(np.mean(got)), 4) and abs(summary["std_auc"] - float(np.std(got))) < 1e-4


def test_heading_runs_deal_documents_by_the_number_of_headings(spark, monkeypatch) -> None:  # noqa: ANN001
    heads = spark.range(3000).select((F.col("id") % 300).alias("doc"), (F.hash("id") % 5000).alias("pos"), (F.hash("id", F.lit(1)) % 9).alias("rk"))
    whole = sorted(map(tuple, D.heading_runs(heads, "doc", "pos", "rk", 400, 2).collect()))
    monkeypatch.setattr(D, "TASK_HEADINGS", 100)
    dealt = D.heading_runs(heads, "doc", "pos", "rk", 400, 2)
    assert "31), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, dealt.collect())) == whole and whole


def test_heading_runs_keep_the_first_of_equal_headings(spark) -> None:  # noqa: ANN001
    rows = [(4664929, p, r) for p, r in ((342, 17), (922, 2), (1843, 1), (1951, 13), (1968, 18), (1968, 18))]
    runs = D.heading_runs(spark.createDataFrame(rows, "doc long, pos long, rk long"), "doc", "pos", "rk", 400, 3)
    assert runs._jdf.queryExecution().executedPlan().toString().count("ASC NULLS LAST], false, 0") == 1  # one sort for both windows
    assert list(map(tuple, runs.collect())) == [(4664929, 1843, 1968, 3)]


def test_folds_make_their_features_once(spark) -> None:  # noqa: ANN001
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x: float) -> float:
        made.add(1)
        return x

    rows = [(i, float(i % 3 == 0), float(i % 3 == 0) + (i * 7 % 10) / 5) for i in range(120)]
    data = spark.createDataFrame(rows, "doc_id long, label double, x double").withColumn("x", counted("x"))
    data = models.assembled(data, ["x"]).select("doc_id", "label", "features")
    assert models.fold_auc(data, {"nb": models.naive_bayes()}, folds=2).count() == 2 and made.value == 120
    assert models.held_out(data, {"nb": models.naive_bayes()}, folds=2).count() == 1 and made.value == 240
