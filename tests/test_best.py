"""Searches hold a bounded number of results in a task, and send no more on."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granum.functions import text as X
from granum.operators import best
from granum.operators import search as R
from granum.plans import retrieval


def test_best_rows_are_bounded_and_exact() -> None:
    rng = np.random.default_rng(1)
    score = rng.integers(0, 4, (3, 600)) / 3  # nearly all rows share a score
    found = best.Best(5)
    for lo in range(0, 600, 100):
        found.add(0, best.points(score[:, lo : lo + 100]), pa.array(np.arange(lo, lo + 100)))
        assert all(len(names) <= 15 for _, _, names in found.held.values())
    q, names, got = next(found.rows())
    for i in range(3):
        want = sorted(range(600), key=lambda r: (-round(score[i, r], 6), r))[:5]  # noqa: B023
        assert names.to_numpy()[q == i].tolist() == want and np.allclose(got[q == i], score[i, want], atol=1e-6)


@pytest.mark.parametrize("equal", [False, True])
def test_points_are_made_of_few_scores(monkeypatch, equal) -> None:  # noqa: ANN001
    rng = np.random.default_rng(2)
    score = rng.normal(size=(4, 3000)).round(3)
    score[1, ::7], score[2, 5], score[3, 9] = np.nan, np.inf, -np.inf
    if equal:
        score[0] = 0.5 + 2e-7 * rng.integers(0, 2, 3000)  # equal points of unequal scores
    order = rng.permutation(3000)
    whole, seen = best.Best(5), []
    held = best.points
    monkeypatch.setattr(best, "points", lambda x: seen.append(x.size) or held(x))
    found = best.Best(5)
    for lo in range(0, 3000, 100):
        own = np.sort(order[lo : lo + 100])
        found.add_scores(0, score[:, own], pa.array(own))
        whole.add(0, held(score[:, own]), pa.array(own))
    as_set = lambda b: {x for q, names, got in b.rows() for x in zip(q.tolist(), names.to_pylist(), got.tolist(), strict=True)}
    assert as_set(found) == as_set(whole) and len(as_set(found)) == 20
    assert equal or sum(seen) < score.size / 5


def test_bm25_deals_out_only_each_tasks_best(spark) -> None:  # noqa: ANN001
    docs = spark.createDataFrame([(i, "alpha beta" if i % 3 else "alpha gamma") for i in range(900)], "doc_id long, text string").repartition(3).localCheckpoint()
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "qid long, query string")
    R.bm25(docs, asked, 4).collect()
    chunk = R._questions([(1, [("alpha", 1.0), ("beta", 2.0)]), (2, [("gamma", 1.0)])])  # noqa: SLF001
    schema = spark.createDataFrame([], "qid long, id long, score double").schema
    sent = R._best_documents(docs.select(F.col("doc_id").alias("id"), F.split("text", " ").alias("w")), chunk, 4, 2.0, [], schema)  # noqa: SLF001
    assert sent.count() <= 2 * 4 * 3
    assert [r["id"] for r in R.bm25(docs, asked, 4).where("qid = 1").orderBy("rank").collect()] == [0, 3, 6, 9]  # every weight is negative here, and all documents are met


def test_bm25_takes_rows_of_one_id_as_one_document(spark) -> None:  # noqa: ANN001
    docs = spark.createDataFrame([(1, "red fox"), (1, "blue fox"), (2, "red red"), (3, None), (4, "green tree")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red fox"), (8, "")], "qid long, query string")
    got = {(r["qid"], r["rank"]): r["id"] for r in R.bm25(docs, asked, 3).collect()}
    assert got == {(7, 1): 1, (7, 2): 2, (7, 3): 3, (8, 1): 1, (8, 2): 2, (8, 3): 3}


def test_tfidf_deals_out_counts_by_term_alone(spark) -> None:  # noqa: ANN001
    rows = [(i, ["red", "fox"] * (i % 4) + ["tree", f"w{i % 7}"]) for i in range(60)] + [(3, ["red", "owl"]), (90, []), (91, ["fox"])]
    df = spark.createDataFrame(rows, "doc_id long, w array<string>")
    held: dict[int, dict[str, int]] = {}
    for i, w in rows:
        own = held.setdefault(i, {})
        for t in [*w, *[f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]:
            own[t] = own.get(t, 0) + 1
    terms = {t for own in held.values() for t in own}
    idf = {t: np.log((1 + len(rows)) / (1 + n)) + 1 for t in terms if (n := sum(t in own for own in held.values())) >= 5}
    want = {}
    for i, own in held.items():
        x = {t: n * idf[t] for t, n in own.items() if t in idf}
        unit = sorted(((-round(v / np.sqrt(sum(y * y for y in x.values())), 6), t) for t, v in x.items()))[:3]
        want |= {(i, t): -v for v, t in unit}
    got = {(r["id"], r["term"]): r["weight"] for r in R.tfidf(df, F.col("w"), k=3).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    plan = R.tfidf_weights(df.where("doc_id > 3"), F.col("w"), R.tfidf_vocabulary(df, F.col("w")), k=3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # one row an id: nothing is dealt out


def test_clean_lists_are_clean_words(spark) -> None:  # noqa: ANN001
    texts = [None, "", "The Cat's <b\n>Hat</b> a<bc>dog\tsat", "one < two > three", "na\u00efve\u0130x don't\x0bstop \u65e5\u672c sun", "<", "abc", "  word\r\nnext ", "", "end"]
    texts += ["".join(random.Random(i).choices([*"abcXYZ \t\n\x0c<>/\u00e91'.", "the ", "hello"], k=i % 60)) for i in range(400)]
    want = [r["w"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.clean_words(F.col("t")).alias("w")).orderBy("i").collect()]
    held = pa.array(texts, pa.string())
    assert X.clean_lists(held).to_pylist() == want and X.clean_lists(held.slice(7, 90)).to_pylist() == want[7:97] and len(X.clean_lists(held[:0])) == 0


def test_tfidf_counts_only_bigrams_that_may_be_terms(spark, monkeypatch) -> None:  # noqa: ANN001
    rnd = random.Random(5)
    words = ["".join(rnd.choices("bcdfgh", k=4)) for _ in range(90)]
    rows = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(90)], k=40))) for i in range(150)]
    rows += [(i % 3, "apart alone") for i in range(9)] + [(200 + i % 4, "apart alone") for i in range(8)] + [(300, None)]  # a bigram that only rows of shared ids have
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counted = []
    held = R._term_counts  # noqa: SLF001
    monkeypatch.setattr(R, "_term_counts", lambda *a: counted.append(held(*a)) or counted[-1])
    for vocabulary in (25, 10_000):
        want = set(map(tuple, R.tfidf(df, X.clean_words(F.col("text")), vocabulary=vocabulary).collect()))
        assert set(map(tuple, R.tfidf(df, F.col("text"), vocabulary=vocabulary, split=X.clean_lists).collect())) == want
        assert any(t == "apart alone" for _, t, _ in want) or vocabulary == 25
    every, few = (c.select("term").distinct().count() for c in counted[:2])
    assert few < every / 10  # the rest is counted by slots alone


def test_term_contributions_clean_no_text_in_the_plan(spark, monkeypatch) -> None:  # noqa: ANN001
    def refuse(*_):  # noqa: ANN002, ANN202
        raise AssertionError("patterns run over every text")

    monkeypatch.setattr(X, "clean_words", refuse)
    assert retrieval.term_contributions(spark, "/root/testdata/sf0.001").count() == 10


def test_vector_scan_makes_tables_for_a_block_of_queries(monkeypatch, spark, tmp_path) -> None:  # noqa: ANN001
    from granum.operators import vector_index as V

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(700)], "vec_id long, embedding array<double>")
    V.build(df, str(tmp_path / "index"))
    asked = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    scanned = []
    held = V._scanned  # noqa: SLF001
    monkeypatch.setattr(V, "_scanned", lambda *a: scanned.append(held(*a)) or scanned[-1])
    monkeypatch.setattr(V.best, "HELD", 300 * 16 * 4)
    got = V.search(spark, str(tmp_path / "index"), asked, 4, share=1.0)
    assert got.where("rank = 1 and qid = id").count() == 700
    assert len(scanned) == 3  # no task holds results of more than 300 queries
