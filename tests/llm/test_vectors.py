"""Shards, product codes and whitening against brute force, and their awkward inputs."""

from __future__ import annotations

import hashlib
import os
import zlib
from fractions import Fraction
from math import floor, isfinite

import duckdb
import numpy as np
import pytest

from granum.llm import codes, oracles, queries, sharding, whitening
from granum.operators.ranking import numbered
from tests.llm.helpers import documents, long_texts, odd

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, code string, n int, shard int, id string, x int"


def oracle(sql: str, columns: list[str]) -> list[str]:
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return sorted(map(str, con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))


@pytest.mark.parametrize(("name", "sql"), [("op11_sharding", oracles.OP11), ("op12_vector_codes", oracles.OP12)])
def test_oracle(spark, name, sql) -> None:  # noqa: ANN001
    df = queries.QUERIES[name](spark, SF)
    assert sorted(map(lambda r: str(tuple(r)), df.collect())) == oracle(sql, df.columns)


# ---------------------------------------------------------------- shards


def cut(rows: list[tuple[int | None, str | None]], shards: int) -> list[tuple]:
    """``id, size, crc, shard, slot`` by one pass in order."""
    held = sorted(((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows))
    total, run, out, seen = sum(r[2] for r in held), 0, [], [0] * shards
    for known, i, size, crc in held:
        shard = floor(Fraction((2 * run + size) * shards, 2 * total))
        out.append((i if known else None, size, crc, shard, seen[shard]))
        seen[shard] += 1
        run += size
    return out


@pytest.mark.parametrize("per_range", [2, 50, 1 << 18])
def test_shards_equal_one_pass(spark, monkeypatch, per_range) -> None:  # noqa: ANN001
    monkeypatch.setattr(sharding, "PER_RANGE", per_range)
    rng = np.random.default_rng(3)
    rows = [(int(i), "é" * int(n)) for i, n in zip(rng.integers(0, 60, 120), rng.pareto(1.0, 120) * 9, strict=True)]
    rows += [(None, None)] * 3 + [(7, "same text")] * 60 + [(8, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n in (1, 3, 8):
        got = sharding.shard(df, n).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, cut(rows, n)))


def test_shards_are_balanced_and_slots_gapless(spark) -> None:  # noqa: ANN001
    rows = queries.op11_sharding(spark, SF).collect()
    size = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(size) - min(size) <= 2 * max(r["size"] for r in rows)
    for s in range(8):
        own = sorted((r["slot"], r["doc_id"]) for r in rows if r["shard"] == s)
        assert [x[0] for x in own] == list(range(len(own)))
        assert [x[1] for x in own] == sorted(x[1] for x in own)


def test_shards_of_odd_tables(spark, tmp_path) -> None:  # noqa: ANN001
    df = odd(spark)
    for name in ("part_", "at_", "run_", "row", "number", "rows_", "bytes_", "Size", "shard"):
        df = df.withColumn(name, df["rank"])
    out = sharding.shard(df, 3)
    assert {c.lower() for c in out.columns} == {c.lower() for c in df.columns} | {"size", "text_crc32", "shard", "slot"}
    assert out.count() == df.count()
    assert sorted(str(r["doc_id"]) + str(r["part_"]) for r in out.collect()) == sorted(str(r["doc_id"]) + str(r["part_"]) for r in df.collect())
    assert sharding.shard(df.limit(0), 3).count() == 0
    assert sharding.report(long_texts(spark)).groupBy("shard").count().count() >= 3
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(documents(spark, [f"text {i} " * (i % 7) for i in range(100)]), path, 4)
    back = spark.read.parquet(path)
    assert back.count() == 100
    ends = sorted((min(ids), max(ids)) for s in range(4) if (ids := [r["doc_id"] for r in back.where(f"shard = {s}").collect()]))
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))  # noqa: B905


def test_numbered_covers_a_hot_key(spark) -> None:  # noqa: ANN001
    df = spark.range(0, 3000, 1, 4).selectExpr("if(id % 3 = 0, null, 7L) as k", "id as n")
    rows = numbered(df, ["k", "n"], "n", 6).collect()
    assert len({r["part_"] for r in rows}) == 6
    done = 0
    for p in range(6):
        own = sorted((r["at_"], r["k"] is not None, r["n"], r["run_"]) for r in rows if r["part_"] == p)
        assert [o[0] for o in own] == list(range(len(own)))
        assert [o[1:3] for o in own] == sorted(o[1:3] for o in own)
        run = 0
        for o in own:
            assert o[3] == run
            run += o[2]
        done += len(own)
    assert done == 3000


# ---------------------------------------------------------------- vectors


def kept(rows: list[tuple], scale: int) -> list[tuple[int | None, int | None, list[int]]]:
    return [(i, label, [floor(scale * float(np.float32(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and isfinite(x) for x in v)]


def frame(spark, rows: list[tuple]):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i, v, label, "c", 1, 2, "i", 3) for i, v, label in rows], VECTORS).repartition(3)


def coded(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[dict, str]:
    """Codes by loops over Python integers."""
    held = sorted(kept(rows, 4096), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(held[0][2]) // parts
    piece = lambda v, p: v[p * width : (p + 1) * width]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[piece(v, p) for _, _, v in held[:entries]] for p in range(parts)]
    find = lambda v, p: min(range(len(books[p])), key=lambda e: (gap(piece(v, p), books[p][e]), e))
    for _ in range(rounds):
        chosen = [[find(v, p) for _, _, v in held] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [piece(h[2], p) for h, c in zip(held, chosen[p], strict=True) if c == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out = {}
    for i, label, v in held:
        best = [find(v, p) for p in range(parts)]
        out.setdefault(i, []).append(("".join(f"{e:02x}" for e in best), sum(gap(piece(v, p), books[p][e]) for p, e in enumerate(best)), label))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def some_vectors(n: int, d: int = 16, wide: float = 1.0) -> list[tuple]:
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=d) * wide).tolist(), None if i % 5 == 0 else i % 3) for i in range(n)]
    rows += [(100 + i, rows[3][1], 1) for i in range(n // 2)]  # a hot vector
    return [*rows, (4, rows[1][1], 2), (None, rows[2][1], None), (200, None, 1), (201, [*rows[0][1][:-1], None], 1), (202, [*rows[0][1][:-1], float("nan")], 1), (203, [*rows[0][1][:-1], float("-inf")], 1)]


@pytest.mark.parametrize("wide", [1.0, 1e6, 1e14])
def test_codes_equal_brute_force(spark, wide) -> None:  # noqa: ANN001
    rows = some_vectors(60, wide=wide)
    want, digest = coded(rows)
    held = (1 << 63) - 1
    total: dict[int | None, int] = {}
    for found in want.values():
        for _, error, label in found:
            total[label] = total.get(label, 0) + min(error, held)
    got: dict = {}
    for r in codes.compress(frame(spark, rows)).collect():
        got.setdefault(r["vec_id"], []).append((r["code"], r["error"], r["label_error"]))
        assert r["codebooks_sha256"] == digest
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted((c, min(e, held), min(total[lab], held)) for c, e, lab in v) for i, v in want.items()}


def test_codes_of_odd_tables(spark, monkeypatch) -> None:  # noqa: ANN001
    assert codes.report(frame(spark, some_vectors(20)).limit(0)).collect() == []
    few = codes.report(frame(spark, [(1, [0.5] * 8, None), (2, [0.25] * 8, None), (3, [], 1), (4, [1.0] * 9, 1)])).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in few) == [(1, "00" * 8, 0), (2, "01" * 8, 0)]
    assert [r["code"] for r in codes.report(frame(spark, [(1, [], 1)])).collect()] == ["00" * 8]
    padded = codes.compress(frame(spark, [(1, [0.5] * 9, None), (2, [0.25] * 9, None)])).collect()
    assert sorted(r["error"] for r in padded) == [0, 0]
    rows = frame(spark, some_vectors(40))
    plain = sorted(map(str, codes.report(rows).collect()))
    monkeypatch.setattr(codes, "LABELS", 1)
    assert sorted(map(str, codes.report(rows).collect())) == plain


def test_decoding_is_the_nearest_entry(spark) -> None:  # noqa: ANN001
    rows, width = codes.prepared(frame(spark, some_vectors(50)), 8, 4096, "vec_id", "embedding", "label")
    books = codes.fit(rows, width)
    for r in rows.join(codes.encoded(rows, books).select("id", "code", "error"), "id").collect():
        gap = np.array(r["x"]) - codes.decoded(r["code"], books)
        assert (gap * gap).sum() == r["error"] or r["id"] == 4


def whitened(rows: list[tuple]) -> tuple[int, np.ndarray, list, list[int]]:
    """``n``, covariance, rows and deviations with exact fractions."""
    held = [(i, [x + 1_000_000 for x in v]) for i, _, v in kept(rows, 64)]
    fit = sorted({tuple(v) for _, v in held})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(x, n) for x in s]
    cov = np.array([[float(sum((v[a] - mean[a]) * (v[b] - mean[b]) for v in fit) / n) for b in range(len(s))] for a in range(len(s))])
    return n, cov, [(i, [float(x - m) for x, m in zip(v, mean, strict=True)]) for i, v in held], [sum((n * x - t) ** 2 for x, t in zip(v, s, strict=True)) for _, v in held]


@pytest.mark.parametrize("wide", [1.0, 1e9, 1e20])
def test_whitening_equals_exact_fractions(spark, wide) -> None:  # noqa: ANN001
    d = 20 if wide == 1.0 else 6
    rows = some_vectors(60, d, wide) if wide < 1e20 else [(i, [float(x) for x in np.random.default_rng(i).normal(size=d) * 1e15], 0) for i in range(30)]
    n, cov, held, deviations = whitened(rows)
    e, vectors = np.linalg.eigh(cov)
    e, vectors = e[::-1][:16], vectors[:, ::-1][:, :16]
    out = whitening.whiten(frame(spark, rows)).collect()
    k = min(16, d)
    assert len(out) == len(held) * k
    got: dict = {}
    for r in out:
        assert r["n"] == n
        assert r["identity_error"] < 1e-8
        assert abs(r["explained"] - e[r["component"] - 1] / np.trace(cov)) < 1e-9
        got.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append((r["whitened"], r["deviation"]))
    for c in range(1, k + 1):
        want = {}
        for (i, x), dev in zip(held, deviations, strict=True):
            want.setdefault(i, []).append((float(np.dot(x, vectors[:, c - 1]) / np.sqrt(e[c - 1])), min(dev, (1 << 63) - 1)))
        near = lambda sign: all(np.allclose(sorted(sign * a for a, _ in got[c][i]), sorted(a for a, _ in want[i]), atol=1e-6) for i in want)  # noqa: B023, E731
        assert near(1) or near(-1)
        assert all(sorted(b for _, b in got[c][i]) == sorted(b for _, b in want[i]) for i in want)


def test_scatter_is_exact(spark) -> None:  # noqa: ANN001
    big = [[(1 << 61) - i, -(1 << 61) + 7 * i, i] for i in range(9)] + [[i, i * i, -i] for i in range(5000)]
    fit = spark.createDataFrame([(v,) for v in big], "x array<long>").repartition(4)
    shift = np.array([5, -6, 7])
    n, s, q = whitening.scatter(fit, 3, shift)
    y = [[a - int(b) for a, b in zip(v, shift, strict=True)] for v in big]
    assert n == len(big)
    assert s == [sum(c) for c in zip(*y, strict=True)]
    assert q == [[sum(v[a] * v[b] for v in y) for b in range(3)] for a in range(3)]


def test_whitening_of_odd_tables(spark) -> None:  # noqa: ANN001
    assert whitening.report(frame(spark, some_vectors(20)).limit(0)).collect() == []
    assert whitening.report(frame(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)])).collect() == []
    assert whitening.report(frame(spark, [(1, [], 1)])).collect() == []
    flat = whitening.report(frame(spark, [(i, [float(i), 2.0, float(i)], 1) for i in range(9)] + [(None, [1.0, 2.0, 1.0], 1), (50, [1.0], 1)])).collect()
    assert {r["component"] for r in flat} == {1}
    assert len(flat) == 10
    assert sum(r["vec_id"] is None for r in flat) == 1
