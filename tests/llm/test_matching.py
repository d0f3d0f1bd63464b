"""SimHash, line dedup, decontamination, top-k and near-dedup against brute force."""

from __future__ import annotations

import glob
import hashlib
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.helpers import documents, long_texts, odd

from granum.llm import buckets, common, decontaminate, lines, neardup, simhash, topk
from granum.llm.common import components


def brute_components(n: int, linked) -> list[int]:  # noqa: ANN001
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text: str | None, n: int = 3) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    w = [x for x in words.split(" ") if x]
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) > n else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def near_texts(rng: random.Random, groups: int, copies: int) -> list[str | None]:
    vocab = [f"w{i}" for i in range(400)]
    out: list[str | None] = [None, "", " ", "one", "One two"]
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    return out


def test_golay_decodes_every_word_within_three() -> None:
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 2000, dtype=np.uint32)
    low, high, error = simhash._golay()
    e = error[low[w & 0xFFF] ^ high[w >> 12]]
    assert np.bitwise_count(e).max() <= 3
    code = w ^ e
    assert not (low[code & 0xFFF] ^ high[code >> 12]).any()
    assert len(np.unique(error)) == 1 << 11


def test_keys_meet_within_three_bits() -> None:
    rng = np.random.default_rng(1)
    p = rng.integers(0, 1 << 64, 800, dtype=np.uint64)
    q = p.copy()
    for i in range(len(q)):
        for b in rng.choice(64, size=rng.integers(0, 4), replace=False):
            q[i] ^= np.uint64(1) << np.uint64(b)
    sr, sk, _, _ = simhash.keys(p)
    _, _, lr, lk = simhash.keys(q)
    stored = set(zip(sr.tolist(), sk.tolist(), strict=True))
    assert {r for r, k in zip(lr.tolist(), lk.tolist(), strict=True) if (r, k) in stored} == set(range(len(p)))


def test_simhash_against_brute_force(spark) -> None:  # noqa: ANN001
    texts = near_texts(random.Random(3), 25, 6)
    got = {r["doc_id"]: r for r in simhash.report(documents(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    want = brute_components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_simhash_dense_buckets_and_cells(spark, monkeypatch) -> None:  # noqa: ANN001
    """Many fingerprints around one point, with buckets split in cells."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 3, dtype=np.uint64)
    p = []
    for b in base:
        for _ in range(60):
            x = b
            for bit in rng.choice(64, size=rng.integers(0, 5), replace=False):
                x ^= np.uint64(1) << np.uint64(bit)
            p.append(x)
    p = np.unique(np.array(p)).view(np.int64).tolist()
    df = spark.createDataFrame([(x, x) for x in p], "id long, print long")
    want = brute_components(len(p), lambda i, j: ((p[i] ^ p[j]) & (1 << 64) - 1).bit_count() <= 3)
    monkeypatch.setattr(buckets, "CELL", 12)
    roots = {r["node"]: r["root"] for r in components(simhash.link(df, 3)).collect()}
    got = {}
    for i, x in enumerate(p):
        got.setdefault(roots.get(x, x), set()).add(i)
    groups = {}
    for i, r in enumerate(want):
        groups.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def ball(n: int, seed: int) -> list[int]:
    """``n`` different signed fingerprints, all within five bits of one point."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 1 << 63))
    out: set[int] = set()
    while len(out) < n:
        out.add(base ^ sum(1 << int(b) for b in rng.choice(64, size=5, replace=False)))
    return [simhash.signed(x) for x in out]


def test_written_rows_of_a_hot_key_are_linear(spark) -> None:  # noqa: ANN001
    """One key for all rows, at the real size of a cell: different fingerprints, and rows that only chance tells apart."""
    one = lambda batch: (np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64), None)
    p = ball(40_000, 1)
    written = {}
    for n in (10_000, 20_000, 40_000):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(p[:n])], "id long, print long").repartition(4)
        placed = buckets.deal(df, one, ["id"], buckets.prints_split("print")).groupBy("key", "cell").count()
        assert placed.agg(F.max("count")).first()[0] <= buckets.CELL
        written["split", n] = placed.agg(F.sum("count")).first()[0]
        for name, labels in (("labels", F.col("id")), ("giant", F.when(F.col("id") < 100, F.col("id")).otherwise(-1))):
            placed = buckets.deal(df.withColumn("label", labels), one, ["id", "label"])
            assert placed.groupBy("key", "cell").count().agg(F.max("count")).first()[0] <= 1.2 * buckets.CELL
            written[name, n] = placed.count()
        assert written["labels", n] <= 1.1 * n
        assert written["giant", n] <= 1.1 * n
        rare = placed.where("label >= 0").groupBy("id").agg(F.count_distinct("cell").alias("n")).agg(F.min("n"), F.count("*")).first()
        assert tuple(rare) == (-(-n // buckets.CELL), 100)
        assert buckets.deal(df.withColumn("label", F.lit(5).cast("bigint")), one, ["id"]).count() == 0
    assert written["split", 40_000] <= 5 * written["split", 20_000] <= 25 * written["split", 10_000]


def test_simhash_of_a_hot_bucket_at_real_size(spark) -> None:  # noqa: ANN001
    """20,000 fingerprints around one point: every link that brute force over 64-bit neighbours finds."""
    p = ball(20_000, 2)
    df = spark.createDataFrame([(x, x) for x in p], "id long, print long").repartition(4)
    roots = {r["node"]: r["root"] for r in components(simhash.link(df, 3)).collect()}
    u = np.array(p).view(np.uint64)
    forest = buckets.Forest()
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3) + i + 1:
            forest.join(p[i], p[int(j)])
    assert {x: roots.get(x, x) for x in p} == {x: forest.find(x) for x in p}


def _sets(texts: list[str]) -> list[set[tuple[str, ...]]]:
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]


def _kept(df) -> list[int]:  # noqa: ANN001
    return sorted(r["doc_id"] for r in neardup.without_near_duplicates(df).collect())


@pytest.mark.parametrize("cell", [None, 40])
def test_near_dedup_of_a_crowded_bucket(spark, monkeypatch, cell) -> None:  # noqa: ANN001
    """Variants of one text that are too far apart to be near copies, each with near copies of its own."""
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(150)]
    texts = []
    for _ in range(50):
        w = list(base)
        for at in range(rng.randrange(9), 150, 9):
            w[at] = rng.choice(vocab)
        for k in range(6):
            x = list(w)
            for _ in range(k % 3):
                x[rng.randrange(150)] = rng.choice(vocab)
            texts.append(" ".join(x))
    sets = _sets(texts)
    want = brute_components(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    if cell:
        monkeypatch.setattr(buckets, "CELL", cell)
    assert len(set(want)) >= 40
    assert _kept(documents(spark, texts)) == sorted(set(want))


def test_near_dedup_meets_all_rows_of_a_golay_bucket(spark, monkeypatch) -> None:  # noqa: ANN001
    """Pairs of near copies in one Golay bucket that no band brings together."""
    rng = random.Random(5)
    bands = neardup.band_keys

    def alone(hashes):  # noqa: ANN001, ANN202
        keys, bits = bands(hashes)
        return [i << 56 | int(hashes.sum()) >> 9 for i in range(len(keys))], bits

    monkeypatch.setattr(neardup, "majority", lambda hashes: 0)
    monkeypatch.setattr(neardup, "band_keys", alone)
    for n in (3, 12):
        texts = []
        for _ in range(n):
            words = [f"v{rng.randrange(9000)}" for _ in range(120)]
            texts += [" ".join(words), " ".join([*words, "more"])]
        assert _kept(documents(spark, texts)) == list(range(0, 2 * n, 2))


def test_near_dedup_of_a_chain_in_one_bucket(spark) -> None:  # noqa: ANN001
    """A group held together by single links only: each text is near the next, no other."""
    rng = random.Random(8)
    w = [f"v{rng.randrange(9000)}" for _ in range(120)]
    texts = []
    for k in range(60):
        texts.append(" ".join(w))
        at = (k * 37) % 100
        w = [*w[:at], *[f"n{k}.{i}" for i in range(6)], *w[at + 6 :]]
    sets = _sets(texts)
    want = brute_components(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert _kept(documents(spark, texts)) == sorted(set(want))


def test_simhash_odd_rows(spark) -> None:  # noqa: ANN001
    rows = simhash.report(odd(spark)).collect()
    assert len(rows) == 8
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    zero = "0" * 16
    assert by[(1, zero)] == by[(2, zero)] == by[(5, zero)] == 1
    assert simhash.report(odd(spark).limit(0)).count() == 0


def test_components_of_a_long_chain(spark) -> None:  # noqa: ANN001
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (900, 800)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(e).collect()}
    assert got == {i: 0 for i in range(201)} | {800: 800, 900: 800}


def test_near_dedup_keeps_one_of_each_group(spark) -> None:  # noqa: ANN001
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(3000)]
    texts: list[str | None] = [None, "", "solo words only here"]
    truth = [0, 0, 2]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(220)]
        first = len(texts)
        for k in range(5):
            w = list(base)
            for _ in range(k % 3):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
            truth.append(first)
    got = sorted(r["doc_id"] for r in neardup.without_near_duplicates(documents(spark, texts)).collect())
    assert got == sorted(set(truth))


def test_near_dedup_finds_appended_cut_and_block_edited_copies(spark) -> None:  # noqa: ANN001
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(5000)]
    texts, sets = [], []
    for k in range(150):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 400))]
        far = rng.uniform(0.81, 0.9)
        if k % 3 == 2:  # one block replaced
            size = max(1, int((len(base) - 4) * (1 - far) / (1 + far)) - 4)
            at = rng.randrange(len(base) - size)
            copy = base[:at] + [rng.choice(vocab) for _ in range(size)] + base[at + size :]
        elif k % 3:  # end cut off
            copy = base[: 4 + -int(-(len(base) - 4) * far // 1)]
        else:  # words appended
            copy = base + [rng.choice(vocab) for _ in range(int((len(base) - 4) * (1 / far - 1)))]
        texts += [" ".join(base), " ".join(copy)]
        sets += [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, copy)]
    assert all(0.8 <= len(a & b) / len(a | b) < 1 for a, b in zip(sets[::2], sets[1::2], strict=True))
    kept = sorted(r["doc_id"] for r in neardup.without_near_duplicates(documents(spark, texts)).collect())
    assert kept == list(range(0, len(texts), 2))


def test_near_dedup_odd_rows(spark) -> None:  # noqa: ANN001
    df = odd(spark)
    out = neardup.without_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "4", "6"]
    assert neardup.without_near_duplicates(df.limit(0)).count() == 0


def test_line_dedup_finds_shifted_passages(spark) -> None:  # noqa: ANN001
    rng = random.Random(4)
    line = lambda: " ".join(f"t{rng.randrange(10_000)}" for _ in range(8))
    passage = [line() for _ in range(14)]
    texts = []
    for _ in range(6):
        own = [line() for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(own))
        texts.append("\n".join(own[:at] + passage + own[at:]))
    rows = {r["doc_id"]: r for r in lines.report(documents(spark, texts)).collect()}
    assert rows[0]["text"] == texts[0] and rows[0]["n_removed"] == 0
    for i in range(1, 6):
        assert rows[i]["n_removed"] >= 6
        left = rows[i]["text"].split("\n")
        assert [x for x in texts[i].split("\n") if x not in passage] == [x for x in left if x not in passage]


def test_line_dedup_cuts_whole_short_passages(spark) -> None:  # noqa: ANN001
    rng = random.Random(14)
    line = lambda: " ".join(f"t{rng.randrange(10_000)}" for _ in range(8))
    own = lambda: [line() for _ in range(rng.randint(1, 5))]
    texts, want = [], []
    for n in (2, 3, 4) * 8:
        passage = [line() for _ in range(n)]
        for later in (False, True):
            before, after = own(), own()
            texts.append("\n".join(before + passage + after))
            want.append("\n".join(before + passage * (not later) + after))
    texts += ["x\nx\nx", "y\ny\ny\ny", "p\nq\np\nq\np", "first\nx\nend"]
    want += ["x\nx\nx", "y\ny", "p\nq", "first\nx\nend"]
    rows = {r["doc_id"]: r["text"] for r in lines.report(documents(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == want


def test_line_dedup_odd_rows(spark) -> None:  # noqa: ANN001
    df = odd(spark)
    rows = lines.dedup(df).collect()
    assert len(rows) == 8
    assert {(r["doc_id"], r["text"]) for r in rows} == {(r["doc_id"], r["text"]) for r in df.collect()}
    assert [r["n_lines"] for r in rows if r["doc_id"] == 1] == [0]
    assert lines.dedup(df.limit(0)).count() == 0


def test_decontamination_by_brute_force(spark) -> None:  # noqa: ANN001
    rng = random.Random(6)
    vocab = [f"k{i}" for i in range(30)]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 10, 25]))) if i else "" for i in range(8)]
    texts: list[str | None] = [None, ""]
    for _ in range(40):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        it = rng.choice(items[1:]).split()
        at = rng.randint(0, len(w))
        texts.append(", ".join(w[:at] + it + w[at:]).upper())
    bench = spark.createDataFrame([*enumerate(items), (99, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(documents(spark, texts), bench).collect()}
    windows = [(i, tuple(w[k : k + min(10, len(w))])) for i, t in enumerate(items) if (w := t.split()) for k in range(len(w) - min(10, len(w)) + 1)]
    for d, t in enumerate(texts):
        w = (t or "").lower().replace(",", " ").split()
        hit, owners = set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    owners.add(i)
        assert (got[d]["n_words"], got[d]["n_hit"], got[d]["n_items"]) == (len(w), len(hit), len(owners))
    whole, small = ({r["doc_id"]: tuple(r) for r in decontaminate.overlap(documents(spark, texts).select("doc_id", "text"), bench, broadcast_bytes=b).collect()} for b in (1 << 20, 60))
    assert whole == small
    left, cut = (sorted((r["doc_id"], r["text"]) for r in decontaminate.decontaminate(documents(spark, texts), bench, broadcast_bytes=b).select("doc_id", "text").where("text is not null").collect()) for b in (1 << 20, 60))
    assert left == cut


def test_decontamination_items_with_odd_ids(spark) -> None:  # noqa: ANN001
    bench = spark.createDataFrame([("b", "p q r"), ("a", "p q r"), (None, "x y"), ("c", None), ("d", " - ")], "item_id string, text string")
    rows = {r["doc_id"]: r for r in decontaminate.report(documents(spark, ["o p q r", "x y z", "p q", None]), bench).collect()}
    assert [(rows[i]["n_words"], rows[i]["n_hit"], rows[i]["n_items"], rows[i]["contaminated"]) for i in range(4)] == [(4, 3, 2, True), (3, 2, 1, True), (2, 0, 0, False), (0, 0, 0, False)]
    assert rows[0]["items_sha256"] == hashlib.sha256(b"a,b").hexdigest() and rows[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    for df in (odd(spark), odd(spark).limit(0)):
        for b in (bench, bench.limit(0)):
            for size in (1 << 20, 4):
                assert decontaminate.overlap(df, b, broadcast_bytes=size).count() == df.count()
                out = decontaminate.decontaminate(df, b, broadcast_bytes=size)
                assert out.columns == df.columns and out.count() == df.count()


def test_decontamination_set_of_many_items_and_one_long_item() -> None:
    rng = random.Random(1)
    pieces = [(i, [b"w%d" % rng.randrange(50_000) for _ in range(30)], 10) for i in range(20_000)]
    began = time.monotonic()
    held = decontaminate.WindowSet(pieces)
    assert time.monotonic() - began < 30
    assert held.scan(pieces[7][1])[0].all() and held.scan(pieces[7][1])[1] == [7]
    assert not held.scan(pieces[7][1][:9] + pieces[8][1][:9])[0].any()


def test_decontaminate_cuts_spans_and_drops_copies(spark) -> None:  # noqa: ANN001
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    filler = " ".join(f"z{i}" for i in range(40))
    df = documents(spark, [f"{filler} A b, c d e f g h i j K! end", "a b c d e f g h i j", filler, None])
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert got == {0: f"{filler} ! end", 2: filler, 3: None}
    assert decontaminate.decontaminate(odd(spark), bench).count() == 8


def test_topk_against_brute_force(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(260, 6)), 2)
    x[20:60] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (350, [0.5] * 6), (350, [0.25] * 6), (None, [1.0] * 6), (400, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in topk.report(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    live = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q in (0, 50, 100, 150, 200, 250):
        own = dict(live)[q]
        best = sorted(((-int(v @ own), i) for i, v in live if i != q and len(v) == 6))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert len(got[350]) == 5 and 400 not in got and all(i != 350 for _, i, _ in got[350])
    assert topk.report(df.limit(0)).count() == 0


def test_topk_blocks_and_query_chunks(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 12))
    x[100:130] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, []), (1050, []), (1001, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    whole = sorted(map(tuple, topk.report(df).collect()))
    cut = topk.top_k(df, F.col("vec_id") % 50 == 0, block=40, broadcast_bytes=500)
    assert sorted(map(tuple, cut.collect())) == whole
    live = np.floor(256 * x).astype(int)
    for q in range(0, 700, 50):
        best = sorted((-int(live[i] @ live[q]), i) for i in range(700) if i != q)[:5]
        assert [(r[2], r[3]) for r in whole if r[0] == q] == [(i, -s) for s, i in best]
    assert [r for r in whole if r[0] >= 1000] == [(1000, 1, 1001, 0), (1000, 2, 1050, 0), (1050, 1, 1000, 0), (1050, 2, 1001, 0)]


def test_topk_skips_postings_and_holds_wide_scores() -> None:
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 64))
    x = np.repeat(centres, 20, axis=0) + 0.2 * rng.normal(size=(4000, 64))
    rows = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    index, best = topk.ImpactIndex(np.arange(4000), rows), topk.Best(np.arange(0, 4000, 50), rows[::50], 5)
    best.meet(index)
    assert index.taken < 0.7 * index.total
    for n, q in enumerate(range(0, 4000, 50)):
        want = sorted((-int(s), i) for i, s in enumerate(rows @ rows[q]) if i != q)[:5]
        assert [(-int(s), int(i)) for m, s, i in best.found.T if m == n] == want
    wide = np.array([[1 << 40, -3], [1 << 40, -4], [-(1 << 40), 5], [7, 7]], dtype=np.int64)
    best = topk.Best(np.array([9]), wide[:1], 3)
    best.meet(topk.ImpactIndex(np.arange(4), wide))
    top = (1 << 63) - 1
    assert best.found[1:].T.tolist() == [[top, 0], [top, 1], [(7 << 40) - 21, 3]]


def test_very_long_texts(spark) -> None:  # noqa: ANN001
    df = long_texts(spark)
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(70_000, 70_050)))], "item_id long, text string")
    got = {r["doc_id"]: r for r in lines.report(df).collect()}
    assert [(got[i]["n_lines"], got[i]["n_removed"]) for i in range(5)] == [(20_000, 0), (20_000, 20_000), (1, 0), (1, 0), (1, 0)]
    assert _kept(df) == [0, 2, 4]
    assert {r["doc_id"]: r["component_id"] for r in simhash.report(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.report(df, bench).collect()} == {0: 0, 1: 0, 2: 50, 3: 50, 4: 0}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert len(cut) == 5 and "w69999  w70050" in cut[2] and "w70010 " not in cut[2]


def test_intermediate_tables_are_removed(spark) -> None:  # noqa: ANN001
    common.release(spark)
    df = documents(spark, ["a b\nc d", "a b\nc d"])
    lines.report(df).collect()
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert len(glob.glob(f"{base}/granum-roles-*")) >= 1
    assert common.release(spark) >= 1 and not glob.glob(f"{base}/granum-*") and common.release(spark) == 0


def test_bitmaps_hold_their_keys(spark, monkeypatch) -> None:  # noqa: ANN001
    keys = spark.range(500).selectExpr("xxhash64(id) as k").union(spark.createDataFrame([(-1,), (0,), (63,), (64,)], "k long"))
    for bits, left in ((1 << 24, 0), (1 << 12, 1200), (1 << 5, 2000)):  # the last is too crowded to be of use
        monkeypatch.setattr(common, "BITS", bits)
        held = common.bitmap(keys, "k")
        assert (held is None) == (bits == 32)
        assert keys.where(~common.bitmap_has(held, F.col("k"))).count() == 0
        others = spark.range(1000, 3000).selectExpr("xxhash64(id) as k").where(common.bitmap_has(held, F.col("k"))).count()
        assert others <= left
