"""The pipeline, the language model and the quality scorer against versions written out plainly."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tests.llm.helpers import documents

from granum.llm import language, quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kept_by_quality(texts: dict[int, str | None]) -> set[int]:
    """Ids that a scorer keeps which is fitted on every text, step by step."""
    raws = {i: (t or "").encode() for i, t in texts.items()}
    stats = {i: quality.statistics(r) for i, r in raws.items()}
    counts: dict[int, int] = defaultdict(int)
    for s in stats.values():
        counts[quality.votes(s)] += 1
    model = quality.LabelModel(dict(counts))
    different = sorted({(i, t) for i, t in texts.items()}, key=str)
    x = [quality.features(raws[i], stats[i]).astype(float) for i, _ in different]
    sure = [model.posterior.get(quality.votes(stats[i]), 0.5) for i, _ in different]
    weight = [abs(2 * p - 1) for p in sure]
    good = sum(w for w, p in zip(weight, sure, strict=True) if p > 0.5)
    bad = sum(w for w, p in zip(weight, sure, strict=True) if p <= 0.5)
    up = (min(quality.BALANCE, max(1.0, bad / max(good, 1e-9))), min(quality.BALANCE, max(1.0, good / max(bad, 1e-9))))
    weight = [w * up[p <= 0.5] for w, p in zip(weight, sure, strict=True)]
    w, b, vw, vb = np.zeros(quality.DIMS), 1.0, np.zeros(quality.DIMS), 0.0
    for _ in range(400):
        slope, level = 1e-4 * w, 0.0
        for row, c, p in zip(x, weight, sure, strict=True):
            miss = c / sum(weight) * (1 / (1 + math.exp(-(float(row @ w) + b))) - (p > 0.5))
            slope, level = slope + miss * row, level + miss
        vw, vb = 0.9 * vw - 8 * slope, 0.9 * vb - 8 * level
        w, b = w + vw, b + vb
    return {i for i in texts if 1 / (1 + math.exp(-(float(quality.features(raws[i], stats[i]) @ w) + b))) >= quality.CUT}


def without_repeated_lines(texts: dict[int, str]) -> dict[int, str]:
    """Of two adjacent lines that occurred before, in order of id, both go."""
    first: dict[tuple[str, str], tuple[int, int]] = {}
    out = {}
    for i in sorted(texts):
        rows, gone = texts[i].split("\n"), set()
        for k in range(len(rows) - 1):
            pair = (rows[k], rows[k + 1])
            if not (rows[k] + rows[k + 1]).strip(" \t\n\x0b\f\r"):
                continue
            at = first.setdefault(pair, (i, k))
            if at[0] != i or k >= at[1] + 2:
                gone |= {k, k + 1}
        if len(gone) < len(rows):
            out[i] = "\n".join(r for k, r in enumerate(rows) if k not in gone)
    return out


def one_of_each_group(texts: dict[int, str]) -> dict[int, str]:
    """The smallest id of each group of texts whose five-word shingles have a similarity of 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        words = t.encode().lower().split()
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in texts}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: texts[i] for i in ids if find(i) == i}


def without_test_passages(texts: dict[int, str], items: list[str | None]) -> dict[int, str]:
    """Texts without the words under any window of ten of an item; those mostly covered go."""
    windows = set()
    for t in items:
        w = WORD.findall((t or "").translate(UPPER))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes, out = {len(w) for w in windows}, {}
    for i, t in texts.items():
        found = list(WORD.finditer(t.translate(UPPER)))
        w, hit = [m[0] for m in found], set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if len(hit) > 0.5 * len(w):
            continue
        left, done = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                left += t[done : found[k].start()]
            done = found[k].end()
        out[i] = left + t[done:]
    return out


def least_padding(lengths: list[int], buckets: int = 8) -> int:
    """By the plain programme over the different lengths."""
    x = sorted(set(lengths))
    n = {v: lengths.count(v) for v in x}
    cost = lambda i, j: sum(n[v] * (x[j - 1] - v) for v in x[i:j])
    table = [[cost(i, j) if i < j else 0 for j in range(len(x) + 1)] for i in range(len(x) + 1)]
    best = [0] + [math.inf] * len(x)
    for _ in range(buckets):
        best = [0] + [min(best[j], *(best[i] + table[i][j] for i in range(j))) for j in range(1, len(x) + 1)]
    return int(best[-1])


def test_pipeline_equals_a_plain_version(spark, tmp_path) -> None:  # noqa: ANN001
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.xxhash64("doc_id")).limit(220).collect()
    texts: dict[int, str | None] = {r["doc_id"]: r["text"] for r in rows}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    items = [r["text"] for r in bench.select("text").collect()]
    rng, base = random.Random(1), max(texts) + 1
    long = [t for t in texts.values() if t and 60 <= len(t.split()) <= 400]
    lines = [f"{rng.choice(long)[:40]} {rng.random()} of a shared line".replace("\n", " ") for _ in range(4)]
    for k, t in enumerate(long[:30]):
        w = t.split(" ")
        made = [t, f"{t} and more", " ".join([*w[:3], "changed", *w[4:]]), f"{t}\n{lines[0]}\n{lines[1]}\n{lines[2]}", f"{lines[1]}\n{lines[2]}\n{lines[3]}\n{' '.join(w[::-1])}", f"{' '.join(sorted(w))} {rng.choice([x for x in items if x])}"]
        texts[base + k] = made[k % len(made)]
    documents(spark, []).unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")

    keep = kept_by_quality(texts)
    step = {i: t for i, t in texts.items() if i in keep and t is not None}
    sizes = [len(texts), len(step)]
    for stage in (without_repeated_lines, one_of_each_group, lambda x: without_test_passages(x, items)):
        before, step = step, stage(step)
        assert step != before  # each stage has work to do
        sizes.append(len(step))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == step and len(got) == len(step), sizes
    assert all(r["n_chars"] == len(r["text"]) for r in got)

    count = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in step.items()}
    assert all(r["n_tokens"] == count[r["doc_id"]] and r["n_pad"] == r["bucket_len"] - r["n_tokens"] >= 0 for r in got)
    assert sum(r["n_pad"] for r in got) == least_padding(list(count.values()))
    place: dict[int, int] = defaultdict(int)
    for r in sorted(got, key=lambda r: r["doc_id"]):
        fit = max(1, 16384 // max(1, r["bucket_len"]))
        at = place[r["bucket_len"]]
        assert (r["batch"], r["slot"]) == divmod(at, fit)
        place[r["bucket_len"]] += 1


def test_language_network_equals_a_scalar_pass() -> None:
    rng = np.random.default_rng(4)
    p = language._init(3, rng)
    tagger = language.Tagger(p, ["a", "b", "c"])
    raws = [b"", b"q", "häuser und 1 \U0001F600".encode(), bytes(rng.integers(1, 256, 64, dtype=np.uint8)), bytes(rng.integers(1, 256, 150, dtype=np.uint8))]
    got = tagger.documents(raws)
    clip = lambda x, lo: min(1.0, max(lo, x))

    def states(d: str, xs: list[int]) -> list[list[float]]:
        h, out = [0.0] * language.HIDDEN, []
        for x in xs:
            sums = [float(p[f"e{d}"][x][c]) + sum(h[k] * float(p[f"u{d}"][k][c]) for k in range(language.HIDDEN)) for c in range(2 * language.HIDDEN)]
            gate, new = [clip(s, 0.0) for s in sums[: language.HIDDEN]], [clip(s, -1.0) for s in sums[language.HIDDEN :]]
            h = [z * old + (1 - z) * c for z, old, c in zip(gate, h, new, strict=True)]
            out.append(h)
        return out

    for raw, row in zip(raws, got, strict=True):
        total = [0.0] * 3
        for lo in range(0, len(raw), language.WINDOW):
            part = raw[lo : lo + language.WINDOW]
            full = list(part) + [0] * (language.WINDOW - len(part))
            ahead, back = states("f", full), states("b", full[::-1])[::-1]
            for t in range(len(part)):
                e = [math.exp(sum(ahead[t][k] * p["vf"][k][c] + back[t][k] * p["vb"][k][c] for k in range(language.HIDDEN)) + p["c"][c]) for c in range(3)]
                total = [s + v / sum(e) for s, v in zip(total, e, strict=True)]
        assert np.allclose(row, [s / max(1, len(raw)) for s in total], atol=2e-5)


def test_quality_scorer_by_plain_descent(spark) -> None:  # noqa: ANN001
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(200).collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    keep = kept_by_quality(texts)
    assert {r["doc_id"] for r in quality.report(df).where("keep").collect()} == keep and len(keep) < len(texts)
