"""Quality classifier without labels: a weak-label model and a hashed linear scorer.

Overlapping heuristics each vote good, bad or abstain on a document.  Votes are counted by
pattern over the whole corpus (at most ``3 ** len(LABELLERS)`` rows), and
expectation-maximisation under a two-class model with independent labellers estimates each
one's accuracies and the share of good documents.  The posterior of each pattern then
labels a bounded sample, on which a logistic scorer over hashed character-shape trigrams
and text statistics is trained.  Every document is scored by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents the scorer is fitted on: those of smallest id hash.
SAMPLE = 3000
#: Hashed features of the scorer.
DIMS = 2048
#: Documents with a lower score are rejected.
CUT = 0.5
#: Most weight of a document of the rarer class in training.
BALANCE = 4.0
GOOD, BAD, NONE = 1, 0, 2

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that for it as was with be by on are this or an at from "
    b"der die und das den von zu mit sich des auf ist im dem nicht ein eine "
    b"de la le et les des en un du une que est pour qui dans sur par au plus "
    b"el los y las del se por con una su para es al lo como".split()
)
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-")
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Character shapes: letters a or A, digits 0, white space as it is, other ASCII itself.
_SHAPE = bytes(65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else 48 if 48 <= b < 58 else b for b in range(256))


def statistics(raw: bytes) -> dict[str, float]:
    """The text statistics that the labellers read, from the UTF-8 bytes of a text."""
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    lower = [w.lower().strip(b".,;:!?") for w in words]
    upper = sum(raw.count(bytes([c])) for c in _UPPER) if n else 0
    letters = upper + len(raw) - len(raw.translate(None, _LOWER))
    return {
        "words": n,
        "symbols": (len(raw) - len(raw.translate(None, _SYMBOLS))) / size,
        "upper": upper / max(1, letters),
        "shouts": raw.count(b"!!") / max(1, n),
        "bars": words.count(b"|") / max(1, n),
        "repeats": sum(map(bytes.__eq__, lower[1:], lower[:-1])) / max(1, n - 1),
        "distinct": len(set(lower)) / n**0.85 if n else 0.0,
        "function": sum(w in FUNCTION_WORDS for w in lower) / max(1, n),
        "mean_len": sum(map(len, words)) / max(1, n),
    }


def _band(x: float, bad: float, good: float) -> int:
    """A vote from a value where large is bad, abstaining between the two marks."""
    return BAD if x >= bad else GOOD if x <= good else NONE


# The labellers and their marks.
LABELLERS = {
    "symbols": lambda s: _band(s["symbols"], 0.04, 0.01),
    "upper": lambda s: _band(s["upper"], 0.35, 0.10),
    "shouts": lambda s: _band(s["shouts"], 0.10, 0.01),
    "bars": lambda s: _band(s["bars"], 0.15, 0.01),
    "repeats": lambda s: _band(s["repeats"], 0.25, 0.06),
    "distinct": lambda s: NONE if s["words"] < 30 else _band(-s["distinct"], -0.20, -0.35),
    "function": lambda s: NONE if s["words"] < 12 else _band(-s["function"], -0.03, -0.10),
    "words": lambda s: BAD if not s["words"] else GOOD if s["words"] >= 12 else NONE,
    "mean_len": lambda s: NONE if s["words"] < 12 else BAD if not 2.0 <= s["mean_len"] <= 14.0 else GOOD if 3.0 <= s["mean_len"] <= 9.0 else NONE,
}


def votes(stats: dict[str, float]) -> int:
    """The votes of all labellers as one base-3 number."""
    code = 0
    for fn in LABELLERS.values():
        code = code * 3 + fn(stats)
    return code


class LabelModel:
    """Class share and per-labeller vote probabilities from counts of vote patterns.

    ``rates[c, k, v]`` is the probability that labeller ``k``, where it votes, votes ``v``
    on a document of class ``c``; abstaining tells nothing (rate 1).  Expectation-maximisation starts from trust in the labellers, and keeps
    the rate of false bad votes at or below ``FALSE_ALARM``: defects are specific and a
    document seldom has two, so the data alone would read a rare defect as a habit of
    good documents.  For the same reason a labeller finds at least ``FINDS`` of the bad
    documents and at least half of all are good; else a class without defects could pass
    for bad.
    """

    FALSE_ALARM, FINDS = 0.002, 0.1

    def __init__(self, counts: dict[int, int], rounds: int = 100) -> None:
        k = len(LABELLERS)
        codes = np.array(sorted(counts), dtype=np.int64)
        weight = np.array([counts[int(c)] for c in codes], dtype=np.float64)
        v = (codes[:, None] // 3 ** np.arange(k - 1, -1, -1)) % 3
        hot = (v[:, :, None] == np.arange(3)).astype(float)
        self.share = 0.8
        start = np.array([[0.2, 0.8, 1.0], [self.FALSE_ALARM, 1 - self.FALSE_ALARM, 1.0]])
        self.rates = np.repeat(start[:, None, :], k, axis=1)
        for _ in range(rounds if len(codes) else 0):
            p = self._posterior(hot)
            self.share = float(np.clip((weight * p).sum() / weight.sum(), 0.5, 0.99))
            for c, mass in ((0, weight * (1 - p)), (1, weight * p)):
                n = np.einsum("i,ikv->kv", mass, hot)[:, :NONE] + 5 * start[c, :NONE]
                self.rates[c, :, :NONE] = n / n.sum(axis=1, keepdims=True)
            self.rates[1, :, BAD] = np.minimum(self.rates[1, :, BAD], self.FALSE_ALARM)
            self.rates[0, :, BAD] = np.maximum(self.rates[0, :, BAD], self.FINDS)
            self.rates[:, :, GOOD] = 1 - self.rates[:, :, BAD]
        post = self._posterior(hot)
        self.posterior = {int(c): float(x) for c, x in zip(codes, post, strict=True)}

    def _posterior(self, hot: np.ndarray) -> np.ndarray:
        logs = np.einsum("ikv,ckv->ci", hot, np.log(self.rates)) + np.log([[1 - self.share], [self.share]])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def features(raw: bytes, stats: dict[str, float]) -> np.ndarray:
    """Hashed shape trigrams (log share) and bucketed statistics, of unit length."""
    x = np.zeros(DIMS, dtype=np.float32)
    shape = np.frombuffer(raw.translate(_SHAPE), dtype=np.uint8).astype(np.uint32)
    if len(shape) >= 3:
        h = (shape[:-2] * 0x9E37 + shape[1:-1] * 0x85EB + shape[2:] * 0xC2B3) * np.uint32(0x27D4EB2F)
        counts = np.bincount((h >> np.uint32(21)).astype(np.int64), minlength=DIMS)[:DIMS]
        x += np.log1p(100.0 * counts / len(shape)).astype(np.float32)
    for i, (name, value) in enumerate(sorted(stats.items())):
        bucket = int(min(31, 4 * np.log2(1 + value) if name in ("words", "mean_len") else 32 * min(value, 0.99)))
        x[(i * 40503 + bucket * 2654435) % DIMS] += 1.0
    norm = float(np.sqrt((x * x).sum()))
    return x / norm if norm else x


def fit_scorer(x: np.ndarray, target: np.ndarray, rounds: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights and bias for posteriors as targets.

    A document counts by how sure its posterior is; the rarer class counts up to
    ``BALANCE`` times.  With nothing known the scorer keeps everything.
    """
    w, b = np.zeros(x.shape[1]), 1.0
    weight = np.abs(2 * target - 1)
    if not weight.sum():
        return w, b
    target = (target > 0.5).astype(float)
    good, bad = (weight * target).sum(), (weight * (1 - target)).sum()
    weight = weight * np.where(target > 0.5, min(BALANCE, max(1.0, bad / max(good, 1e-9))), min(BALANCE, max(1.0, good / max(bad, 1e-9))))
    weight /= weight.sum()
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = weight * (p - target)
        vw = 0.9 * vw - 8.0 * (x.T @ g + decay * w)
        vb = 0.9 * vb - 8.0 * g.sum()
        w, b = w + vw, b + vb
    return w, float(b)


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def label_counts(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """How many documents of the whole corpus gave each pattern of votes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([votes(statistics(_raw(t.as_py()))) for t in batch.column(0)], dtype=np.int64)
            code, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

    rows = docs.select(text_col).mapInArrow(each, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {r["code"]: r["n"] for r in rows}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray, float]:
    """The label model of the corpus and the scorer fitted on ``sample`` documents."""
    model = LabelModel(label_counts(docs, text_col))
    schema = "code long, x binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, xs = [], []
            for t in batch.column(0):
                raw = _raw(t.as_py())
                s = statistics(raw)
                codes.append(votes(s))
                xs.append(features(raw, s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(xs, pa.binary())], names=["code", "x"])

    # the smallest hashes of id and text; rows that repeat count once, so the bound holds
    key = F.xxhash64(id_col, text_col)
    chosen = docs.select(key.alias("key")).orderBy("key").limit(sample)
    top = chosen.agg(F.max("key")).first()[0]
    if top is None:
        return model, np.zeros(DIMS), 1.0
    few = docs.where(key <= top).groupBy(key.alias("key")).agg(F.first(text_col).alias("text")).select("text")
    rows = few.mapInArrow(each, schema).collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), dtype=np.float32).reshape(len(rows), DIMS).astype(np.float64)
    target = np.array([model.posterior.get(r["code"], 0.5) for r in rows])
    w, b = fit_scorer(x, target)
    return model, w, b


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``votes, weak_label, score, keep``.

    ``votes`` is the pattern as base-3 digits, ``weak_label`` the label model's posterior,
    ``score`` the linear scorer's probability that the document is good, ``keep`` whether
    it is at least ``CUT``.  Null and empty texts are wordless documents, voted bad by
    length.  Repeated rows are treated alike; an empty table gives an empty result;
    columns of ``docs`` with these names are replaced.
    """
    names = ("votes", "weak_label", "score", "keep")
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    model, w, b = train(src, id_col, text_col, sample)
    weights, posterior = w.astype(np.float32), model.posterior
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*src.schema.fields, *[T.StructField(a, k) for a, k in zip(names, kinds, strict=True)]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, scores = [], []
            for t in batch.column(batch.schema.get_field_index(text_col)):
                raw = _raw(t.as_py())
                s = statistics(raw)
                codes.append(votes(s))
                scores.append(float(1 / (1 + np.exp(-(float(features(raw, s) @ weights) + b)))))
            extra = [
                pa.array([np.base_repr(c, 3).zfill(len(LABELLERS)) for c in codes], pa.string()),
                pa.array([posterior.get(c, 0.5) for c in codes], pa.float64()),
                pa.array(scores, pa.float64()),
                pa.array([x >= CUT for x in scores], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    return src.mapInArrow(each, schema)


def report(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, votes, weak_label, score, keep``."""
    return classify(docs.select("doc_id", "text")).select("doc_id", "votes", "weak_label", "score", "keep")
