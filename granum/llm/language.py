"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut in windows of ``WINDOW``.  In each window one gated
recurrent layer reads forward and one backward (a light gated unit: an update gate and a
candidate, both piecewise linear, so a step is two small products and two clips).  The two
states of a position give it language probabilities, and the mean over all positions of
the text is the document's.  Training is backpropagation through time in numpy on the
driver, from windows of a bounded sample of labelled rows; prediction is map-only over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granum.operators.sizes import broadcast_if_small

#: Bytes of a window, and state size of each direction.
WINDOW, HIDDEN = 64, 8
#: Training bounds: distinct texts of each language, and windows of each, drawn from the whole text.
PER_LANG, PER_TEXT = 200, 24
#: Windows predicted at once.
CHUNK = 2048
UNDETERMINED = "und"

Params = dict[str, np.ndarray]


def _init(n_langs: int, rng: np.random.Generator) -> Params:
    p: Params = {}
    for d in "fb":
        p[f"e{d}"] = rng.normal(0, 0.4, (256, 2 * HIDDEN))
        p[f"e{d}"][:, :HIDDEN] += 0.5
        p[f"u{d}"] = rng.normal(0, 0.15, (HIDDEN, 2 * HIDDEN))
        p[f"v{d}"] = rng.normal(0, 0.5, (HIDDEN, n_langs))
    p["c"] = np.zeros(n_langs)
    return p


def _forward(p: Params, d: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States after each step, and raw gate and candidate sums, of windows ``x`` (steps, rows)."""
    steps, rows = x.shape
    h = np.zeros((steps + 1, rows, HIDDEN))
    raw = np.empty((steps, rows, 2 * HIDDEN))
    for t in range(steps):
        raw[t] = p[f"e{d}"][x[t]] + h[t] @ p[f"u{d}"]
        z, c = np.clip(raw[t, :, :HIDDEN], 0, 1), np.clip(raw[t, :, HIDDEN:], -1, 1)
        h[t + 1] = c + z * (h[t] - c)
    return h, raw


def _backward(p: Params, d: str, x: np.ndarray, h: np.ndarray, raw: np.ndarray, dh_out: np.ndarray) -> Params:
    """Gradients of one direction by backpropagation through time."""
    ge, gu = np.zeros_like(p[f"e{d}"]), np.zeros_like(p[f"u{d}"])
    dh = np.zeros_like(h[0])
    for t in range(len(x) - 1, -1, -1):
        dh = dh + dh_out[t]
        rz, rc = raw[t, :, :HIDDEN], raw[t, :, HIDDEN:]
        z, c = np.clip(rz, 0, 1), np.clip(rc, -1, 1)
        dz = dh * (h[t] - c) * ((rz > 0) & (rz < 1))
        dc = dh * (1 - z) * ((rc > -1) & (rc < 1))
        dr = np.concatenate((dz, dc), axis=1)
        np.add.at(ge, x[t], dr)
        gu += h[t].T @ dr
        dh = dh * z + dr @ p[f"u{d}"].T
    return {f"e{d}": ge, f"u{d}": gu}


def train(windows: np.ndarray, mask: np.ndarray, y: np.ndarray, n_langs: int, epochs: int = 4, batch: int = 256, seed: int = 7) -> Params:
    """Fit by Adam on windows (rows, steps) of language ``y``; ``mask`` marks real bytes."""
    rng = np.random.default_rng(seed)
    p = _init(n_langs, rng)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    share = np.bincount(y, minlength=n_langs) / max(1, len(y))
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * 0.5**epoch
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = order[lo : lo + batch]
            x, k = windows[rows].T, mask[rows].T
            hf, rf = _forward(p, "f", x)
            hb, rb = _forward(p, "b", x[::-1])
            back = hb[1:][::-1]
            logits = hf[1:] @ p["vf"] + back @ p["vb"] + p["c"]
            q = np.exp(logits - logits.max(axis=2, keepdims=True))
            q /= q.sum(axis=2, keepdims=True)
            q[:, np.arange(len(rows)), y[rows]] -= 1
            weight = 1 / np.maximum(share[y[rows]] * n_langs, 0.05)
            g = q * k[:, :, None] * (weight / max(1, k.sum()))[None, :, None]
            grads = {"vf": np.einsum("trh,trl->hl", hf[1:], g), "vb": np.einsum("trh,trl->hl", back, g), "c": g.sum(axis=(0, 1))}
            grads |= _backward(p, "f", x, hf, rf, g @ p["vf"].T)
            grads |= _backward(p, "b", x[::-1], hb, rb, (g @ p["vb"].T)[::-1])
            step += 1
            for name, a in grads.items():
                m[name] += 0.1 * (a - m[name])
                v[name] += 0.01 * (a * a - v[name])
                p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
    return p


def cut(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows, steps), mask of real bytes, and the text number of each window."""
    counts = [-(-len(r) // WINDOW) for r in raws]
    flat = b"".join(r.ljust(c * WINDOW, b"\0") for r, c in zip(raws, counts, strict=True))
    x = np.frombuffer(flat, dtype=np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(raws)), counts)
    left = np.array([len(r) for r in raws])[owner] - WINDOW * (np.arange(len(x)) - np.repeat(np.cumsum([0, *counts[:-1]]) if counts else [], counts))
    return x, np.arange(WINDOW)[None, :] < left[:, None], owner


class Tagger:
    """The trained network in single precision, for prediction."""

    def __init__(self, p: Params, langs: list[str]) -> None:
        self.langs = langs
        self.p = {k: np.ascontiguousarray(a.astype(np.float32)) for k, a in p.items()}

    def _states(self, d: str, x: np.ndarray) -> np.ndarray:
        e, u = self.p[f"e{d}"], self.p[f"u{d}"]
        steps, rows = x.shape
        out = np.empty((steps, rows, HIDDEN), dtype=np.float32)
        h = np.zeros((rows, HIDDEN), dtype=np.float32)
        raw, seen = np.empty((rows, 2 * HIDDEN), dtype=np.float32), np.empty((rows, 2 * HIDDEN), dtype=np.float32)
        gate, cand = raw[:, :HIDDEN], raw[:, HIDDEN:]
        for t in range(steps):
            np.matmul(h, u, out=raw)
            np.take(e, x[t], axis=0, out=seen)
            raw += seen
            np.clip(gate, 0, 1, out=gate)
            np.clip(cand, -1, 1, out=cand)
            h = np.subtract(h, cand, out=out[t])
            h *= gate
            h += cand
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities of each position of windows ``x`` (rows, steps)."""
        xt = np.ascontiguousarray(x.T)
        logits = self._states("f", xt) @ self.p["vf"]
        logits += (self._states("b", xt[::-1]) @ self.p["vb"])[::-1]
        logits += self.p["c"]
        np.clip(logits, -30, 30, out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits.transpose(1, 0, 2)

    def documents(self, raws: list[bytes]) -> np.ndarray:
        """Mean language probabilities over all positions of each text (zeros for empty)."""
        total, size = np.zeros((len(raws), len(self.langs))), np.zeros(len(raws))
        x, mask, owner = cut(raws)
        for lo in range(0, len(x), CHUNK):
            part = slice(lo, lo + CHUNK)
            p = self.positions(x[part])
            real = mask[part]
            if not real[:, -1].all():
                p = p * real[:, :, None]
            np.add.at(total, owner[part], p.sum(axis=1, dtype=np.float64))
            np.add.at(size, owner[part], real.sum(axis=1))
        return total / np.maximum(size, 1)[:, None]


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", per_lang: int = PER_LANG, per_text: int = PER_TEXT) -> Tagger:
    """Train on at most ``per_lang`` distinct texts of every language, ``per_text`` windows of each.

    Texts are those of smallest hash, so copies count once; windows are drawn from the whole
    text by a generator that the hash seeds.  Rows with null or empty text or null language
    take no part.  With no row there is a tagger without languages.
    """
    clean = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).where("lang is not null and length(text) > 0")
    first = Window.partitionBy("lang").orderBy("th")
    chosen = clean.select("lang", "th").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_lang).drop("r")
    texts = clean.join(broadcast_if_small(chosen), ["lang", "th"]).dropDuplicates(["lang", "th"]).select("lang", "th", "text")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for th, t in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                x, mask, _ = cut([t.as_py().encode("utf-8", "surrogatepass")])
                if len(x) > per_text:
                    x, mask = (a[np.sort(np.random.default_rng(th & (1 << 63) - 1).permutation(len(a))[:per_text])] for a in (x, mask))
                held.append((x.tobytes(), mask.sum(axis=1).astype(np.uint8).tobytes()))
            cols = list(zip(*held, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.binary()) for c in cols]], names=["lang", "th", "x", "sizes"])

    kind = clean.schema["lang"].dataType.simpleString()
    rows = sorted(texts.mapInArrow(windows, f"lang {kind}, th long, x binary, sizes binary").collect(), key=lambda r: (r["lang"], r["th"]))
    if not rows:
        return Tagger(_init(0, np.random.default_rng(0)), [])
    langs = sorted({r["lang"] for r in rows})
    number = {name: i for i, name in enumerate(langs)}
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    sizes = np.frombuffer(b"".join(bytes(r["sizes"]) for r in rows), dtype=np.uint8)
    y = np.repeat([number[r["lang"]] for r in rows], [len(r["sizes"]) for r in rows])
    return Tagger(train(x, np.arange(WINDOW)[None, :] < sizes[:, None], y, len(langs)), langs)


def identify(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the pooled probability).

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned;
    ties go to the language first in order.  Repeated rows are treated alike; columns of
    ``docs`` with these names are replaced.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    schema = T.StructType([*src.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [t.as_py() for t in batch.column(batch.schema.get_field_index(text_col))]
                known = [bool(t) and bool(model.langs) and any(map(str.isalpha, t)) for t in texts]
                p = model.documents([t.encode("utf-8", "surrogatepass") if k else b"" for t, k in zip(texts, known, strict=True)])
                best = p.argmax(axis=1) if model.langs else np.zeros(len(texts), dtype=int)
                lang = [model.langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                score = [float(min(1.0, p[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return src.mapInArrow(each, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score``."""
    tagger = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), tagger).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
