"""Exact token counts at every prefix of a text.

For a byte-level BPE vocabulary, the tokens of a word's prefix of ``j`` bytes end in the
one token ``t`` for which ``t`` is a suffix of the prefix and follows the last token of
the remaining prefix, that is, the pair of the two encodes to itself.  Dynamic
programming over ``j`` so gives the count of every prefix of a word in one pass.  Words
are those of the vocabulary's pre-tokeniser; as no token crosses words, the counts of a
text's prefixes are running sums over its words' counts.  A word is worked out once per
task and remembered.  Counts are kept as one signed byte per code point (the change from
the prefix one shorter), from which truncation and budget questions are answered without
encoding again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pre-tokeniser pattern of the vocabulary, as published with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A unit is what the pattern may cut differently when more text follows: a run of white
#: space with the word behind it, or else a single word.
UNIT = regex.compile(r"\s{2,}(?:(?<= )(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|(?<! )(?:'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+))|'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s(?:'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
SPACES = regex.compile(r"\s*")
#: Remembered units and seams per process.
MEMORY = 300_000


def refuse_other_kinds(spec: dict) -> None:
    """Raise ``ValueError`` for a vocabulary file whose text handling differs from what is built here.

    That is: byte-level BPE under :data:`PATTERN`, no normaliser, no prefix space, added
    tokens found literally, and no option of the model that changes how words are merged.
    """
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [
        spec.get("normalizer") is not None and "a normaliser",
        (before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)) and "another pre-tokeniser",
        model.get("type", "BPE") != "BPE" and "another model",
        any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")) and "an option of the model",
        any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")) and "added tokens that take neighbours",
    ]
    if any(wrong):
        raise ValueError("not a plain byte-level vocabulary: it has " + ", ".join(w for w in wrong if w))


class PrefixCounter:
    """Prefix token counts under the vocabulary of a byte-level BPE ``tokenizer.json``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_other_kinds(spec)
        chars = self._byte_chars()
        back = {c: b for b, c in chars.items()}
        raw = lambda s: bytes(back[c] for c in s)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        known = set(self.special)
        self.vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in known}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            x, y = map(raw, m.split(" ") if isinstance(m, str) else m)
            pair = (self.vocab[x], self.vocab[y])
            self.ranks.setdefault(pair, rank)
            self.made.setdefault(self.vocab[x + y], (*pair, rank))
        self.spines: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.seen: dict[str, bytes] = {}
        self.splitter = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    @staticmethod
    def _byte_chars() -> dict[int, str]:
        """Byte to the printable character that stands for it in byte-level vocabularies."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens at one edge of a token's merge tree (0 left, 1 right), innermost first.

        Each comes with the rank that made it (-1 for a byte) and the rank that used it up.
        """
        known = self.spines.get((token, side))
        if known is None:
            known, used = [], len(self.ranks)
            at: int | None = token
            while at is not None:
                parts = self.made.get(at)
                born = parts[2] if parts else -1
                known.append((at, born, used))
                at, used = (parts[side], born) if parts else (None, 0)
            known.reverse()
            self.spines[token, side] = known
        return known

    def adjoins(self, left: int, right: int) -> bool:
        """Whether the two tokens, written together, encode to themselves.

        They do unless two tokens at the seam that exist at the same time have a merge
        that comes before the merges inside either token (at equal ranks the leftmost
        pair goes first).
        """
        a, b = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        known = True
        ranks = self.ranks
        while i < len(a) and j < len(b):
            x, _, end_x = a[i]
            y, _, end_y = b[j]
            r = ranks.get((x, y))
            if r is not None and r < end_x and r <= end_y:
                known = False
                break
            if end_x <= end_y:
                i += 1
            else:
                j += 1
        if len(self.follows) > MEMORY:
            self.follows.clear()
        self.follows[left, right] = known
        return known

    def word(self, data: bytes) -> list[int]:
        """Token counts of all byte prefixes of one word; ``[0]`` is 0.

        The automaton gives the tokens that end at each byte, longest first.
        """
        n = len(data)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        follows, done = self.follows, 0
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            if end < done:
                continue
            i = end + 1 - size
            if i:
                known = follows.get((last[i], token))
                if known is None:
                    known = self.adjoins(last[i], token)
                if not known:
                    continue
            done = end + 1
            last[done], count[done] = token, count[i] + 1
        if done != n:
            raise ValueError("the vocabulary lacks a single byte")
        return count

    def unit(self, text: str) -> bytes:
        """Changes of the count at each code point of a unit, as signed bytes."""
        lead = SPACES.match(text).end()
        body = text[lead:]
        if lead == 0 or not body or (lead == 1 and text[0] == " "):
            counts = self._at_points(text) if text[:1] != "'" or len(text) < 3 or not text[1:].isalpha() else self._short_form(text)
        else:
            space = self._at_points(text[:lead])
            if text[lead - 1] == " ":
                base, tail, head = space[lead - 1], self._tail(" " + body), 1
            else:
                base = space[lead - 1] + self._at_points(text[lead - 1 : lead])[-1]
                tail, head = self._tail(body), 0
            counts = space + [base + c for c in tail[1 + head :]]
        changes = [b - a for a, b in zip(counts, counts[1:])]  # noqa: B905
        if changes and not -128 <= min(changes) <= max(changes) < 128:
            raise OverflowError("a count changes by more than a signed byte holds")
        return bytes([c & 255 for c in changes])

    def _tail(self, word: str) -> list[int]:
        return self._short_form(word) if word[0] == "'" and len(word) >= 3 and word[1:].isalpha() else self._at_points(word)

    def _short_form(self, text: str) -> list[int]:
        """Counts of ``'re``-like words, whose shorter prefixes are cut behind the quote."""
        quote = self._at_points("'")[-1]
        inner = [quote + c for c in self._at_points(text[1:])[1:-1]]
        return [0, quote, *inner, self._at_points(text)[-1]]

    def _at_points(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        counts = self.word(data)
        if text.isascii():
            return counts
        return [0] + [counts[j] for j in range(1, len(data) + 1) if j == len(data) or data[j] & 0xC0 != 0x80]

    def changes(self, text: str | None) -> bytes:
        """The change of the count at each code point of a text (null: empty)."""
        if not text:
            return b""
        if self.splitter is None or not self.splitter.search(text):
            return self._plain(text)
        out, done = [], 0
        for m in self.splitter.finditer(text):
            out.append(self._plain(text[done : m.start()]))
            before, inside = self._plain(text[done : m.end() - 1]), self._plain(text[done : m.start()])
            held = np.frombuffer(before, np.int8).sum(dtype=np.int64) - np.frombuffer(inside, np.int8).sum(dtype=np.int64)
            out += [before[len(inside) :], np.array([1 - held], dtype=np.int8).tobytes()]
            if before[: len(inside)] != inside:
                raise AssertionError("a marker changed the words before it")
            done = m.end()
        return b"".join([*out, self._plain(text[done:])])

    def _plain(self, text: str) -> bytes:
        seen, out = self.seen, []
        for u in UNIT.findall(text):
            d = seen.get(u)
            if d is None:
                if len(seen) > MEMORY:
                    seen.clear()
                d = self.unit(u)
                if len(u) <= 64:
                    seen[u] = d
            out.append(d)
        return b"".join(out)


@cache
def counter(path: str) -> PrefixCounter:
    """One counter per process and vocabulary."""
    return PrefixCounter(path)


def default_path() -> str:
    """The production vocabulary; a path parameter may name another."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def total(changes: bytes) -> int:
    """The number of tokens of the whole text."""
    return int(np.frombuffer(changes, np.int8).sum(dtype=np.int64))


def count_at(changes: bytes, n_chars: int) -> int:
    """The number of tokens of the first ``n_chars`` code points."""
    return total(changes[: max(0, n_chars)])


def longest_within(changes: bytes, budget: int) -> int:
    """The most code points of a prefix with at most ``budget`` tokens (prefixes differ, so counts may fall)."""
    running = np.concatenate(([0], np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)))
    return int(np.flatnonzero(running <= budget)[-1]) if budget >= 0 else 0


def prefix_counts(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes, n_tokens, prefix_changes`` (see the module text).

    Null texts count as empty; repeated rows are treated alike; columns of ``docs`` with
    these names are replaced.  Map-only over whole texts.
    """
    names = ("n_bytes", "n_tokens", "prefix_changes")
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    kinds = (T.LongType(), T.LongType(), T.BinaryType())
    schema = T.StructType([*src.schema.fields, *[T.StructField(a, b) for a, b in zip(names, kinds, strict=True)]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path or default_path())
        for batch in batches:
            texts = [t.as_py() for t in batch.column(batch.schema.get_field_index(text_col))]
            made = [c.changes(t) for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            extra = [pa.array(sizes, pa.int64()), pa.array([total(m) for m in made], pa.int64()), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    return src.mapInArrow(each, schema)


def report(docs: DataFrame, limit: int = 1024) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit``."""
    counted = prefix_counts(docs.select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
