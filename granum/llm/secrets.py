"""Secret scan with structural confirmation.

Three base patterns mark assignments, access keys and hex runs.  Beside them, runs that
could be base64 (either alphabet) or hex of a key are decoded and reported only if their
structure is that of secret material: the DER layouts of private keys (PKCS#1, DSA, SEC1,
PKCS#8 and its encrypted form), OpenSSH private key files, and tokens whose header is a JSON
object with an ``alg``.  Public keys, certificates and signatures have other layouts and are
not reported.  The length that a structure states tells where it ends, so keys are found
without padding, before a next line of text, wrapped, indented, or with escaped line ends.
Only the lengths are read, a few bytes each, wherever in the run they stand, so the work at
a possible start does not depend on the length of what follows, and a text costs time in
proportion to its length.  Spans are code point offsets.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "token", "der", "openssh")

# The base patterns and their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Dotted runs of base64url parts, any of which may be the header of a token.
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")
#: What a text with a token has: a dot behind enough characters for a header.
_TOKEN_SIGN = re.compile(r"\.(?<=[A-Za-z0-9_-]{14}\.)")


def _starts(sign: str, then: str, alphabet: str, flags: int = 0) -> re.Pattern:
    """Where a run may start with ``sign`` and ``then``: not inside another, but behind an escaped line end or PEM dashes."""
    return re.compile(rf"{sign}(?={then})(?:(?<![{alphabet}]{sign})|(?<=\\n{sign})|(?<=-----{sign}))", flags)


_ALPHABET = {True: "A-Za-z0-9+/_-", False: "0-9A-Fa-f"}
#: A DER sequence starts with 0x30, so its base64 with M.
_DER64 = _starts("M", "[A-Za-z0-9+/_-]{15}", _ALPHABET[True])
_SSH64 = _starts("b", "3BlbnNzaC1rZXktdjEA", _ALPHABET[True])
_DERHEX = _starts("3", "0[0-9A-Fa-f]{22}", _ALPHABET[False])
_SSHHEX = _starts("6", "f70656e7373682d6b65792d763100", _ALPHABET[False], re.IGNORECASE)
#: What may stand between two lines of a key: a line end, real or escaped, and indentation.
_JOIN = r"(?:\r?\n|\\r\\n|\\n)[ \t]*"
#: A line of a run, and what joins it to the next one.
_LINE = {b: re.compile(rf"([{c}]+)({_JOIN}(?=[{c}]))?") for b, c in _ALPHABET.items()}
#: Most values of a sequence; the private layouts have ten at most.
_VALUES = 16
#: Longest name of a cipher, and most keys of an OpenSSH file (which holds one).
_NAME, _KEYS = 64, 16
_MAGIC = b"openssh-key-v1\x00"
_CIPHER = re.compile(rb"none|(?:aes|3des|chacha)[A-Za-z0-9@.-]*")
#: Object identifiers of password-based encryption, as they begin in DER.
_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_INT, _OCTETS, _OID, _SEQ = 0x02, 0x04, 0x06, 0x30


def _decoded(run: str) -> bytes:
    """Base64 of either alphabet, without padding, as bytes; a cut-off last byte goes."""
    flat = run.replace("-", "+").replace("_", "/")
    flat = flat[:-1] if len(flat) % 4 == 1 else flat
    try:
        return base64.b64decode(flat + "=" * (-len(flat) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_header(data: bytes | Encoded, at: int) -> tuple[int, int] | None:
    """Where the DER value at ``at`` has its body, and its end; None if no length is stated right."""
    if at + 2 > len(data):
        return None
    size, body = data[at + 1], at + 2
    if size & 0x80:
        k = size & 0x7F
        if not 1 <= k <= 4 or body + k > len(data) or data[body] == 0:
            return None
        size, body = int.from_bytes(data[body : body + k], "big"), body + k
        if size < 128:
            return None
    return body, body + size


def der_parts(data: bytes | Encoded, at: int, stop: int) -> list[tuple[int, int, int]] | None:
    """``(tag, body, end)`` of the values that fill ``data[at:stop]``; None if they do not, or are more than any layout has."""
    out = []
    while at < stop:
        header = der_header(data, at)
        if header is None or header[1] > stop or len(out) == _VALUES:
            return None
        out.append((data[at], *header))
        at = header[1]
    return out


def is_private_der(data: bytes | Encoded) -> bool:
    """One DER sequence that fills ``data`` with the layout of a private key."""
    top = der_header(data, 0)
    if not len(data) or data[0] != _SEQ or top is None or top[1] != len(data):
        return False
    parts = der_parts(data, *top)
    if not parts:
        return False
    tags = [t for t, _, _ in parts]

    def named(i: int, starts: tuple[bytes, ...] = (b"",)) -> bool:  # an algorithm: a sequence that an object identifier leads
        inner = der_parts(data, *parts[i][1:])
        return bool(inner) and inner[0][0] == _OID and inner[0][2] > inner[0][1] and data[inner[0][1] : inner[0][1] + 16].startswith(starts)

    if tags == [_SEQ, _OCTETS]:
        return named(0, _ENCRYPTION)
    number = data[parts[0][1] : parts[0][2]] if tags[0] == _INT and parts[0][2] - parts[0][1] == 1 else None
    if number not in (b"\x00", b"\x01"):
        return False
    filled = all(e > b for _, b, e in parts)
    if tags[1:3] == [_SEQ, _OCTETS]:
        return named(1) and filled and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:])
    if tags[1:2] == [_OCTETS]:
        return number == b"\x01" and parts[1][2] - parts[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    whole = [t for t in tags if t == _INT]
    return filled and (len(whole) == 9 and tags[9:] in ([], [_SEQ]) or tags == [_INT] * 6)


def openssh_end(data: bytes | Encoded) -> int:
    """Where an OpenSSH private key file ends in ``data``, or -1 if its lengths do not nest."""
    if data[: len(_MAGIC)] != _MAGIC:
        return -1
    at = len(_MAGIC)

    def string() -> tuple[int, int] | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return at - size, at

    cipher, kdf, options = string(), string(), string()
    if cipher is None or kdf is None or options is None or cipher[1] - cipher[0] > _NAME or not _CIPHER.fullmatch(data[slice(*cipher)]):
        return -1
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= _KEYS:
        return -1
    for _ in range(keys):
        held = string()
        if held is None or held[0] == held[1]:
            return -1
    held = string()
    return at if held is not None and held[0] < held[1] else -1


class Runs:
    """The runs of a text: lines of one alphabet, joined over line ends, without what joins them."""

    def __init__(self, text: str, base64_: bool) -> None:
        self.text, self.base64_ = text, base64_
        self.start, self.place, self.last = [], [], []  # of each line: where it is in the text and in ``flat``, and its run's last line
        pieces, size, first = [], 0, 0
        for m in _LINE[base64_].finditer(text):
            self.start.append(m.start())
            self.place.append(size)
            pieces.append(m[1])
            size += len(m[1])
            if m[2] is None:
                self.last += [len(pieces) - 1] * (len(pieces) - first)
                first = len(pieces)
        self.place.append(size)
        self.flat = "".join(pieces)

    def at(self, start: int) -> Encoded:
        """What the run encodes from a place in the text on."""
        line = bisect_right(self.start, start) - 1
        return Encoded(self, self.place[line] + start - self.start[line], self.place[self.last[line] + 1])

    def end(self, stop: int) -> int | None:
        """The place in the text behind ``flat[:stop]``, None if the run goes on directly."""
        line = bisect_right(self.place, stop - 1) - 1
        end = self.start[line] + stop - self.place[line]
        return end if stop == self.place[line + 1] or self.text.startswith("-----", end) else None


class Encoded:
    """Decoded bytes of a stretch of a run: the first ``HEAD`` at once, each slice beyond as it is asked for."""

    HEAD = 48

    def __init__(self, runs: Runs, start: int, stop: int, size: int | None = None) -> None:
        self.runs, self.start, self.stop = runs, start, stop
        most = (stop - start) * 3 // 4 if runs.base64_ else (stop - start) // 2
        self.size = most if size is None else min(size, most)
        self.head = self._decode(0, min(self.HEAD, most))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int | slice) -> int | bytes:
        if isinstance(at, int):
            return self[at : at + 1][0]
        lo, hi, _ = at.indices(self.size)
        return self.head[lo:hi] if hi <= len(self.head) else self._decode(lo, hi)

    def _decode(self, lo: int, hi: int) -> bytes:
        if hi <= lo:
            return b""
        if not self.runs.base64_:
            return bytes.fromhex(self.runs.flat[self.start + 2 * lo : self.start + 2 * hi])
        first, past = self.start + lo // 3 * 4, min(self.start + -(-hi // 3) * 4, self.stop)
        return _decoded(self.runs.flat[first:past])[lo % 3 : lo % 3 + hi - lo]

    def first(self, size: int) -> Encoded:
        """The first ``size`` bytes."""
        return Encoded(self.runs, self.start, self.stop, size)

    def span(self, size: int) -> tuple[int, int] | None:
        """Where the first ``size`` bytes stand in the text, with padding; None if the run goes on directly behind them."""
        runs = self.runs
        end = runs.end(self.start + (-(-size * 4 // 3) if runs.base64_ else 2 * size))
        if end is None:
            return None
        for _ in range(-size % 3 if runs.base64_ else 0):
            end += runs.text[end : end + 1] == "="
        line = bisect_right(runs.place, self.start) - 1
        return runs.start[line] + self.start - runs.place[line], end


def _promising(text: str, at: int, base64_: bool) -> bool:
    """Whether the first bytes of a DER value may lead a private key."""
    run = text[at : at + (16 if base64_ else 24)]
    head = _decoded(run) if base64_ else bytes.fromhex(run)
    top = der_header(head, 0)
    if top is None or head[top[0] : top[0] + 1] not in (b"\x02", b"\x30"):
        return False
    return head[top[0]] != _INT or head[top[0] : top[0] + 3] in (b"\x02\x01\x00", b"\x02\x01\x01")


def _key(data: Encoded, ssh: bool) -> tuple[int, int] | None:
    """The span of the private key that ``data`` starts with."""
    if ssh:
        size = openssh_end(data)
    else:
        top = der_header(data, 0)
        size = top[1] if top and top[1] <= len(data) and is_private_der(data.first(top[1])) else -1
    return data.span(size) if size > 0 else None


def _header(part: str) -> dict | None:
    """The JSON object that a base64url part encodes, if it has an ``alg``."""
    if len(part) < 14:
        return None
    raw = _decoded(part) if len(part) % 4 != 1 else b""
    if raw.lstrip()[:1] != b"{":
        return None
    try:
        header = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return header if isinstance(header, dict) and isinstance(header.get("alg"), str) else None


def _tokens(text: str) -> list[tuple[int, int, str]]:
    """Spans of signed (three parts) and encrypted (five) tokens."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at, done = m[0].split("."), m.start(), 0
        for i, part in enumerate(parts):
            if i >= done and len(parts) - i >= 3 and (header := _header(part)) is not None:
                n = 5 if "enc" in header and len(parts) - i >= 5 else 3
                size = sum(map(len, parts[i : i + n])) + n - 1
                out.append((at, at + size, "token"))
                done = i + n
            at += len(part) + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of the three base patterns, unsorted."""
    out = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans whose decoded structure is that of a private key or a token, unsorted."""
    out = _tokens(text) if _TOKEN_SIGN.search(text) else []
    runs: dict[bool, Runs] = {}
    for kind, sign, pattern, base64_ in (
        ("openssh", "b3BlbnNzaC1rZXktdjE", _SSH64, True), ("openssh", "6f", _SSHHEX, False), ("openssh", "6F", _SSHHEX, False), ("der", "M", _DER64, True), ("der", "30", _DERHEX, False),
    ):
        done = 0
        for m in pattern.finditer(text) if sign in text else ():
            at = m.start()
            if at < done or (kind == "der" and not _promising(text, at, base64_)):
                continue
            if base64_ not in runs:
                runs[base64_] = Runs(text, base64_)
            if span := _key(runs[base64_].at(at), kind == "openssh"):
                out.append((*span, kind))
                done = span[1]
    return sorted(set(out))


def find(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind; none for null and empty texts."""
    if not text:
        return []
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[0], order[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end`` of each span, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every span, or union of overlapping ones, replaced by ``mark``."""
    out, done = [], 0
    for a, b, _ in find(text):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``, an array of ``(kind, start, end)``.

    Map-only, whole texts; null and empty texts get an empty array, repeated rows are
    treated alike, and a column of ``docs`` named ``spans`` is replaced.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "spans"])
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*src.schema.fields, T.StructField("spans", T.ArrayType(item))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in find(t.as_py())] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "spans"])

    return src.mapInArrow(each, schema)


def report(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    fields = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]
    src = docs.select("doc_id", "text")
    schema = T.StructType([src.schema["doc_id"], *[T.StructField(a, b) for a, b in fields]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                spans = find(t.as_py())
                base = [s for s in spans if s[2] in LEAST]
                counts = [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [pa.array(c, pa.string() if i > 2 else pa.int64()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return src.mapInArrow(each, schema)
