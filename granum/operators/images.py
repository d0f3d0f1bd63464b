"""Image files as the small grey arrays that a digit model reads."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Side, brightness above which a picture is inverted, and mean and deviation of the training pictures.
SIDE, BRIGHT, MEAN, DEVIATION = 28, 127, 0.1307, 0.3081
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(raw: bytes) -> np.ndarray:
    """Rows, columns and channels (1 or 3) of an 8-bit PNG without interlace; ``ValueError`` for others."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, palette, head = 8, b"", None, None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("not an 8-bit PNG without interlace")
    width, height, step = head[0], head[1], _CHANNELS[head[3]]
    try:
        lines = np.frombuffer(zlib.decompress(data), np.uint8)[: height * (width * step + 1)].reshape(height, -1)
    except zlib.error as e:
        raise ValueError("damaged PNG") from e
    out = np.zeros((height + 1, width + 1, step), dtype=np.int64)
    for y, line in enumerate(lines, 1):
        pixels = line[1:].reshape(width, step).astype(np.int64)
        if line[0] in (0, 2):  # no pixel depends on its left neighbour
            out[y, 1:] = pixels + (out[y - 1, 1:] if line[0] else 0)
        elif line[0] == 1:
            out[y, 1:] = np.cumsum(pixels, axis=0)
        else:
            for x in range(1, width + 1):
                left, up, corner = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
                if line[0] == 3:
                    guess = (left + up) // 2
                else:
                    gaps = np.abs([up - corner, left - corner, left + up - 2 * corner])
                    guess = np.where((gaps[0] <= gaps[1]) & (gaps[0] <= gaps[2]), left, np.where(gaps[1] <= gaps[2], up, corner))
                out[y, x] = (pixels[x - 1] + guess) & 255
        out[y] &= 255
    picture = out[1:, 1:]
    if head[3] == 3:
        return palette[picture[:, :, 0]]
    return picture[:, :, : 3 if step >= 3 else 1].astype(np.uint8)


def decode_pnm(raw: bytes) -> np.ndarray:
    """Rows, columns and channels of a binary grey or colour map (P5, P6)."""
    parts = raw.split(None, 4)
    if len(parts) < 4 or parts[0] not in (b"P5", b"P6") or parts[3] != b"255":
        raise ValueError("no binary map of 8 bits")
    width, height, step = int(parts[1]), int(parts[2]), 3 if parts[0] == b"P6" else 1
    return np.frombuffer(raw[len(raw) - width * height * step :], np.uint8).reshape(height, width, step)


def grey(picture: np.ndarray) -> np.ndarray:
    """Luma of a picture (299, 587 and 114 thousandths of red, green and blue)."""
    if picture.shape[2] == 1:
        return picture[:, :, 0].astype(np.float64)
    return np.floor((picture.astype(np.int64) @ np.array([299, 587, 114])) / 1000 + 0.5)


def resized(x: np.ndarray, side: int = SIDE) -> np.ndarray:
    """``x`` at ``side`` by ``side`` with triangle filters, widened where it shrinks."""

    def weights(n: int) -> np.ndarray:
        scale = n / side
        wide = max(scale, 1.0)
        centre = (np.arange(side) + 0.5) * scale - 0.5
        w = np.maximum(0, 1 - np.abs(np.arange(n)[None, :] - centre[:, None]) / wide)
        return w / w.sum(axis=1, keepdims=True)

    return weights(x.shape[0]) @ x @ weights(x.shape[1]).T


def preprocessed(raw: bytes | None) -> np.ndarray:
    """The model's input of one file: grey, dark ground, small, standardised."""
    if not raw:
        raise ValueError("empty file")
    x = grey(decode_pnm(raw) if raw[:1] == b"P" else decode_png(raw))
    if x.mean() > BRIGHT:
        x = 255 - x
    return (resized(x) / 255 - MEAN) / DEVIATION


def digits(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` (such as ``binaryFile`` reads) with ``pixels``, a flat array, or an ``error`` where a file is no picture.

    The file's bytes are left out; null and empty files are errors.
    """
    keep = [f for f in files.schema.fields if f.name not in (content, "pixels", "error")]
    schema = T.StructType([*keep, T.StructField("pixels", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels, errors = [], []
            for raw in batch.column(batch.schema.get_field_index(content)):
                try:
                    pixels.append(preprocessed(raw.as_py()).astype(np.float32).ravel())
                    errors.append(None)
                except (ValueError, IndexError, TypeError, struct.error) as e:
                    pixels.append(None)
                    errors.append(str(e) or "damaged file")
            extra = [pa.array(pixels, pa.list_(pa.float32())), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], *extra], names=schema.names)

    return files.mapInArrow(each, schema)
