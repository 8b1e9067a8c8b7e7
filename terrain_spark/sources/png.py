"""PNG images to and from arrays of pixels, for 8-bit grey, RGB and RGBA images without interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIGN = b"\x89PNG\r\n\x1a\n"
_BANDS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """Height × width × bands of bytes."""
    if data[:8] != _SIGN:
        raise ValueError("no PNG image")
    at, body, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + n
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in _BANDS or interlaced:
        raise ValueError("only 8-bit grey, RGB and RGBA images without interlacing are read")
    bands = _BANDS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * bands)
    if (raw[:, 0] > 2).any():
        return _by_diagonals(raw[:, 0], raw[:, 1:].reshape(height, width, bands))
    out = np.zeros((height, width * bands), np.uint8)
    zero = np.zeros(width * bands, np.uint8)
    for y in range(height):
        kind, line, up = raw[y, 0], raw[y, 1:], out[y - 1] if y else zero
        out[y] = line if kind == 0 else np.cumsum(line.reshape(width, bands), axis=0, dtype=np.uint8).reshape(-1) if kind == 1 else line + up
    return out.reshape(height, width, bands)


def _by_diagonals(kinds: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Undoes filters whose pixels depend on those to the left and above: the pixels of a diagonal don't depend on each other."""
    height, width, bands = raw.shape
    out = np.zeros((height + 1, width + 1, bands), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        a, b, c, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y][:, None]
        by_a, by_b, by_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((by_a <= by_b) & (by_a <= by_c), a, np.where(by_b <= by_c, b, c))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) // 2, nearest], 0)
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def encode(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    bands = 1 if pixels.ndim == 2 else pixels.shape[2]
    colour = {v: k for k, v in _BANDS.items()}[bands]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.zeros((height, 1 + width * bands), np.uint8)
    raw[:, 1:] = pixels.reshape(height, -1)
    return _SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


@F.pandas_udf(T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("width", "height", "bands")], T.StructField("pixels", T.BinaryType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    images = [decode(bytes(x)) for x in content]
    return pd.DataFrame({"width": [x.shape[1] for x in images], "height": [x.shape[0] for x in images], "bands": [x.shape[2] for x in images], "pixels": [x.tobytes() for x in images]})


@F.pandas_udf(T.BinaryType())
def encoded(pixels: pd.Series, width: pd.Series, height: pd.Series, bands: pd.Series) -> pd.Series:
    return pd.Series([encode(np.frombuffer(bytes(p), np.uint8).reshape(h, w, b)) for p, w, h, b in zip(pixels, width, height, bands, strict=True)])


@F.pandas_udf(T.LongType())
def byte_sum(pixels: pd.Series) -> pd.Series:
    """The sum of all bytes."""
    return pd.Series([int(np.frombuffer(bytes(p), np.uint8).sum(dtype=np.int64)) for p in pixels])
