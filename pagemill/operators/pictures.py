"""Pictures in files: PNG bytes to grey pixels, and their area means on a smaller grid, ready for the hashes of operators.change."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type: grey, colour, palette, grey and alpha, colour and alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Weights of red, green and blue in a grey value, of 65,536.
LUMA = (19595, 38470, 7471)


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """The bytes of all rows: each row names how it was told from its left neighbour (step bytes away) and the row above."""
    out = np.zeros((height, stride), dtype=np.uint8)
    above = np.zeros(stride, dtype=np.uint8)
    for y in range(height):
        kind, row = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1)
        if kind == 0:
            found = row
        elif kind == 1:  # left: running sums of each sample
            padded = np.zeros(-(-stride // step) * step, dtype=np.uint8)
            padded[:stride] = row
            found = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            found = row + above
        elif kind in (3, 4):
            line, up, src = bytearray(stride), above.tolist(), row.tolist()
            for i in range(stride):
                a, b = line[i - step] if i >= step else 0, up[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[i - step] if i >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[i] = (src[i] + guess) & 255
            found = np.frombuffer(bytes(line), np.uint8)
        else:
            raise ValueError(f"no such filter: {kind}")
        out[y] = above = found
    return out


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey pixels (rows by columns, 0 to 255) of a PNG file; alpha is ignored. None for anything else, damaged or interlaced files."""
    if not data or not data.startswith(SIGNATURE):
        return None
    at, head, palette, parts = len(SIGNATURE), None, None, []
    try:
        while at < len(data):
            n, kind = struct.unpack_from(">I4s", data, at)
            body = data[at + 8 : at + 8 + n]
            if len(body) < n or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
                return None
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                parts.append(body)
            elif kind == b"IEND":
                break
            at += 12 + n
        width, height, depth, colour, _, _, interlaced = head
        samples = SAMPLES[colour]
        if interlaced or not width or not height:
            return None
        stride = -(-width * samples * depth // 8)
        rows = _unfiltered(zlib.decompress(b"".join(parts)), height, stride, max(1, samples * depth // 8))
        if depth == 16:
            rows = rows[:, ::2]  # the high byte
        elif depth < 8:
            bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
            rows = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)
            rows = rows if colour == 3 else (rows.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        pixels = rows[:, : width * samples].reshape(height, width, samples)
        if colour == 3:
            pixels = palette[pixels[:, :, 0]]
        if colour in (2, 3, 6):
            return ((pixels[:, :, :3].astype(np.int64) @ np.array(LUMA) + 32768) >> 16).astype(np.uint8)
        return pixels[:, :, 0]
    except (struct.error, zlib.error, ValueError, KeyError, IndexError, TypeError):
        return None


def encode(pixels: np.ndarray) -> bytes:
    """A grey PNG file of rows by columns."""
    height, width = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    up = np.diff(pixels.astype(np.uint8), axis=0, prepend=np.zeros((1, width), np.uint8))
    rows = b"".join(b"\2" + r.tobytes() for r in up)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _shares(old: int, new: int) -> np.ndarray:
    """How much of each old pixel lies in each new one, rows that sum to 1."""
    edges = np.arange(new + 1) * old / new
    at = np.arange(old)
    inside = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
    return np.maximum(inside, 0) * new / old


def area_means(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """pixels on another grid: each new pixel is the mean of the area it covers."""
    return _shares(pixels.shape[0], height) @ pixels @ _shares(pixels.shape[1], width).T


def grey_pixels(width: int | None = None, height: int | None = None):
    """A column function from PNG bytes to grey pixels, row after row; resampled to width by height if given; null for what is no picture."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def pixels(files: pd.Series) -> pd.Series:
        out = []
        for data in files:
            found = decode(bytes(data) if data is not None else None)
            if found is not None and width:
                found = area_means(found, height or width, width)
            out.append(None if found is None else found.astype(float).ravel())
        return pd.Series(out)

    return pixels


def png_files(width: int):
    """A column function from grey pixels (numbers from 0 to 255, row after row) to PNG bytes; null where rows are not whole."""

    @F.pandas_udf(T.BinaryType())
    def files(pixels: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or not len(p) or len(p) % width else encode(np.asarray(p).reshape(-1, width)) for p in pixels])

    return files
