"""Picture files (PNG) as relations of their samples. A task holds one picture."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import put

#: The signature, and samples of a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(raw: bytes) -> np.ndarray:
    """Rows by columns by channels of a picture that is not interlaced; palettes become colours."""
    if raw[:8] != SIGNATURE:
        raise ValueError("no picture of this format")
    at, data, palette = 8, b"", None
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
    if interlaced:
        raise ValueError("interlaced pictures are not read")
    n = SAMPLES[color]
    step, line = max(1, n * depth // 8), -(-width * n * depth // 8)
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, line + 1)
    out, above = np.zeros((height, line), np.uint8), np.zeros(line + step, np.int32)
    for y in range(height):
        above = _unfilter(int(rows[y, 0]), rows[y, 1:].astype(np.int32), above, step)
        out[y] = above[step:]
    if depth == 16:
        values = out.reshape(height, -1, 2).astype(np.uint16)
        values = values[..., 0] << 8 | values[..., 1]
    elif depth == 8:
        values = out
    else:
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)
        values = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2)[:, : width * n]
    values = values.reshape(height, width, n)
    return palette[values[..., 0]] if color == 3 else values


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of bytes, ``step`` zeros before it, from its differences and the line above."""
    out = np.zeros_like(above)
    if kind in (0, 2):
        out[step:] = (line + (above[step:] if kind else 0)) % 256
    elif kind == 1:
        for k in range(step):
            out[step + k :: step] = np.cumsum(line[k::step]) % 256
    else:
        for k, v in enumerate(line.tolist()):
            a, b, c = int(out[k]), int(above[k + step]), int(above[k])
            if kind == 3:
                guess = (a + b) // 2
            else:
                near = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
                guess = (a, b, c)[near.index(min(near))]
            out[k + step] = (v + guess) % 256
    return out


def encode(picture: np.ndarray) -> bytes:
    """A picture of bytes: rows by columns (gray), or by 2, 3 or 4 channels."""
    height, width = picture.shape[:2]
    n = picture.shape[2] if picture.ndim == 3 else 1
    color = {v: k for k, v in SAMPLES.items() if k != 3}[n]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), picture.reshape(height, width * n).astype(np.uint8)], 1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """file, y, x, channel, v of every sample of every picture."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, raw in zip(pdf.path, pdf.content, strict=True):
                p = decode(bytes(raw))
                y, x, c = np.indices(p.shape)
                yield pd.DataFrame({"file": name, "y": y.ravel(), "x": x.ravel(), "channel": c.ravel(), "v": p.ravel().astype("int64")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, y int, x int, channel int, v int")


def write_picture(pixels: DataFrame, path: str) -> None:
    """One picture of (y, x, v) or (y, x, channel, v), bytes; it is one file, so the driver holds it."""
    rows = pixels if "channel" in pixels.columns else pixels.withColumn("channel", F.lit(0))
    pdf = rows.select("y", "x", "channel", "v").toPandas()
    out = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1, pdf.channel.max() + 1), np.uint8)
    out[pdf.y, pdf.x, pdf.channel] = np.clip(pdf.v, 0, 255)
    put(pixels.sparkSession, path, encode(out))
