"""Binary files of named arrays, level 5: numbers, texts, cell arrays and structures, packed or not. Files are read whole by Spark."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .store import put

#: Codes of data types and of array classes.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, PACKED, UTF8, UTF16, UTF32 = 14, 15, 16, 17, 18
CELL, STRUCT, OBJECT, CHAR, SPARSE, DOUBLE = range(1, 7)
CLASSES = {6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32", 14: "int64", 15: "uint64"}
TEXT_CODES = {UTF8: "utf-8", UTF16: "utf-16", UTF32: "utf-32", 4: "utf-16", 2: "latin-1", 1: "latin-1"}
COMPLEX, LOGICAL = 0x0800, 0x0200


def _elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, body) of the elements in a row."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # small: type and size in one word, body in the next
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + size + (-size % 8 if kind != PACKED else 0)


def _numbers(kind: int, body: bytes, order: str) -> np.ndarray:
    return np.frombuffer(body, np.dtype(order + TYPES[kind]))


def _array(body: bytes, order: str, path: str | None = None) -> Iterator[tuple[str, str, int, float | None, str | None]]:
    """(path, type, place, number, text) of an array's entries, in order of columns; rows of texts; cells and fields by paths of their own."""
    if not body:
        return
    parts = list(_elements(body, order))
    flags = int(_numbers(*parts[0], order)[0])
    cls, shape = flags & 0xFF, _numbers(*parts[1], order).tolist()
    name = bytes(parts[2][1]).decode("latin-1") if path is None else path
    count = int(np.prod(shape))
    if cls == CELL:
        for k, (_, inner) in enumerate(parts[3:]):
            yield from _array(inner, order, f"{name}{{{k}}}")
    elif cls in (STRUCT, OBJECT):
        parts = parts if cls == STRUCT else [*parts[:3], *parts[4:]]
        width = int(_numbers(*parts[3], order)[0])
        fields = [parts[4][1][k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(parts[4][1]), width)]
        for k, (_, inner) in enumerate(parts[5:]):
            entry = "" if count == 1 else f"({k // len(fields)})"
            yield from _array(inner, order, f"{name}{entry}.{fields[k % len(fields)]}")
    elif cls == CHAR:
        kind, data = parts[3] if len(parts) > 3 else (UTF8, b"")
        code = TEXT_CODES[kind]
        text = data.decode(code + ("-le" if order == "<" else "-be") if code in ("utf-16", "utf-32") else code, "replace")
        rows = shape[0] if shape else 0
        for r in range(rows):
            yield name, "char", r, None, text[r::rows]
    elif cls == SPARSE:
        raise ValueError(f"{name}: sparse arrays are not read")
    else:
        kind = "logical" if flags & LOGICAL else CLASSES[cls]
        real = _numbers(*parts[3], order).astype(float) if len(parts) > 3 else np.zeros(0)
        for k, v in enumerate(real.tolist()):
            yield name, kind, k, v, None
        if flags & COMPLEX:
            for k, v in enumerate(_numbers(*parts[4], order).astype(float).tolist()):
                yield name + ".imag", kind, k, v, None


def entries(raw: bytes) -> Iterator[tuple[str, str, int, float | None, str | None]]:
    order = "<" if raw[126:128] == b"IM" else ">"

    def walk(body: bytes):
        for kind, part in _elements(body, order):
            if kind == PACKED:
                yield from walk(zlib.decompress(part))
            elif kind == MATRIX:
                yield from _array(part, order)

    yield from walk(raw[128:])


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """file, path, type, i, number, text of every entry of every variable."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, raw in zip(pdf.path, pdf.content, strict=True):
                yield pd.DataFrame([(name, *x) for x in entries(bytes(raw))], columns=["file", "path", "type", "i", "number", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, path string, type string, i long, number double, text string")


def _element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def encode(value, name: str = "") -> bytes:
    """An element of a number, text, list of numbers (a row), list of lists with one entry each (cells), or dict (a structure)."""
    fields: list[bytes] = []
    if isinstance(value, dict):
        cls, shape = STRUCT, (1, 1)
        names = b"".join(k.encode("latin-1")[:31].ljust(32, b"\0") for k in value)
        fields = [_element(5, struct.pack("<i", 32)), _element(1, names), *[encode(v) for v in value.values()]]
    elif isinstance(value, str):
        data = value.encode("utf-16-le")
        cls, shape, fields = CHAR, (1, len(data) // 2), [_element(UTF16, data)]
    elif isinstance(value, list) and value and isinstance(value[0], list):
        cls, shape, fields = CELL, (1, len(value)), [encode(v[0]) for v in value]
    else:
        flat = value if isinstance(value, list) else [value]
        whole = all(isinstance(v, int) for v in flat)
        cls, shape = (12 if whole else DOUBLE), (1, len(flat))
        fields = [_element(5 if whole else 9, np.array(flat, "<i4" if whole else "<f8").tobytes())]
    head = _element(6, struct.pack("<II", cls, 0)) + _element(5, struct.pack("<ii", *shape)) + _element(1, name.encode("latin-1"))
    return _element(MATRIX, head + b"".join(fields))


def write_mat(spark: SparkSession, path: str, values: dict) -> None:
    """One file of named values; they are held by the driver, as the format is one file."""
    body = b"".join(struct.pack("<II", PACKED, len(z)) + z for z in (zlib.compress(encode(v, k)) for k, v in values.items()))
    put(spark, path, b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + body)
