"""Helpers the operators share: splits, shared storage, grouping of documents, packed bytes and hashes.

Texts are handled as one byte buffer with offsets; words, shingles and byte windows are hashed with
whole-array arithmetic (a polynomial prefix sum modulo 2**64), so no Python code runs for each word.
"""

from __future__ import annotations

import ctypes
import glob
import os
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text in one group of documents; the working memory of a task is a small multiple.
GROUP_BYTES = 8 << 20


_OWN: dict[str, str] = {}


def release() -> None:
    """Give freed memory back to the system: a worker's peak then does not stay with it between groups."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


@lru_cache
def _blas():
    """Functions that read and set the number of threads of the OpenBLAS that numpy brings, or None."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        try:
            lib = ctypes.CDLL(path)
        except OSError:
            continue
        for name in ("scipy_openblas_{}_num_threads64_", "scipy_openblas_{}_num_threads", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
            if hasattr(lib, name.format("set")):
                return getattr(lib, name.format("get")), getattr(lib, name.format("set"))
    return None


@contextmanager
def one_thread():
    """Small matrix products on one thread: tasks already fill the cores, and threads that wait for each other spin."""
    found = _blas()
    if found is None:
        yield
        return
    get, put = found
    before = get()
    put(1)
    try:
        yield
    finally:
        put(before)


def released(fn):
    """fn on one thread of linear algebra, releasing memory after each call."""

    def call(*tables):
        release()
        with one_thread():
            out = fn(*tables)
        release()
        return out

    return call


def released2(fn):
    """The same for functions of two tables that get the group's key."""
    return lambda key, left, right: released(fn)(key, left, right)


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's. A folder of our own is used
    only on one machine, where none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _OWN.setdefault("dir", "") or _OWN.update(dir="file://" + tempfile.mkdtemp(prefix="tidemark-")) or _OWN["dir"]
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame, names: tuple[str, ...]):
    """docs with columns of these names put aside under others, and a function that puts them back."""
    clash = {c: f"_aside_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(clash), lambda out: out.withColumnsRenamed({v: k for k, v in clash.items()})


def text_bytes(docs: DataFrame) -> int:
    row = docs.agg(F.sum(F.octet_length("text").cast("long") + 16).alias("b")).first()
    return int(row["b"] or 0)


def group_size(total: int) -> int:
    """Bytes of a group. Keys travel from G groups to G buckets: groups grow with the root of the corpus,
    so that each of the G * G parcels keeps about a hundred keys or more."""
    return max(GROUP_BYTES, int((600 * total) ** 0.5))


def grouped(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text (null as empty) and g: a bounded share of the corpus, dealt by a hash of id and size.

    Hot sources and copies spread evenly; the number of groups, also returned, follows the bytes.
    """
    spark = docs.sparkSession
    total = text_bytes(docs)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // group_size(total)))
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return out.withColumn("g", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n)).cast("int")), n


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after the other, and n + 1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20):
    """Index ranges of whole documents of about ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i <= n."""
    if len(_POWERS.get("up", ())) <= n:
        for key, base in (("up", BASE), ("down", BASE_INV)):
            x = np.full(n + 1, base, U)
            x[0] = 1
            _POWERS[key] = np.cumprod(x, dtype=U)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (x[k] + 1) * BASE**k for i <= k < j, of bytes or of words' hashes."""
    up, _ = powers(len(data))
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, the same wherever the bytes stand."""
    _, down = powers(len(prefix) - 1)
    h = (prefix[end] - prefix[start]) * down[start]
    return mix(h ^ ((end - start).astype(U) * U(0xD6E8FEB86659FD93)))


#: Bytes whose sums are held at a time when ranges of a longer text are hashed.
SPAN = 1 << 20


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """range_hash() of ranges in ascending order that do not overlap, in memory that follows SPAN and the longest range, not the text."""
    out, i = np.zeros(len(start), U), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SPAN, "right")))
        low = start[i]
        out[i:j] = range_hash(prefix_hash(data[low : end[j - 1]]), start[i:j] - low, end[i:j] - low)
        i = j
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each document (n + 1 entries)."""
    n = len(data)
    inside = ~is_sep[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z as a-z) and the first word of each document."""
    data = LOWER[data]
    start, end, first = word_spans(data, offsets, is_sep)
    return hash_ranges(data, start, end), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words within a document, and its document. A document with 1 to n - 1 words has one, the whole."""
    if not len(words):
        return np.zeros(0, U), np.zeros(0, np.int64)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    left = np.repeat(first[1:], size) - np.arange(len(words))
    out = np.zeros(len(words), U)
    padded = np.concatenate([words, np.zeros(n, U)])
    for t in range(n):
        part = padded[t : t + len(words)] + U(t + 1)
        out = out * U(BASE) + np.where(left > t, part, U(0))
    keep = (left >= n) | ((np.arange(len(words)) == np.repeat(first[:-1], size)) & (left < n))
    return mix(out[keep]), doc[keep]
