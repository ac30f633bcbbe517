"""Counting keys without a row for each: groups send sorted, packed keys to buckets and get packed answers.

A group of documents sends, to each bucket of the key space, one parcel with its sorted keys as
differences in byte planes (the high planes are zeros, which the shuffle compresses away). A bucket
counts its keys over all parcels and returns to each group one small answer for every key sent, in the
same order; ``top`` is the bucket's largest. So a question such as "how many documents hold this shingle" costs a few bytes a shingle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import released

KEY_BITS = 48
PARCELS = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
ANSWERS = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("codes", pa.binary()), ("top", pa.int32())])
PARCEL_TYPE, ANSWER_TYPE = "b int, g int, n int, keys binary, extra binary", "g int, b int, codes binary, top int"


def short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - KEY_BITS)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys under 2**48."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(KEY_BITS // 8, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, : KEY_BITS // 8] = planes.T
    return np.cumsum(d.view("<u8")[:, 0], dtype=np.uint64)


def parcels(g: int, keys: np.ndarray, n_buckets: int, extra: np.ndarray | None = None) -> pa.Table:
    """Sorted keys of a group, cut into buckets; ``extra`` is an array alongside."""
    bucket = ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(n_buckets)) >> np.uint64(32)
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
    used = np.flatnonzero(np.diff(cut))
    part = [slice(cut[b], cut[b + 1]) for b in used]
    return pa.Table.from_arrays(
        [
            pa.array(used, pa.int32()),
            pa.array(np.full(len(used), g), pa.int32()),
            pa.array(np.diff(cut)[used], pa.int32()),
            pa.array([pack(keys[s]) for s in part], pa.binary()),
            pa.array([extra[s].tobytes() if extra is not None else b"" for s in part], pa.binary()),
        ],
        schema=PARCELS,
    )


def answer(sent: DataFrame, count: Callable[[np.ndarray, list[bytes]], np.ndarray]) -> DataFrame:
    """count(keys of a bucket, parcels' extras) gives a code for each key; codes go back parcel by parcel."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("g")
        keys = [unpack(x) for x in table.column("keys").to_pylist()]
        codes = count(np.concatenate(keys), table.column("extra").to_pylist())
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        back = [codes[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        top = pa.array(np.full(len(back), codes.max(initial=0)), pa.int32())
        return pa.Table.from_arrays([table.column("g").combine_chunks(), table.column("b").combine_chunks(), pa.array(back, pa.binary()), top], schema=ANSWERS)

    return sent.groupBy("b").applyInArrow(lambda t: released(run)(t), ANSWER_TYPE)


def codes_of(table: pa.Table, dtype) -> np.ndarray:
    """A group's answers in the order of its sorted keys."""
    table = table.sort_by("b")
    return np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype)
