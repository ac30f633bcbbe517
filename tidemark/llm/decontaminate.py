"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed, a window of three words, are compared: running Karp-Rabin
matching marks the longest common runs of words that do not overlap earlier ones, again and again, down
to runs of three. The share of an item's words under these tiles is its coverage; at 0.8 or more the
document holds the item, whatever order its passages stand in. Seeds are no longer than the shortest tile
and chosen so that no item that reaches its coverage is missed. Words are runs of letters and digits
(any byte over 127 counts as a letter), without regard to case.

The benchmark goes to the executors in chunks of a fixed size, one pass over the documents for each,
written before the next; a usual benchmark is one chunk.

Defined cases: null and empty texts, and texts without a word, hold nothing and are held by nothing; items
of one or two words are one tile, found wherever a document has these words in a row; of equally long
matches the leftmost in the document, then in the item, is marked first; texts of any length, and repeated
words, are worked whole; repeated documents are repeated, repeated items count once; an empty benchmark
gives empty hits, an empty table no rows; extra columns are kept.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_TILE, COVERAGE = 3, 0.8
CHUNK_BYTES = 8 << 20
IS_SEP = np.ones(256, bool)
IS_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
FILTER_BITS = 22


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented capitals that UTF-8 writes as C3 80 to C3 9E."""
    out = C.LOWER[data]
    if len(out) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return C.word_hashes(fold(data), offsets, IS_SEP)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, length) of the tiles, longest first.

    Running Karp-Rabin matching: window hashes come from running sums, so a window of any length costs the
    same; the greatest length at which free windows of both agree is searched for, every match of that length
    that is still free is marked, leftmost first, and the search goes on below it. No free match of a marked
    length is left, so there are at most as many passes as different tile lengths.
    """
    free = np.isin(doc, item), np.isin(item, doc)
    sums = [C.prefix_hash(x) for x in (doc, item)]
    out: list[tuple[int, int, int]] = []
    length = min(len(doc), len(item))
    while True:
        length = min(length, *(int(_run_lengths(f).max(initial=0)) for f in free))
        length = _longest(sums, free, least, length)
        if length < least:
            return out
        (at, one), (spot, two) = (_windows(s, f, length) for s, f in zip(sums, free, strict=True))
        queues: dict[int, deque[int]] = defaultdict(deque)
        both = np.isin(two, one)
        for h, j in zip(two[both].tolist(), spot[both].tolist(), strict=True):
            queues[h].append(j)
        both = np.isin(one, two)
        used_d, used_i = (~f for f in free)
        for h, i in zip(one[both].tolist(), at[both].tolist(), strict=True):
            if used_d[i] or used_d[i + length - 1]:
                continue
            queue = queues[h]
            # Marks of this pass are as long as its windows: one that overlaps a window covers an end of it.
            while queue and (used_i[queue[0]] or used_i[queue[0] + length - 1]):
                queue.popleft()
            if queue and np.array_equal(doc[i : i + length], item[queue[0] : queue[0] + length]):
                j = queue.popleft()
                used_d[i : i + length] = used_i[j : j + length] = True
                out.append((i, j, length))
        free = (~used_d, ~used_i)
        length -= 1


def _run_lengths(free: np.ndarray) -> np.ndarray:
    """For each place, how many free places begin there."""
    n = len(free)
    stop = np.where(free, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n) if n else np.zeros(0, int)


def _windows(sums: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the free windows of a length."""
    at = np.flatnonzero(_run_lengths(free) >= length)
    return at, C.range_hash(sums, at, at + length)


def _longest(sums, free, least: int, most: int) -> int:
    """The greatest length in least..most at which free windows agree, or less than least. Agreement at a length implies it below."""
    low, high = least - 1, most
    while low < high:
        middle = (low + high + 1) // 2
        (_, one), (_, two) = (_windows(s, f, middle) for s, f in zip(sums, free, strict=True))
        if len(one) and len(two) and np.isin(two, one).any():
            low = middle
        else:
            high = middle - 1
    return low


def needed(n_words: int) -> int:
    """How many windows of MIN_TILE words of an item are common if its coverage is reached.

    A tile of k >= MIN_TILE words has k - MIN_TILE + 1 such windows, at least k / MIN_TILE of them.
    """
    return -(-math.ceil(COVERAGE * n_words - 1e-9) // MIN_TILE)


class Benchmark:
    """Words and seeds of some items. A seed is a window of MIN_TILE words, or the whole of a shorter item.

    An item that reaches its coverage has needed() windows in common, so it misses none of the rest but that
    many: as many of its rarest windows and one more must hold a common one, and only these are seeds.
    """

    def __init__(self, items: list[tuple[int, str]]):
        data, offsets = C.text_buffer(pa.array([t for _, t in items], pa.large_string()))
        hashes, first = words(data, offsets)
        self.ids = [i for i, _ in items]
        self.words = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        size = np.diff(first)
        self.sizes = sorted({min(int(n), MIN_TILE) for n in size if n})
        self.seeds = {}
        for k in self.sizes:
            seed, item = C.shingle_hashes(hashes, first, k)
            own = (size[item] == k) if k < MIN_TILE else (size[item] >= k)
            key = np.unique(np.stack([seed[own], item[own].astype(np.uint64)], 1), axis=0)
            seed, item = key[:, 0], key[:, 1].astype(np.int64)
            _, inverse, times = np.unique(seed, return_inverse=True, return_counts=True)
            order = np.lexsort((seed, times[inverse], item))
            seed, item = seed[order], item[order]
            rank = np.arange(len(item)) - np.searchsorted(item, item)
            # A repeated window counts once here but as often as it stands in needed(): the rest only gets smaller.
            windows = size[item] - k + 1
            want = np.array([needed(int(n)) for n in size])[item] if k == MIN_TILE else np.ones(len(item), int)
            keep = rank <= windows - want
            seed, item = seed[keep], item[keep]
            order = np.lexsort((item, seed))
            seed, item = seed[order], item[order]
            quick = np.zeros(1 << FILTER_BITS, bool)
            quick[(seed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.seeds[k] = seed, item, quick

    def candidates(self, k: int, window: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct (document, item) with a common seed of k words."""
        seed, item, quick = self.seeds[k]
        hit = np.flatnonzero(quick[(window >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        a, b = np.searchsorted(seed, window[hit], "left"), np.searchsorted(seed, window[hit], "right")
        hit, a, n = hit[b > a], a[b > a], (b - a)[b > a]
        spot = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if not len(spot):
            return np.zeros((0, 2), np.int64)
        return np.unique(np.stack([np.repeat(doc[hit], n), item[spot]], 1), axis=0)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        hashes, first = words(data, offsets)
        for k in self.sizes:
            window, doc = C.shingle_hashes(hashes, first, k)
            at = np.searchsorted(doc, np.arange(len(first)))
            last, there = -1, None
            for d, i in self.candidates(k, window, doc).tolist():
                if d != last:
                    last, there = d, np.unique(window[at[d] : at[d + 1]])
                whole, item = hashes[first[d] : first[d + 1]], self.words[i]
                if not reachable(there, item, k):
                    continue
                found = tiles(compress(whole, item, k), item, k)
                covered = sum(n for _, _, n in found)
                if covered >= COVERAGE * len(item) - 1e-9:
                    out[d].append({"item_id": self.ids[i], "coverage": covered / len(item), "n_tiles": len(found)})
        return out


def reachable(there: np.ndarray, item: np.ndarray, k: int) -> bool:
    """Whether the item's words under windows of k words that the document has reach the coverage: tiles cover no others."""
    window, _ = C.shingle_hashes(item, np.array([0, len(item)]), k)
    spot = np.minimum(np.searchsorted(there, window), len(there) - 1)
    known = np.flatnonzero(there[spot] == window)
    cover = np.zeros(len(item) + 1, np.int64)
    np.add.at(cover, known, 1)
    np.add.at(cover, known + k, -1)
    return (np.cumsum(cover)[:-1] > 0).sum() >= COVERAGE * len(item) - 1e-9


def compress(doc: np.ndarray, item: np.ndarray, least: int = MIN_TILE) -> np.ndarray:
    """The runs of doc that only have the item's words, long enough for a tile, with a word that no item has between them."""
    known = np.concatenate([[False], np.isin(doc, item), [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    start, end = edge[::2], edge[1::2]
    long_ = end - start >= least
    start, size = start[long_], (end - start)[long_] + 1
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out = doc[np.minimum(at, len(doc) - 1)] if len(doc) else doc
    foreign = np.uint64(0)
    while foreign in item:
        foreign += np.uint64(1)
    out[np.cumsum(size) - 1] = foreign
    return out


def mark(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Every column of docs and hits, which replaces one so named: array<struct<item_id, coverage, n_tiles>>, of items (item_id, text)."""
    docs = docs.drop("hits")
    kept = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n_chunks = max(1, -(-C.text_bytes(kept) // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_chunks))
    hits = F.lit(None).cast("array<struct<item_id:long,coverage:double,n_tiles:int>>")
    schema = docs.withColumn("hits", hits).schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32())]))

    def one(df: DataFrame, k: int):
        rows = sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in kept.where(chunk == k).collect())
        sent = df.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(sent.value)
            for batch in batches:
                table = pa.table(batch)
                data, offsets = C.text_buffer(table.column(text))
                got = [h for i, j in C.pieces(offsets) for h in bench.hits(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
                if "hits" in table.column_names:
                    spot = table.schema.get_field_index("hits")
                    table = table.set_column(spot, "hits", pa.array([a + b for a, b in zip(table.column("hits").to_pylist(), got, strict=True)], kind))
                else:
                    table = table.append_column("hits", pa.array(got, kind))
                yield from table.to_batches()

        return df.mapInArrow(run, schema), sent

    out = docs
    for k in range(n_chunks):
        out, sent = one(out, k)
        if k + 1 < n_chunks:  # written, so that one chunk at a time is held by the driver and the executors
            out = C.materialize(out)
            sent.destroy()
    return out
