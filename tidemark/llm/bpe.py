"""Byte-level BPE by a pair occurrence index.

The distinct words of a unit (a bounded share of a partition) stand one after the other in a symbol
array. An index maps every mergeable pair to all its positions; the active ranks are taken in ascending
order, all occurrences of a pair merge at once, and only the neighbours' entries are updated. Results
equal those of merging each word alone, lowest rank first, leftmost first.

Defined cases: null and empty texts have no tokens; added tokens' strings in a text are those tokens;
text of any length is encoded whole; of equal pairs the leftmost merges first; an empty table gives no
rows. Repeated rows repeat; extra columns are kept. Vocabularies with rules that are not built raise an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import release

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNIT_BYTES = 10 << 20
NONE = np.iinfo(np.int32).max


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and the byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks, ids and bytes of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        unknown = [t["content"] for t in spec["added_tokens"] if any(t.get(f) for f in ("lstrip", "rstrip", "single_word"))]
        if spec.get("normalizer") or unknown or (spec.get("pre_tokenizer") or {}).get("add_prefix_space") or spec["model"].get("dropout"):
            raise ValueError("the vocabulary asks for a normalizer, stripping tokens, a prefix blank or dropout, which are not built")
        ids, to_byte = spec["model"]["vocab"], byte_symbols()
        self.n = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes = [b""] * self.n
        for token, i in ids.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes[i] = content.encode()
        self.of_byte = np.array([ids[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([ids[a] * self.n + ids[b] for a, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.left, self.right = key // self.n, key % self.n
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[spot] == key, self.rank[spot], NONE)


def merge_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and each word's first (n + 1 entries)."""
    size = np.array([len(w) for w in words], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    n = int(at[-1])
    if not n:
        return np.zeros(0, np.int64), at
    sym = vocab.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[at[1:][size > 0] - 1] = -1
    prv[at[:-1][size > 0]] = -1
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[int] = []

    def enter(pos: np.ndarray) -> None:
        pos = pos[nxt[pos] >= 0]
        rank = vocab.ranks(sym[pos], sym[nxt[pos]])
        pos, rank = pos[rank != NONE], rank[rank != NONE]
        if not len(pos):
            return
        order = np.argsort(rank, kind="stable")
        pos, rank = pos[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        for r, p in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(pos, cut), strict=True):
            if r not in index:
                heapq.heappush(heap, r)
            index[r].append(p)

    enter(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = vocab.left[r], vocab.right[r]
        pos = pos[(sym[pos] == a) & (nxt[pos] >= 0)]
        pos = pos[sym[nxt[pos]] == b]
        if a == b and len(pos) > 1:  # in a run of overlapping pairs every other one merges, from the left
            new = np.ones(len(pos), bool)
            new[1:] = nxt[pos[:-1]] != pos[1:]
            run = np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - run) % 2 == 0]
        if not len(pos):
            continue
        second = nxt[pos]
        after = nxt[second]
        sym[pos] = vocab.made[r]
        sym[second] = -1
        nxt[pos] = after
        nxt[second] = -1
        prv[after[after >= 0]] = pos[after >= 0]
        before = prv[pos]
        enter(np.unique(np.concatenate([pos, before[before >= 0]])))
    alive = sym >= 0
    return sym[alive], np.concatenate([[0], np.cumsum(alive)])[at]


class Encoder:
    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.find = regex.compile(PATTERN).findall

    def words(self, text: str) -> list[str]:
        """Pre-tokens; an added token is one, marked by a leading NUL pair that no pre-token has."""
        if self.vocab.split is None or not any(t in text for t in self.vocab.added):
            return self.find(text)
        out = []
        for part in self.vocab.split.split(text):
            if part in self.vocab.added:
                out.append(("added", part))
            else:
                out += self.find(part)
        return out

    def encode_unit(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
        """For each text the numbers of its words; and for all: ids of the distinct words."""
        number: dict = defaultdict()
        number.default_factory = number.__len__
        rows = [np.fromiter(map(number.__getitem__, self.words(t)), np.int64) for t in texts]
        raw = [b"" if isinstance(w, tuple) else w.encode("utf-8") for w in number]
        ids, at = merge_words(raw, self.vocab)
        flat = ids.tolist()
        per = [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for w, i in number.items():
            if isinstance(w, tuple):
                per[i] = [self.vocab.added[w[1]]]
        return rows, per

    def encode(self, text: str) -> list[int]:
        rows, per = self.encode_unit([text])
        return [i for k in rows[0].tolist() for i in per[k]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.vocab.bytes[i] for i in ids).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, digest: bool = False, text: str = "text") -> DataFrame:
    """Every column of docs and n_tokens, ids, which replace columns so named; with ``digest`` the SHA-256 of the ids and of the decoded text instead of ids."""
    from pyspark.sql import functions as F

    docs = docs.drop("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    empty = docs.withColumn("n_tokens", F.lit(0).cast("long"))
    if digest:
        empty = empty.withColumn("ids_sha256", F.lit("")).withColumn("decoded_sha256", F.lit(""))
    else:
        empty = empty.withColumn("ids", F.array().cast("array<int>"))

    def unit(encoder: Encoder, tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(tables)
        rows, per = encoder.encode_unit([t or "" for t in table.column(text).to_pylist()])
        count = np.array([len(x) for x in per] or [0], np.int64)
        table = table.append_column("n_tokens", pa.array([int(count[r].sum()) for r in rows], pa.int64()))
        if digest:
            shown = [",".join(map(str, x)) for x in per]
            known = encoder.vocab.bytes
            back = [b"".join(map(known.__getitem__, x)) for x in per]
            a, b = [], []
            for r in rows:
                r = r.tolist()
                a.append(hashlib.sha256(",".join(map(shown.__getitem__, r)).encode()).hexdigest())
                whole = b"".join(map(back.__getitem__, r))
                b.append(hashlib.sha256(whole.decode("utf-8", "replace").encode()).hexdigest())
            table = table.append_column("ids_sha256", pa.array(a, pa.string())).append_column("decoded_sha256", pa.array(b, pa.string()))
        else:
            got = [[i for k in r.tolist() for i in per[k]] for r in rows]
            table = table.append_column("ids", pa.array(got, pa.list_(pa.int32())))
        yield from table.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, size = Encoder(path), [], 0
        for batch in batches:
            table = pa.table(batch)
            step = max(1, int(table.num_rows * UNIT_BYTES / max(1, table.nbytes)))
            for k in range(0, table.num_rows, step):
                part = table.slice(k, step)
                held.append(part)
                size += part.nbytes
                if size >= UNIT_BYTES:
                    yield from unit(encoder, held)
                    held, size = [], 0
                    release()
        if held:
            yield from unit(encoder, held)

    return docs.mapInArrow(run, empty.schema)
