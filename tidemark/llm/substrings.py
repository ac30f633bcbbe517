"""Long repeated byte strings, found by column-wise construction of collection suffix arrays.

A string of LENGTH bytes that also starts elsewhere is repeated; every byte it covers goes. Windows of
that length are owned by their smallest hash of WORD bytes (the leftmost if equal), so equal windows,
wherever they stand, have equal owners at equal distances. Consecutive windows of one owner form a
block; no two windows of a block are equal. Three steps:

1. Each group of documents sends (owner, hash of the block's bytes), twice if it has the pair more than
   once. A block with an equal one elsewhere is repeated whole. An owner with several different blocks,
   one of them single, is open: one of each of its blocks goes on.
2. Open blocks are collected by owner. The collection's Burrows-Wheeler transform and longest common
   prefixes are built column by column from the ends: each round inserts one symbol of every text and
   rewrites the files of the sorted suffixes in sequence. Symbols are words of eight bytes; each block gives eight texts, one for each alignment to its owner, so any window is a
   run of whole symbols. Neighbours with a common prefix of LENGTH bytes or more are repeated.
3. Documents mark their repeated windows and drop the bytes under them.

An owner with more than HOT open blocks (a passage that very many documents hold, in different
surroundings) would be too much for one task: its windows are hashed one by one and counted instead,
by the same exchange as step 1.

Defined cases: null texts are empty; texts shorter than LENGTH keep all; repeated rows are copies;
overlaps within a text count; of equal strings none is first, all go; texts of any length are worked whole;
an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import exchange as X

LENGTH, WORD, SYMBOL = 200, 32, 8
WIDTH = LENGTH - WORD + 1
HOT = 30000
COLLECTION_BYTES, COLUMN_BYTES = 4 << 20, 1 << 20
PLACE_BITS = 25
#: Codes of a block: single; repeated; open; repeated and sent on for its equals; the last two under a hot owner.
SINGLE, REPEATED, OPEN, HEAD, HOT_OPEN, HOT_HEAD = range(6)
BACK = "g int, b int, codes binary, doc_id long, text_key long, start long, flags binary"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` entries."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Piece:
    """Blocks of some documents: first and last window, owner's place, owner, hash of the bytes, document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        self.prefix = C.prefix_hash(data)
        self.text_key = C.range_hash(self.prefix, offsets[:-1], offsets[1:]).view(np.int64)
        self.first = self.last = self.place = self.doc = np.zeros(0, np.int64)
        self.owner = self.content = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        _, down = C.powers(n)
        hashes = (self.prefix[WORD:] - self.prefix[:-WORD]) * down[: n - WORD + 1]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
        low = np.uint64((1 << PLACE_BITS) - 1)
        # Long documents pass a place's bits: places are kept within spans that overlap by a window.
        span = (1 << PLACE_BITS) - 2 * LENGTH
        place = np.empty(n - LENGTH + 1, np.int64)
        for a in range(0, len(place), span):
            part = hashes[a : a + span + WIDTH - 1]
            packed = (part & ~low) | np.arange(len(part), dtype=np.uint64)
            got = sliding_min(packed, WIDTH)
            place[a : a + len(got)] = (got & low).astype(np.int64) + a
        valid = np.ones(len(place) + LENGTH, bool)
        for e in offsets[1:].tolist():
            valid[max(0, e - LENGTH + 1) : e] = False
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        new[offsets[:-1][offsets[:-1] < len(place)]] = True
        valid = valid[: len(place)]
        edge = new.copy()
        edge[1:] |= valid[1:] != valid[:-1]
        at = np.flatnonzero(edge)
        end = np.append(at[1:], len(place)) - 1
        keep = valid[at]
        self.first, self.last = at[keep], end[keep]
        self.place = place[self.first]
        self.owner = hashes[self.place]
        self.content = C.range_hash(self.prefix, self.first, self.last + LENGTH) + C.mix((self.place - self.first).astype(np.uint64))
        self.doc = np.searchsorted(offsets, self.first, "right") - 1

    def windows(self, k: int) -> np.ndarray:
        """Hashes of the windows of block k."""
        at = np.arange(self.first[k], self.last[k] + 1)
        return C.range_hash(self.prefix, at, at + LENGTH)


def pieces(table: pa.Table) -> Iterator[tuple[int, Piece]]:
    """(first document, piece) over a group, whose documents are put in a fixed order first."""
    data, offsets = C.text_buffer(table.column("text"))
    for i, j in C.pieces(offsets):
        yield i, Piece(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def entries(owner: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, content) in order, with the number of each block's pair; pairs that come more often stand twice."""
    key = X.short(C.mix(owner))
    order = np.lexsort((content, key))
    k, c = key[order], content[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    number = np.empty(len(k), np.int64)
    at = np.flatnonzero(new)
    times = np.minimum(np.diff(np.append(at, len(k))), 2)
    place = np.concatenate([[0], np.cumsum(times)[:-1]]) if len(at) else at
    number[order] = place[np.cumsum(new) - 1]
    return np.repeat(k[at], times), np.repeat(c[at], times), number


def judge(hot: int):
    """Codes for the entries of a bucket."""

    def count(keys: np.ndarray, extras: list[bytes]) -> np.ndarray:
        content = np.frombuffer(b"".join(extras), np.uint64)
        order = np.lexsort((content, keys))
        k, c = keys[order], content[order]
        own = np.ones(len(k), bool)
        own[1:] = k[1:] != k[:-1]
        new = own.copy()
        new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        owner, pair = np.cumsum(own) - 1, np.cumsum(new) - 1
        times = np.diff(np.append(at, len(k)))[pair]
        kinds = np.bincount(owner[at])[owner]
        single = np.bincount(owner, times == 1)[owner]
        opened = (kinds > 1) & (single > 0)
        code = np.where(times > 1, REPEATED, SINGLE).astype(np.uint8)
        code[opened & (times == 1)] = OPEN
        code[opened & (times > 1) & new] = HEAD
        much = opened & (kinds > hot)
        code[much & (code == OPEN)] = HOT_OPEN
        code[much & (code == HEAD)] = HOT_HEAD
        out = np.empty(len(k), np.uint8)
        out[order] = code
        return out

    return count


def twice(keys: np.ndarray, extras: list[bytes]) -> np.ndarray:
    """Codes for windows: repeated or single."""
    content = np.frombuffer(b"".join(extras), np.uint64)
    order = np.lexsort((content, keys))
    k, c = keys[order], content[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    times = np.diff(np.append(np.flatnonzero(new), len(k)))[np.cumsum(new) - 1] if len(k) else np.zeros(0, int)
    out = np.empty(len(k), np.uint8)
    out[order] = np.where(times > 1, REPEATED, SINGLE)
    return out


class Columns:
    """The sorted suffixes of a collection in files, one a column: each round reads every column once, in
    sequence, and writes it once.

    ``bwt``: the symbol before each suffix, 0 where none is inserted yet; the first entries are those of the
    empty suffixes, one for each text. The other columns leave these out: ``key`` is a suffix's first symbol
    and the place of the rest (where the transform's entry leads), ``lcp`` the common prefix with the
    suffix before, ``at`` where the suffix starts. The files have no name and are private to their task.
    """

    FIELDS = {"bwt": np.int32, "key": np.int64, "lcp": np.int16, "at": np.int32}

    def __init__(self, n_texts: int):
        self.files = {name: tempfile.TemporaryFile(buffering=0) for name in self.FIELDS}
        self.size = dict.fromkeys(self.FIELDS, 0)
        self.write("bwt", np.zeros(n_texts, np.int32))

    def read(self, name: str) -> np.ndarray:
        out = np.empty(self.size[name], self.FIELDS[name])
        self.files[name].seek(0)
        left = memoryview(out.view(np.uint8))
        while len(left):
            left = left[self.files[name].readinto(left) :]
        return out

    def write(self, name: str, x: np.ndarray) -> None:
        x = np.ascontiguousarray(x, self.FIELDS[name])
        self.size[name] = len(x)
        self.files[name].seek(0)
        left = memoryview(x.view(np.uint8))
        while len(left):
            left = left[self.files[name].write(left) :]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for f in self.files.values():
            f.close()


def range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of x[a : b + 1], a <= b, by minima over blocks."""
    size = 32
    n = -(-len(x) // size)
    padded = np.full(n * size, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    levels = [padded.reshape(n, size).min(1)]
    while len(levels[-1]) > 2 ** (len(levels) - 1):
        step = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    out = np.full(len(a), np.iinfo(x.dtype).max, x.dtype)
    span = b - a
    near = span < 2 * size
    for lo, some in ((0, near & (span < 4)), (4, near & (span >= 4))):
        i = np.flatnonzero(some)
        if len(i):
            width = 4 if lo == 0 else 2 * size
            spot = np.minimum(a[i, None] + np.arange(width), b[i, None])
            out[i] = x[spot].min(1)
    i = np.flatnonzero(~near)
    if len(i):
        p, q = a[i], b[i]
        left = padded[np.minimum(p[:, None] + np.arange(size), ((p // size + 1) * size - 1)[:, None])].min(1)
        right = padded[np.maximum(q[:, None] - np.arange(size), (q // size * size)[:, None])].min(1)
        u, v = p // size + 1, q // size - 1
        out[i] = np.minimum(left, right)
        whole = np.flatnonzero(v >= u)
        if len(whole):
            u, v = u[whole], v[whole]
            level = np.floor(np.log2(v - u + 1)).astype(int)
            best = np.empty(len(whole), x.dtype)
            for k in np.unique(level):
                at = level == k
                best[at] = np.minimum(levels[k][u[at]], levels[k][v[at] - 2**k + 1])
            out[i[whole]] = np.minimum(out[i[whole]], best)
    return out


def repeated_starts(flat: np.ndarray, offsets: np.ndarray, need: int) -> np.ndarray:
    """Positions of flat, a collection of texts, whose suffix shares ``need`` symbols with another suffix."""
    out = np.zeros(len(flat), bool)
    if not len(flat):
        return out
    with Columns(len(offsets) - 1) as columns:
        build(flat, offsets, columns)
        lcp, at = columns.read("lcp"), columns.read("at")
    hit = lcp >= need
    hit[:-1] |= hit[1:].copy()
    out[at[hit]] = True
    return out


def build(flat: np.ndarray, offsets: np.ndarray, columns: Columns) -> np.ndarray:
    """Insert the texts' suffixes, one symbol of every text a round, from the ends; returns the symbols' values by number, less one."""
    n_texts, size = len(offsets) - 1, np.diff(offsets)
    values, number = np.unique(flat, return_inverse=True)
    symbol = (number.astype(np.int64) + 1) << 32
    mask = (1 << 32) - 1
    current = np.arange(n_texts)  # place of each text's latest suffix; places count the empty suffixes
    for depth in range(1, int(size.max()) + 1):
        text = np.flatnonzero(size >= depth)
        at = offsets[1:][text] - depth
        key = symbol[at] | current[text]
        bwt = columns.read("bwt")
        bwt[current[text]] = key >> 32
        order = np.argsort(key)
        text, at, key = text[order], at[order], key[order]
        old, lcp = columns.read("key"), columns.read("lcp")
        n, m = len(old), len(key)
        spot = np.searchsorted(old, key)
        place = spot + np.arange(m)
        is_old = np.ones(n + m, bool)
        is_old[place] = False
        moved = np.flatnonzero(is_old)  # the new place of each old suffix
        # Common prefixes with the one before, and of the one after with it, from minima over the rests.
        before = np.where(spot > 0, old[np.maximum(spot - 1, 0)] if n else 0, 0)
        before[1:] = np.where(spot[1:] == spot[:-1], key[:-1], before[1:])
        new_lcp = np.zeros(m, np.int16)
        same = np.flatnonzero(before >> 32 == key >> 32)
        new_lcp[same] = 1 + _common(lcp, before[same] & mask, key[same] & mask, n_texts)
        last = np.flatnonzero((spot < n) & np.append(spot[1:] != spot[:-1], True))
        changed = lcp
        if len(last):
            after = old[spot[last]]
            tied = (after >> 32) == (key[last] >> 32)
            changed = lcp.copy()
            changed[spot[last]] = 0
            changed[spot[last[tied]]] = 1 + _common(lcp, key[last[tied]] & mask, after[tied] & mask, n_texts)
        to = np.concatenate([np.arange(n_texts), moved + n_texts])

        def insert(name: str, old_part: np.ndarray, new_part: np.ndarray, first: int = 0) -> None:
            x = np.empty(first + n + m, Columns.FIELDS[name])
            x[:first] = old_part[:first]
            x[first + moved] = old_part[first:]
            x[first + place] = new_part
            columns.write(name, x)

        insert("bwt", bwt, np.zeros(m, np.int32), n_texts)
        insert("key", (old & ~mask) | to[old & mask], (key & ~mask) | to[key & mask])
        insert("lcp", changed, new_lcp)
        insert("at", columns.read("at"), at)
        current = to[current]
        current[text] = place + n_texts
    return values


def _common(lcp: np.ndarray, a: np.ndarray, b: np.ndarray, n_texts: int) -> np.ndarray:
    """Common prefix of the suffixes at places a < b: none if a is empty, else the least between them."""
    out = np.zeros(len(a), np.int16)
    full = np.flatnonzero(a >= n_texts)
    if len(full):
        out[full] = range_min(lcp, a[full] + 1 - n_texts, b[full] - n_texts)
    return out


def repeated_windows(bodies: list[bytes], places: list[int]) -> list[np.ndarray]:
    """For each block (its bytes, and its owner's place in them) which of its windows are repeated in the collection.

    Equal windows are equally far from their owners, so the eight alignments are collections of their own.
    """
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(b) for b in bodies])
    first = np.cumsum(size) - size
    windows, place = size - LENGTH + 1, np.array(places)
    mark = np.zeros(len(raw), bool)
    for k in range(SYMBOL):
        # One text for each block that has a window of this alignment: its first byte, and its number of symbols.
        start = (place + k) % SYMBOL
        block = np.flatnonzero(start < windows)
        if not len(block):
            continue
        count = (size[block] - start[block]) // SYMBOL
        offsets = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(first[block] + start[block] - offsets[:-1] * SYMBOL, count) + np.arange(offsets[-1]) * SYMBOL
        flat = np.zeros(len(at), "<u8")
        for i in range(SYMBOL):
            flat |= raw[at + i].astype("<u8") << np.uint64(8 * i)
        mark[at[repeated_starts(flat, offsets, LENGTH // SYMBOL)]] = True
    return [mark[a : a + w] for a, w in zip(first.tolist(), windows.tolist(), strict=True)]


def cuts(owner: list[int], size: list[int]) -> Iterator[int]:
    """Ends of runs of whole owners with about COLUMN_BYTES."""
    total = 0
    for k, s in enumerate(size):
        total += s
        if k + 1 == len(size) or total >= COLUMN_BYTES and owner[k + 1] != owner[k]:
            yield k + 1
            total = 0


def _open_blocks(table: pa.Table, codes: np.ndarray):
    """Every block of a group with its code: (document, piece, block numbers, codes)."""
    held = list(pieces(table))
    owner, content = (np.concatenate([getattr(p, x) for _, p in held] or [np.zeros(0, np.uint64)]) for x in ("owner", "content"))
    _, _, number = entries(owner, content)
    code = codes[number] if len(number) else np.zeros(0, np.uint8)
    # Of equal blocks in a group the first carries a HEAD code on.
    head = np.flatnonzero((code == HEAD) | (code == HOT_HEAD))
    if len(head):
        _, one = np.unique(number[head], return_index=True)
        extra = np.ones(len(head), bool)
        extra[one] = False
        code = code.copy()
        code[head[extra]] = REPEATED
    at = 0
    for i, p in held:
        yield i, p, code[at : at + len(p.first)]
        at += len(p.first)


def remove(docs: DataFrame, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with_text adds the kept bytes."""
    texts, n_groups = C.grouped(docs)
    by_g = texts.groupBy("g")

    def send(table: pa.Table) -> pa.Table:
        held = [p for _, p in pieces(table)]
        owner, content = (np.concatenate([getattr(p, x) for p in held]) for x in ("owner", "content"))
        key, content, _ = entries(owner, content)
        return X.parcels(table.column("g")[0].as_py(), key, n_groups, content)

    found = C.materialize(X.answer(by_g.applyInArrow(lambda t: C.released(send)(t), X.PARCEL_TYPE), judge(hot)))
    kind = pa.schema([("owner", pa.int32()), ("g", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("place", pa.int32()), ("body", pa.binary())])

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, g, rows = left.column("doc_id").to_pylist(), left.column("g")[0].as_py() if len(left) else 0, []
        for i, p, code in _open_blocks(left, X.codes_of(right, np.uint8)):
            some = np.flatnonzero((code == OPEN) | (code == HEAD))
            part = (C.mix(p.owner[some]) % np.uint64(1 << 31)).astype(np.int64).tolist()
            for k, b in zip(some.tolist(), part, strict=True):
                a, e, d = int(p.first[k]), int(p.last[k]) + LENGTH, int(p.doc[k])
                rows.append((b, g, ids[i + d], int(p.text_key[d]), a - int(p.offsets[d]), int(p.place[k]) - a, p.data[a:e].tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, kind, strict=True)], schema=kind)

    opened = C.materialize(by_g.cogroup(found.groupBy("g")).applyInArrow(lambda a, b: C.released(pick)(a, b), "owner int, g int, doc_id long, text_key long, start long, place int, body binary"))
    total = opened.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // COLLECTION_BYTES))
    schema = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("codes", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("flags", pa.binary())])

    def solve(table: pa.Table) -> pa.Table:
        # Owners stay whole; collections are kept small, so that their columns stay near the processor.
        table = table.sort_by("owner")
        owner, bodies, places = (table.column(c).to_pylist() for c in ("owner", "body", "place"))
        got, i = [], 0
        for j in cuts(owner, [len(b) for b in bodies]):
            got += repeated_windows(bodies[i:j], places[i:j])
            i = j
        keep = np.array([x.any() for x in got])
        table = table.filter(pa.array(keep))
        flags = pa.array([np.packbits(x).tobytes() for x, k in zip(got, keep, strict=True) if k], pa.binary())
        none = pa.nulls(len(table), pa.int32())
        return pa.Table.from_arrays(
            [table.column("g").combine_chunks(), none, pa.nulls(len(table), pa.binary()), *(table.column(c).combine_chunks() for c in ("doc_id", "text_key", "start")), flags], schema=schema
        )

    solved = opened.withColumn("part", F.pmod("owner", F.lit(parts)).cast("int")).groupBy("part").applyInArrow(lambda t: C.released(solve)(t), BACK)
    back = found.select("g", "b", "codes").unionByName(solved, allowMissingColumns=True)
    if (found.agg(F.max("top")).first()[0] or 0) >= HOT_OPEN:
        back = back.unionByName(_hot_windows(by_g, found, n_groups).select("g", "b", "codes"), allowMissingColumns=True)

    out_kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        is_code = pa.compute.is_valid(right.column("codes"))
        is_flag = pa.compute.is_valid(right.column("flags"))
        coded, flagged = right.filter(is_code), right.filter(is_flag)
        is_hot = pa.compute.greater_equal(coded.column("b"), n_groups)
        marks: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for i, t, a, f in zip(*(flagged.column(c).to_pylist() for c in ("doc_id", "text_key", "start", "flags")), strict=True):
            marks.setdefault((i, t), []).append((a, np.unpackbits(np.frombuffer(f, np.uint8)).astype(bool)))
        hot_codes = X.codes_of(coded.filter(is_hot), np.uint8)
        codes = X.codes_of(coded.filter(pa.compute.invert(is_hot)), np.uint8)
        ids, rows = left.column("doc_id").to_pylist(), []
        held = list(_open_blocks(left, codes))
        hot_number = _hot_numbers(held)
        for (i, p, code), numbers in zip(held, hot_number, strict=True):
            n = len(p.data)
            hit = np.zeros(n + 1, np.int32)
            whole = np.flatnonzero((code == REPEATED) | (code == HEAD) | (code == HOT_HEAD))
            hit[p.first[whole]] += 1
            hit[p.last[whole] + 1] -= 1
            starts = np.cumsum(hit)[:n] > 0
            for k, number in numbers:
                starts[p.first[k] : p.last[k] + 1] |= hot_codes[number] == REPEATED
            for d in range(len(p.offsets) - 1):
                for a, f in marks.get((ids[i + d], int(p.text_key[d])), ()):
                    a += int(p.offsets[d])
                    f = f[: n - a]
                    starts[a : a + len(f)] |= f
            total = np.concatenate([[0], np.cumsum(starts)])
            covered = total[1:] > total[np.maximum(np.arange(n) - LENGTH + 1, 0)]
            for d, (a, e) in enumerate(zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True)):
                c = covered[a:e]
                kept = p.data[a:e][~c].tobytes()
                spans = int((c[1:] & ~c[:-1]).sum()) + int(c[:1].sum())
                rows.append((ids[i + d], e - a, int(c.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(out_kind), out_kind, strict=True)], schema=out_kind)

    out_type = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return by_g.cogroup(back.groupBy("g")).applyInArrow(lambda a, b: C.released(finish)(a, b), out_type)


def _hot_numbers(held) -> list[list[tuple[int, np.ndarray]]]:
    """For each piece its blocks under hot owners, with the entry number of each of their windows."""
    spots = [(x, k) for x, (_, _, code) in enumerate(held) for k in np.flatnonzero(code >= HOT_OPEN).tolist()]
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in held]
    if spots:
        hashes = [held[x][1].windows(k) for x, k in spots]
        _, _, number = entries(np.concatenate(hashes), C.mix(np.concatenate(hashes)))
        at = 0
        for (x, k), h in zip(spots, hashes, strict=True):
            out[x].append((k, number[at : at + len(h)]))
            at += len(h)
    return out


def _hot_windows(by_g, found: DataFrame, n_groups: int) -> DataFrame:
    """Answers, in buckets from n_groups on, for the windows of blocks under hot owners."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        held = list(_open_blocks(left, X.codes_of(right, np.uint8)))
        hashes = [p.windows(k) for _, p, code in held for k in np.flatnonzero(code >= HOT_OPEN).tolist()]
        hashes = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        key, content, _ = entries(hashes, C.mix(hashes))
        return X.parcels(left.column("g")[0].as_py() if len(left) else 0, key, n_groups, content)

    sent = by_g.cogroup(found.groupBy("g")).applyInArrow(send, X.PARCEL_TYPE)
    return X.answer(sent, twice).withColumn("b", F.col("b") + n_groups)
