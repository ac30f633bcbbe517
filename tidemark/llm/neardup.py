"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct shingles. Documents with equal sets form classes, and one document
stands for each. Every class learns how many classes hold each of its tokens (see exchange). Tokens are
ordered rare first; if a set misses at most q tokens of any partner, its first q + 1 tokens hold a
common one. For tokens of a frequent class, the prefix is extended and combinations of two tokens are
indexed instead: a prefix suffices once (rare tokens) + (frequent tokens - 1) reach q + 1, for then some
rare token or some pair of frequent ones is common. Tokens that no other class holds index nothing,
and a set with more than q of these has no partner at all.

Index entries are gathered under their smallest member, so what meets there may be linked with that one
set; chains of sets that only neighbours share stay apart. Pairs that share an entry and are near enough
in size are verified on whole sets, each pair once, hot entries in blocks of bounded size. Verified links
become components by star contraction.

Pairs of frequent tokens grow with the square of a set's size. Sets of over LONG tokens index single
frequent tokens instead; sets that may have partners on both sides of LONG index both ways, so no pair
is lost.

Defined cases: null, empty and blank texts have no tokens and are linked with nothing; texts with fewer
words than a shingle have one token, the whole sequence; repeated rows are copies of each other; rows
without an id have none to be found by, and keep a null component. Extra columns are harmless.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import exchange as X
from .components import components

#: Tokens in more classes than this are the frequent ones, indexed in pairs.
FREQUENT = 1024
#: Sets of more tokens than this index frequent tokens one by one: their pairs would be too many.
LONG = 400
#: Bounds of one block of an area, and of the sets one task holds in bytes.
BLOCK_TOKENS, BLOCK_ROWS, PART_BYTES = 1 << 18, 128, 4 << 20
#: Columns of an incidence matrix at a time.
COLUMNS = 4096
SETS = "doc_id long, n long, tokens binary, keys array<long>"


def sets_of(column, words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    data, offsets = C.text_buffer(column)
    out: list[np.ndarray] = []
    for i, j in C.pieces(offsets):
        hashes, first = C.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        token, doc = C.shingle_hashes(hashes, first, words)
        at = np.searchsorted(doc, np.arange(j - i + 1))
        out += [np.unique(token[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def signature(tokens: np.ndarray) -> bytes:
    """128 bits for a set: two sums of mixed tokens, which no order changes."""
    return np.array([C.mix(tokens * C.U(3)).sum(dtype=C.U), C.mix(tokens + C.U(1)).sum(dtype=C.U)], "<u8").tobytes()


def describe(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, g, n, sig of every document of grouped()."""
    kind = pa.schema([("doc_id", pa.int64()), ("g", pa.int32()), ("n", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        for batch in batches:
            C.release()
            sets = sets_of(batch.column(batch.schema.get_field_index("text")), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else b"" for s in sets], pa.binary())], schema=kind
            )

    return docs.select("doc_id", "text", "g").mapInArrow(run, "doc_id long, g int, n long, sig binary")


def _chosen(docs: pa.Table, heads: pa.Table, words: int) -> tuple[list[int], list[np.ndarray]]:
    """The documents of a group that stand for their classes, in order of id, and their sets."""
    wanted = dict(zip(heads.column("doc_id").to_pylist(), heads.column("sig").to_pylist(), strict=True))
    ids = docs.column("doc_id").to_pylist()
    spot = [k for k, i in enumerate(ids) if i in wanted]
    found: dict[int, np.ndarray] = {}
    for k, s in zip(spot, sets_of(docs.column("text").take(pa.array(spot, pa.int64())), words), strict=True):
        if ids[k] not in found and len(s) and signature(s) == wanted[ids[k]]:
            found[ids[k]] = s
    order = sorted(found)
    return order, [found[i] for i in order]


def _code(count: np.ndarray) -> np.ndarray:
    """Counts in one byte: exact to 127, then eighths of powers of two."""
    return np.where(count < 128, count, np.minimum(255, 128 + np.floor(8 * np.log2(np.maximum(count, 128) / 128)))).astype(np.uint8)


def _count(keys: np.ndarray, extras: list[bytes]) -> np.ndarray:
    _, inverse = np.unique(keys, return_inverse=True)
    return _code(np.bincount(inverse, np.frombuffer(b"".join(extras), np.uint16)))[inverse]


def allowed(n: int, percent: int) -> int:
    """Most tokens that a set of n can miss of a partner: an overlap of percent / 100 of the union needs that share of n."""
    return n - -(-percent * n // 100)


def index_keys(tokens: np.ndarray, code: np.ndarray, percent: int, frequent: int, long: int | None = None) -> np.ndarray | None:
    """Index entries of a set; None if no set can be its partner."""
    n, long = len(tokens), LONG if long is None else long
    q = allowed(n, percent)
    if (code == 1).sum() > q:
        return None
    order = np.lexsort((tokens, code))
    often = code[order] > _code(np.array([frequent]))[0]
    found = []
    if 100 * n > percent * long:  # a partner may be long: the first q + 1 tokens, one by one
        first = order[: q + 1]
        found.append(tokens[first[code[first] > 1]])
    if percent * n <= 100 * long:  # a partner may be short: rare ones, and pairs of frequent ones
        worth = np.cumsum(~often) + np.maximum(np.cumsum(often) - 1, 0)
        end = np.searchsorted(worth, q + 1) + 1
        prefix, frequent_ones = tokens[order[:end]], often[:end]
        a, b = np.triu_indices(int(frequent_ones.sum()), 1)
        pairs = prefix[frequent_ones]
        # In a fixed order, whatever the prefix: the pair's smaller token comes first.
        low, high = np.minimum(pairs[a], pairs[b]), np.maximum(pairs[a], pairs[b])
        found += [prefix[~frequent_ones & (code[order[:end]] > 1)], C.mix(low * C.U(5) + C.mix(high))]
    return np.unique(np.concatenate(found)).view(np.int64)


def indexed(docs: DataFrame, heads: DataFrame, n_groups: int, words: int, percent: int, frequent: int) -> DataFrame:
    """SETS of the classes that may have a partner."""

    def send(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, sets = _chosen(left, right, words)
        keys, times = np.unique(X.short(np.concatenate(sets or [np.zeros(0, np.uint64)])), return_counts=True)
        return X.parcels(key[0].as_py(), keys, n_groups, np.minimum(times, 65535).astype(np.uint16))

    def index(key, left: pa.Table, right: pa.Table) -> pa.Table:
        mask = pa.compute.is_null(right.column("codes"))
        ids, sets = _chosen(left, right.filter(mask), words)
        code = X.codes_of(right.filter(pa.compute.invert(mask)), np.uint8)
        rows = []
        if sets:
            flat = X.short(np.concatenate(sets))
            own = code[np.searchsorted(np.unique(flat), flat)]
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            for k, (i, s) in enumerate(zip(ids, sets, strict=True)):
                keys = index_keys(s, own[at[k] : at[k + 1]], percent, frequent)
                if keys is not None and len(keys):
                    rows.append({"doc_id": i, "n": len(s), "tokens": s.tobytes(), "keys": keys.tolist()})
        return pa.Table.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("keys", pa.list_(pa.int64()))]))

    by_g = docs.groupBy("g")
    sent = by_g.cogroup(heads.groupBy("g")).applyInArrow(C.released2(send), X.PARCEL_TYPE)
    back = X.answer(sent, _count)
    both = back.unionByName(heads, allowMissingColumns=True)
    return C.materialize(by_g.cogroup(both.groupBy("g")).applyInArrow(C.released2(index), SETS))


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether a[i] and b[j] have a number in common, for all i, j: products of incidence matrices, some columns at a time."""
    size = np.array([len(x) for x in a] + [len(x) for x in b])
    column = np.unique(np.concatenate([*a, *b]), return_inverse=True)[1] if size.sum() else np.zeros(0, int)
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(a), len(b)), bool)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        part = np.zeros((len(size), COLUMNS), np.float32)
        part[row[i:j], column[i:j] - lo] = 1
        out |= part[: len(a)] @ part[len(a) :].T > 0
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, common tokens) of the wanted pairs of sets; the work is that of the wanted pairs alone."""
    size = np.array([len(s) for s in right])
    vocab, flat = np.unique(np.concatenate(right), return_inverse=True)
    at = np.cumsum(size) - size
    mark = np.zeros(len(vocab), np.int32)
    out = []
    for i in np.flatnonzero(wanted.any(1)).tolist():
        spot = np.minimum(np.searchsorted(vocab, left[i]), len(vocab) - 1)
        spot = spot[vocab[spot] == left[i]]
        j = np.flatnonzero(wanted[i])
        start = np.cumsum(size[j]) - size[j]
        mark[spot] = 1
        common = np.add.reduceat(mark[flat[np.repeat(at[j] - start, size[j]) + np.arange(size[j].sum())]], start)
        mark[spot] = 0
        out.append((np.full(len(j), i), j, common))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


@dataclass
class Members:
    """Sets of one block of an area: tokens, index entries, and the areas each is in."""

    tokens: list[np.ndarray]
    keys: list[np.ndarray]
    areas: list[np.ndarray]


def verify(area: int, a: Members, b: Members | None, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (i, j) of a with b, or among a, that belong to this area, and how many pairs were compared.

    Compared are pairs that share an index entry, are near enough in size, and meet in no smaller area.
    """
    right = b or a
    n, m = (np.array([len(t) for t in x.tokens]) for x in (a, right))
    wanted = 100 * np.minimum(n[:, None], m) >= percent * np.maximum(n[:, None], m)
    if b is None:
        wanted &= np.triu(np.ones(wanted.shape, bool), 1)
    wanted &= shared(a.keys, right.keys)
    wanted &= ~shared([x[x < area] for x in a.areas], [x[x < area] for x in right.areas])
    i, j, common = overlaps(a.tokens, right.tokens, wanted)
    hit = 100 * common >= percent * (n[i] + m[j] - common)
    return i[hit], j[hit], len(i)


def _lists(column) -> list[np.ndarray]:
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def links_of(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links that tie the linked sets, and (doc_id, partners) counts, from SETS.

    An index entry belongs to the area of its smallest member, so an area holds what may be linked with
    one set, never what is only reached through others. A set goes to each of its areas; a pair is
    compared in the smallest area that has both.
    """
    entry = sets.select("doc_id", "n", F.explode("keys").alias("key"))
    star = entry.groupBy("key").agg(F.min("doc_id").alias("area"), F.count("*").alias("k"), F.min("n").alias("low"), F.max("n").alias("high"))
    star = star.where((F.col("k") > 1) & ~((F.col("k") == 2) & (100 * F.col("low") < percent * F.col("high")))).select("key", "area")
    own = entry.join(star, "key").groupBy("doc_id").agg(F.collect_set("area").alias("areas"), F.collect_list("key").alias("shared_keys"))
    held = C.materialize(own.join(sets.select("doc_id", "n", "tokens"), "doc_id"))
    member = held.select("doc_id", "n", "tokens", "shared_keys", "areas", F.explode("areas").alias("area"))
    blocks = F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)), F.ceil(F.count("*") / F.lit(BLOCK_ROWS))).cast("int")
    size = C.materialize(member.groupBy("area").agg(F.count("*").alias("members"), F.sum("n").alias("n"), blocks.alias("blocks")).where("members > 1"))
    total = size.agg(F.sum(F.col("n") * F.col("blocks") * 16)).first()[0] or 0
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PART_BYTES))
    # Block x meets every block y: a small area is one block, so its sets travel once.
    met = member.drop("n").join(size.select("area", "blocks"), "area").withColumn("x", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    met = met.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("area", "doc_id", "tokens", "shared_keys", "areas", "x", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("r"))
    met = met.withColumn("part", F.pmod(F.xxhash64("area", "p", "r"), F.lit(parts)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        ids, area, x, p, r = (table.column(c).to_numpy() for c in ("doc_id", "area", "x", "p", "r"))
        tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        keys, areas = _lists(table.column("shared_keys")), _lists(table.column("areas"))
        order = np.lexsort((ids, r, p, area))
        new = np.flatnonzero(np.any([np.diff(c[order]) != 0 for c in (area, p, r)], axis=0)) + 1
        out_id, out_b, out_n = [], [], []
        for some in np.split(order, new):
            pick = lambda s: Members([tokens[k] for k in s], [keys[k] for k in s], [areas[k] for k in s])
            k = some[0]
            first, second = some[x[some] == p[k]], some[x[some] == r[k]]
            if not len(first) or not len(second):
                continue
            i, j, _ = verify(int(area[k]), pick(first), None if p[k] == r[k] else pick(second), percent)
            if len(i):
                i, j = ids[first[i]], ids[second[j]]
                one, n = np.unique(np.concatenate([i, j]), return_counts=True)
                tied = forest(i, j)
                out_id += [one, tied[0]]
                out_b += [np.full(len(one), -1), tied[1]]
                out_n += [n, np.full(len(tied[0]), 0)]
        none = [np.zeros(0, np.int64)]
        b, n = np.concatenate(out_b or none), np.concatenate(out_n or none)
        return pa.Table.from_arrays([pa.array(np.concatenate(out_id or none)), pa.array(b, pa.int64(), mask=n > 0), pa.array(n, pa.int64())], names=["doc_id", "b", "partners"])

    found = C.materialize(met.groupBy("part").applyInArrow(lambda t: C.released(run)(t), "doc_id long, b long, partners long"))
    links = found.where("partners = 0").select(F.col("doc_id").alias("a"), "b")
    return links, found.where("partners > 0").groupBy("doc_id").agg(F.sum("partners").alias("partners"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links, one fewer than the nodes of each component, that tie what (a, b) ties."""
    up: dict[int, int] = {}

    def root(k: int) -> int:
        while up.setdefault(k, k) != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    out = []
    for s, t in zip(a.tolist(), b.tolist(), strict=True):
        s, t = root(s), root(t)
        if s != t:
            up[max(s, t)] = min(s, t)
            out.append((max(s, t), min(s, t)))
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def join(docs: DataFrame, words: int = 4, percent: int = 85, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable), n_classes linked directly; one row for each document."""
    texts, n_groups = C.grouped(docs)
    every = C.materialize(describe(texts, words))
    full = every.where("n > 0 AND doc_id IS NOT NULL")
    heads = full.groupBy("sig").agg(F.min(F.struct("doc_id", "g")).alias("head")).select("sig", "head.doc_id", "head.g")
    sets = indexed(texts, heads, n_groups, words, percent, frequent)
    links, partners = links_of(sets, percent)
    tops = components(links)
    known = heads.select("sig", "doc_id").join(tops.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(partners, "doc_id", "left")
    known = known.select("sig", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("partners", F.lit(0)).alias("n_classes"))
    out = full.join(known, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_classes")
    alone = every.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_classes"))
    return out.unionByName(alone)
