"""Scoring by a causal self-attention model over subword ids, beside a word unigram base.

Counts cover the whole corpus: groups of documents send their distinct words, with training counts, to
buckets of a packed exchange and get each word's count back; the same exchange sums the counts of all
subword ids of the training documents, and counts every pair of neighbouring ids. A token's probability is
MIX * P(id | h) + (1 - MIX) * (n(previous, id) + PRIOR * P(id | h)) / (n(previous) + PRIOR): the pairs n are
exact and of all training documents, P is the attention model: embeddings, one masked head, an output over
classes of ids, then over the leaves of a class. Classes come from the pairs of all training documents; the
frequent ids of a class are leaves of their own, the others share one, by the counts of the whole corpus. The
weights learn from every token of every training document: each part of them, of a fixed size, takes a pass of
gradient steps over all of its own, and the parts' weights are averaged by what they learnt from. The passes start at weights fitted to a
bounded sample, which sets the start only. Texts are scored in windows that overlap: every token is
scored once, with at least CONTEXT tokens before it where the text has them, many windows at a time.

Words are runs without white space, A-Z as a-z; a word's subwords are those of the word with a blank
before it; every text ends with one end token. Defined cases: null texts are empty and hold the end
only; with no training document all counts are zero; repeated rows are scored each; texts of any length
are scored whole; an empty table gives no rows; extra columns are dropped. Words are told apart by 64-bit
hashes; of equally frequent subwords the smaller id comes first.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import exchange as X

WIDTH, CONTEXT, DIM, CLASSES, LEAVES, BATCH = 32, 8, 16, 64, 48, 48
#: Rows of a matrix product, few enough for the kernels that linear algebra has for small ones; plays no role in results.
ROWS = 896
#: Most that a logit counts for.
CAP = np.float32(80)
#: Bounds of the start of the fit: documents sampled and code points of each; steps of training.
SAMPLE_DOCS, SAMPLE_CHARS, STEPS = 2500, 6000, 1500
#: Windows in a step of training, and in a step of a group's pass, with the rate of the pass.
BATCH_TRAIN, BATCH_PASS, RATE_PASS = 128, 512, 0.003
#: Most frequent ids that ids are told apart by, as neighbours on either side, to make classes.
OFTEN = 512
#: Weights are summed in so many parts, of so many groups at a time.
PARTS, FAN = 16, 64
#: Words of the texts that are scored at a time.
SLICE_WORDS = 1 << 18
#: Share of the attention model in a probability, and its weight in the other share, in occurrences of the previous id.
MIX, PRIOR = 0.8, 3.0
#: Pairs are spread over the keys of the exchange by this factor; odd, so none coincide.
SPREAD, KEY_MASK = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << X.KEY_BITS) - 1)
UNSPREAD = np.uint64(pow(int(SPREAD), -1, 1 << X.KEY_BITS))
#: Buckets that sum the counts of subword ids.
ID_BUCKETS = 16


class Subwords:
    """Ids of distinct words, by a public byte-level vocabulary in tiktoken's format."""

    #: Words that are encoded in a row.
    ROW = 20000

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.leads = np.zeros(self.size, bool)
        self.leads[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.grouping = None  # classes and vectors of the ids, where a corpus gave them
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word with a blank before it, one after the other, and each word's first (n + 1 entries).

        Many words are encoded at a time, in a row; no word holds a blank, so the ids that begin with one
        are the words' first. Where their number is not that of the words, the words are encoded one by one.
        """
        found, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), self.ROW):
            part = words[k : k + self.ROW]
            got = np.array(self.encode(" " + " ".join(part)), np.int32)
            first = np.flatnonzero(self.leads[got])
            if len(first) == len(part) and first[0] == 0:
                counts.append(np.diff(np.append(first, len(got))))
            else:
                each = [self.encode(" " + w) for w in part]
                got = np.array([i for x in each for i in x], np.int32)
                counts.append(np.array([len(x) for x in each], np.int64))
            found.append(got)
        return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


@lru_cache(maxsize=1)
def subwords_of(path: str, pattern: str) -> Subwords:
    """The vocabulary, read once by each worker."""
    return Subwords(path, pattern)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, ascending, a place of each, and which of them stands at each place."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(values)))
    return ordered[first], order[first], inverse


class Words:
    """The words of a group: document and distinct word of each; distinct words by ascending hash."""

    def __init__(self, column):
        data, offsets = C.text_buffer(column)
        data = C.LOWER[data]
        keys, starts, ends, counts = [], [], [], []
        for i, j in C.pieces(offsets):
            part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            start, end, first = C.word_spans(part, off)
            keys.append(C.hash_ranges(part, start, end))
            starts.append(start + offsets[i])
            ends.append(end + offsets[i])
            counts.append(np.diff(first))
        none = [np.zeros(0, np.int64)]
        self.size = np.concatenate(counts or none)  # words of each document
        self.hash, one, self.word = distinct(np.concatenate(keys or [np.zeros(0, np.uint64)]))
        start, end = np.concatenate(starts or none)[one], np.concatenate(ends or none)[one]
        raw = data.tobytes()
        self.text = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        self.doc = np.repeat(np.arange(len(self.size)), self.size)


def send_counts(words: Words, train: np.ndarray, subwords: Subwords, g: int, n_buckets: int) -> pa.Table:
    """Parcels of a group: words with their counts in training documents, and counts of subword ids."""
    count = np.bincount(words.word, train[words.doc], len(words.hash)).astype(np.uint32)
    low = (words.hash & np.uint64(0xFFFF)).astype(np.uint16)
    extra = np.zeros(len(low), [("low", "<u2"), ("count", "<u4")])
    extra["low"], extra["count"] = low, count
    out = X.parcels(g, X.short(words.hash), n_buckets, extra)
    ids, at = subwords.ids(words.text)
    total = np.bincount(ids, np.repeat(count, np.diff(at)), subwords.size).astype(np.uint64)
    rows = []
    for k in range(ID_BUCKETS):
        own = np.arange(k, subwords.size, ID_BUCKETS)
        own = own[total[own] > 0]
        if len(own):
            rows.append({"b": n_buckets + k, "g": g, "n": len(own), "keys": X.pack(own.astype(np.uint64)), "extra": total[own].tobytes()})
    key, times = pair_counts(words, ids, at, subwords, train)
    pairs = X.parcels(g, key, n_buckets, times)
    pairs = pairs.set_column(0, "b", pa.array(pairs.column("b").to_numpy() + n_buckets + ID_BUCKETS, pa.int32()))
    return pa.concat_tables([out, pa.Table.from_pylist(rows, X.PARCELS), pairs])


def pairs_of(flat: np.ndarray, size: np.ndarray, subwords: Subwords) -> np.ndarray:
    """(previous id, id) of every token as one number; before the first token of a text stands the end."""
    kind = np.uint32 if subwords.size**2 < 1 << 32 else np.uint64
    previous = np.empty(len(flat), kind)
    previous[1:] = flat[:-1]
    previous[np.cumsum(size) - size] = subwords.end
    return previous * kind(subwords.size) + flat.astype(kind)


def slices(words: Words):
    """Ranges of documents and of their words, of bounded size."""
    first = np.concatenate([[0], np.cumsum(words.size)])
    for i, j in C.pieces(first, SLICE_WORDS):
        yield i, j, words.word[first[i] : first[j]]


def pair_counts(words: Words, ids: np.ndarray, at: np.ndarray, subwords: Subwords, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, of all pairs of a group's documents, and how often each stands in training documents."""
    found, times = [], []
    for i, j, part in slices(words):
        flat, size = laid_out(part, words.size[i:j], ids, at, subwords.end)
        pair, learnt = pairs_of(flat, size, subwords), np.repeat(train[i:j], size)
        one, n = np.unique(pair[learnt], return_counts=True)
        other = np.unique(pair[~learnt])
        found += [one, other]
        times += [n, np.zeros(len(other), np.int64)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    pair, _, inverse = distinct(np.concatenate(found))
    count = np.bincount(inverse, np.concatenate(times), len(pair)).astype(np.uint32)
    key = spread(pair)
    order = np.argsort(key)
    return key[order], count[order]


def spread(pair: np.ndarray) -> np.ndarray:
    return pair.astype(np.uint64) * SPREAD & KEY_MASK


ANSWER_TYPE = X.ANSWER_TYPE + ", n long, v long"
ANSWERS = X.ANSWERS.append(pa.field("n", pa.int64())).append(pa.field("v", pa.int64()))


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts of any size: the bytes that the largest needs, then so many bytes of each."""
    width = max(1, -(-int(counts.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    out = np.zeros((len(planes), 8), np.uint8)
    out[:, : raw[0]] = planes
    return out.view("<u8")[:, 0]


def sum_counts(table: pa.Table, n_buckets: int) -> pa.Table:
    """A bucket's counts, sent back to every group that asked; n tokens and v words in all on the first row.

    Row -1 of a bucket of ids has their counts, row -2 of one of pairs the pairs of training documents."""
    b = table.column("b")[0].as_py()
    table = table.sort_by("g")
    keys = [X.unpack(x) for x in table.column("keys").to_pylist()]
    raw = b"".join(table.column("extra").to_pylist())
    flat = np.concatenate(keys)
    if b >= n_buckets + ID_BUCKETS:
        one, inverse = np.unique(flat, return_inverse=True)
        total = np.bincount(inverse, np.frombuffer(raw, "<u4")).astype(np.uint64)
        back = total[inverse]
        cut = np.cumsum([len(k) for k in keys])[:-1]
        rows = zip(table.column("g").to_pylist(), np.split(back, cut), strict=True)
        learnt = X.pack(one[total > 0]) + pack_counts(total[total > 0])
        rows = [(g, pack_counts(x)) for g, x in rows] + [(-2, learnt)]
        # Row -2 tells in top how many pairs it has.
        return pa.Table.from_pylist([{"g": g, "b": b, "codes": x, "top": int((total > 0).sum()) if g == -2 else 0, "n": 0, "v": 0} for g, x in rows], ANSWERS)
    if b >= n_buckets:
        ids, inverse = np.unique(flat, return_inverse=True)
        total = np.bincount(inverse, np.frombuffer(raw, np.uint64)).astype(np.uint64)
        return pa.Table.from_pylist([{"g": -1, "b": b, "codes": np.stack([ids, total]).tobytes(), "top": 0, "n": 0, "v": 0}], ANSWERS)
    extra = np.frombuffer(raw, [("low", "<u2"), ("count", "<u4")])
    _, inverse = np.unique(flat << np.uint64(16) | extra["low"].astype(np.uint64), return_inverse=True)
    total = np.bincount(inverse, extra["count"])
    back = total.astype(np.uint64)[inverse]
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    n, v = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    n[0], v[0] = total.sum(), (total > 0).sum()
    codes = [pack_counts(back[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    return pa.Table.from_arrays(
        [table.column("g").combine_chunks(), table.column("b").combine_chunks(), pa.array(codes, pa.binary()), pa.array(np.zeros(len(keys)), pa.int32()), pa.array(n), pa.array(v)], schema=ANSWERS
    )


def windows(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first token, document) of the windows of texts with ``size`` tokens one after the other."""
    step = WIDTH - CONTEXT
    n = np.maximum(1, -(-(size - CONTEXT) // step))
    doc = np.repeat(np.arange(len(size)), n)
    at = np.cumsum(size) - size
    return at[doc] + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)), doc


CAUSAL = np.tril(np.ones((WIDTH, WIDTH), np.float32))


class Model:
    """x = vector(previous id) + place; h = x + masked attention over x; softmax over classes, then over leaves."""

    def __init__(self, params: dict[str, np.ndarray], group: np.ndarray, leaf: np.ndarray, share: np.ndarray):
        self.p, self.group, self.leaf, self.share = params, group, leaf, share  # share: log of an id's part of its leaf
        self.cell = (group * (LEAVES + 1) + leaf).astype(np.uint16)
        self.seen = np.full(len(params["vector"]), 1e-8, np.float32)  # sums of AdaGrad of the fit so far

    def hidden(self, previous: np.ndarray, keep: bool = False, skip: int = 0):
        """States of all tokens but the first ``skip`` of each window, and what their gradient needs."""
        p, d = self.p, DIM
        n, t = previous.shape
        x = np.take(p["vector"], previous, axis=0)
        x += p["place"][:t]
        qkv = x @ p["qkv"]
        a = qkv[:, skip:, :d] @ np.ascontiguousarray(qkv[:, :, d : 2 * d].transpose(0, 2, 1))
        np.clip(a, -60, 60, out=a)
        np.exp(a, out=a)
        a *= CAUSAL[skip:t, :t]
        # The weights stay undivided; what they sum up is narrower.
        share = 1 / (a.reshape(-1, t) @ np.ones(t, np.float32))
        o = a @ qkv[:, :, 2 * d :]
        o *= np.repeat(share, d).reshape(o.shape)
        h = o @ p["mix"]
        h += x[:, skip:]
        return (h, (x, qkv, a, o, share)) if keep else h

    def log_probability(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of P(id | h), row by row."""
        cell = self.cell[ids]
        order = np.argsort(cell, kind="stable")
        cell, got, rows = cell[order], self.share[ids[order]], beside_one(np.take(h, order, axis=0))
        group, leaf = np.divmod(cell, LEAVES + 1)
        first, second = self.layers()
        capped = self.capped(rows)
        for k in range(0, len(ids), ROWS):
            part = slice(k, k + ROWS)
            got[part] += _pick(rows[part] @ first, group[part], capped)
        cut = np.searchsorted(group, np.arange(CLASSES + 1))
        for g in np.flatnonzero(np.diff(cut)).tolist():
            for k in range(cut[g], cut[g + 1], ROWS):
                some = slice(k, min(k + ROWS, cut[g + 1]))
                got[some] += _pick(rows[some] @ second[g], leaf[some], capped)
        out = np.empty_like(got)
        out[order] = got
        return out

    def layers(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes, and of the leaves of each, with their biases as the last row."""
        p = self.p
        return np.concatenate([p["out"], p["bias"][None]]), np.concatenate([p["out2"], p["bias2"][:, None]], 1)

    def capped(self, rows: np.ndarray) -> bool:
        """Whether logits of these rows of states could pass CAP, by the largest lengths of states and of weights."""
        p, h = self.p, rows[:, :DIM]
        longest = np.einsum("ij,ij->i", h, h).max(initial=0) * max((p["out"] ** 2).sum(0).max(), (p["out2"] ** 2).sum(1).max())
        return not np.sqrt(longest) + max(p["bias"].max(), p["bias2"].max()) < CAP

    def log10(self, ids: np.ndarray, size: np.ndarray, end: int) -> np.ndarray:
        """log10 probability of every token of texts one after the other."""
        out = np.empty(len(ids), np.float32)
        previous = np.empty(len(ids), np.int32)
        previous[1:] = ids[:-1]
        at = np.cumsum(size) - size
        previous[at] = end
        start, doc = windows(size)
        fresh = start == at[doc]
        # Windows of equal length are scored together; the shorter ones, at the ends of texts, by their lengths.
        width = np.minimum(WIDTH, (at + size)[doc] - start)
        order = np.argsort(width * 2 + fresh, kind="stable")
        cut = np.flatnonzero(np.diff((width * 2 + fresh)[order])) + 1
        states, spots, held = [], [], 0

        def flush() -> None:
            spot = np.concatenate(spots)
            out[spot] = self.log_probability(np.concatenate(states), ids[spot])

        for some in np.split(order, cut) if len(order) else []:
            w, skip = int(width[some[0]]), 0 if fresh[some[0]] else CONTEXT
            batch = max(BATCH, BATCH * WIDTH // w)
            for k in range(0, len(some), batch):
                spot = start[some[k : k + batch], None] + np.arange(w)
                states.append(self.hidden(previous[spot], skip=skip).reshape(-1, DIM))
                spots.append(spot[:, skip:].ravel())
                held += len(spots[-1])
                if held > 1 << 17:
                    flush()
                    states, spots, held = [], [], 0
        if held:
            flush()
        return out / np.float32(np.log(10))


def beside_one(rows: np.ndarray) -> np.ndarray:
    """Rows with a one after each, which meets a bias."""
    out = np.ones((len(rows), rows.shape[1] + 1), np.float32)
    out[:, :-1] = rows
    return out


def _exp(z: np.ndarray, capped: bool) -> np.ndarray:
    """Exponentials of logits, in place. Logits are small; capped, their exponentials cannot overflow."""
    if capped:
        np.minimum(z, CAP, out=z)
    return np.exp(z, out=z)


def _pick(z: np.ndarray, target: np.ndarray, capped: bool) -> np.ndarray:
    """log softmax of each row at its target."""
    got = np.minimum(z[np.arange(len(z)), target], CAP)
    return got - np.log(_exp(z, capped) @ np.ones(z.shape[1], np.float32))


def _gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, some rows at a time."""
    out = np.zeros((a.shape[1], b.shape[1]), np.float32)
    for i in range(0, len(a), ROWS):
        out += a[i : i + ROWS].T @ b[i : i + ROWS]
    return out


def columns(counts: np.ndarray) -> np.ndarray:
    """The place of each of the OFTEN most frequent ids, the end aside; -1 for all others."""
    known = np.flatnonzero(counts[:-1] > 0)
    often = known[np.argsort(-counts[known], kind="stable")[:OFTEN]]
    col = np.full(len(counts), -1)
    col[often] = np.arange(len(often))
    return col


def cells(pair: np.ndarray, n: np.ndarray, counts: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, frequent neighbour) as one number, and the log of how much oftener than by chance they meet; those that do."""
    size, found = len(counts), []
    a, b = (pair // np.uint64(size)).astype(np.int64), (pair % np.uint64(size)).astype(np.int64)
    for shift, row, other in ((0, b, a), (OFTEN, a, b)):
        ok = (col[other] >= 0) & (row != size - 1)
        ratio = n[ok] * counts.sum() / (counts[row[ok]] * counts[other[ok]])
        cell = row[ok] * (2 * OFTEN) + shift + col[other[ok]]
        found.append((cell[ratio > 1], np.log(ratio[ratio > 1])))
    return np.concatenate([x for x, _ in found]).astype("<u4"), np.concatenate([y for _, y in found]).astype("<f2")


def neighbours(found: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cells() of the pairs of all training documents; at most one for an id and each of the frequent ones on a side."""
    known = found.sparkSession.sparkContext.broadcast((counts, columns(counts)))

    def run(batches):
        for batch in batches:
            out = []
            for raw, n in zip(batch.column("codes").to_pylist(), batch.column("top").to_pylist(), strict=True):
                cut = n * X.KEY_BITS // 8
                cell, value = cells(X.unpack(raw[:cut]) * UNSPREAD & KEY_MASK, unpack_counts(raw[cut:]).astype(float), *known.value)
                out.append({"cell": cell.tobytes(), "value": value.tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("cell", pa.binary()), ("value", pa.binary())]))

    rows = found.where("g = -2").select("codes", "top").mapInArrow(run, "cell binary, value binary").collect()
    return np.frombuffer(b"".join(r["cell"] for r in rows), "<u4"), np.frombuffer(b"".join(r["value"] for r in rows), "<f2")


def classes(cell: np.ndarray, value: np.ndarray, counts: np.ndarray, leads: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Classes of ids by their neighbours (cells()), and vectors; unseen ids share two classes."""
    size = len(counts)
    group = np.where(leads, CLASSES - 2, CLASSES - 3)
    vector = np.zeros((size, DIM), np.float32)
    group[size - 1] = CLASSES - 1
    known = np.flatnonzero((counts > 0) & (np.arange(size) != size - 1))
    if len(known) < CLASSES:
        return group, vector
    count, row = counts, np.full(size, -1)
    row[known] = np.arange(len(known))
    pairs = np.zeros((len(known), 2 * OFTEN), np.float32)
    pairs[row[cell // (2 * OFTEN)], cell % (2 * OFTEN)] = value
    pairs *= np.sqrt(np.minimum(1, count[known, None] / 20)).astype(np.float32)
    value, basis = np.linalg.eigh(pairs.T @ pairs)
    point = pairs @ basis[:, -DIM:]
    point /= np.linalg.norm(point, axis=1, keepdims=True) + 1e-6
    centre = point[rng.choice(len(known), CLASSES - 3, replace=False, p=count[known] ** 0.5 / (count[known] ** 0.5).sum())]
    for _ in range(15):
        own = (point @ centre.T - (centre**2).sum(1) / 2).argmax(1)
        weight = np.bincount(own, count[known], CLASSES - 3)
        for k in range(DIM):
            centre[:, k] = np.where(weight > 0, np.bincount(own, point[:, k] * count[known], CLASSES - 3) / np.maximum(weight, 1e-9), centre[:, k])
    group[known] = own
    vector[known] = point.astype(np.float32) * 0.5
    return group, vector


def train(texts: list[str], counts: np.ndarray, subwords: Subwords, seed: int = 0, steps: int = STEPS) -> Model:
    """Classes from the corpus, or from the texts where none gave any; shares from the counts; weights, by Adam, from the texts."""
    rng = np.random.default_rng(seed)
    words = Words(pa.array(texts, pa.large_string()))
    ids, size = sequences(words, subwords)
    if subwords.grouping is None:
        own = np.bincount(ids, minlength=subwords.size).astype(float)
        pair, n = np.unique(pairs_of(ids, size, subwords).astype(np.uint64), return_counts=True)
        group, vector = classes(*cells(pair, n.astype(float), own, columns(own)), own, subwords.leads, rng)
    else:
        group, vector = subwords.grouping
    # The most frequent ids of each class, by the corpus, are leaves; the last leaf is for all others.
    order = np.lexsort((np.arange(subwords.size), -counts, group))
    rank = np.empty(subwords.size, np.int64)
    rank[order] = np.arange(subwords.size) - np.searchsorted(group[order], group[order])
    leaf = np.minimum(rank, LEAVES)
    smooth, cell = counts + 0.1, group * (LEAVES + 1) + leaf
    share = np.log(smooth / np.bincount(cell, smooth, CLASSES * (LEAVES + 1))[cell]).astype(np.float32)
    f = np.float32
    mass = np.bincount(cell, smooth, CLASSES * (LEAVES + 1)).reshape(CLASSES, LEAVES + 1)
    total = np.log(mass.sum(1) + 1)
    inner = np.where(mass > 0, np.log(np.maximum(mass, 1e-9)), -30)
    p = {
        "vector": vector + rng.normal(0, 0.05, (CLASSES, DIM)).astype(f)[group],
        "place": rng.normal(0, 0.02, (WIDTH, DIM)).astype(f),
        "qkv": rng.normal(0, DIM**-0.5, (DIM, 3 * DIM)).astype(f),
        "mix": rng.normal(0, 0.1, (DIM, DIM)).astype(f),
        "out": rng.normal(0, 0.1, (DIM, CLASSES)).astype(f),
        "bias": (total - total.max()).astype(f),
        "out2": rng.normal(0, 0.1, (CLASSES, DIM, LEAVES + 1)).astype(f),
        "bias2": (inner - inner.max(1, keepdims=True)).astype(f),
    }
    model = Model(p, group, leaf, share)
    model.seen = np.full(len(p["vector"]), 1e-8, f)
    at, width = spans(size)
    fit(model, model.seen, ids, size, subwords.end, (rng.choice(len(at), min(BATCH_TRAIN, len(at)), replace=False) for _ in range(steps if len(at) else 0)), steps, 0.01)
    return model


def spans(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first token, tokens) of windows that hold every token once; the last of a text may be short."""
    n = -(-size // WIDTH)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.cumsum(size) - size, n) + WIDTH * k, np.minimum(WIDTH, np.repeat(size, n) - WIDTH * k)


def fit(model: Model, seen: np.ndarray, ids: np.ndarray, size: np.ndarray, end: int, picks, steps: int, top_rate: float) -> None:
    """A step of Adam (vectors: of AdaGrad, whose sums are ``seen``) for each of ``picks``, places in spans(size)."""
    p, d, f = model.p, DIM, np.float32
    at, width = spans(size)
    previous = np.empty(len(ids), np.int32)
    previous[1:] = ids[:-1]
    previous[np.cumsum(size) - size] = end
    # All weights but the vectors are one array, of which p has parts.
    dense = np.concatenate([p[k].ravel() for k in DENSE])
    cut = np.cumsum([p[k].size for k in DENSE])[:-1]
    p.update((k, x.reshape(p[k].shape)) for k, x in zip(DENSE, np.split(dense, cut), strict=True))
    m, s, scratch = np.zeros_like(dense), np.zeros_like(dense), np.empty_like(dense)
    for step, some_windows in enumerate(picks, 1):
        # Short windows are filled up; what follows a text's end is masked and, as attention looks back only, reaches nothing.
        w = width[some_windows]
        live = np.flatnonzero(np.arange(w.max()) < w[:, None])
        spot = np.minimum(at[some_windows, None] + np.arange(w.max()), len(ids) - 1)
        before = np.take(previous, spot)
        blocks = [slice(k, k + BATCH) for k in range(0, len(before), BATCH)]
        parts = [model.hidden(before[k], keep=True) for k in blocks]
        h = np.concatenate([h for h, _ in parts])
        # Tokens in the order of their classes and leaves.
        cell = np.take(model.cell, np.take(ids, np.take(spot.ravel(), live)))
        order = np.argsort(cell, kind="stable")
        cell, place = cell[order], np.take(live, order)
        back, g = _softmax_gradient(model, beside_one(np.take(h.reshape(-1, d), place, axis=0)), cell)
        source = np.full(h.shape[0] * h.shape[1], len(place))
        source[place] = np.arange(len(place))
        dh = np.take(back, source, axis=0).reshape(h.shape)
        g.update((k, np.zeros_like(p[k])) for k in ("place", "qkv", "mix"))
        dx = np.concatenate([_attention_gradient(p, kept, dh[k], g) for k, (_, kept) in zip(blocks, parts, strict=True)])
        rate = top_rate * min(1, step / 20) * (1 - 0.9 * step / steps)
        grad = np.concatenate([g[k].ravel() for k in DENSE])
        grad += f(1e-16)  # far below what a step sees; keeps numbers out of the slow range next to zero
        m += np.multiply(np.subtract(grad, m, out=scratch), f(0.1), out=scratch)
        grad *= grad
        s += np.multiply(np.subtract(grad, s, out=scratch), f(0.01), out=scratch)
        np.sqrt(np.multiply(s, f(1 / (1 - 0.99**step)), out=scratch), out=scratch)
        scratch += f(1e-8)
        np.divide(m, scratch, out=scratch)
        scratch *= f(rate / (1 - 0.9**step))
        dense -= scratch
        own = np.take(before.ravel(), live)
        order = np.argsort(own)
        own = own[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        used, gv = own[first], np.add.reduceat(np.take(dx, np.take(live, order), axis=0), first, axis=0)
        seen[used] += (gv**2).mean(1)
        p["vector"][used] -= f(0.1) * gv / np.sqrt(seen[used])[:, None]


def _softmax_gradient(model: Model, rows: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Gradients of the mean loss by each row of states (and a row of zeros), and by the output's weights; rows come by ascending cell."""
    p, d, n = model.p, DIM, len(rows)
    first, second = model.layers()
    up, up2 = np.ascontiguousarray(p["out"].T), np.ascontiguousarray(p["out2"].transpose(0, 2, 1))
    got, share = np.empty((2, n, d), np.float32), np.empty((2, n), np.float32)
    g, g2, capped = np.zeros_like(first), np.zeros_like(second), model.capped(rows)
    group, leaf = np.divmod(cell.astype(np.int64), LEAVES + 1)

    def layer(k: int, i: int, j: int, down: np.ndarray, up: np.ndarray, target: np.ndarray, total: np.ndarray) -> None:
        # Softmax less target, times the sum of the exponentials; divided by it in the states, which are narrower.
        some = rows[i:j]
        z = _exp(some @ down, capped)
        sums = z @ np.ones(z.shape[1], np.float32)
        z.reshape(-1)[target[i:j] + np.arange(0, z.size, z.shape[1])] -= sums
        np.matmul(z, up, out=got[k, i:j])
        part = np.divide(np.float32(1 / n), sums, out=share[k, i:j])
        total += (some * part[:, None]).T @ z

    for i in range(0, n, ROWS):
        layer(0, i, min(i + ROWS, n), first, up, group, g)
    cut = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    for c in range(CLASSES):
        for i in range(cut[c], cut[c + 1], ROWS):
            layer(1, i, min(i + ROWS, cut[c + 1]), second[c], up2[c], leaf, g2[c])
    back = np.zeros((n + 1, d), np.float32)
    np.multiply(got[0], share[0, :, None], out=back[:n])
    back[:n] += got[1] * share[1, :, None]
    return back, {"out": g[:d], "bias": g[d], "out2": g2[:, :d], "bias2": g2[:, d]}


def _attention_gradient(p: dict[str, np.ndarray], kept: tuple[np.ndarray, ...], dh: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
    """Gradient by the vectors of all places of some windows, from that by the states; those of the weights are added to ``g``."""
    x, qkv, a, o, share = kept
    n, t, d = x.shape
    o = o.reshape(-1, d)
    g["mix"] += _gram(o, dh.reshape(-1, d))
    # Beside the gradient by what attention gives, what is to be taken from each weight's; both without the divisor.
    wide, v = np.empty((n, t, d + 1), np.float32), np.ones((n, d + 1, t), np.float32)
    flat = wide.reshape(-1, d + 1)
    np.multiply((dh @ np.ascontiguousarray(p["mix"].T)).reshape(-1, d), share[:, None], out=flat[:, :d])
    np.negative(np.einsum("ij,ij->i", flat[:, :d], o), out=flat[:, d])
    v[:, :d] = qkv[:, :, 2 * d :].transpose(0, 2, 1)
    ds = wide @ v
    ds *= a
    back = np.empty((n, t, 3 * d), np.float32)
    np.matmul(ds, qkv[:, :, d : 2 * d], out=back[:, :, :d])
    np.matmul(ds.transpose(0, 2, 1), qkv[:, :, :d], out=back[:, :, d : 2 * d])
    np.matmul(a.transpose(0, 2, 1), wide[:, :, :d], out=back[:, :, 2 * d :])
    g["qkv"] += _gram(x.reshape(-1, d), back.reshape(-1, 3 * d))
    dx = back @ np.ascontiguousarray(p["qkv"].T)
    dx += dh
    g["place"][:t] += dx.sum(0)
    return dx.reshape(-1, d)


DENSE = ("place", "qkv", "mix", "out", "bias", "out2", "bias2")
WEIGHTS_TYPE = "part int, g int, rows binary, times binary, sums binary"
WEIGHTS = pa.schema([("part", pa.int32()), ("g", pa.int32()), ("rows", pa.binary()), ("times", pa.binary()), ("sums", pa.binary())])


def table_of(p: dict[str, np.ndarray]) -> np.ndarray:
    """All weights as rows of DIM: the ids' vectors, then what all ids share, filled up with zeros."""
    dense = np.concatenate([p[k].ravel() for k in DENSE])
    return np.concatenate([p["vector"], np.append(dense, np.zeros(-len(dense) % DIM, np.float32)).reshape(-1, DIM)])


def put_table(p: dict[str, np.ndarray], table: np.ndarray) -> None:
    n = len(p["vector"])
    p["vector"], flat, at = table[:n].astype(np.float32), table[n:].ravel().astype(np.float32), 0
    for k in DENSE:
        p[k] = flat[at : at + p[k].size].reshape(p[k].shape)
        at += p[k].size


def learn(model: Model, ids: np.ndarray, size: np.ndarray, end: int, g: int) -> pa.Table:
    """A pass over every token of a group's training texts, from the weights given: rows of changed weights, summed over the tokens they learnt from."""
    mine = Model({k: x.copy() for k, x in model.p.items()}, model.group, model.leaf, model.share)
    at, _ = spans(size)
    order = np.random.default_rng(g).permutation(len(at))
    batch = min(BATCH_PASS, max(16, len(order) // 64))  # small groups take smaller steps, not fewer than a few
    picks = [order[k : k + batch] for k in range(0, len(order), batch)]
    fit(mine, model.seen.copy(), ids, size, end, picks, len(picks), RATE_PASS)
    table, n = table_of(mine.p), len(mine.p["vector"])
    # A vector learns from each token that its id stands before; a text's last id, the end, stands before its first.
    times = np.append(np.bincount(ids, minlength=n), np.full(len(table) - n, len(ids))).astype(float)
    out = []
    for k in range(PARTS):
        rows = np.arange(k, len(table), PARTS)
        rows = rows[times[rows] > 0]
        if len(rows):
            sums = (table[rows] * times[rows, None]).astype(np.float32)
            out.append({"part": k, "g": g // FAN, "rows": rows.astype("<u4").tobytes(), "times": times[rows].tobytes(), "sums": sums.tobytes()})
    return pa.Table.from_pylist(out, WEIGHTS)


def add_weights(table: pa.Table) -> pa.Table:
    """The sum of the weights of groups, as one."""
    got = sorted(zip(*(table.column(c).to_pylist() for c in ("rows", "times", "sums")), strict=True))
    rows = np.unique(np.concatenate([np.frombuffer(r, "<u4") for r, _, _ in got]))
    times, sums = np.zeros(len(rows)), np.zeros((len(rows), DIM))
    for r, t, x in got:
        at = np.searchsorted(rows, np.frombuffer(r, "<u4"))
        times[at] += np.frombuffer(t)
        sums[at] += np.frombuffer(x, np.float32).reshape(-1, DIM)
    one = {"part": table.column("part")[0].as_py(), "g": table.column("g")[0].as_py() // FAN, "rows": rows.tobytes(), "times": times.tobytes(), "sums": sums.astype(np.float32).tobytes()}
    return pa.Table.from_pylist([one], WEIGHTS)


def learners(docs: DataFrame, total: int) -> tuple[DataFrame, int]:
    """docs with the part they are learnt in as g, and the number of parts: both follow the texts, no setting of the session."""
    n = max(1, -(-total // C.group_size(total)))
    return docs.withColumn("g", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n)).cast("int")), n


def learn_all(train_texts: DataFrame, n_groups: int, model: Model, vocabulary: str, pattern: str) -> None:
    """Weights of the model after a pass of each group over all of its texts, averaged; a vector, by how often each group has its id."""
    start = train_texts.sparkSession.sparkContext.broadcast((model.p, model.group, model.leaf, model.share, model.seen))

    def run(table: pa.Table) -> pa.Table:
        *parts, seen = start.value
        given, subs = Model(*parts), subwords_of(vocabulary, pattern)
        given.seen = seen
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids, size = sequences(Words(table.column("text")), subs)
        return learn(given, ids, size, subs.end, table.column("g")[0].as_py())

    got = C.materialize(train_texts.groupBy("g").applyInArrow(lambda t: C.released(run)(t), WEIGHTS_TYPE))
    while n_groups > 1:
        got = got.groupBy("part", "g").applyInArrow(lambda t: C.released(add_weights)(t), WEIGHTS_TYPE)
        n_groups = -(-n_groups // FAN)
    table = table_of(model.p).astype(float)
    for r in got.collect():
        rows = np.frombuffer(r["rows"], "<u4")
        table[rows] = np.frombuffer(r["sums"], np.float32).reshape(-1, DIM) / np.frombuffer(r["times"])[:, None]
    put_table(model.p, table)


def sequences(words: Words, subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each with its end, and their numbers."""
    ids, at = subwords.ids(words.text)
    return laid_out(words.word, words.size, ids, at, subwords.end)


def laid_out(word: np.ndarray, size: np.ndarray, ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)[word]
    size = np.bincount(np.repeat(np.arange(len(size)), size), n, len(size)).astype(np.int64) + 1
    out = np.full(int(size.sum()), end, np.int32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(size) - 1] = False
    shift = (at[word] - np.cumsum(n) + n).astype(np.int32)
    out[inside] = ids[np.repeat(shift, n) + np.arange(int(n.sum()), dtype=np.int32)]
    return out, size


def score(docs: DataFrame, held_out: Column, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; training is what is not held out."""
    texts, n_groups = C.grouped(docs)
    texts = texts.withColumn("held_out", held_out)
    by_g = texts.groupBy("g")

    def send(table: pa.Table) -> pa.Table:
        train_ = ~np.array(table.column("held_out").to_pylist(), bool)
        return send_counts(Words(table.column("text")), train_, subwords_of(vocabulary, pattern), table.column("g")[0].as_py(), n_groups)

    sent = by_g.applyInArrow(lambda t: C.released(send)(t), X.PARCEL_TYPE)
    found = C.materialize(sent.groupBy("b").applyInArrow(lambda t: sum_counts(t, n_groups), ANSWER_TYPE))
    training = texts.where(~F.col("held_out"))
    n_train, total = training.agg(F.count("*"), F.sum(F.octet_length("text").cast("long") + 16)).first()
    n, v = found.agg(F.sum("n"), F.sum("v")).first()
    n, v = (n or 0) + n_train, (v or 0) + (n_train > 0)
    subwords = Subwords(vocabulary, pattern)
    counts = np.zeros(subwords.size)
    for r in found.where(F.col("g") == -1).select("codes").collect():
        ids, times = np.frombuffer(r["codes"], np.uint64).reshape(2, -1)
        counts[ids.astype(np.int64)] += times
    counts[subwords.end] = n_train
    with C.one_thread():
        subwords.grouping = classes(*neighbours(found, counts), counts, subwords.leads, np.random.default_rng(0))
    drawn = sample(training, n_train)
    with C.one_thread():
        model = train(drawn, counts, subwords)
    learn_all(*learners(training, total or 0), model, vocabulary, pattern)
    known = docs.sparkSession.sparkContext.broadcast((model.p, model.group, model.leaf, model.share, counts))
    floor = float(np.log10(n + 0.1 * (v + 1)))
    end_base = float(np.log10(n_train + 0.1))
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, subs = Words(left.column("text")), subwords_of(vocabulary, pattern)
        codes = [unpack_counts(x) for x in right.sort_by("b").column("codes").to_pylist()]
        codes = np.concatenate(codes or [np.zeros(0, np.uint64)])  # of words, then of pairs
        count = codes[: len(words.hash)].astype(float)
        m = len(words.size)
        base = np.bincount(words.doc, np.log10(count + 0.1)[words.word], m) + end_base - floor * (words.size + 1)
        seen = np.bincount(words.doc, (count > 0)[words.word], m) + (n_train > 0)
        ids, at = subs.ids(words.text)
        laid = []
        for i, j, part in slices(words):
            flat, size = laid_out(part, words.size[i:j], ids, at, subs.end)
            pair, _, inverse = distinct(pairs_of(flat, size, subs))
            laid.append((i, j, flat, size, pair, inverse.astype(np.int32)))
        # The pairs that the group sent, in the order of their keys.
        key = np.sort(spread(np.unique(np.concatenate([x[4] for x in laid]))))
        pair_count = codes[len(words.hash) :]
        *parts, total = known.value
        model, own = Model(*parts), np.empty(m)
        for i, j, flat, size, pair, inverse in laid:
            n = pair_count[np.searchsorted(key, spread(pair))]
            got = blend(model.log10(flat, size, subs.end), n[inverse], total[pair // subs.size][inverse])
            own[i:j] = np.bincount(np.repeat(np.arange(j - i), size), got, j - i)
        return pa.Table.from_arrays([left.column("doc_id").combine_chunks(), left.column("held_out").combine_chunks(), pa.array(words.size + 1, pa.int64()), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(own)], schema=kind)

    # Groups with no word have no answers; a cogroup still brings them.
    out = by_g.cogroup(found.where("g >= 0").select("g", "b", "codes").groupBy("g")).applyInArrow(lambda a, b: C.released(run)(a, b), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def blend(log10: np.ndarray, pair: np.ndarray, previous: np.ndarray) -> np.ndarray:
    """log10 probabilities from the attention model's and the counts of pairs and of their first ids."""
    p = 10.0 ** log10.astype(float)
    return np.log10(MIX * p + (1 - MIX) * (pair + PRIOR * p) / (previous + PRIOR))


def sample(docs: DataFrame, n: int, rows: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[str]:
    """Up to about ``rows`` texts to start at, drawn by a hash; of a longer text a part placed by a hash."""
    steps = 1 << 30
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps))
    start = (F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.length("text") - chars, F.lit(1))) + 1).cast("int")
    got = docs.where(draw < F.lit(min(steps, -(-rows * steps // max(n, 1))))).select(draw.alias("draw"), F.substring("text", start, F.lit(chars)).alias("t")).orderBy("draw", "t").limit(2 * rows).collect()
    return [t for _, t in sorted(tuple(r) for r in got)]
