"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of the character n-grams (in UTF-8 bytes, with word marks) and whole words of its
words; their vectors are averaged, rare ones with more weight, and a linear softmax gives the class. Vectors and softmax are
trained together on a bounded sample of labelled rows. Unseen misspellings share n-gram vectors with
the words they come from. To score, each bucket's vector folds into one number, its logit.

Defined cases: null and empty texts, or texts without a word, get the score of the bias alone; null
labels are not learnt from; with no labelled rows, or one class only, every score is the prior. Equal labels
of an id count once, an id with both labels is learnt with both; a labelled id with several documents
brings each. Texts of any length are scored whole; an empty table gives no rows; extra columns are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS, DIM, SIZES = 1 << 18, 8, (3, 4, 5)
#: Bounds of the fit: labelled rows of each class, and code points of each text (a window placed by a hash).
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 10000
EPOCHS, BATCH, RATE = 20, 128, 0.3
#: n-grams of no leaning that each text has besides its own: a few n-grams are little evidence.
SMOOTH = 40
#: Share of training texts at which an n-gram's weight in the average is a half; rarer ones weigh more.
RARE = 0.1

IS_SEP = np.ones(256, bool)
IS_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all n-grams and the whole of each word."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size + 2)])
    body = np.full(at[-1], 1, np.uint8)
    inner = np.arange(at[-1]) - np.repeat(at[:-1], size + 2)
    inside = (inner > 0) & (inner <= np.repeat(size, size + 2))
    body[inside] = data[np.repeat(start, size) + inner[inside] - 1]
    body[at[1:] - 1] = 2
    owner = np.repeat(np.arange(len(size)), size + 2)
    prefix = C.prefix_hash(body)
    words, grams = [np.arange(len(size))], [C.range_hash(prefix, at[:-1], at[1:])]
    left = np.repeat(at[1:], size + 2) - np.arange(at[-1])
    for n in SIZES:
        i = np.flatnonzero((left >= n) & (np.repeat(size, size + 2) + 2 != n))
        words.append(owner[i])
        grams.append(C.range_hash(prefix, i, i + n))
    return np.concatenate(words), (np.concatenate(grams) % np.uint64(BUCKETS)).astype(np.int64)


def bag(data: np.ndarray, offsets: np.ndarray):
    """Distinct words of a piece: their spans, and for every word of the piece its document and distinct word."""
    data = C.LOWER[data]
    start, end, first = C.word_spans(data, offsets, IS_SEP)
    key, one, inverse = np.unique(C.hash_ranges(data, start, end), return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return data, start[one], end[one], doc, inverse


@dataclass
class Model:
    logit: np.ndarray  # of each bucket, as if alone in its text
    bias: float
    rarity: np.ndarray  # weight of each bucket in an average

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        data, start, end, doc, inverse = bag(data, offsets)
        if len(start):
            word, gram = word_grams(data, start, end)
            s = np.bincount(word, (self.logit * self.rarity)[gram], len(start))
            c = np.bincount(word, self.rarity[gram], len(start))
            total = np.bincount(doc, s[inverse], n)
            count = np.bincount(doc, c[inverse], n)
        z = self.bias + total / (count + SMOOTH)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    """Joint stochastic gradient descent (Adagrad) on vectors and softmax."""
    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))), np.ones(BUCKETS))
    rng = np.random.default_rng(seed)
    rows, cols, weights = [], [], []
    data, offsets = C.text_buffer(pa.array(texts, pa.large_string()))
    for i, j in C.pieces(offsets, 1 << 20):
        piece, start, end, doc, inverse = bag(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if not len(start):
            continue
        word, gram = word_grams(piece, start, end)
        order = np.argsort(word, kind="stable")
        at = np.searchsorted(word[order], np.arange(len(start) + 1))
        size = np.diff(at)[inverse]
        take = np.repeat(at[inverse] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        key, times = np.unique(np.repeat(doc, size) * BUCKETS + gram[order][take], return_counts=True)
        rows.append((key // BUCKETS + i).astype(np.int32))
        cols.append((key % BUCKETS).astype(np.int32))
        weights.append(times.astype(np.float32))
    row, col, weight = np.concatenate(rows), np.concatenate(cols), np.concatenate(weights)
    rarity = RARE / (RARE + np.bincount(col, minlength=BUCKETS) / len(y))
    weight *= rarity.astype(np.float32)[col]
    weight /= (np.bincount(row, weight, len(y)) + SMOOTH).astype(np.float32)[row]
    at = np.searchsorted(row, np.arange(len(y) + 1))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    g_vec, g_out, g_bias = np.full((BUCKETS, DIM), 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    share = len(y) / (2 * np.bincount(y, minlength=2))
    for _ in range(EPOCHS):
        perm = rng.permutation(len(y))
        for b in range(0, len(y), BATCH):
            ids = perm[b : b + BATCH]
            idx = np.concatenate([np.arange(at[i], at[i + 1]) for i in ids])
            own = np.repeat(np.arange(len(ids)), at[ids + 1] - at[ids])
            c, w = col[idx], weight[idx]
            hidden = np.stack([np.bincount(own, vectors[c, k] * w, len(ids)) for k in range(DIM)], 1).astype(np.float32)
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = p
            err[np.arange(len(ids)), y[ids]] -= 1
            err *= share[y[ids], None] / len(ids)
            d_hidden = err @ out.T
            d_out, d_bias = hidden.T @ err, err.sum(0)
            g_out += d_out**2
            g_bias += d_bias**2
            used, spot = np.unique(c, return_inverse=True)
            d = np.stack([np.bincount(spot, d_hidden[own, k] * w, len(used)) for k in range(DIM)], 1)
            g_vec[used] += d**2
            vectors[used] -= RATE * d / np.sqrt(g_vec[used])
            out -= RATE * d_out / np.sqrt(g_out)
            bias -= RATE * d_bias / np.sqrt(g_bias)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]), rarity)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """From docs (doc_id, text) and labels (doc_id, toxic): up to ``rows`` labels of each class, drawn by a hash of the id.

    The draw is made on the labels alone; only its rows, bounded by ``rows``, go to the documents, which do not move.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    steps = 1 << 30
    below = F.lit(0)
    for label, n in counts.items():
        below = F.when(F.col("toxic") == label, F.lit(min(steps, -(-3 * rows * steps // (2 * n))))).otherwise(below)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(steps))
    picked = known.select("doc_id", draw.alias("draw"), F.col("toxic").alias("y"), below.alias("below")).where("draw < below").orderBy("draw", "doc_id").limit(4 * rows)
    start = (F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.length("text") - chars, F.lit(1))) + 1).cast("int")
    found = docs.where(F.col("text").isNotNull()).join(F.broadcast(picked.select("doc_id", "draw", "y")), "doc_id")
    got = sorted((r["draw"], r["t"], r["y"]) for r in found.select("draw", "y", F.substring("text", start, F.lit(chars)).alias("t")).orderBy("draw", "y", "t").limit(4 * rows).collect())
    kept = [x for label in sorted(counts) for x in [g for g in got if g[2] == label][:rows]]
    return train([x[1] for x in kept], [x[2] for x in kept])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every column of docs and ``score`` (which replaces one so named). The model's size is fixed (twice BUCKETS numbers)."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast((model.logit.astype(np.float32), model.bias, model.rarity.astype(np.float32)))
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(sent.value[0].astype(np.float64), sent.value[1], sent.value[2].astype(np.float64))
        for batch in batches:
            table = pa.table(batch)
            data, offsets = C.text_buffer(table.column(text))
            got = [known.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in C.pieces(offsets)]
            table = table.append_column("score", pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64()))
            yield from table.to_batches()

    return docs.mapInArrow(run, schema)
