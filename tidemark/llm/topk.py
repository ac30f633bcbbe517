"""Exact top-k inner products by block-at-a-time pruning.

Vectors of integers are terms (dimension, weight). Rows are dealt, by id, into shards of bounded size;
in a shard, document-range blocks of consecutive ids keep each dimension's largest and smallest weight
and a forward index (the block's own vectors). A query sums the terms' maxima into a bound for each
block, takes blocks in falling order of bounds, scores them through the forward index, and stops when
the next bound cannot enter its k best. Queries come in chunks, each shard meets each chunk once, and
the shards' k best are merged. Every row stands against every query; nothing is sampled.

Defined cases: vectors null, empty, or holding null or non-finite components take no part; neither do
rows without an id; vectors of another length than the query's are no candidates for it; equal
scores go to the smaller id; of rows that repeat an id all are candidates, for other ids' queries, and the
smallest vector is the query. Extra columns are harmless, an empty table gives no rows; scores beyond 64
bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, CHUNK_ROWS, BLOCK_ROWS = 16384, 1024, 64
EXACT = 1 << 53


def integer_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, xs: floor(scale * x) of each finite vector."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite)
    xs = F.transform(x, lambda v: F.floor(v * float(scale)).cast("long"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), xs.alias("xs"))


class Shard:
    """Blocks over rows in ascending order of id."""

    def __init__(self, ids: np.ndarray, xs: np.ndarray):
        self.ids, self.xs = ids, xs
        at = np.arange(0, len(ids), BLOCK_ROWS)
        self.top, self.low = np.maximum.reduceat(xs, at), np.minimum.reduceat(xs, at)
        self.at, self.first = np.append(at, len(ids)), ids[at]

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        bound = np.maximum(q, 0) @ self.top.T + np.minimum(q, 0) @ self.low.T
        order = np.lexsort((self.first, -bound))
        ids, scores, at, width = np.zeros(0, np.int64), np.zeros(0, self.xs.dtype), 0, 2
        while at < len(order):
            blocks = order[at : at + width]
            if len(ids) == k:  # an equal bound may still bring a smaller id
                blocks = blocks[(bound[blocks] > scores[-1]) | ((bound[blocks] == scores[-1]) & (self.first[blocks] < ids[-1]))]
                if bound[order[at]] < scores[-1]:
                    break
            if len(blocks):
                rows = np.concatenate([np.arange(self.at[b], self.at[b + 1]) for b in blocks])
                rows = rows[self.ids[rows] != query_id]
                ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, self.xs[rows] @ q])
                if len(ids) > 4 * k:
                    cut = -np.partition(-scores, k - 1)[k - 1]
                    ids, scores = ids[scores >= cut], scores[scores >= cut]
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            at, width = at + width, min(2 * width, 256)
        return ids, scores


def _arrays(xs: list, dim: int, exact: bool) -> np.ndarray:
    out = np.array(xs, np.int64).reshape(len(xs), dim)
    return out.astype(np.float64) if exact else out.astype(object)


def search_shard(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    found = []
    for dim, part in queries.groupby(queries["xs"].map(len)):
        own = rows[rows["xs"].map(len) == dim].sort_values("vec_id", kind="stable")
        if not len(own):
            continue
        # Products are exact in doubles below 2**53; larger ones are computed with whole numbers.
        peak = max(int(np.abs(np.array(list(own["xs"]), np.float64)).max()), 1) * max(int(np.abs(np.array(list(part["xs"]), np.float64)).max()), 1)
        exact = peak * dim * 2 < EXACT
        shard = Shard(own.vec_id.to_numpy(np.int64), _arrays(list(own["xs"]), dim, exact))
        for query_id, q in zip(part.query_id, _arrays(list(part["xs"]), dim, exact), strict=True):
            ids, scores = shard.search(int(query_id), q, k)
            found += [(int(query_id), int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")


def search(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of integer_rows() for each of its rows under is_query."""
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards, chunks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // CHUNK_ROWS))
    deal = lambda seed, m: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    meet = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # Consecutive ids share a shard's blocks; runs of ids are dealt to shards by a hash of the run.
    run = F.floor(F.col("vec_id") / F.lit(BLOCK_ROWS))
    left = rows.withColumn("shard", F.pmod(F.xxhash64(run), F.lit(shards)).cast("int")).withColumn("chunk", meet(chunks))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("xs").alias("xs"))
    right = asked.select(F.col("vec_id").alias("query_id"), "xs", deal(7, chunks).alias("chunk")).withColumn("shard", meet(shards))
    found = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInPandas(
        lambda a, b: search_shard(a, b, k), "query_id long, vec_id long, score long"
    )
    # A rank with a bound is cut to it before the shuffle too, so no task gathers all shards' rows of a query.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
