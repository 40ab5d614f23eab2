"""Nearest neighbours by largest inner product, over randomly rotated one-bit codes.

Every vector is scaled to length one, rotated by a fixed random rotation and kept as the signs of
its components (packed bits) with two scalars: its length and its inner product with its own code.
From the bits alone the inner product with a query is estimated without bias; its error is bounded,
with a probability that ``EPSILON`` sets, by a term that the second scalar gives. The best guesses
are compared exactly first; of the rest only candidates whose upper bound reaches the k-th best of
these are.

Queries and candidates meet in blocks: candidates are spread evenly over parts, and each part takes
the blocks of queries one at a time, so that a task holds one part and one block. Each pair of part
and block passes on at most k rows for each query; a window picks the k nearest.

Exact products add component by component in double precision, so that equal vectors have equal
scores and ties go to the smaller id.

Defined results: vectors that are null, all zero, or hold a null, NaN or infinity take no part, as
queries or candidates, and so do null ids and vectors whose size is not that of most vectors; a
query has fewer than k rows if there are fewer other vectors; repeated ids are candidates each,
but a query's own id is none of its neighbours; further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART, BLOCK, AT_ONCE, EPSILON, SEED = 8_192, 8_192, 128, 3.0, 20_240
_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    if dim not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
        _rotations[dim] = q * np.sign(np.diag(r))
    return _rotations[dim]


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors, their lengths, and their inner product with their codes."""
    dim = vectors.shape[1]
    length = np.sqrt((vectors * vectors).sum(axis=1))
    turned = (vectors / length[:, None]) @ rotation(dim).T
    bits = turned > 0
    aligned = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    return np.packbits(bits, axis=1), length, aligned


def estimates(packed: np.ndarray, length: np.ndarray, aligned: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries by candidates) and the bounds of their errors."""
    dim = queries.shape[1]
    signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (queries @ rotation(dim).T).astype(np.float32)
    scale = (length / aligned / np.sqrt(dim)).astype(np.float32)
    spread = length * np.sqrt(np.maximum(1 - aligned**2, 0) / np.maximum(aligned**2, 1e-12)) / np.sqrt(max(dim - 1, 1))
    norms = np.sqrt((queries * queries).sum(axis=1))
    return (turned @ signs.T) * scale, (EPSILON * norms)[:, None].astype(np.float32) * spread[None, :].astype(np.float32)


def exact(a: np.ndarray, b: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``a`` with rows of ``b``, adding component after component."""
    out = np.zeros(len(rows))
    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for i in range(len(x)):
        out += x[i][rows] * y[i][others]
    return out


def nearest_in(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """Of each query the k nearest among the candidates whose bounds admit them."""
    coded = codes(vectors)
    parts = [_nearest(ids, vectors, coded, query_ids[i : i + AT_ONCE], queries[i : i + AT_ONCE], k) for i in range(0, len(queries), AT_ONCE)]
    return pd.concat(parts, ignore_index=True)


def _nearest(ids: np.ndarray, vectors: np.ndarray, coded: tuple, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    guess, error = estimates(*coded, queries)
    own = query_ids[:, None] == ids[None, :]
    guess[own] = -np.inf
    n, some = len(ids), 3 * k
    if n > some:
        # The k-th best exact score among the best guesses is a floor for all k: below it nothing needs reranking.
        first = np.argpartition(guess, n - some, axis=1)[:, n - some :]
        rows = np.repeat(np.arange(len(queries)), some)
        best = exact(queries, vectors, rows, first.ravel()).reshape(len(queries), some)
        best[own[rows.reshape(best.shape), first]] = -np.inf
        floor = np.partition(best, some - k, axis=1)[:, some - k]
        pick = (guess + error >= floor[:, None] - 1e-4 * np.abs(floor[:, None])) & ~own
        pick[rows, first.ravel()] = True
        pick &= ~own
    else:
        pick = ~own
    q, c = np.nonzero(pick)
    score = exact(queries, vectors, q, c)
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    start = np.searchsorted(q, np.arange(len(query_ids)))
    keep = np.arange(len(q)) - start[q] < k
    return pd.DataFrame({"query_id": query_ids[q[keep]], "vec_id": ids[c[keep]], "score": score[keep]})


def usable(vector: Column) -> Column:
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", part: int = PART, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of each row for which ``is_query`` holds."""
    rows = vectors.where(usable(vectors[vector]) & vectors[vec_id].isNotNull())
    rows = rows.select(rows[vec_id].cast("long").alias("vec_id"), F.transform(rows[vector], lambda x: x.cast("double")).alias("v"), is_query.alias("is_query"))
    size = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("int")).alias("q")).orderBy(F.desc("n"), "dim").first()
    if size is None:
        size = {"dim": 1, "n": 0, "q": 0}
    rows = rows.where(F.size("v") == size["dim"])
    parts, blocks = -(-size["n"] // part) or 1, -(-(size["q"] or 0) // block) or 1
    # The place of a row follows from its id, so a row that is read again lands in the same part and block.
    at = F.xxhash64("vec_id", "v")
    candidate = rows.select(F.pmod(at, F.lit(parts)).alias("part"), "vec_id", "v").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(False))
    query = rows.where("is_query").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "v", F.pmod(F.xxhash64("v", "vec_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("asks", F.lit(True))

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return nearest_in(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()), right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()), k)

    near = candidate.withColumn("part", F.col("part").cast("long")).groupBy("part", "block").cogroup(query.withColumn("part", F.col("part").cast("long")).groupBy("part", "block")).applyInPandas(met, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
