"""Dense search with a partitioned index: cells around centroids, probed as far as bounds demand.

Centroids are fitted to a bounded sample of the vectors; every vector belongs to the cell of its nearest
centroid, and a cell knows its size and its radius (the greatest angle of a member). For unit vectors an angle
is a distance, so no member of a cell of radius r can be nearer to a query than its angle to the centroid less
r. A query first probes its nearest cells until these hold k vectors; its k-th best score there is a floor, and
of the other cells only those whose bound reaches the floor are probed. The result is that of plain search:
the index saves work and loses nothing.

A cell is dealt over tasks in parts of ``PART`` vectors, and queries in blocks of ``BLOCK``, so a group is
bounded however many vectors are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, MOST_CELLS, PART, BLOCK, ROUNDS, SEED = 20_000, 1_024, 8_192, 4_096, 8, 11
#: Room for the rounding of angles and of scores that are compared to nine digits.
SLACK = 2e-9


class Cells(NamedTuple):
    centroids: np.ndarray  # unit vectors
    radius: np.ndarray
    size: np.ndarray


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; those of length zero stay."""
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, length, out=v.astype(np.float64).copy(), where=length > 0)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def fitted(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` centroids of a sample of unit vectors."""
    different = np.unique(sample, axis=0)
    centroids = different[np.random.default_rng(SEED).permutation(len(different))[:n]]
    for _ in range(ROUNDS):
        own = (sample @ centroids.T).argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        used = np.bincount(own, minlength=len(centroids)) > 0
        centroids[used] = unit(total[used])
    return centroids


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def cell_index(vectors: DataFrame, n_cells: int | None = None, sample: int = SAMPLE) -> tuple[DataFrame, Cells]:
    """``doc_id, v, cell, part`` of every row of ``vectors(doc_id, v)``, ``v`` of length one, and the cells.

    By default the number of cells is the root of that of the rows. The sample is the rows with the least
    hashes of their ids, ``sample`` at most.
    """
    rows = vectors.select("doc_id", F.transform("v", lambda x: x.cast("double")).alias("v")).where("v is not null and size(v) > 0")
    n = rows.count()
    n_cells = n_cells or max(1, min(MOST_CELLS, int(n**0.5)))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, 2.0 * sample / max(n, 1)) * (1 << 20)))
    chosen = rows.where(share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("v").collect() if n else []
    centroids = fitted(unit(np.array([r["v"] for r in chosen], dtype=np.float64)), n_cells) if chosen else np.zeros((0, 1))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = unit(_vectors(b.column("v")))
                near = v @ centroids.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(v)), cell], -1.0, 1.0))
                yield pa.record_batch([b.column("doc_id"), pa.array(list(v), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["doc_id", "v", "cell", "angle"])

    placed = rows.mapInArrow(assigned, f"doc_id {dict(rows.dtypes)['doc_id']}, v array<double>, cell int, angle double") if len(centroids) else rows.select("doc_id", "v", F.lit(0).alias("cell"), F.lit(0.0).alias("angle"))
    radius, size = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # one row for each cell
        if len(centroids):
            radius[r["cell"]], size[r["cell"]] = r["radius"] + SLACK, r["n"]
    return placed, Cells(centroids, radius, size)


def _probes(queries: DataFrame, cells: Cells, k: int, vectors: bool = True) -> DataFrame:
    """``query_id, q, cell, bound, early`` for every query and cell with members; ``early`` ones are probed at once.

    Without ``vectors``, ``q`` is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.flatnonzero(cells.size)
        for b in batches:
            if not b.num_rows or not len(full):
                continue
            q = unit(_vectors(b.column("q")))
            angle = angles(q, cells.centroids[full])
            bound = np.cos(np.maximum(angle - cells.radius[full], 0.0))
            order = np.argsort(angle, axis=1, kind="stable")
            before = np.cumsum(cells.size[full][order], axis=1) - cells.size[full][order]
            early = np.zeros(bound.shape, bool)
            np.put_along_axis(early, order, before < k, axis=1)
            # A query of length zero has no angle; all of its scores are 0.
            bound[(q == 0).all(axis=1)] = 0.0
            at = pa.array(np.repeat(np.arange(len(q)), len(full)))
            yield pa.record_batch([b.column("query_id").take(at), pa.array(list(q if vectors else q[:, :0]), pa.list_(pa.float64())).take(at), pa.array(np.tile(full, len(q)).astype(np.int32)), pa.array(bound.ravel()), pa.array(early.ravel())], names=["query_id", "q", "cell", "bound", "early"])

    return queries.mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, q array<double>, cell int, bound double, early boolean")


def _scores(index: DataFrame, cells: Cells, probed: DataFrame, k: int, blocks: int) -> DataFrame:
    """``query_id, doc_id, score`` of the best k of every part of a cell that a query probes, not below its ``floor``."""
    parts = [max(1, -(-int(n) // PART)) for n in cells.size] or [1]
    n_parts = F.element_at(F.array(*map(F.lit, parts)), F.col("cell") + 1)
    rows = index.withColumn("part", F.pmod(F.xxhash64("doc_id"), n_parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("cell", "part", "block", "doc_id", "v")
    asked = probed.select("cell", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "q", "floor")
    kinds = {**dict(index.dtypes), **dict(probed.dtypes)}

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": right["query_id"][:0], "doc_id": left["doc_id"][:0], "score": pd.Series(dtype="float64")})
        score = np.clip(np.stack(right["q"].to_numpy()) @ np.stack(left["v"].to_numpy()).T, 0.0, 1.0)
        ids, floor = left["doc_id"].to_numpy(), right["floor"].to_numpy()[:, None]
        order = np.lexsort((np.broadcast_to(np.argsort(np.argsort(ids, kind="stable"), kind="stable"), score.shape), -np.round(score, 9)), axis=1)[:, :k]
        best = np.take_along_axis(score, order, axis=1)
        row, col = np.nonzero(best >= floor - SLACK)
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[row], "doc_id": ids[order[row, col]], "score": best[row, col]})

    keys = ["cell", "part", "block"]
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(met, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")


def nearest(queries: DataFrame, index: DataFrame, cells: Cells, k: int) -> DataFrame:
    """``query_id, doc_id, score, rank``: the k best of the index for ``queries(query_id, q)`` by cosine, clipped to 0..1."""
    from sheetmill.operators.retrieval import top_k

    asked = queries.select("query_id", F.transform("q", lambda x: x.cast("double")).alias("q")).where("q is not null and size(q) > 0")
    blocks = max(1, -(-asked.count() // BLOCK))
    every = _probes(asked, cells, k)
    first = _scores(index, cells, every.where("early").withColumn("floor", F.lit(-1.0)), k, blocks)
    best = top_k(first, k, "query_id", F.desc(F.round("score", 9)), F.col("doc_id"))
    floors = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).select("query_id", F.when(F.col("n") == k, F.col("floor")).otherwise(-1.0).alias("floor"))
    more = every.where("not early").join(floors, "query_id").where(F.greatest("bound", F.lit(0.0)) >= F.col("floor") - SLACK)
    rest = _scores(index, cells, more, k, blocks)
    return top_k(best.drop("rank").unionByName(rest), k, "query_id", F.desc(F.round("score", 9)), F.col("doc_id"))
