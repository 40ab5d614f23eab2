"""Product codes of vectors on whole numbers, with a GNAT over the entries of every codebook.

A vector is cut into equal parts; each part gets the number of the nearest of up to 256 entries, which a few
rounds of means improve. The nearest entry is found in a geometric near-neighbour access tree: a node has
split points and, under each, the entries nearer to it than to the other splits; for every pair of split and
child it stores the least and greatest distance between the split and the child's entries. A query that lies
at distance d from a split and has a candidate at distance r passes by every child whose stored range does
not meet [d - r, d + r]. Ranges are widened and radii rounded up by far more than floating-point error, a
child is passed by only if it lies strictly outside, and entries that are met are compared as integers with
ties to the lower number; so the codes are those of plain comparison. Queries go through the tree in
batches: a child is entered by all queries that may not pass it by.

Each round is one pass over the stored vectors; a partition adds up counts and sums by entry. The driver
holds the codebooks only: parts x 256 entries at most.

Defined results: vectors that are null, hold a null, NaN or infinity, or whose size is not that of most
vectors (of equally many, the smallest) take no part and are not returned; if that size is no multiple of
the number of parts, the last parts are one component shorter or longer than the first as evenly as can
be; null ids come after all others as first entries; repeated ids are vectors each; with fewer vectors than
entries there are fewer entries; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmill.llm.common import checkpointed
from sheetmill.llm.integer_vectors import LONGEST, Sums, finite, floored, longs, matrix, moved, slices, squared, sums_schema, whole

DEGREE, LEAF, SLACK, SALTS = 12, 24, 1e-9, 16


class Gnat:
    """A tree over the rows of ``points``; ``nearest`` answers batches."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.counted = 0
        self.root = self._node(np.arange(len(points)))

    def _far(self, at: np.ndarray, one: int) -> np.ndarray:
        return np.sqrt(squared(self.points[at], self.points[one][None, :]).astype(np.float64))

    def _node(self, at: np.ndarray):
        if len(at) <= LEAF:
            return at
        # Split points far from each other: each is the point furthest from those before it.
        splits, near = [int(at[0])], self._far(at, int(at[0]))
        while len(splits) < DEGREE and near.max() > 0:
            splits.append(int(at[near.argmax()]))
            near = np.minimum(near, self._far(at, splits[-1]))
        if len(splits) == 1:
            return at  # all entries are equal
        far = np.stack([self._far(at, s) for s in splits])
        owner = far.argmin(axis=0)
        members = [np.flatnonzero(owner == j) for j in range(len(splits))]
        low = np.array([[far[i][m].min() for m in members] for i in range(len(splits))]) * (1 - SLACK)
        high = np.array([[far[i][m].max() for m in members] for i in range(len(splits))]) * (1 + SLACK)
        return np.array(splits), low, high, [self._node(at[m]) for m in members]

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest point of each query; of equally near ones the lowest."""
        best = np.zeros(len(queries), dtype=np.int64)
        d2 = squared(queries, self.points[:1])
        self._visit(self.root, np.arange(len(queries)), queries, best, d2)
        return best, d2

    def _compare(self, entry: int, at: np.ndarray, queries: np.ndarray, best: np.ndarray, d2: np.ndarray) -> np.ndarray:
        d = squared(queries[at], self.points[entry][None, :])
        self.counted += len(at)
        closer = (d < d2[at]) | ((d == d2[at]) & (entry < best[at]))
        best[at[closer]], d2[at[closer]] = entry, d[closer]
        return d

    def _visit(self, node, at: np.ndarray, queries: np.ndarray, best: np.ndarray, d2: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, np.ndarray):
            for entry in node:
                self._compare(int(entry), at, queries, best, d2)
            return
        splits, low, high, children = node
        far = np.stack([np.sqrt(self._compare(int(s), at, queries, best, d2).astype(np.float64)) for s in splits], axis=1)
        # The child of the nearest split first: its entries shrink the radius for the others.
        first = far.argmin(axis=1)
        for j, child in enumerate(children):
            self._visit(child, at[first == j], queries, best, d2)
        for j, child in enumerate(children):
            radius = np.sqrt(d2[at].astype(np.float64)) * (1 + SLACK) + SLACK * far.max(axis=1)
            outside = (far - radius[:, None] > high[None, :, j]) | (far + radius[:, None] < low[None, :, j])
            self._visit(child, at[(first != j) & ~outside.any(axis=1)], queries, best, d2)


def cuts(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return [dim * p // parts for p in range(parts + 1)]


def kept_vectors(vectors: DataFrame, scale: int, vec_id: str, vector: str, label: str | None) -> tuple[DataFrame, int]:
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[vector].alias("raw"), (vectors[label] if label else F.lit(None).cast("int")).alias("label")).where(finite(vectors[vector]))
    size = rows.groupBy(F.size("raw").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = size["dim"] if size else 0
    return rows.where(F.size("raw") == dim).select("vec_id", floored(F.col("raw"), scale).alias("v"), "label"), dim


def coded(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code, error`` of every kept vector, and the final codebooks."""
    kept, dim = kept_vectors(vectors, scale, vec_id, vector, label)
    types = dict(kept.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    stored = checkpointed(kept, 10_000)
    first = stored.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return stored.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    at = cuts(dim, parts)
    books = [whole([r["v"][at[p] : at[p + 1]] for r in first]) for p in range(parts)]
    n, width = len(first), max(at[p + 1] - at[p] for p in range(parts))
    for _ in range(rounds):
        # Parts of all positions are slots of one table; shorter parts are filled up with zeros.
        padded = whole(np.concatenate([np.pad(b.astype(object), ((0, 0), (0, width - b.shape[1]))) for b in books]) if width else np.zeros((n * parts, 0), dtype=object))
        after = moved(padded, sums(stored, books, at, width))
        books = [whole(after[p * n : (p + 1) * n, : at[p + 1] - at[p]]) for p in range(parts)]
    final = books

    def run(batches):
        trees = [Gnat(b) for b in final]
        for batch in slices(batches):
            v = matrix(batch.column("v"), dim)
            found = [t.nearest(v[:, at[p] : at[p + 1]]) for p, t in enumerate(trees)]
            code = [bytes(int(f[0][i]) for f in found).hex() for i in range(len(v))]
            error = sum(f[1] if abs(f[1]).max() < LONGEST // (parts + 1) else f[1].astype(object) for f in found)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), longs(error)], names=["vec_id", "label", "code", "error"])

    return stored.mapInArrow(run, schema), final


def sums(stored: DataFrame, books: list[np.ndarray], at: list[int], width: int) -> DataFrame:
    """Counts and sums by part and entry, one row for each partition and entry that it uses."""
    n, dim = len(books[0]), at[-1]

    def run(batches):
        trees, added = [Gnat(b) for b in books], Sums(n * len(books), width)
        for batch in slices(batches):
            v = matrix(batch.column("v"), dim)
            for p, tree in enumerate(trees):
                part = v[:, at[p] : at[p + 1]]
                added.add(tree.nearest(part)[0] + p * n, np.pad(part, ((0, 0), (0, width - part.shape[1]))))
        yield added.batch()

    return stored.select("v").mapInArrow(run, sums_schema(width))


def with_sums(rows: DataFrame, by: str, value: str, into: str, salts: int = SALTS) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal ``by``, nulls together; a hot ``by`` is dealt to ``salts`` tasks."""
    key: Column = F.struct(by)
    totals = rows.groupBy(key.alias("_key")).agg(F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias(into))
    spread = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumns({"_key": key, "_salt": F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")})
    return salted.join(spread, ["_key", "_salt"]).drop("_key", "_salt")


def report(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``."""
    found, books = coded(vectors, entries, parts, rounds, scale)
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    found = checkpointed(found, 10_000)
    return with_sums(found, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def twin(entries: int = 256, parts: int = 4, rounds: int = 4, scale: int = 1024, dim: int = 64, table: str = "embeddings") -> str:
    """The same report in DuckDB SQL: every part with every entry, round by round; vectors of ``dim`` components."""
    width = dim // parts
    ctes = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS n, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM {table}
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0))""",
        f"pieces AS MATERIALIZED (SELECT n, p, v[p * {width} + 1:(p + 1) * {width}] AS x FROM kept, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, n AS e, x AS c FROM pieces WHERE n < {entries})",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"""a{i} AS MATERIALIZED (
  SELECT n, p, min(struct_pack(d := d, e := e)) AS best
  FROM (SELECT n, p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM pieces JOIN b{i} USING (p)) GROUP BY n, p)"""
        )
        if i < rounds:
            ctes.append(
                f"""m{i} AS MATERIALIZED (
  SELECT p, e, list(CAST(CASE WHEN s >= 0 THEN s // k ELSE -((k - 1 - s) // k) END AS BIGINT) ORDER BY pos) AS c FROM (
    SELECT p, best.e AS e, pos, CAST(sum(y) AS HUGEINT) AS s, count(*) AS k
    FROM (SELECT p, best, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM pieces JOIN a{i} USING (n, p)) GROUP BY ALL) GROUP BY p, e)"""
            )
            ctes.append(f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (p, e))")
    return (
        "WITH "
        + ",\n".join(ctes)
        + f""",
done AS (SELECT n, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY n),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN done USING (n), h"""
    )
