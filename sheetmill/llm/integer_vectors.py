"""Vectors of whole numbers, for operators whose results must not depend on rounding.

Components are scaled and floored once, by column functions; all comparisons that decide a result are made
on these integers. Numbers of more than ``PLAIN`` in size, whose squared distances may not fit 64 bits, are
handled as Python integers; what is returned is then cut to the largest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN = 1 << 26
LONGEST = (1 << 63) - 1
AT_ONCE = 4_096


def finite(vector: Column) -> Column:
    """Whether a vector is there and no component is null, NaN or infinite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    return vector.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def floored(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; beyond the range of a long, the nearest long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` longs as rows; as Python integers where 64 bits may not do."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), width)
    return flat if not flat.size or (flat.min() >= -PLAIN and flat.max() <= PLAIN) else flat.astype(object)


def whole(values) -> np.ndarray:
    """A matrix of Python integers, as 64-bit integers where these do."""
    out = np.array(values, dtype=object)
    return out.astype(np.int64) if not out.size or max(abs(out.min()), abs(out.max())) <= PLAIN else out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``a`` from the rows of ``b`` with the same place."""
    if object in (a.dtype, b.dtype):
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(axis=-1)


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.minimum(values, LONGEST).astype(np.int64), pa.int64())


def slices(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


class Sums:
    """Counts and componentwise sums of rows by slot; one partition adds up before it sends anything."""

    def __init__(self, slots: int, width: int):
        self.n, self.total = np.zeros(slots, dtype=np.int64), np.zeros((slots, width), dtype=np.int64)

    def add(self, slot: np.ndarray, rows: np.ndarray) -> None:
        if rows.dtype == object or self.total.dtype == object:
            self.total = self.total.astype(object)
            np.add.at(self.total, slot, rows.astype(object))
        else:
            order = np.argsort(slot, kind="stable")
            used, first = np.unique(slot[order], return_index=True)
            self.total[used] += np.add.reduceat(rows[order], first, axis=0)
            # Each addend is at most PLAIN, so only a partition of 2^37 rows could overflow.
        self.n += np.bincount(slot, minlength=len(self.n))

    def batch(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.n)
        decimals = pa.decimal128(38, 0)
        sums = [pa.array([int(x) for x in self.total[used, i]], decimals) for i in range(self.total.shape[1])]
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(self.n[used]), *sums], names=["slot", "n", *(f"s{i}" for i in range(len(sums)))])


def sums_schema(width: int) -> str:
    return "slot int, n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(width))


def moved(old: np.ndarray, parts: DataFrame) -> np.ndarray:
    """``old`` with every slot that has rows replaced by the floor of their mean.

    What comes back to the driver is one row for each slot, however many vectors there are.
    """
    width = old.shape[1]
    rows = parts.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").cast("decimal(38,0)").alias(f"s{i}") for i in range(width))).collect()
    new = old.astype(object)
    for r in rows:
        new[r["slot"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return whole(new)
