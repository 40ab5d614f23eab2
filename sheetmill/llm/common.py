"""Helpers shared by the corpus operators: the shared folder, batches of texts, token hashes."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder; on a cluster
    a missing setting is an error, as a machine-local folder would lose files.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def checkpointed(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """``df`` written to the shared folder and read from there from now on.

    While it is computed, Python workers get at most ``rows`` rows at once: a row may hold a whole text,
    and both sides keep a batch in memory.
    """
    conf = df.sparkSession.conf
    shared_dir(df.sparkSession)
    before = conf.get(BATCH)
    conf.set(BATCH, str(min(int(before), rows)) if int(before) > 0 else str(rows))
    try:
        return df.checkpoint()
    finally:
        conf.set(BATCH, before)


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; null for a null id."""
    return F.crc32(id_col.cast("string")) % k


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text column, a null being the empty text."""
    return F.coalesce(df[col], F.lit(""))


def text_key(col: Column) -> Column:
    """16 bytes that stand for a text: its MD5."""
    return F.unhex(F.md5(col))


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def sized_batches(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def give_back() -> None:
    """Returns free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run: Callable, *clear: Callable[[], None]) -> Callable:
    """``run`` for ``mapInArrow``; at the end of a task the worker gives back memory that it no longer needs.

    Workers are used again by later stages, and an idle one keeps what its last task has allocated. ``clear``
    empties caches.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for c in clear:
                c()
            give_back()

    return whole


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(31))) * U64(0x7FB5D329728EA185)
        h = (h ^ (h >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def token_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))


def word_shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for every run of ``k`` words; a text of fewer words is one run, an empty one none."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=U64)
        for i in range(k):
            out = out * GOLDEN + mix(hashes[i : i + n] + U64(i))
    return mix(out)
