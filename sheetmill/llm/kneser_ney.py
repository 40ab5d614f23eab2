"""Language-model scores: an interpolated modified Kneser-Ney bigram model.

Counting is Spark's work. Each task sorts the bigrams of its texts and sends them, counted, in
blocks by bucket; a bucket is a range of a hash of the history and of a few bits of the next word,
so that the followers of a very frequent word spread over many buckets. The tasks that receive the
buckets add the counts up, write each bucket as a sorted array of hashes with its counts to the
shared folder, and pass on how often each word is a history, how many followers it has once, twice
and more often, and how many different words come before it. Spark sums these by word; they are
written as sorted hash arrays too. The driver sees one small row for each bucket of words.

Scoring maps these files into memory in the workers, which look up the bigrams of their own texts;
pages are shared by the workers of a machine. A file that is not on a mounted file system is copied
to the worker's temporary folder first and removed as soon as it is mapped.

A bigram is known by 64 bits of hash, at every size of the input. Order 2 is used because the counts
of order 3 do not fit four times the input's size on disk.

Words: lower-cased (A-Z only), split at the six ASCII blanks; then one end for each text.

Defined results: a null text is empty and has one token, its end; without any training text every
token has the same probability; a null id is neither held out nor trained on; repeated rows count
each; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmill.llm.common import GOLDEN, U64, fold, mix, shared_dir, sized_batches, strings, token_hashes

BEGIN, END = U64(0x5BD1E995AB1F03C7), U64(0x27D4EB2F165667C5)
LOW40 = U64((1 << 40) - 1)
FLUSH = 2_500_000  # bigrams that a task holds before it sends them on
HELD = 2_000_000  # different bigrams of merged buckets that a task holds before it tells their words' counts
AT_ONCE = 3 << 20  # bytes of text that a worker takes apart at once
BYTES_PER_BUCKET = 2_600_000  # of text; about 200,000 different bigrams
MOST_BUCKETS = 1 << 16


class Model(NamedTuple):
    """Where the arrays are and the few numbers that go with them."""

    folder: str
    gram_bits: int
    word_bits: int
    tokens: int  # N
    types: int  # V
    bigrams: int  # different bigrams
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_gamma: float


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def gram_hash(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h1 * GOLDEN + (h2 & LOW40))


def gram_bucket(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """Up to 1/64 of the buckets share the followers of one history."""
    spread = U64(max(1, (1 << bits) >> 6) - 1)
    with np.errstate(over="ignore"):
        return (mix(h1 + (h2 & spread) * GOLDEN) >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h1), np.int64)


def bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Histories and next words of all texts in a row; each text begins with BEGIN and ends with END."""
    lists = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    h = token_hashes([w for x in lists for w in x])
    ends = np.cumsum(sizes)
    return np.insert(h, ends - sizes, BEGIN), np.insert(h, ends, END)


def added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, each value summed by key; also the place of a row of each key."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return sorted_keys[first], order[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


def packed(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> bytes:
    """A block of bigrams in order of history: histories once with their runs, 40 bits of each next word, counts."""
    order = np.argsort(h1, kind="stable")
    h1, h2, n = h1[order], h2[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h1[1:] != h1[:-1]]))
    runs = np.diff(np.append(first, len(h1))).astype("<u4")
    parts = [np.array([len(h1), len(first)], "<i8"), h1[first], runs, (h2 & U64(0xFFFFFFFF)).astype("<u4"), ((h2 >> U64(32)) & U64(0xFF)).astype("u1"), n.astype("<u4")]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in parts))


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, u = (int(x) for x in np.frombuffer(raw, "<i8", 2))
    at = 16
    h1 = np.frombuffer(raw, "<u8", u, at)
    runs = np.frombuffer(raw, "<u4", u, at := at + 8 * u)
    low = np.frombuffer(raw, "<u4", n, at := at + 4 * u)
    high = np.frombuffer(raw, "u1", n, at := at + 4 * n)
    count = np.frombuffer(raw, "<u4", n, at + n)
    return np.repeat(h1, runs), low.astype(U64) | (high.astype(U64) << U64(32)), count.astype(np.int64)


# -- files in the shared folder ----------------------------------------------------------------
def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_arrays(uri: str, *arrays: np.ndarray) -> None:
    """Written under another name, then renamed: a task that runs again leaves one whole file."""
    fs, path = _fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as out:
        out.write(np.array([len(arrays[0])], "<i8").tobytes())
        for a in arrays:
            out.write(a.tobytes())
    fs.move(part, path)


def mapped(uri: str, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """The arrays of a file, mapped into memory; empty ones if there is no such file."""
    fs, path = _fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return tuple(np.zeros(0, k) for k in kinds)
    copy = None
    if not isinstance(fs, pafs.LocalFileSystem):
        handle, copy = tempfile.mkstemp()
        os.close(handle)
        pafs.copy_files(path, copy, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
    whole = np.memmap(copy or path, dtype=np.uint8, mode="r")
    if copy:
        os.unlink(copy)
    n, at, out = int(whole[:8].view("<i8")[0]), 8, []
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(whole[at : at + size].view(k))
        at += size
    return tuple(out)


# -- training ----------------------------------------------------------------------------------
def _blocks(bits: int):
    def send(h1: list[np.ndarray], h2: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b = np.concatenate(h1), np.concatenate(h2)
        h1.clear()
        h2.clear()
        _, at, n = added(gram_hash(a, b), np.ones(len(a), np.int64))
        a, b = a[at], b[at]
        bucket = gram_bucket(a, b, bits)
        order = np.argsort(bucket, kind="stable")
        a, b, n, bucket = a[order], b[order], n[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        rows = [packed(a[x:y], b[x:y], n[x:y]) for x, y in pairwise(cuts)]
        yield pa.record_batch([pa.array(bucket[cuts[:-1]], pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "block"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1, h2, held = [], [], 0
        for b in sized_batches(batches, most=AT_ONCE):
            x, y = bigrams(strings(b.column("text")))
            h1.append(x)
            h2.append(y)
            held += len(x)
            if held >= FLUSH:
                yield from send(h1, h2)
                held = 0
        if held:
            yield from send(h1, h2)

    return count


STATS = "kind int, key long, n long, n1 long, n2 long, n3 long"
HISTORY, NEXT, COUNTS = 0, 1, 2


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _stats(kind: int, keys: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
    zero = np.zeros(len(keys), np.int64)
    columns = [np.full(len(keys), kind, np.int32), _signed(keys), *sums, *[zero] * (4 - len(sums))]
    return pa.record_batch([pa.array(c) for c in columns], names=["kind", "key", "n", "n1", "n2", "n3"])


def _merge(folder: str):
    def finish(bucket: int, blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [unpacked(x) for x in blocks]
        h1, h2, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
        keys, at, n = added(gram_hash(h1, h2), n)
        write_arrays(f"{folder}/grams/{bucket}", keys, np.minimum(n, 2**32 - 1).astype("<u4"))
        return h1[at], h2[at], n

    def tell(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h1, h2, n = (np.concatenate([x[k] for x in held]) for k in range(3))
        held.clear()
        keys, _, total, n1, n2, n3 = added(h1, n, *((f(n)).astype(np.int64) for f in (lambda x: x == 1, lambda x: x == 2, lambda x: x >= 3)))
        yield _stats(HISTORY, keys, total, n1, n2, n3)
        keys, _, before = added(h2, np.ones(len(h2), np.int64))
        yield _stats(NEXT, keys, before)
        yield _stats(COUNTS, np.arange(1, 5, dtype=U64), np.array([(n == k).sum() for k in range(1, 5)], np.int64))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, held, size = -1, [], [], 0
        for b in batches:
            for k, block in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
                if k != bucket and blocks:
                    held.append(finish(bucket, blocks))
                    size, blocks = size + len(held[-1][0]), []
                    if size >= HELD:
                        yield from tell(held)
                        size = 0
                bucket = k
                blocks.append(block)
        if blocks:
            held.append(finish(bucket, blocks))
        if held:
            yield from tell(held)

    return merge


META = "n long, types long, grams long, c1 long, c2 long, c3 long, c4 long, more long, g1 long, g2 long, g3 long, g4 long"
UNI, CONT = ("<u8", "<i8", "<i8", "<i8", "<i8"), ("<u8", "<i8")


def _words(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of bucket, kind and key (as a signed number)."""
        waiting: list[list[np.ndarray]] = []
        bucket = -1

        def finish() -> pa.RecordBatch:
            kind, key, n, n1, n2, n3 = (np.concatenate([w[k] for w in waiting]) for k in range(6))
            key = key.view(U64)
            out = np.zeros(12, np.int64)
            h, x, c = kind == HISTORY, kind == NEXT, kind == COUNTS
            o = np.argsort(key[h], kind="stable")
            write_arrays(f"{folder}/words/{bucket}", *(a[h][o] for a in (key, n, n1, n2, n3)))
            o = np.argsort(key[x], kind="stable")
            write_arrays(f"{folder}/before/{bucket}", key[x][o], n[x][o])
            before = n[x]
            out[:3] = n[h].sum(), h.sum(), before.sum()
            out[3:8] = [(before == k).sum() for k in range(1, 5)] + [(before >= 3).sum()]
            for k, v in zip(key[c].tolist(), n[c].tolist(), strict=True):
                out[7 + k] = v
            return pa.record_batch([pa.array([v], pa.int64()) for v in out], names=[f.split()[0] for f in META.split(", ")])

        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(7)]
            cuts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1], [True]]))
            for x, y in pairwise(cuts):
                if cols[0][x] != bucket and waiting:
                    yield finish()
                    waiting = []
                bucket = int(cols[0][x])
                waiting.append([c[x:y].copy() for c in cols[1:]])
        if waiting:
            yield finish()

    return write


def _discounts(n: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from how many bigrams (words) have the counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k) for k, d in enumerate(raw, 1))  # type: ignore[return-value]


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts the texts of ``docs`` and leaves the model's arrays in the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(4, int(size / BYTES_PER_BUCKET).bit_length()), MOST_BUCKETS.bit_length() - 1)
    word_bits = max(2, bits - 3)
    base = shared_dir(spark)
    folder = f"{base.rstrip('/')}/kneser-ney-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.mapInArrow(_blocks(bits), "bucket long, block binary")
    stats = blocks.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge(folder), STATS)
    words = stats.groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in ("n", "n1", "n2", "n3")))
    # The same rule for both kinds, on the 40 bits that they share.
    words = words.withColumn("bucket", F.when(F.col("kind") == COUNTS, 0).otherwise(F.shiftrightunsigned(F.shiftleft("key", 24), 64 - word_bits)))
    words = words.select("bucket", "kind", "key", "n", "n1", "n2", "n3").repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "key")
    meta = np.array([list(r) for r in words.mapInArrow(_words(folder), META).collect()], dtype=np.int64).reshape(-1, 12).sum(axis=0)
    n, types, grams, c1, c2, c3, c4, more = (int(x) for x in meta[:8])
    d, dw = _discounts(tuple(int(x) for x in meta[8:])), _discounts((c1, c2, c3, c4))
    gamma = (dw[0] * c1 + dw[1] * c2 + dw[2] * more) / grams if grams else 1.0
    return Model(folder, bits, word_bits, n, types, grams, d, dw, gamma)


# -- scoring -----------------------------------------------------------------------------------
class Lookup:
    """A worker's view of a model's files; a file is mapped when it is first asked for."""

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, {}

    def find(self, kind: str, kinds: tuple[str, ...], bucket: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        """The values of each key, 0 if it is not there."""
        out = [np.zeros(len(keys), np.int64) for _ in kinds[1:]]
        order = np.lexsort((keys, bucket))
        sorted_bucket = bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], sorted_bucket[1:] != sorted_bucket[:-1], [True]])) if len(keys) else np.zeros(1, int)
        for x, y in pairwise(cuts):
            name = f"{kind}/{int(sorted_bucket[x])}"
            if name not in self.open:
                self.open[name] = mapped(f"{self.model.folder}/{name}", kinds)
            have, *values = self.open[name]
            if not len(have):
                continue
            rows = order[x:y]
            wanted = keys[rows].astype(have.dtype)
            at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
            hit = have[at] == wanted
            for o, v in zip(out, values, strict=True):
                o[rows[hit]] = v[at[hit]]
        return out

    def words(self, h: np.ndarray) -> list[np.ndarray]:
        """Of each word: count, followers seen once, twice, more often, and different words before it."""
        with np.errstate(over="ignore"):
            bucket = ((h << U64(24)) >> U64(64 - self.model.word_bits)).astype(np.int64)
        as_history = self.find("words", UNI, bucket, h)
        return [*as_history, *self.find("before", CONT, bucket, h & LOW40)]

    def pairs(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        m = self.model
        return self.find("grams", ("<u8", "<u4"), gram_bucket(h1, h2 & LOW40, m.gram_bits), gram_hash(h1, h2))[0]


def _discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0.0)


_lookups: dict[str, Lookup] = {}


def lookup(model: Model) -> Lookup:
    if model.folder not in _lookups:
        _lookups.clear()
        _lookups[model.folder] = Lookup(model)
    return _lookups[model.folder]


def score_texts(model: Model, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of each text: tokens, known tokens, base score, model score (log10)."""
    look = lookup(model)
    h1, h2 = bigrams(texts)
    ends = np.flatnonzero(h1 == BEGIN)
    uniq, inverse = np.unique(np.concatenate([h1, h2]), return_inverse=True)
    count, n1, n2, n3, before = look.words(uniq)
    # The end is no history; it is counted where texts begin.
    if (e := np.searchsorted(uniq, END)) < len(uniq) and uniq[e] == END:
        count[e] = count[np.searchsorted(uniq, BEGIN)]
    a, b = inverse[: len(h1)], inverse[len(h1) :]
    base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
    unseen = 1.0 / (model.types + 1)
    p1 = _discounted(before, model.word_discounts) / max(model.bigrams, 1) + model.word_gamma * unseen
    d = model.discounts
    total = n1 * 1.0 + n2 + n3
    total = np.where(total > 0, np.maximum(count, 1), 1)
    gamma = np.where(n1 + n2 + n3 > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / total, 1.0)
    p2 = _discounted(look.pairs(h1, h2), d) / total[a] + gamma[a] * p1[b]
    known = (count[b] > 0).astype(np.int64)
    tokens = np.diff(np.append(ends, len(h1)))
    return tokens, np.add.reduceat(known, ends), np.add.reduceat(base[b], ends), np.add.reduceat(np.log10(p2), ends)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of each row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized_batches(batches, most=AT_ONCE):
            tokens, known, base, own = score_texts(model, strings(b.column("text")))
            yield pa.record_batch([b.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(own)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def cross_validated(docs: DataFrame, k: int = 10) -> DataFrame:
    """Learns from the rows whose fold is not 0 and scores all rows, with the perplexity of each."""
    model = train(docs.where(fold(docs["doc_id"], k) != 0))
    out = score(docs, model)
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), k) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
