"""Removal of every byte that a repeated string of ``length`` bytes covers (suffix-array dedup).

A suffix array of a corpus puts suffixes that share a beginning side by side. Here Spark brings them
together: of each string of ``length`` bytes the gram with the smallest hash (the leftmost of
equals) is its anchor, so equal strings have equal anchors at equal places, and only suffixes at
anchors of one gram have to be compared. About one byte in ninety is an anchor.

1. Anchors of all texts; grams with two occurrences or more are kept (a count, then a join).
2. An anchor owns the strings whose smallest gram it is; together they are its context. Contexts
   that occur twice or more are repeats as a whole, and one text stands for them from here on.
3. Contexts that share a gram but differ are sorted as suffixes: mergesort, in which two suffixes
   are compared through their longest common extension, found by binary search over prefix
   polynomial hashes and compared byte by byte before it counts. They are sorted by their extensions to
   the left in the same way. Clusters grow along the left order, longest extension first; as two
   meet, the members of the smaller one look for their neighbours in the right order of the larger
   one. So K contexts need about K log K comparisons and no pair is listed.
4. Groups are dealt over tasks by gram. One with more than ``most`` different contexts would be too
   much for a task: its strings are counted one by one (by 128-bit hashes, combined before the
   shuffle). Both ways find the same.
5. The stretches of each text are united, and what is left is put together.

Whole copies are told apart by a 64-bit hash with their size, contexts by 128 bits (64 of the gram and
64 of the rest); these two are not compared byte by byte. Grams and contexts that are frequent are salted,
so that no join reads all of their places in one task.

Defined results: a null text is empty; a text below ``length`` bytes keeps all; matches never cross
texts; rows that repeat are copies of each other; null ids are kept; an empty table gives an empty
table; further columns are ignored by the report and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cmp_to_key
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmill.llm.common import U64, checkpointed, mix, sized_batches, strings, tidied

LENGTH, GRAM, MOST, SPLIT = 200, 32, 20_000, 1_000
BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_powers: dict[str, np.ndarray] = {}


def _power(of: U64, n: int) -> np.ndarray:
    have = _powers.get(str(of))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = _powers[str(of)] = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(max(n, 1 << 20), of, U64)]))
    return have[:n]


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of all texts: number of the text, place of the anchor, first and last string owned, gram's hash."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n, width = len(raw), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length or not (sizes >= length).any():
        return none, none, none, none, none.astype(U64)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE_CODES[raw] * _power(INVERSE, n), dtype=U64)])
        grams = mix((prefix[gram:] - prefix[:-gram]) * _power(BASE, n - gram + 1))
    # A place's rank: half of its gram's hash, then the place, so that the leftmost of equals is least.
    rank = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    rows = -(-len(rank) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, U64)
    padded[: len(rank)] = rank
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - length + 1], ahead[width - 1 : width - 1 + n - length + 1])
    text_no = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    first = np.concatenate([[0], np.cumsum(np.maximum(sizes - length + 1, 0))])[:-1]
    at = np.arange(len(text_no)) - first[text_no] + starts[text_no]  # starts of strings inside one text
    place = (least[at] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (text_no[1:] != text_no[:-1])])
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(at)) - 1
    no = text_no[cut]
    return no, place[cut] - starts[no], at[cut] - starts[no], at[last] - starts[no], grams[place[cut]]


KEY = "tk long, size int"


def _keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(t).alias("tk"), F.octet_length(t).alias("size"), t.alias("text"))


def _context(t: bytes, place: int, low: int, high: int, length: int) -> int:
    return xxhash.xxh3_64_intdigest(t[low : high + length], place - low) - 2**63


def _anchor_rows(length: int, gram: int, full: bool):
    """Rows of anchors: their grams alone, or with context, text and place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized_batches(batches, most=1 << 20):
            texts = [t.encode("utf-8", "surrogatepass") for t in strings(b.column("text"))]
            no, place, low, high, g = anchors(texts, length, gram)
            out = [pa.array(g.view(np.int64))]
            if full:
                context = [_context(texts[i], p, x, y, length) for i, p, x, y in zip(no.tolist(), place.tolist(), low.tolist(), high.tolist(), strict=True)]
                take = pa.array(no)
                out += [pa.array(context, pa.int64()), b.column("tk").take(take), b.column("size").take(take), pa.array(place.astype(np.int32))]
            yield pa.record_batch(out, names=["gram", "context", "tk", "size", "place"][: len(out)])

    return rows


# -- the suffix sort of one group ----------------------------------------------------------------
MASK = (1 << 64) - 1
_shifts = array("Q")


def prefix_hashes(data: bytes) -> array:
    """Sums of byte codes times falling powers, modulo 2**64; a difference times a rising power is the hash of a stretch."""
    global _shifts
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.cumsum(BYTE_CODES[np.frombuffer(data, np.uint8)] * _power(INVERSE, n), dtype=U64)
    if len(_shifts) < n + 1:
        _shifts = array("Q", _power(BASE, max(n + 1, 1 << 16)).tobytes())
    return array("Q", bytes(8) + sums.tobytes())


class Suffix:
    """A context and its prefix polynomial hashes; the suffix begins at the anchor.

    The contexts of a group may share one row of hashes, in which this one's begin at ``base``.
    """

    __slots__ = ("at", "base", "data", "hashes", "row")

    def __init__(self, data: bytes, at: int, row: int, hashes: array | None = None, base: int = 0) -> None:
        self.data, self.at, self.row, self.base = data, at, row, base
        self.hashes = prefix_hashes(data) if hashes is None else hashes

    def part(self, low: int, high: int) -> int:
        low += self.base
        return (self.hashes[self.base + high] - self.hashes[low]) * _shifts[low] & MASK


def suffixes_of(contexts: list[tuple[bytes, int]]) -> list[Suffix]:
    """Suffixes of a group's contexts (bytes, place of the anchor), numbered."""
    hashes, base, out = prefix_hashes(b"".join(data for data, _ in contexts)), 0, []
    for row, (data, at) in enumerate(contexts):
        out.append(Suffix(data, at, row, hashes, base))
        base += len(data)
    return out


def common_right(a: Suffix, b: Suffix) -> int:
    """Bytes that two suffixes share from their anchors on: binary search over hashes of prefixes, then the bytes themselves."""
    low, high = 0, min(len(a.data) - a.at, len(b.data) - b.at)
    while low < high:
        middle = (low + high + 1) // 2
        if a.part(a.at + low, a.at + middle) == b.part(b.at + low, b.at + middle):
            low = middle
        else:
            high = middle - 1
    x, y = a.data[a.at : a.at + low], b.data[b.at : b.at + low]
    return low if x == y else len(os.path.commonprefix([x, y]))  # hashes collided


def common_left(a: Suffix, b: Suffix) -> int:
    """The same to the left of the anchors."""
    low, high = 0, min(a.at, b.at)
    while low < high:
        middle = (low + high + 1) // 2
        if a.part(a.at - middle, a.at - low) == b.part(b.at - middle, b.at - low):
            low = middle
        else:
            high = middle - 1
    x, y = a.data[a.at - low : a.at], b.data[b.at - low : b.at]
    return low if x == y else len(os.path.commonprefix([x[::-1], y[::-1]]))


def _order(a: Suffix, b: Suffix) -> int:
    k = common_right(a, b)
    x, y = a.data[a.at + k : a.at + k + 1], b.data[b.at + k : b.at + k + 1]
    return -1 if x < y else int(x > y)


def _left_order(a: Suffix, b: Suffix) -> int:
    k = common_left(a, b)
    x, y = a.data[max(a.at - k - 1, 0) : a.at - k], b.data[max(b.at - k - 1, 0) : b.at - k]
    return -1 if x < y else int(x > y)


def common_stretches(group: list[Suffix], length: int) -> dict[int, list[int]]:
    """Row -> how far, to the left and to the right of its anchor, stretches reach that it shares with another context.

    All stretches of a row hold its anchor, so together they are one. Two contexts that are put
    together by a step share exactly that step's extension to the left; the longest to the right is
    that of a neighbour in right order.
    """
    if len(group) == 2:  # nothing to sort
        a, b = group
        right = common_right(a, b)
        left = common_left(a, b) if right + min(a.at, b.at) >= length else 0
        return {s.row: [left, right] for s in group} if left + right >= length else {}
    by_right = sorted(group, key=cmp_to_key(_order))  # mergesorts
    rank = {s.row: k for k, s in enumerate(by_right)}
    by_left = sorted(group, key=cmp_to_key(_left_order))
    steps = sorted(((common_left(a, b), k) for k, (a, b) in enumerate(pairwise(by_left))), reverse=True)
    cluster, members = list(range(len(group))), [[rank[s.row]] for s in by_left]

    def root(k: int) -> int:
        while cluster[k] != k:
            cluster[k] = k = cluster[cluster[k]]
        return k

    reach: dict[int, list[int]] = {}
    for left, k in steps:
        small, large = sorted((root(k), root(k + 1)), key=lambda c: len(members[c]))
        into = members[large]
        for x in members[small]:
            at = bisect_left(into, x)
            for y in into[max(at - 1, 0) : at + 1]:
                a, b = by_right[x], by_right[y]
                right = common_right(a, b)
                if left + right >= length:
                    for row in (a.row, b.row):
                        far = reach.setdefault(row, [0, 0])
                        far[:] = max(far[0], left), max(far[1], right)
            into.insert(at, x)
        cluster[small] = large
        members[small] = []
    return reach


SPAN = "tk long, size int, low int, high int"


def _sort_groups(length: int):
    """Rows come in order of gram; a group is done when the next begins."""

    def done(group: list[tuple]) -> Iterator[tuple]:
        suffixes = suffixes_of([(data, at) for _, _, _, at, data in group])
        for row, (left, right) in common_stretches(suffixes, length).items():
            tk, size, place = group[row][:3]
            yield tk, size, place - left, place + right

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["tk", "size", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, group = None, []
        for b in batches:
            out: list[tuple] = []
            for g, *row in zip(*(b.column(c).to_pylist() for c in ("gram", "tk", "size", "place", "at", "data")), strict=True):
                if g != gram:
                    if len(group) > 1:
                        out += done(group)
                    gram, group = g, []
                group.append(tuple(row))
            yield batch(out)
        if len(group) > 1:
            yield batch(list(done(group)))

    return run


def _fetch(length: int, gram: int):
    """Contexts of the anchors that are asked for, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            texts = [unzip.decompress(x) for x in b.column("packed").to_pylist()]
            for t, tk, size, wanted in zip(texts, b.column("tk").to_pylist(), b.column("size").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                if not wanted:
                    continue
                _, place, low, high, g = anchors([t], length, gram)
                pick = np.flatnonzero(np.isin(place, np.array(wanted)))
                names = ["gram", "tk", "size", "place", "at", "data"]
                data = [t[low[k] : high[k] + length] for k in pick.tolist()]
                yield pa.record_batch(
                    [pa.array(g[pick].view(np.int64)), pa.array([tk] * len(pick), pa.int64()), pa.array([size] * len(pick), pa.int32()), pa.array(place[pick].astype(np.int32)), pa.array((place - low)[pick].astype(np.int32)), pa.array(data, pa.binary())],
                    names=names,
                )

    return run


def _strings_of(length: int):
    """Every string of ``length`` bytes in a context, by a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, tk, size, low = [], [], [], []
            for k, s, p, at, data in zip(*(b.column(c).to_pylist() for c in ("tk", "size", "place", "at", "data")), strict=True):
                for i in range(len(data) - length + 1):
                    key.append(xxhash.xxh3_128_digest(data[i : i + length]))
                    tk.append(k)
                    size.append(s)
                    low.append(p - at + i)
            yield pa.record_batch([pa.array(key, pa.binary()), pa.array(tk, pa.int64()), pa.array(size, pa.int32()), pa.array(low, pa.int32())], names=["key", "tk", "size", "low"])

    return run


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _cut(length: int, gram: int):
    """What is left of each text, after its repeated contexts and stretches are taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for tk, size, packed, whole, lows, highs in zip(*(b.column(c).to_pylist() for c in ("tk", "size", "packed", "whole", "lows", "highs")), strict=True):
                t = unzip.decompress(packed)
                spans = list(zip(lows or [], highs or [], strict=True))
                if whole:
                    _, place, low, high, _ = anchors([t], length, gram)
                    pick = np.isin(place, np.array(whole))
                    spans += list(zip(low[pick].tolist(), (high[pick] + length).tolist(), strict=True))
                spans = united(spans)
                kept = b"".join(t[x:y] for x, y in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(t)], strict=True))
                for c, v in zip(rows, (tk, size, len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), pack.compress(kept)), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["tk", "size", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        packed = pa.array([z.compress(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary())
        yield pa.record_batch([b.column("tk"), b.column("size"), packed, b.column("whole"), b.column("wanted")], names=["tk", "size", "packed", "whole", "wanted"])


def held_by(rows: DataFrame, keys: DataFrame, by: list[str], total: int) -> DataFrame:
    """The ``rows`` (with ``tk`` and ``place``) whose ``by`` is in ``keys(by, n)``, where n counts the rows of a key.

    Keys with more than a ``SPLIT``-th of all ``total`` rows, so at most ``SPLIT`` of them, are sent to all tasks
    and their rows dealt over as many tasks as they need.
    """
    parts = F.ceil(F.col("n") / F.lit(max(total // SPLIT, 1))).cast("int")
    hot = keys.where(parts > 1).select(*by, parts.alias("parts"))
    dealt = rows.join(F.broadcast(hot), by, "left").withColumn("salt", F.pmod(F.xxhash64("tk", "place"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return dealt.join(keys.select(*by, F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")), [*by, "salt"], "left_semi").drop("salt")


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Of each different text with a repeat: what is removed and what is kept; and all rows by text key.

    The first has ``tk, size, n_removed, n_spans, kept_sha256, kept`` (``kept`` packed; null and all
    removed where the whole text has a copy), the second ``tk, size, doc_id``.
    """
    rows = _keyed(docs, text)
    copies = checkpointed(rows.where(F.col("size") >= length).groupBy("tk", "size").agg(F.count("*").alias("copies"), F.min(F.coalesce("doc_id", F.lit(-1))).alias("rep")))
    source = rows.where(F.col("size") >= length)
    often = checkpointed(source.select("tk", "size", "text").mapInArrow(tidied(_anchor_rows(length, gram, False)), "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = source.select("tk", "size", "text").mapInArrow(tidied(_anchor_rows(length, gram, True)), "gram long, context long, tk long, size int, place int")
    found = checkpointed(held_by(placed, often, ["gram"], total))
    contexts = found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("tk", "size", "place")).alias("rep"))
    groups = contexts.groupBy("gram").agg(F.count("*").alias("different"))
    contexts = checkpointed(contexts.join(groups, "gram").select("gram", "context", "n", "rep", "different"))
    whole = held_by(found, contexts.where("n > 1").select("gram", "context", "n"), ["gram", "context"], total).select("tk", "size", F.col("place").alias("whole"), F.lit(None).cast("int").alias("wanted"))
    members = contexts.where("different > 1").select("rep.tk", "rep.size", F.lit(None).cast("int").alias("whole"), F.col("rep.place").alias("wanted"))
    marks = whole.unionByName(members).groupBy("tk", "size").agg(F.collect_set("whole").alias("whole"), F.collect_set("wanted").alias("wanted"))
    # Texts with a whole copy are known to go; their text is needed only if others are compared with it.
    marks = marks.join(copies, ["tk", "size"]).where("copies = 1 or size(wanted) > 0").withColumnRenamed("rep", "doc_id").drop("copies")
    texts = source.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).join(marks, ["tk", "size", "doc_id"]).select("tk", "size", "text", "whole", "wanted")
    packed = checkpointed(texts.mapInArrow(tidied(_pack), "tk long, size int, packed binary, whole array<int>, wanted array<int>"))
    asked = packed.where("size(wanted) > 0").mapInArrow(tidied(_fetch(length, gram)), "gram long, tk long, size int, place int, at int, data binary")
    asked = asked.join(groups.where("different > 1"), "gram")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = asked.where(F.col("different") <= most).repartition(parts, "gram").sortWithinPartitions("gram").drop("different")
    sorted_out = small.mapInArrow(tidied(_sort_groups(length)), SPAN)
    large = asked.where(F.col("different") > most).mapInArrow(tidied(_strings_of(length)), "key binary, tk long, size int, low int")
    twice = large.groupBy("key").count().where("count > 1").select("key")
    counted = large.join(twice, "key", "left_semi").select("tk", "size", "low", (F.col("low") + length).alias("high"))
    spans = sorted_out.unionByName(counted).groupBy("tk", "size").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    single = packed.join(copies.where("copies = 1"), ["tk", "size"], "left_semi").drop("wanted").dropDuplicates(["tk", "size"])
    cut = single.join(spans, ["tk", "size"], "left").mapInArrow(tidied(_cut(length, gram)), "tk long, size int, n_removed long, n_spans long, kept_sha256 string, kept binary").where("n_spans > 0")
    gone = copies.where("copies > 1").select("tk", "size", F.col("size").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    return cut.unionByName(gone), rows.select("doc_id", "tk", "size", "text")


def report(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row."""
    removed, rows = repeats(docs, text, length, gram, most)
    own = rows.select("doc_id", "tk", "size", F.sha2("text", 256).alias("own"))
    out = own.join(removed.drop("kept"), ["tk", "size"], "left")
    return out.select("doc_id", F.col("size").cast("long").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for b in batches:
        kept = ["" if x is None else z.decompress(x).decode("utf-8", "ignore") for x in b.column("kept").to_pylist()]
        yield pa.record_batch([b.column("tk"), b.column("size"), pa.array(kept, pa.string())], names=["tk", "size", "kept"])


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """``docs`` with repeated bytes taken out of its text; a character that loses a byte goes whole.

    A null text stays null. A row is carried as a whole, so no name of a column can clash.
    """
    removed, _ = repeats(docs, text, length, gram, most)
    kept = removed.select("tk", "size", "kept").mapInArrow(tidied(_unpack), "tk long, size int, kept string")
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(t).alias("tk"), F.octet_length(t).alias("size"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    out = rows.join(kept, ["tk", "size"], "left")
    return out.select(*(F.coalesce("kept", F.col("row")[c]).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
