"""Near-duplicates by ProbMinHash signatures, banding and exact verification.

A text is the weighted set of its five-word shingles, the weight being how often one occurs. Each
shingle sends arrivals at exponential distances (its weight is their rate) to registers chosen by
its hash; a register keeps the shingle that came first. Arrivals of a text stop as soon as they
come later than all of its registers hold (early termination). Two texts agree in a register with
probability equal to their probability Jaccard similarity.

Texts that agree in all registers of a band meet in a bucket. All members of a bucket are compared
with its centre, the member that meets most texts in all of its buckets, which splits buckets of
copies into few components without listing their pairs. Where a bucket still holds several
components, two exact filters come before any pair is looked at. Shingles that no other such text
has cannot be shared; their number and weight bound both measures of every pair from above. A member
whose bound with the best imaginable partner of its bucket is below ``least`` goes, and so do buckets
that are of one component then. Both are sums over shingles and members, combined before the
shuffle. What is left (texts that could link to another component) meets in a task, blocks of
``most`` whose bounds allow a link are compared by matrix products, and only links come out.
Buckets beyond ``PARTS * most`` such members are dealt over tasks as pairs of parts. The comparison is
exact, on the shingles of both texts, and a link needs a similarity (probability or plain Jaccard)
of ``least``.

Bands of 5 registers, 20 of them: a pair at similarity 0.8 is missed once in about 2,800. Texts in
which shingles repeat have 20 more, over their shingles without weights, so this holds for both measures.

Defined results: a null text is empty; texts without words are only copies of equal texts; a text
of fewer than five words is one shingle; equal texts share a class; a class is named by its least
doc_id (null if it has none); repeated rows share a class; further columns are ignored by
``classes`` and kept by ``one_of_each``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmill.llm.common import GOLDEN, U64, checkpointed, mix, sized_batches, strings, tidied, token_hashes, word_shingles
from sheetmill.llm.components import components

WORDS, LEAST, BANDS, ROWS, MOST = 5, 0.8, 20, 5, 256
#: Blocks of a bucket that one task takes from each side, and columns of one matrix product.
PARTS, WIDTH = 4, 4096


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, in order, and how often each occurs."""
    return np.unique(word_shingles(token_hashes(text.encode("utf-8", "surrogatepass").lower().split()), words), return_counts=True)


def _uneven(x: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether weights differ; if those of neither set do, both measures are the same."""
    return bool((x[1] != x[1][0]).any())


def signatures(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """``n`` rows of ``m`` registers; ``owner`` is the row to which each shingle belongs."""
    time, held = np.full(n * m, np.inf), np.zeros(n * m, U64)
    x, e, w, d = np.zeros(len(hashes)), hashes, weights.astype(float), owner
    turn = 0
    while len(e):
        with np.errstate(over="ignore"):
            r = mix(e + U64(2 * turn + 1) * GOLDEN)
            k = (mix(r ^ U64(0xA0761D6478BD642F)) % U64(m)).astype(np.int64)
        x = x - np.log(((r >> U64(11)).astype(float) + 1.0) * 2.0**-53) / w
        at = d * m + k
        np.minimum.at(time, at, x)
        first = x == time[at]
        held[at[first]] = e[first]
        go = x < time.reshape(n, m).max(axis=1)[d]
        x, e, w, d = x[go], e[go], w[go], d[go]
        turn += 1
    return held.reshape(n, m)


def bands_of(texts: list[str], words: int, bands: int, rows: int) -> list[list[int] | None]:
    """Of each text one hash for each band; None for a text without words.

    A text whose shingles do not all occur equally often has further bands, those of its shingles
    without weights. Without weights a text of equal ones has the same bands, so plain copies meet.
    """
    parts = [shingles(t, words) for t in texts]
    plain = [k for k, p in enumerate(parts) if len(p[0]) and _uneven(p)]
    parts += [(parts[k][0], np.ones_like(parts[k][1])) for k in plain]
    sizes = [len(p[0]) for p in parts]
    if not sum(sizes):
        return [None] * len(texts)
    owner = np.repeat(np.arange(len(parts)), sizes)
    sig = signatures(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), owner, len(parts), bands * rows).reshape(len(parts), bands, rows)
    with np.errstate(over="ignore"):
        out = np.zeros(sig.shape[:2], U64)
        for i in range(rows):
            out = mix(out * GOLDEN + sig[:, :, i] + U64(i))
        out = mix(out + np.arange(bands, dtype=U64) * GOLDEN)
    found = [r if s else None for r, s in zip(out.view(np.int64).tolist(), sizes, strict=True)]
    for k, more in zip(plain, found[len(texts) :], strict=True):
        found[k] = sorted({*found[k], *more})
    return found[: len(texts)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The greater of probability Jaccard and plain Jaccard of two weighted sets."""
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    union = len(a[0]) + len(b[0]) - len(shared)
    if not len(shared):
        return 0.0
    jaccard = len(shared) / union
    # Weights of all elements, as few different pairs; those of the shared ones likewise.
    rest_a, rest_b = np.delete(a[1], i), np.delete(b[1], j)
    wa = np.concatenate([a[1][i], rest_a, np.zeros(len(rest_b), a[1].dtype)]).astype(float)
    wb = np.concatenate([b[1][j], np.zeros(len(rest_a), b[1].dtype), rest_b]).astype(float)
    pairs, times = np.unique(np.stack([wa, wb]), axis=1, return_counts=True)
    own, own_times = np.unique(np.stack([wa[: len(shared)], wb[: len(shared)]]), axis=1, return_counts=True)
    total = sum(n / float((np.maximum(pairs[0] / x, pairs[1] / y) * times).sum()) for x, y, n in zip(own[0], own[1], own_times, strict=True))
    return max(jaccard, float(total))


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float) -> bool:
    """Whether the similarity is at least ``least``; bounds that hold for both measures come first."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return False
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    i = b[0][at] == a[0]
    shared = int(np.count_nonzero(i))
    if shared / (len(a[0]) + len(b[0]) - shared) >= least:
        return True
    if not shared or not _uneven(a) and not _uneven(b) or np.minimum(a[1][i] / a[1].sum(), b[1][at[i]] / b[1].sum()).sum() < least - 1e-9:
        return False
    return similarity(a, b) >= least


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(t, F.octet_length(t)).alias("t"), t.alias("text"))


def _signed(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized_batches(batches, most=1 << 20):
            out = bands_of(strings(b.column("text")), words, bands, rows)
            yield pa.record_batch([b.column("doc_id"), b.column("t"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "t", "bands"])

    return run


def _weighted(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized_batches(batches, most=2 << 20):
            out, size, uneven = [], [], []
            for t in strings(b.column("text")):
                h, n = shingles(t, words)
                out.append(h.astype("<u8").tobytes() + n.astype("<u4").tobytes())
                size.append(len(h))
                uneven.append(len(h) > 0 and _uneven((h, n)))
            yield pa.record_batch([b.column("t"), pa.array(out, pa.binary()), pa.array(size, pa.int32()), pa.array(uneven, pa.bool_())], names=["t", "weights", "size", "uneven"])

    return run


def _loaded(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (64 bits) and weights (32 bits) of a text's shingles."""
    n = len(raw) // 12
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n)


def _compared(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last, left = None, None
            keep = []
            for k, (x, y) in enumerate(zip(b.column("wa"), b.column("wb"), strict=True)):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    last, left = x, _loaded(x)
                right = _loaded(y)
                if alike(left, right, least):
                    keep.append(k)
            take = pa.array(keep, pa.int64())
            yield pa.record_batch([b.column("a").take(take), b.column("b").take(take)], names=["a", "b"])

    return run


def weights_of(keys: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """``t, weights, size, uneven`` of the texts that ``keys(t)`` names."""
    first = rows.groupBy("t").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("doc_id")).join(keys.distinct(), "t")
    texts = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).join(first, ["t", "doc_id"]).select("t", "text")
    return checkpointed(texts.mapInArrow(tidied(_weighted(words)), "t long, weights binary, size int, uneven boolean").dropDuplicates(["t"]))


def verified(pairs: DataFrame, rows: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts are similar; ``rows`` has a text for each key, or several equal ones."""
    weights = weights_of(pairs.select(F.col("a").alias("t")).union(pairs.select(F.col("b").alias("t"))), rows, words)
    with_a = pairs.join(weights.select(F.col("t").alias("a"), F.col("weights").alias("wa")), "a")
    with_b = with_a.join(weights.select(F.col("t").alias("b"), F.col("weights").alias("wb")), "b")
    return checkpointed(with_b.mapInArrow(tidied(_compared(least)), "a long, b long"))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each text: its hash and its share of the text's weight."""
    for b in batches:
        sets = [_loaded(w) for w in b.column("weights").to_pylist()]
        owner = pa.array(np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets]))
        h = np.concatenate([h for h, _ in sets]) if sets else np.zeros(0, "<u8")
        share = np.concatenate([w / w.sum() for _, w in sets]) if sets else np.zeros(0)
        yield pa.record_batch([pa.array(h.view("<i8"), pa.int64()), b.column("t").take(owner), pa.array(share, pa.float64())], names=["h", "t", "share"])


def own_part(weights: DataFrame) -> DataFrame:
    """``weights`` with ``own`` and ``own_share``: number and weight of the shingles that no other of its texts has."""
    h = weights.mapInArrow(tidied(_shares), "h long, t long, share double").groupBy("h").agg(F.count("*").alias("n"), F.min("t").alias("t"), F.min("share").alias("share"))
    own = h.where("n = 1").groupBy("t").agg(F.count("*").alias("own"), F.sum("share").alias("own_share"))
    return weights.join(own, "t", "left").withColumns({"own": F.coalesce("own", F.lit(0)), "own_share": F.coalesce("own_share", F.lit(0.0))})


def linkable(rows: DataFrame, least: float) -> DataFrame:
    """Of ``rows(key, size, own, own_share, uneven, ...)`` those that could link to some member of their bucket.

    Two texts share at most the shingles that neither has for itself. With c of n shingles not its
    own, plain Jaccard reaches ``least`` only if c >= least / (1 + least) * (n + n') for both, so the
    other's n' has to fit into ``room`` and n into the other's. Probability Jaccard is at most
    (1 - e) (1 - e') / (1 - e e') for own shares e and e'; it matters only if weights differ.
    """
    rows = rows.withColumn("room", (F.col("size") - F.col("own")) * ((1 + least) / least) - F.col("size") + 1e-6)
    best = rows.groupBy("key").agg(F.min("size").alias("least_size"), F.max("room").alias("most_room"), F.min("own_share").alias("least_share"), F.max("uneven").alias("any_uneven"))
    plain = (F.col("room") >= F.col("least_size")) & (F.col("size") <= F.col("most_room"))
    e, f = F.col("own_share"), F.col("least_share")
    weighted = F.col("any_uneven") & ((1 - e) * (1 - f) >= (least - 1e-6) * (1 - e * f))
    return rows.join(best, "key").where(plain | weighted).drop("least_size", "most_room", "least_share", "any_uneven", "room")


def overlaps(xs: list, ys: list) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of sets, the number of shared shingles, and the least share of weight that they hold in either."""
    common = np.intersect1d(np.concatenate([x[0] for x in xs]), np.concatenate([y[0] for y in ys]))
    number, in_x, in_y = (np.zeros((len(xs), len(ys)), np.float32) for _ in range(3))
    if not len(common):
        return number, in_x
    sides = []
    for sets in (xs, ys):
        owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
        hashes, share = np.concatenate([h for h, _ in sets]), np.concatenate([w / w.sum() for _, w in sets]).astype(np.float32)
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        keep = np.flatnonzero(common[at] == hashes)
        keep = keep[np.argsort(at[keep], kind="stable")]
        sides.append((owner[keep], at[keep], share[keep]))
    weighted = any(map(_uneven, xs)) or any(map(_uneven, ys))
    for start in range(0, len(common), WIDTH):
        width = min(WIDTH, len(common) - start)
        ones, shares = [], []
        for sets, (owner, at, share) in zip((xs, ys), sides, strict=True):
            low, high = np.searchsorted(at, [start, start + width])
            one, part = np.zeros((len(sets), width), np.float32), np.zeros((len(sets), width), np.float32)
            one[owner[low:high], at[low:high] - start] = 1
            part[owner[low:high], at[low:high] - start] = share[low:high]
            ones.append(one)
            shares.append(part)
        number += ones[0] @ ones[1].T
        if weighted:
            in_x += shares[0] @ ones[1].T
            in_y += ones[0] @ shares[1].T
    return number, np.minimum(in_x, in_y)


def may_link(size: np.ndarray, own: np.ndarray, share: np.ndarray, uneven: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """For members ``x`` and ``y``, whether the bounds of ``linkable`` allow the pair a link."""
    most = np.minimum((size - own)[x][:, None], (size - own)[y][None, :])
    plain = most * (1 + least) + 1e-6 >= least * (size[x][:, None] + size[y][None, :])
    e, f = share[x][:, None], share[y][None, :]
    return plain | ((uneven[x][:, None] | uneven[y][None, :]) & ((1 - e) * (1 - f) >= (least - 1e-6) * (1 - e * f)))


COLUMNS = ("key", "low", "high", "part", "t", "label", "weights", "own", "own_share")


def _across(most: int, least: float):
    """Links between members of different components of a bucket; those that unite what is already one are left out.

    Rows come in order of bucket and pair of its parts. Where the parts differ, members of one are
    compared with those of the other.
    """

    def links(group: list[tuple]) -> Iterator[tuple[int, int]]:
        group.sort(key=lambda g: g[:3])
        part, t, label, own = (np.array([g[k] for g in group], dtype=np.int64) for k in (0, 2, 1, 4))
        share = np.array([g[5] for g in group])
        sets = [_loaded(g[3]) for g in group]
        size, uneven = np.array([len(s[0]) for s in sets]), np.array([_uneven(s) for s in sets])
        cut = int(np.searchsorted(part, part[0], side="right"))
        blocks = [np.arange(k, min(k + most, end)) for start, end in ((0, cut), (cut, len(t))) for k in range(start, end, most)]
        first = sum(b[0] < cut for b in blocks)
        both = [(i, j) for i in range(first) for j in range(first, len(blocks))] if cut < len(t) else [(i, j) for i in range(first) for j in range(i, first)]
        for i, j in both:
            x, y = blocks[i], blocks[j]
            open_ = may_link(size, own, share, uneven, x, y, least) & (label[x][:, None] != label[y][None, :])
            x, y = x[open_.any(axis=1)], y[open_.any(axis=0)]
            if not len(x):
                continue
            number, both_share = overlaps([sets[k] for k in x], [sets[k] for k in y])
            number = number.astype(float)
            plain = number / (size[x][:, None] + size[y][None, :] - number) >= least
            # The shared part of either one's weight bounds probability Jaccard; room for single precision.
            weighted = (uneven[x][:, None] | uneven[y][None, :]) & (both_share >= least - 0.001)
            for p, q in np.argwhere((plain | weighted) & (label[x][:, None] != label[y][None, :])):
                u, v = x[p], y[q]
                if label[u] != label[v] and (plain[p, q] or alike(sets[u], sets[v], least)):
                    label[label == label[v]] = label[u]
                    yield int(t[u]), int(t[v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ends(group: list[tuple]) -> pa.RecordBatch:
            # Pairs inside a part belong to the pair of the part with itself.
            alone = key is not None and key[1] != key[2] and len({g[0] for g in group}) < 2
            found = list(links(group)) if len(group) > 1 and not alone else []
            return pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        key, group = None, []
        for b in batches:
            for k, low, high, part, t, label, *rest in zip(*(b.column(c).to_pylist() for c in COLUMNS), strict=True):
                if (k, low, high) != key:
                    yield ends(group)
                    key, group = (k, low, high), []
                group.append((part, label, t, *rest))
        yield ends(group)

    return run


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """``key, n`` of the buckets of ``rows(key, t, label)`` that hold several components; of those with the same members, one."""
    agg = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.min("t").alias("first"), F.bit_xor(F.xxhash64("t")).alias("same"))
    return agg.where("low <> high").groupBy("n", "first", "same").agg(F.min("key").alias("key")).select("key", "n")


def classes(docs: DataFrame, text: str = "text", words: int = WORDS, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """``t, class_id, kept`` of each different text (``kept`` is the text that stays for its class), and ``doc_id, t, text`` of each row."""
    spark = docs.sparkSession
    keyed = _keyed(docs, text)
    signed = keyed.mapInArrow(tidied(_signed(words, bands, rows)), "doc_id long, t long, bands array<long>")
    texts = checkpointed(signed.groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    member = texts.where("bands is not null").select("t", F.explode("bands").alias("key"))
    buckets = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = checkpointed(member.join(buckets, "key"))
    meets = met.groupBy("t").agg(F.sum("n").alias("meets"))
    centres = met.join(meets, "t").groupBy("key").agg(F.max_by("t", F.struct("meets", "t")).alias("centre"))
    star = checkpointed(met.join(centres, "key").where("t <> centre").select(F.col("centre").alias("a"), F.col("t").alias("b")).distinct())
    links = verified(star, keyed, words, least)
    label = components(links)
    labelled = met.join(label.withColumnRenamed("v", "t"), "t", "left").select("key", "t", F.coalesce("label", "t").alias("label"))
    open_rows = checkpointed(labelled.join(mixed_buckets(labelled).select("key"), "key"))
    weights = checkpointed(own_part(weights_of(open_rows.select("t"), keyed, words)))
    left = checkpointed(linkable(open_rows.join(weights.drop("weights"), "t"), least).select("key", "t", "label"))
    parts = F.ceil(F.col("n") / F.lit(PARTS * most)).cast("int")
    left = left.join(mixed_buckets(left), "key")
    dealt = left.withColumn("part", F.pmod(F.xxhash64("t"), parts).cast("int")).select("key", "t", "label", "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    dealt = dealt.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "t", "label").join(weights.select("t", "weights", "own", "own_share"), "t")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    more = dealt.repartition(tasks, "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(tidied(_across(most, least)), "a long, b long")
    label = components(links.union(checkpointed(more)))
    joined = texts.select("t", "doc_id").join(label.withColumnRenamed("v", "t"), "t", "left").withColumn("label", F.coalesce("label", "t"))
    best = joined.groupBy("label").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "t")).alias("best"))
    return joined.join(best, "label").select("t", F.col("best.doc_id").alias("class_id"), F.col("best.t").alias("kept")), keyed


def report(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``doc_id, class_id`` of each row."""
    named, keyed = classes(docs, text, **options)
    return keyed.select("doc_id", "t").join(named, "t").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each class: the one with the least doc_id (a null after all others).

    If different texts of a class share that id, one of them stays, and of rows that repeat id and
    text, one. The row is carried as a whole, so no name of a column can clash.
    """
    named, _ = classes(docs, text, **options)
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    own = docs.select(F.xxhash64(t, F.octet_length(t)).alias("kept"), docs["doc_id"].cast("long").alias("class_id"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    first = named.where("t = kept").select("kept", F.col("class_id").alias("least"))
    out = own.join(first, "kept").where(F.col("class_id").eqNullSafe(F.col("least")))
    return out.dropDuplicates(["kept"]).select("row.*")
