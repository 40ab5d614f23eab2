"""Clusters and product codes on whole numbers against plain comparison, and against their SQL."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sheetmill.llm import gnat_codes, ptolemaic_clusters
from sheetmill.llm.integer_vectors import Sums, squared, whole

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, code int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def ints(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def nearest(v, centres):
    return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))


def means(old, groups):
    return [[sum(col) // len(groups[i]) for col in zip(*groups[i])] if groups[i] else c for i, c in enumerate(old)]


def plain_clusters(rows, k, rounds, scale, dim, prefix):
    kept = [(r[0], ints(r[1], scale)) for r in rows if usable(r[1]) and len(r[1]) == dim]
    sha = lambda i: hashlib.sha256(f"{prefix}{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, sha(r[0]), r[1]))[:k]]
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v, centres)[1]].append(v)
        centres = means(centres, groups)
    found = [(i, *nearest(v, centres)) for i, v in kept]
    by = Counter()
    for _, d, c in found:
        by[c] += d
    return Counter((i, c, d, by[c], sum(by.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in found)


def plain_codes(rows, entries, parts, rounds, scale):
    sizes = Counter(len(r[1]) for r in rows if usable(r[1]))
    if not sizes:
        return Counter()
    dim = min(sizes, key=lambda s: (-sizes[s], s))
    kept = sorted([(r[0], ints(r[1], scale), r[2]) for r in rows if usable(r[1]) and len(r[1]) == dim], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [dim * p // parts for p in range(parts + 1)]
    split = lambda v: [v[cut[p] : cut[p + 1]] for p in range(parts)]
    books = [[split(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        groups = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p, x in enumerate(split(v)):
                groups[p][nearest(x, books[p])[1]].append(x)
        books = [means(b, g) for b, g in zip(books, groups)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, [nearest(x, books[p]) for p, x in enumerate(split(v))], label) for i, v, label in kept]
    by = Counter()
    for _, f, label in found:
        by[label] += sum(d for d, _ in f)
    return Counter((i, bytes(e for _, e in f).hex(), sum(d for d, _ in f), by[label], digest) for i, f, label in found)


def fixture(rng, n, dim):
    centres = rng.normal(size=(5, dim))
    rows = [(i, [float(x) for x in (centres[i % 5] + 0.2 * rng.normal(size=dim)).astype(np.float32)], None if i % 7 == 0 else i % 3, "x", 9) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same, 1, "x", 9) for i in range(n // 3)]  # a third of all rows alike
    rows += [(5, rows[6][1], 2, "x", 9), (5, rows[6][1], 2, "x", 9), (None, rows[8][1], None, "x", 9), (-4, [0.0] * dim, 2, "x", 9)]
    rows += [(900, None, 1, "x", 9), (901, [], 1, "x", 9), (902, [float("nan")] + [0.0] * (dim - 1), 1, "x", 9), (903, [None] + [0.0] * (dim - 1), 1, "x", 9), (904, [float("inf")] + [0.0] * (dim - 1), 1, "x", 9), (905, [1.0] * (dim - 1), 1, "x", 9)]
    return rows


def got(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def rows():
    return fixture(np.random.default_rng(3), 90, 8)


def test_clusters_equal_plain_comparison_and_sql(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = got(ptolemaic_clusters.report(df, 12, 5, 256, 8))
    assert out == plain_clusters(rows, 12, 5, 256, 8, "2:")
    con = duckdb.connect()
    con.register("embeddings", df.select("vec_id", "embedding").toArrow())
    assert out == Counter(con.execute(ptolemaic_clusters.twin(12, 5, 256, 8)).fetchall())


def test_codes_equal_plain_comparison_and_sql(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = got(gnat_codes.report(df, 60, 4, 4, 1024))
    assert out == plain_codes(rows, 60, 4, 4, 1024)
    con = duckdb.connect()
    con.register("embeddings", df.select("vec_id", "embedding", "label").toArrow())
    assert out == Counter(con.execute(gnat_codes.twin(60, 4, 4, 1024, 8)).fetchall())


def test_few_rows_huge_numbers_uneven_parts_and_no_rows(spark):
    rows = [(1, [1e9, -3e9, 2.0, 4e18, 1.0], 1, "x", 1), (2, [1e9, -3e9, 2.0, 3.9e18, 1.0], None, "x", 1), (3, [0.5, 0.25, -0.1, 7.0, 1.0], None, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = lambda c: Counter({tuple(min(x, 2**63 - 1) if isinstance(x, int) else x for x in r): n for r, n in c.items()})
    assert got(ptolemaic_clusters.report(df, 2, 3, 1, 5)) == cut(plain_clusters(rows, 2, 3, 1, 5, "2:"))
    assert got(gnat_codes.report(df, 2, 4, 2, 1)) == cut(plain_codes(rows, 2, 4, 2, 1))
    for empty in (df.limit(0), df.select("vec_id", "embedding", "label").where("vec_id is null")):
        assert ptolemaic_clusters.report(empty).count() == 0 and gnat_codes.report(empty).count() == 0


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, size=(40, 64))
    x = centres[rng.integers(0, 40, 3_000)] + rng.integers(-30, 30, size=(3_000, 64))
    pivots = ptolemaic_clusters.spread_out(centres)
    best, d2, counted = ptolemaic_clusters.Ptolemy(centres, pivots).nearest(x, np.stack([squared(x, p[None, :]) for p in pivots], axis=1))
    every = np.stack([squared(x, c[None, :]) for c in centres], axis=1)
    assert (best == every.argmin(axis=1)).all() and (d2 == every.min(axis=1)).all() and counted < 0.3 * every.size


def test_tree_passes_subtrees_by_and_keeps_ties():
    rng = np.random.default_rng(2)
    middles = rng.integers(-600, 600, size=(16, 16))
    points = np.concatenate([middles[rng.integers(0, 16, 250)] + rng.integers(-40, 40, size=(250, 16)), np.repeat(middles[:1], 6, axis=0)])
    queries = np.concatenate([points[rng.integers(0, 256, 2_000)] + rng.integers(-20, 20, size=(2_000, 16)), points, points[-3:]])
    tree = gnat_codes.Gnat(points)
    best, d2 = tree.nearest(queries)
    every = np.stack([squared(queries, p[None, :]) for p in points], axis=1)
    assert (best == every.argmin(axis=1)).all() and (d2 == every.min(axis=1)).all() and tree.counted < 0.5 * every.size
    same = gnat_codes.Gnat(np.zeros((100, 4), dtype=np.int64))
    assert same.nearest(np.ones((3, 4), dtype=np.int64))[0].tolist() == [0, 0, 0]


def test_sums_of_large_and_small_numbers():
    s = Sums(3, 2)
    s.add(np.array([2, 0, 2]), np.array([[1, 2], [3, 4], [5, 6]]))
    s.add(np.array([2]), whole([[1 << 70, -1]]))
    rows = s.batch().to_pylist()
    assert [(r["slot"], r["n"], int(r["s0"]), int(r["s1"])) for r in rows] == [(0, 1, 3, 4), (2, 3, 6 + (1 << 70), 7)]
