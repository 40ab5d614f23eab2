import numpy as np
from pyspark.sql import functions as F

from sheetmill.operators import cells, late, retrieval


def _brute(tokens, patches, k):
    out = {}
    for q in {t[0] for t in tokens}:
        scores = []
        for i in {p[0] for p in patches}:
            each = []
            for t in (np.array(t[2]) for t in tokens if t[0] == q):
                fits = [t @ np.array(p[2]) / np.linalg.norm(t) / np.linalg.norm(p[2]) for p in patches if p[0] == i and p[2] and None not in p[2] and len(p[2]) == len(t)]
                each += [max(fits)] if fits else []
            if each and np.mean(each) >= 0:
                scores.append((-round(np.mean(each), 9), i))
        out |= {(q, n): (i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_pairs_do_not_leave_their_part(spark):
    r = np.random.default_rng(3)
    patches = [(i, p, r.normal(size=64).tolist()) for i in range(200) for p in range(3)]
    tokens = [(q, t, r.normal(size=64).tolist()) for q in range(6) for t in range(2)]
    asked = spark.createDataFrame(tokens, "query_id long, token_no int, q array<double>").select("query_id", retrieval.normalised(F.col("q")).alias("q"), "token_no")
    table = spark.createDataFrame(patches, "image_id long, patch_no int, v array<double>")
    index, found = cells.cell_index(table.select(F.struct("image_id", "patch_no").alias("doc_id"), "v"))
    # Vectors without clusters: nearly all pairs reach the floor, and a part gives only its best.
    assert late.early_and_surviving(asked, index, found, 5, 0.0, "avg")[1].count() > 400
    assert late.early_and_surviving(asked, index, found, 5, 0.0, "avg", 5)[1].count() <= 6 * 5 * late.parts_of(600, spark)
    for max_sim in (late.max_sim, retrieval.max_sim):
        assert {(x.query_id, x.rank): (x.image_id, round(x.score, 9)) for x in max_sim(asked, table, 5).collect()} == _brute(tokens, patches, 5)


def test_all_pairs_are_scored_without_a_join(spark):
    r = np.random.default_rng(4)
    patches = [(None if i == 7 else f"i{i}", p, r.normal(size=4 if i % 2 else 6).tolist()) for i in range(40) for p in range(2)] + [("none", 0, None), ("i3", 5, [1.0, None, 0.0, 0.0]), ("empty", 0, [])]
    tokens = [(f"q{q}", t, r.normal(size=4 if t else 6).tolist()) for q in range(3) for t in range(2)]
    got = retrieval.max_sim(spark.createDataFrame(tokens, "query_id string, token_no int, q array<double>"), spark.createDataFrame(patches, "image_id string, patch_no int, v array<double>"), 100)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    named = lambda rows: [(x[0] or "", *x[1:]) for x in rows]
    assert {(x.query_id, x.rank): (x.image_id or "", round(x.score, 9)) for x in got.collect()} == _brute(tokens, named(patches), 100)
