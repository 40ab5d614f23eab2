"""Repeats and near-duplicates against brute force."""

import collections
import hashlib
import random

import pytest

from sheetmill.llm import probminhash, suffix_dedup
from sheetmill.llm.components import components


def plain_repeats(texts, length):
    starts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(t, mark) if not y)
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(t), sum(mark), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.fixture(scope="module")
def passages():
    r = random.Random(3)
    w = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    base = [w(r.randint(0, 400)) for _ in range(20)]
    phrase, passage = w(60), w(230)
    out = [*base, base[3], base[3], "", None, "a" * 900, "ab" * 500, "x" * 199, "x" * 200, "y" * 201]
    for _ in range(25):
        a, b = r.choice(base), r.choice(base)
        out.append(a[r.randint(0, len(a)) :] + w(5) + b[: r.randint(0, len(b))])
    out += [w(30) + phrase + w(160) for _ in range(90)]  # a frequent phrase: the path without groups
    return out + [w(30) + passage[: r.randint(190, 230)] + w(40) for _ in range(80)]


@pytest.mark.parametrize("length,gram,most", [(200, 32, 20_000), (60, 16, 20_000), (200, 32, 30)])
def test_repeats(spark, passages, length, gram, most):
    rows = [(k, t, "source") for k, t in enumerate(passages)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(df, length=length, gram=gram, most=most).collect()}
    want = plain_repeats([(t or "").encode() for t in passages], length)
    assert got == {k: x[:4] for k, x in enumerate(want)}
    if length == 200 and most > 30:
        kept = {r.doc_id: r for r in suffix_dedup.without_repeats(df, length=length, gram=gram).collect()}
        assert {k: (r.text or "").encode() for k, r in kept.items()} == {k: x[4].decode("utf-8", "ignore").encode() for k, x in enumerate(want)}
        assert kept[0].asDict().keys() == {"doc_id", "text", "size"}


def test_repeats_of_nothing_and_null_ids(spark):
    df = spark.createDataFrame([(None, "q" * 250), (None, "q" * 250), (7, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.report(df).collect()) == [(0, 250), (0, 250), (7, 0)]
    assert suffix_dedup.report(df.limit(0)).collect() == []


def test_names_of_columns_cannot_clash(spark):
    names = ["tk", "size", "kept", "row", "_tk", "_kept", "class_id", "least", "t", "key", "_row", "none", "words"]
    df = spark.createDataFrame([(1, "p" * 150 + "q" * 150, *range(13)), (2, "q" * 149 + "r" * 150 + "q", *range(13)), (None, None, *range(13))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for out in (suffix_dedup.without_repeats(df), probminhash.one_of_each(df)):
        assert out.columns == df.columns
        assert sorted(out.collect(), key=str) == sorted(df.collect(), key=str)


def test_stretches_of_a_group_are_those_of_all_pairs():
    r = random.Random(9)
    for n in (2, 3, 8, 60):
        gram = b"G" * 8
        group = [suffix_dedup.Suffix(x + gram + y, len(x), k) for k, (x, y) in enumerate((bytes(r.choices(b"ab", [9, 1], k=r.randint(0, 25))), bytes(r.choices(b"ab", [9, 1], k=r.randint(0, 25)))) for _ in range(n))]
        want = {}
        for a in group:
            for b in group:
                left, right = suffix_dedup.common_left(a, b), suffix_dedup.common_right(a, b)
                if a is not b and left + right >= 30:
                    far = want.setdefault(a.row, [0, 0])
                    far[:] = max(far[0], left), max(far[1], right)
        assert suffix_dedup.common_stretches(group, 30) == want


def test_one_row_of_a_class_stays_whatever_its_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    near = text + " more"
    same_id = spark.createDataFrame([(4, text, "a"), (4, near, "b"), (4, near, "c"), (5, "other words stay here too", "d")], "doc_id long, text string, t string")
    assert sorted(r.doc_id for r in probminhash.one_of_each(same_id).collect()) == [4, 5]
    null_ids = spark.createDataFrame([(None, text), (None, near), (None, text), (None, "q")], "doc_id long, text string")
    assert sorted(r.text for r in probminhash.one_of_each(null_ids).collect())[0] == "q" and probminhash.one_of_each(null_ids).count() == 2
    assert probminhash.one_of_each(null_ids.limit(0)).collect() == []


def test_a_family_just_below_the_threshold_links_only_what_is_alike(spark):
    r = random.Random(11)
    base = [f"b{k}" for k in range(120)]

    def edited(n, seed):
        x, q = list(base), random.Random(seed)
        for i in q.sample(range(120), n):
            x[i] = f"e{seed}-{i}"
        return x

    texts = [" ".join(edited(4, k)) for k in range(300)]
    pair = edited(4, 1000)
    texts += [" ".join(pair), " ".join([*pair[:60], "one", *pair[61:]])]
    sets = [probminhash.shingles(t) for t in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if want[a] != want[b] and probminhash.similarity(sets[a], sets[b]) >= 0.8:
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    assert want[300] == want[301] and len(set(want)) > 250
    r.shuffle(texts_ids := list(enumerate(texts)))
    df = spark.createDataFrame(texts_ids, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.class_id for x in probminhash.report(df, bands=30, rows=2).collect()} == dict(enumerate(want))


def chains(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))

    def edit(x, k):
        x = list(x)
        for i in r.sample(range(len(x)), k):
            x[i] = word()
        return x

    base = [word() for _ in range(200)]
    out = [base] + [edit(base, r.choice([2, 3, 4, 5, 6, 7])) for _ in range(80)]
    for _ in range(12):  # copies of copies
        a = edit(base, 5)
        out += [a, edit(a, 4), edit(edit(a, 4), 4)]
    out += [base[: 200 - 4 * k] for k in range(15)] + [base[7 * k :] for k in range(8)]
    return [" ".join(x) for x in out] + ["", None, "  ", "one two", "one two", "One  two", " ".join(base), " ".join(["again and again"] * 40), " ".join(["again and again"] * 44)]


def test_classes(spark):
    texts = chains(5)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts)], "doc_id long, text string, t int").repartition(3)
    got = {r.doc_id: r.class_id for r in probminhash.report(df).collect()}
    sets, text = {i: probminhash.shingles(t or "") for i, t in zip(ids, texts)}, {i: t or "" for i, t in zip(ids, texts)}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (text[a] == text[b] or probminhash.similarity(sets[a], sets[b]) >= 0.8):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in ids}
    kept = probminhash.one_of_each(df.union(df.limit(5)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == df.columns


def test_links_of_large_buckets_are_whole(spark):
    texts = sorted({t for t in chains(7) if t and len(t.split()) > 4})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    keys = [set(b) for b in probminhash.bands_of([t for t in texts], 5, 3, 1)]
    sets = [probminhash.shingles(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and keys[a] & keys[b] and probminhash.similarity(sets[a], sets[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    for most in (2, 5, 10_000):
        assert {r.doc_id: r.class_id for r in probminhash.report(df, bands=3, rows=1, most=most).collect()} == dict(enumerate(label))


def test_either_measure_links_texts_with_repeats(spark):
    words = [f"w{k}" for k in range(100)]
    phrase = " ".join(["five words said over again"] * 200)
    texts = [phrase, phrase + " " + " ".join(f"t{k}" for k in range(20)), " ".join(words), " ".join(words + words[:10] * 60)]
    sets = [probminhash.shingles(t) for t in texts]
    assert probminhash.similarity(sets[0], sets[1]) > 0.95 and probminhash.similarity(sets[2], sets[3]) > 0.9
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in probminhash.report(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_similarity_of_weighted_sets():
    a = probminhash.shingles("a b c d e f g h i j")
    assert probminhash.similarity(a, a) == pytest.approx(1.0)
    import numpy as np

    u = (np.array([1, 2], "u8"), np.array([1, 3]))
    v = (np.array([2, 3], "u8"), np.array([3, 1]))
    assert probminhash.similarity(u, v) == pytest.approx(max(1 / 3, 1 / (1 / 3 + 1 + 1 / 3)))


def test_signature_agreement_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(2)
    both, one, two = (r.integers(1, 2**63, n).astype("u8") for n in (80, 10, 10))
    agree = []
    for k in range(60):
        x = probminhash.mix(np.concatenate([both, one]) + np.uint64(k))
        y = probminhash.mix(np.concatenate([both, two]) + np.uint64(k))
        s = probminhash.signatures(np.concatenate([x, y]), np.ones(180), np.repeat([0, 1], 90), 2, 100)
        agree.append((s[0] == s[1]).mean())
    assert np.mean(agree) == pytest.approx(0.8, abs=0.02)


def test_classes_of_nothing(spark):
    df = spark.createDataFrame([(None, "x y z"), (3, "x y z")], "doc_id long, text string")
    assert {r.class_id for r in probminhash.report(df).collect()} == {3}
    assert probminhash.report(df.limit(0)).collect() == []


def test_components(spark):
    links = [(k, k + 1) for k in range(40) if k != 20] + [(5, 5), (3, 2)]
    got = {r.v: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 if k <= 20 else 21 for k in range(41)}
