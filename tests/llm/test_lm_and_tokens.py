"""Language-model scores, token counts and the piece transducer against plain versions."""

import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from sheetmill.llm import kneser_ney, token_counts, wfst_pieces
from sheetmill.llm.queries import tokenizer

ODD = ["", " ", "  ", "a ", "a  ", " a", "   a b   c  ", "日本語 text 😀", "x\n\ny\t z", " " * 3000 + "a", "a" * 3000, "ab " * 2000, "a  b   c    " * 500, "\x00a", "z" * 1700 + " " + "y" * 1700, "é è", None]


def odd(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "null id", "y"), (0, "", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer())


@pytest.mark.parametrize("chunk,overlap", [(16_384, 512), (64, 4)])
def test_token_counts(spark, sf, library, chunk, overlap):
    docs = odd(spark).select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 100, "text"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in token_counts.count_tokens(docs, tokenizer(), chunk=chunk, overlap=overlap).collect():
        assert (r.n_bytes, r.n_tokens) == (len(text[r.doc_id].encode()), len(library.encode(text[r.doc_id]))), text[r.doc_id][:40]


def test_token_report_of_nothing_and_limits(spark):
    assert token_counts.token_report(odd(spark).limit(0), tokenizer()).collect() == []
    assert {r.over_limit for r in token_counts.token_report(odd(spark), tokenizer(), 100).collect()} == {True, False}


def test_transducer_gives_the_byte_pair_ids(spark, sf, library):
    m = wfst_pieces.machine(tokenizer())
    texts = [t or "" for t in ODD] + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in texts:
        assert m.encode(t) == library.encode(t)
        assert m.decode(m.encode(t)) == t
    assert m.decode(m.encode("a▁b")) == "a b"


def test_piece_tables(spark):
    rows = wfst_pieces.encode_pieces(odd(spark), tokenizer()).collect()
    assert len(rows) == len(ODD) + 2 and all(r.decoded == (ODD[r.doc_id] or "" if r.doc_id is not None else "null id") for r in rows)
    digest = {r.doc_id: r for r in wfst_pieces.piece_digest(odd(spark), tokenizer()).collect()}
    assert all(d.round_trip for d in digest.values()) and digest[0].n_pieces == 0


def plain_model(train, order=None):
    words = lambda t: (t or "").encode().lower().split()
    lists = [words(t) for t in train]
    c = collections.Counter(w for x in lists for w in x + [None])
    grams = collections.Counter(p for x in lists for p in zip([0, *x], [*x, None]))
    total, kinds, before = collections.Counter(), collections.defaultdict(collections.Counter), collections.Counter()
    for (a, b), n in grams.items():
        total[a] += n
        kinds[a][min(n, 3)] += 1
        before[b] += 1
    of = lambda x: kneser_ney._discounts(tuple(collections.Counter(x.values())[k] for k in (1, 2, 3, 4)))
    d, dw, types = of(grams), of(before), max(len(grams), 1)
    gamma = sum(dw[min(v, 3) - 1] for v in before.values()) / types if grams else 1.0
    less = lambda n, k: max(n - k[min(n, 3) - 1], 0) if n else 0.0
    one = lambda w: less(before[w], dw) / types + gamma / (len(c) + 1)

    def two(a, w):
        if a not in total:
            return one(w)
        return less(grams[a, w], d) / total[a] + sum(d[k - 1] * kinds[a][k] for k in (1, 2, 3)) / total[a] * one(w)

    n = sum(c.values())

    def score(t):
        x = words(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in [*x, None])
        return len(x) + 1, sum(c[w] > 0 for w in [*x, None]), n, base, sum(math.log10(two(a, b)) for a, b in zip([0, *x], [*x, None]))

    return score


def test_scores_equal_a_plain_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd(spark).select(F.col("doc_id") + 10_000, "text"))
    rows = docs.where("doc_id is not null").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    score = plain_model([r.text for r in rows if not held(r.doc_id)])
    text = {r.doc_id: r.text for r in rows}
    got = kneser_ney.cross_validated(docs).collect()
    assert len(got) == docs.count()
    gain = 0.0
    for r in got:
        if r.doc_id is None:
            continue
        n, known, total, base, own = score(text[r.doc_id])
        assert r.held_out == held(r.doc_id) and (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(own, rel=1e-6)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def test_no_training_text(spark):
    empty = odd(spark).limit(0)
    model = kneser_ney.train(empty)
    assert kneser_ney.score(empty, model).collect() == []
    assert {round(r.score, 9) for r in kneser_ney.score(odd(spark).where("doc_id = 1"), model).collect()} == {0.0}
