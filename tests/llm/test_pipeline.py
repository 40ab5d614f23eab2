"""The pipeline's stages against plain versions, each on its own input."""

import random
import zlib

import pytest
import xxhash

import corpus_pipeline
from sheetmill.llm import probminhash, rule_quality, wfst_pieces
from sheetmill.llm.queries import tokenizer
from tests.llm.test_dedup import plain_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture_documents():
    r = random.Random(21)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    passage, item = say(70), "What is the ratio of seven to twelve parts of copper in the alloy described above?"
    texts = [" ".join(say(r.randint(6, 14)) for _ in range(r.randint(2, 8))) for _ in range(60)]
    junk = [" ".join("#$%|" * r.randint(1, 4) for _ in range(40)) for _ in range(30)]
    near = " ".join(say(12) for _ in range(8))
    texts += [near, near, near + " tail", say(40) + " " + passage + " " + say(30), say(35) + " " + passage + " " + say(20), say(20) + " " + item + " " + say(20)]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)]
    rows += [(1000 + k, t, "en", "junk", len(t)) for k, t in enumerate(junk)]
    clean = say(30)
    # Null ids, a shared id, an empty and a null text, a repeated row, a very long text.
    rows += [(None, clean, None, None, None), (None, say(25) + " " + item, "en", "x", 1), (5, say(33), "en", "x", 1), (7, "", "en", "x", 0), (8, None, "en", "x", None), rows[3]]
    rows.append((2000, " ".join(say(9) for _ in range(2500)), "en", "long", 1))
    return rows, [(1, item)], [(k, 1, 0) for k in range(60)] + [(1000 + k, 0, 0) for k in range(30)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, items, labels = fixture_documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def key(r):
    return tuple(str(x) for x in r)


def plain_classes(texts):
    sets = [probminhash.shingles(t or "") for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and ((texts[a] or "") == (texts[b] or "") or probminhash.similarity(sets[a], sets[b]) >= 0.8):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality"](spark, docs, tables)
    model = rule_quality.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"), "quality")
    good = {(r.doc_id, r.text) for r in docs.select("doc_id", "text", rule_quality.score_of(docs.text, model).alias("s")).na.fill({"text": ""}).collect() if (r.s or 1.0) >= 0.3}
    rows = kept.collect()
    assert kept.columns == docs.columns and {r.source for r in rows} >= {"src0", "src1", "src2", "long"} and not [r for r in rows if r.source == "junk"]
    assert {(r.doc_id, r.text) for r in rows if r.text} <= good

    near = stages["near_duplicates"](spark, kept, tables)
    left, label = near.collect(), plain_classes([r.text for r in rows])
    assert near.columns == docs.columns and len(left) == len(set(label))
    first = {}
    for r, c in zip(rows, label):
        first.setdefault(c, []).append(r)
    for group in first.values():
        best = min((r.doc_id is None, r.doc_id or 0) for r in group)
        assert sum(r in group and (r.doc_id is None, r.doc_id or 0) == best for r in left) == 1

    cut = stages["repeated_passages"](spark, near, tables)
    plain = plain_repeats([(r.text or "").encode() for r in left], 200)
    want = sorted(key((*r[:1], None if r.text is None else x[4].decode("utf-8", "ignore"), *r[2:])) for r, x in zip(left, plain))
    parted = cut.collect()
    assert cut.columns == docs.columns and sorted(map(key, parted)) == want and any(x[1] for x in plain)

    decontaminated = stages["decontamination"](spark, cut, tables)
    item = fixture_documents()[1][0][1]
    assert sorted(map(key, decontaminated.collect())) == sorted(key(r) for r in parted if item not in (r.text or ""))

    pieces = stages["pieces"](spark, decontaminated, tables).collect()
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    want = []
    for r in decontaminated.collect():
        ids = library.encode(r.text or "")
        raw = b"".join(i.to_bytes(2, "little") for i in ids)
        want.append(key((r.doc_id, len((r.text or "").encode()), len(ids), xxhash.xxh3_64_intdigest(raw) - 2**63)))
    assert sorted(key(p[:4]) for p in pieces) == sorted(want) and all(p.round_trip for p in pieces)

    whole = corpus_pipeline.run(spark, tables).collect()
    assert sorted(map(key, whole)) == sorted(map(key, pieces))


def test_stages_on_an_empty_table_and_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tables).collect() == [], name
    more = docs.limit(4).selectExpr("*", "1 as row", "2 as tk", "3 as _hit", "4 as kept", "5 as score", "6 as label", "7 as _tk")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, more, tables).columns == more.columns, name


def test_pieces_of_every_text_are_those_of_the_library(spark):
    import sentencepiece

    sf = "/root/testdata/sf0.01"
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in wfst_pieces.piece_digest(docs, tokenizer()).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_pieces, r.ids_hash) == (len(ids), xxhash.xxh3_64_intdigest(b"".join(i.to_bytes(2, "little") for i in ids)) - 2**63)


def test_folds_are_those_of_crc32(spark):
    from pyspark.sql import functions as F

    from sheetmill.llm.common import fold

    got = spark.range(50).select("id", fold(F.col("id"), 10).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 10 for r in got)
