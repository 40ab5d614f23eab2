"""Whole outputs of operators that SQL cannot express, against literals and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from sheetmill.functions import dicts
from sheetmill.operators import extraction, maintenance, retrieval, rules, tables, text


def column(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(make(F.col("t")).alias("x")).first().x


def plain_packed(sentences, size=800, overlap=200):
    out, current = [], []
    width = lambda a: len(" ".join(a))
    parts = [s[k : k + size] for s in sentences for k in (range(0, len(s), size - overlap) if len(s) > size else (0,))]
    for s in parts:
        if current and width([*current, s]) > size:
            out.append(" ".join(current))
            tail = next((current[k:] for k in range(len(current)) if width(current[k:]) <= overlap), [])
            current = tail if width([*tail, s]) <= size else []
        current = [*current, s]
    return out + ([" ".join(current)] if current else [])


def test_packed_chunks_are_those_of_a_plain_packer(spark):
    r = random.Random(2)
    docs = []
    for k in range(12):
        docs.append([" ".join("".join(r.choices("abcdef", k=r.randint(2, 9))) for _ in range(r.randint(3, 40))) + "." for _ in range(r.randint(1, 30))])
    docs.append([" ".join(["word"] * 26_000) + "."])  # one sentence of 130,000 signs
    docs.append(["Short.", " ".join(["long"] * 300) + ".", "End."])
    df = spark.createDataFrame([(k, 1, " ".join(s)) for k, s in enumerate(docs)], "document_id long, page int, text string")
    got = {}
    for x in text.packed_chunks(df).orderBy("document_id", "pos").collect():
        got.setdefault(x.document_id, []).append(x.chunk)
    assert got == {k: plain_packed(s) for k, s in enumerate(docs)}


def test_windows_cover_a_long_text(spark):
    t = " ".join(str(k) for k in range(26_000))
    df = spark.createDataFrame([(1, 1, t), (2, 1, ""), (3, 1, None)], "document_id long, page int, text string")
    rows = text.windows_of(df).orderBy("start").collect()
    assert "".join(x.chunk[: 600 if k + 1 < len(rows) else None] for k, x in enumerate(rows)) == t and {x.document_id for x in rows} == {1}


@pytest.mark.parametrize(
    "lines,want",
    [
        (["VCC = 5 V typical", "plain words"], ["VCC = 5 V typical", "plain words"]),
        (["keep", r"\\begin{tabular} a", "lost in it", "Electrical Characteristics"], ["keep"]),
        (["Package Dimensions", "1.2 3.4", "Electrical Characteristics", "after"], ["Electrical Characteristics", "after"]),
        (["Figure 3 gain", "0.1", "0.2"], []),
        (["1 2 3 4 five", "x", "", "tail"], ["tail"]),
        (["Figure 1", *["noise"] * 21, "back"], ["back"]),
        (["A123 left over", "B456 "], ["left over"]),
        (["Supply 3 V for cores", "VIN (V)", "junk"], ["Supply 3 V for cores"]),
        ([f"row {k} " + "12 mA " * 40 for k in range(7)] + ["end"], [(f"row {k} " + "12 mA " * 40).strip() for k in range(5)]),
    ],
)
def test_query_time_text(spark, lines, want):
    assert column(spark, "\n".join(lines), text.query_time_text) == "\n".join(want)


def test_scanned_text(spark):
    df = spark.createDataFrame(
        [(1, "HIGH-LEVEL output voltage V OH 2.4 3.4 V IOH -4 mA LOW-LEVEL V OL 0.2 0.4 V"), (2, "nothing 3.3"), (3, "VIL input 0.8 1.2 IIL LEAKAGE 0.5")],
        "table_id long, content string",
    )
    got = {(x.table_id, x.param): (x.min_value, x.typ_value, x.max_value, x.unit) for x in tables.scanned_text(df).collect()}
    assert got[1, "VOH"] == (2.4, 3.4, None, "V") and got[1, "IOH"] == (-2.4, None, None, "mA") and got[1, "VOL"] == (None, 0.2, 0.4, "V")
    assert got[3, "VIL"] == (None, None, 0.8, "V") and got[3, "IIL"] == (0.5, None, None, "µA") and not [k for k in got if k[0] == 2]


def test_enriched_queries(spark):
    x = lambda q: column(spark, q, extraction.enriched_query)
    assert x("NE5532 amplifier") == "NE5532 amplifier ne5532电路 ne5532运放 ne5532 5532电路 5532运放 5532"
    assert x("滤波") == "滤波 filter LPF HPF"
    assert x("unknown thing") == "unknown thing unknown thing电路"


def test_pairs_of_parts(spark):
    assert column(spark, "can SN74HC04 drive 74HC04 or LM358?", extraction.driver_and_receiver) == ["SN74HC04", "LM358"]


def test_captions(spark):
    x = lambda t: column(spark, t, lambda c: text.caption(c, F.lit("filter")))
    long = "a" * 120 + "。" + "b" * 120
    assert x("**Gain** `of` two [1]") == "Gain of two" and x(long) == "a" * 120 + "。" and x("") == "filter figure" and x("c" * 300) == "c" * 200


def test_annotations(spark):
    df = spark.createDataFrame([(1, "a schematic with an amplifier, NE5532", "circuit_diagram"), (2, "a photo", "photo"), (3, "circuit and filter", None)], "image_id long, response string, clip_type string")
    got = {x.image_id: (x.types, x.components, round(x.confidence, 2)) for x in text.annotations(df).collect()}
    assert set(got) == {1, 3} and got[1][0] == ["circuit_diagram", "amplifier"] and got[1][1] == ["NE5532"] and got[1][2] == 0.85 and got[3][2] == 0.7


def test_acceptance(spark):
    rows = [(1, "A fine answer about 5 V supplies."), (2, "Traceback (most recent call last): x"), (3, "Same sentence here. " * 12), (4, "abc")]
    df = spark.createDataFrame(rows, "k long, text string")
    assert {x.k: x.verdict for x in text.accepted(df, ["k"]).collect()} == {1: "original", 2: "rejected", 3: "deduped", 4: "rejected"}


def test_sentences_have_their_places(spark):
    df = spark.createDataFrame([(1, 1, "One.  Two is 3.5 V! 三。End")], "document_id long, page int, text string")
    got = [(x.sentence, x.start, x.end) for x in text.sentences(df).orderBy("pos").collect()]
    t = "One. Two is 3.5 V! 三。End"
    assert [s for s, _, _ in got] == ["One.", "Two is 3.5 V!", "三。", "End"] and all(t[a:b] == s for s, a, b in got)


def test_containing_is_a_substring_search(spark):
    r = random.Random(3)
    hay = [(k, "".join(r.choices("abc", k=r.randint(0, 14)))) for k in range(300)]
    needles = sorted({"".join(r.choices("abc", k=r.randint(1, 7))) for _ in range(60)} | {"zzzzz"})
    got = {(x.needle, x.row_id) for x in retrieval.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(hay, "row_id long, hay string")).collect()}
    assert got == {(n, k) for n in needles for k, h in hay if n in h}


def test_retrieve_unites_all_paths(spark):
    q = spark.createDataFrame([(1, "amplifier gain", [1.0, 0.0]), (2, "nothing here", None)], "query_id long, query string, q array<double>")
    chunks = spark.createDataFrame([(1, "d1", "amplifier gain is high"), (2, "d2", "filter"), (3, "d1", "gain only")], "doc_id long, document_id string, text string")
    v = spark.createDataFrame([(2, [1.0, 0.1]), (1, [0.0, 1.0])], "doc_id long, v array<double>")
    t = spark.createDataFrame([(1, "d3", "amplifier | gain | 3")], "doc_id long, document_id string, text string")
    rows = retrieval.retrieve(q, chunks, v, t, 5).orderBy("query_id", "rank").collect()
    got = {x.chunk_id: x.sources for x in rows if x.query_id == 1}
    assert got == {"1": ["bm25", "vector"], "2": ["vector"], "3": ["bm25"], "t1": ["table"]} and rows[0].chunk_id == "1" and rows[0].score == 1.0
    assert {x.query_id for x in rows} == {1}


def test_tokenizer_and_rules_are_arguments(spark):
    docs = spark.createDataFrame([(1, "a-b a"), (2, "b")], "doc_id long, text string")
    letters = lambda c: F.split(c, "[- ]")
    assert sorted((x.term, x.doc_id, x.tf) for x in retrieval.postings(docs, tokenizer=letters).collect()) == [("a", 1, 2), ("b", 1, 1), ("b", 2, 1)]
    table = spark.createDataFrame([("x", "y", 3.0)], "driver string, receiver string, volts double")
    own = rules.Rule(1, "OWN", F.lit(True), F.col("volts") > 2, F.col("volts") - 2, rules.ERROR)
    assert [(r.rule_id, r.passed, r.margin) for r in rules.check_pairs(table, dicts.degradation(spark), layers=(1,), rules=[own]).collect()] == [("OWN", True, 1.0)]


def test_index_counts(spark):
    one = lambda n: spark.createDataFrame([(1, k) for k in range(n)] + [(2, 0)], "document_id long, k int")
    got = {x.document_id: (x.chunk_count, x.posting_count, x.table_count) for x in maintenance.index_counts(one(3), one(2), one(1).where("document_id = 1")).collect()}
    assert got == {1: (3, 2, 1), 2: (1, 1, 0)}
