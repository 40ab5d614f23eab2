"""Small literal cases, properties and plans."""

import pytest
from pyspark.sql import functions as F

from sheetmill.functions import dicts
from sheetmill.operators import extraction, maintenance, retrieval, rules, scoring, tables, text
from sheetmill.plans import registry


def one(df):
    return df.first()


def test_condition_parse(spark):
    t, v = extraction.conditions(F.lit("VCC = 5V, 25C"))
    assert tuple(one(spark.range(1).select(t, v))) == (25.0, 5.0)


def test_regex_examples(spark):
    df = spark.createDataFrame([("a", "VOH  Output High Voltage  2.4 V  min"), ("b", "V_OL = 0.4V max when IOL = 8mA")], "chip string, text string")
    got = {(r.chip, r.param): r.value for r in extraction.regex_specs(df, ["VOH", "VOL", "IOL"]).collect()}
    assert got["a", "VOH"] == 2.4 and got["b", "VOL"] == 0.4 and got["b", "IOL"] == 8.0


def pair(spark, driver, receiver):
    cols = "driver string, voh double, vol double, ioh double, ioh_unit string, iol double, iol_unit string, driver_vcc double, driver_process string"
    d = spark.createDataFrame([driver], cols)
    r = spark.createDataFrame([receiver], "receiver string, vih double, vil double, iih double, iih_unit string, iil double, iil_unit string, receiver_vcc double, receiver_package string")
    p = spark.createDataFrame([(driver[0], receiver[0])], "driver string, receiver string")
    out = rules.check_pairs(rules.paired(p, d, r), dicts.degradation(spark), 25.0)
    return {x.rule_id: x for x in out.collect()}


HC04_OUT, HC04_IN = ("74HC04", 4.5, 0.1, -4.0, "mA", 4.0, "mA", 5.0, "CMOS"), ("74HC04", 3.5, 1.0, 0.1, "uA", -0.1, "uA", 5.0, "DIP")


def test_hc04_to_itself(spark):
    r = pair(spark, HC04_OUT, HC04_IN)
    assert r["L1-V001"].margin == pytest.approx(1.0) and r["L1-V002"].margin == pytest.approx(0.9)
    assert r["L1-N001"].passed and r["L1-N001"].margin == pytest.approx(0.9 / 4.4 - 0.2)
    assert r["L1-V000"].passed and r["L2-T001"].passed and "L2-R001" not in r


def test_low_level_driver_fails(spark):
    r = pair(spark, ("STM32F103C8T6", 2.4, 0.4, -20.0, "mA", 20.0, "mA", 3.3, "CMOS"), HC04_IN)
    assert not r["L1-V001"].passed and r["L1-V001"].margin == pytest.approx(-1.1) and not r["L1-V000"].passed


def test_rules_without_inputs_are_absent(spark):
    r = pair(spark, ("x", None, None, None, "mA", None, "mA", None, None), HC04_IN)
    assert not [k for k in r if k.startswith("L1")] and {"L2-T001", "L3-I001", "L3-P001", "L4-P001"} <= set(r)


def test_degradation_golden(spark):
    df = spark.createDataFrame([(3.3,)], "v double")
    x = one(rules.with_degradation(df, dicts.degradation(spark), F.lit("CMOS"), F.lit("DIP"), F.col("v"), "d", 25.0))
    assert (x.d_rate, x.d_factor, x.d_lifetime, x.d_risk) == (pytest.approx(0.1), pytest.approx(0.9), pytest.approx(5000.0), "MEDIUM")


def test_fusion_golden(spark):
    h = spark.createDataFrame([("q", s, "d", "c", "t", 1.0) for s in ("vector", "bm25")], "query_id string, source string, document_id string, chunk_id string, text string, score double")
    assert one(retrieval.fused(h)).score == pytest.approx(0.85 / 61)


def test_adjusted_value_golden(spark):
    df = spark.createDataFrame([("g", 1, "quiescent_current", 10.0, "datasheet_table", 125.0, None)], "group_id string, device int, param string, value double, source string, temperature double, voltage double")
    x = one(scoring.normalised_conditions(df))
    assert x.norm_value == pytest.approx(8.0) and x.confidence == pytest.approx(0.90) and x.adjusted


def test_scores_are_ranked_and_bounded(spark, sf):
    from sheetmill.plans.fixtures import read

    m = scoring.matrix(read(spark, sf, "fx_device_params")).cache()
    assert m.where("norm < 0 or norm > 1 + 1e-9").count() == 0
    w = m.groupBy("group_id", "device").agg(F.sum("weight").alias("w")).where("abs(w - 1) > 1e-9")
    assert w.count() == 0
    s = scoring.device_scores(m).groupBy("group_id").agg(F.countDistinct("rank").alias("a"), F.count("*").alias("b"), F.max("rank").alias("c")).where("a <> b or b <> c")
    assert s.count() == 0


def test_chunks_keep_sizes_and_cover_sentences(spark):
    page = " ".join(f"Sentence number {k} has 3.5V in it." for k in range(60))
    df = spark.createDataFrame([(1, 1, page), (2, 1, ""), (3, 1, None), (4, 1, "x" * 900 + ". End")], "document_id int, page int, text string")
    s = text.sentences(df).where("document_id = 1").orderBy("pos").collect()
    assert len(s) == 60 and all(page[r.start : r.end] == r.sentence for r in s)
    c = text.packed_chunks(df, 200, 50).where("document_id = 1").orderBy("pos").collect()
    assert all(len(r.chunk) <= 200 for r in c)
    for r in s:
        assert any(r.sentence in x.chunk for x in c)
    assert {r.document_id for r in text.packed_chunks(df).collect()} == {1, 4}


def test_chart_noise(spark):
    t = "Intro A001 text\nFigure 3 gain\n1 2 3 4 5 6\nOutput (V)\nskipped\n\nBack in text"
    assert one(spark.createDataFrame([(t,)], "t string").select(text.chart_noise_removed(F.col("t"))))[0] == "Intro text\nBack in text"


def test_markup(spark):
    html = "<html><script>var t='<li>no</li>'</script><!-- <li>x</li> --><ul><li>One &amp; two</li></ul><table><tr><td>a</td><td>b</td></tr></table></html>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert one(df.select(text.markup_text(F.col("html"))))[0] == "One & two a b"
    assert [(r.row_no, r.col_no, r.value) for r in text.markup_cells(df).orderBy("col_no").collect()] == [(0, 0, "a"), (0, 1, "b")]


def test_numbers_of_cells(spark):
    cells = ["2.4V", "2.0 to 5.5", "-", "N/A", "", None, "-4mA", "abc"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string")
    got = [r[0] for r in df.orderBy("k").select(tables.parsed_number(F.col("c"))).collect()]
    assert got == [2.4, 2.0, None, None, None, None, -4.0, None]


def test_ttl_is_not_renewed(spark):
    log = spark.createDataFrame([(1, k, at) for k, at in enumerate([0, 200, 299, 300, 500, 700])], "document_id int, entry long, at long")
    assert sorted(r.entry for r in maintenance.kept_within_ttl(log, "document_id", 300).collect()) == [0, 3, 5]


def test_answers(spark):
    df = spark.createDataFrame([(1, 1, "Traceback (most recent call last)"), (1, 2, "The supply is 5 V. user: next?"), (1, 3, "abc"), (1, 4, "Same sentence here. " * 6)], "conv_id int, turn int, text string")
    got = {r.turn: (r.verdict, r.answer) for r in text.accepted(df, ["conv_id", "turn"]).collect()}
    assert got[1][0] == "rejected" and got[2] == ("original", "The supply is 5 V.") and got[3][0] == "rejected" and got[4] == ("deduped", "Same sentence here.")


def test_pin_names(spark):
    names = {"VCC": "power", "GND": "ground", "1OUT": "output", "2IN+": "input", "PA7": "bidirectional", "NRST": "special"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", extraction.pin_type(F.col("n"))).collect()} == names


@pytest.mark.parametrize("name", ["rt3_jn5_bm25", "rt4_jn6_dense", "er16_layer_rollup", "ag8_ag10_device_scores", "jn3_fallback_lookup"])
def test_plans_stay_in_the_engine(name, spark, sf, capsys):
    registry.queries()[name](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "EvalPython" not in plan and "MapInPandas" not in plan


def test_encoder_hook(spark):
    from sheetmill.sources.tables import encoded

    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None)], "id int, text string")
    got = {r.id: list(r.embedding) for r in encoded(df, lambda ts: [[float(len(t)), 1.0] for t in ts]).collect()}
    assert got == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: [0.0, 1.0]}


def test_page_parser_hook(spark, tmp_path):
    from sheetmill.sources.tables import pages_of_files

    (tmp_path / "a.bin").write_bytes(b"p1\fp2")
    (tmp_path / "b.bin").write_bytes(b"\xff")
    rows = pages_of_files(spark, str(tmp_path), lambda name, raw: raw.decode().split("\f"), "*.bin").collect()
    assert sorted((r.document_id, r.page, r.has_error) for r in rows) == [("a.bin", 1, False), ("a.bin", 2, False), ("b.bin", 1, True)]
