"""What many rows ask for is worked out once."""

from sheetmill.operators import knowledge


def test_a_name_is_looked_up_once_among_different_texts(spark, monkeypatch):
    seen, plain = [], knowledge.containing

    def watched(needles, rows, *more):
        seen.append((needles.count(), rows.count()))
        return plain(needles, rows, *more)

    monkeypatch.setattr(knowledge, "containing", watched)
    names = spark.createDataFrame([(k, "blue anvil" if k % 2 else "SN74LS00") for k in range(40)], "query_id int, name string")
    chips = spark.createDataFrame([(f"c{k}", "74LS00" if k % 3 else "CD4000", "a blue anvil 74ls00" if k % 3 == 0 else None) for k in range(30)], "chip_id string, name string, full_name string")
    out = {(r.query_id, r.chip_id, r.level) for r in knowledge.found_chips(names, chips).collect()}
    assert out == {(q, f"c{c}", 2) for q in range(40) for c in range(30) if (c % 3 == 0) == bool(q % 2)}
    assert seen and all(rows <= 2 for _, rows in seen)


def test_words_that_nobody_asks_for_are_not_shuffled(spark):
    import re

    from sheetmill.operators import retrieval

    docs = spark.createDataFrame([(1, "gain of an amplifier"), (2, "noise gain")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "gain")], "query_id int, query string")
    plan = retrieval.bm25(queries, docs)._jdf.queryExecution().executedPlan().toString()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi), re.sub("#[0-9]+", "", plan)


def test_stop_words_and_cjk_runs(spark):
    from sheetmill.operators.retrieval import tokens

    d = spark.createDataFrame([("The Gain of a NE5532, and x",), ("同相放大器 is 好 gain",), (None,), ("",)], "text string")
    assert [r.t for r in d.select(tokens(d.text).alias("t")).collect()] == [["gain", "ne5532"], ["同相", "相放", "放大", "大器", "gain"], [], []]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pins_of_hits_are_dealt_by_query_and_stay_there(spark):
    from sheetmill.operators import extraction

    hits = spark.createDataFrame([("a", 1, "Pin 1: GND", "DIP-14")], "query_id string, rank int, text string, package string")
    pins = extraction.pins_of_hits(hits)
    dealt = [line for line in plan_of(pins.groupBy("query_id").count()).splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]
    assert pins.collect() == [("a", 1, "GND", "ground")]


def test_results_of_a_pair_are_put_together_where_it_was_dealt(spark):
    from sheetmill.functions import dicts
    from sheetmill.operators import rules

    pairs = spark.createDataFrame([(1, 2)], "driver int, receiver int")
    drivers = spark.createDataFrame([(1, 3.0, 0.2, 3.3)], "driver int, voh double, vol double, driver_vcc double")
    receivers = spark.createDataFrame([(2, 2.0, 0.8, 3.3)], "receiver int, vih double, vil double, receiver_vcc double")
    table = rules.paired(pairs, drivers, receivers).withColumns({n: rules.F.lit(0.1) for n in ("ioh", "iol", "iih", "iil")} | {f"{n}_unit": rules.F.lit("mA") for n in ("ioh", "iol", "iih", "iil")})
    results = rules.check_pairs(table, dicts.degradation(spark))
    plan = plan_of(rules.overall_results(rules.layer_results(results)))
    assert "REPARTITION_BY_NUM" in plan and "filter(array(CASE" not in plan
    # The exchange of pairs and those of a join; none by pair or layer.
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(driver" in line and ", receiver" in line]
    assert results.where("layer is null or rule_id is null").isEmpty() and results.count() > 0


def test_rules_are_counted_before_layers_and_all(spark):
    from sheetmill.operators import rules

    rows = [(1, "A", True), (1, "A", False), (1, "B", True), (2, "C", False)]
    report = rules.rule_report(spark.createDataFrame(rows, "layer int, rule_id string, passed boolean"))
    plan = plan_of(report).splitlines()
    below = plan[next(k for k, line in enumerate(plan) if "Expand" in line) :]
    assert any("HashAggregate" in line for line in below)
    assert {tuple(r) for r in report.collect()} == {(0, "all", 4, 2), (1, "all", 3, 1), (2, "all", 1, 1), (1, "A", 2, 1), (1, "B", 1, 0), (2, "C", 1, 1)}


def test_numbers_of_a_table_window_are_read_once(spark):
    from sheetmill.functions import values
    from sheetmill.operators import tables

    scan = {"VIH": values.TABLE_SCAN["VIH"]}
    rows = spark.createDataFrame([(1, "VIH level 2.5 V"), (2, "H-level 9 V, VIH 3"), (3, "nothing"), (4, None)], "table_id int, content string")
    found = tables.scanned_text(rows, scan=scan)
    # Once for each anchor.
    line = next(x for x in plan_of(found).splitlines() if "inline(" in x)
    assert line.count("regexp_extract_all") <= len(scan["VIH"][0])
    assert [tuple(r)[:3] for r in found.orderBy("table_id").collect()] == [(1, "VIH", 2.5), (2, "VIH", 3.0)]


def test_symbols_and_header_cells_are_normalised_once(spark):
    from sheetmill.operators import tables

    rows = spark.createDataFrame([("V_OH", "voh"), ("-", "voh"), (None, "voh"), ("IOH", "oh")], "s string, p string")
    matched = rows.select(tables.symbol_matches(rows.s, rows.p).alias("m"))
    assert plan_of(matched).count("regexp_replace") == 2
    assert [r.m for r in matched.collect()] == [True, False, None, True]
    header = spark.createDataFrame([(["Sym bol", "Min.", "Typ"],)], "h array<string>").select(tables.column_roles(tables.F.col("h")).alias("r"))
    assert plan_of(header).count("regexp_replace") == 1
    r = header.first().r
    assert (r.symbol, r.min, r.typ, r.max) == (0, 1, 2, None)


def test_equal_texts_are_searched_once_and_give_their_first_rows(spark, monkeypatch):
    from sheetmill.operators import retrieval

    seen, plain = [], retrieval.containing

    def watched(needles, rows, *more):
        seen.append(rows.count())
        return plain(needles, rows, *more)

    monkeypatch.setattr(retrieval, "containing", watched)
    texts = ["VOH 23.5 ab", "voh 1 ab", "x VOH 23.5", "none", None, ""]
    rows = [(600 - k, texts[k % 6]) for k in range(600)]
    queries = [(1, "VOH 23.5"), (2, "voh"), (3, "-"), (4, "23.5, voh"), (5, "ab zz")]
    got = retrieval.contains_all(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(rows, "doc_id int, text string"), 7).collect()
    words = {1: ["voh", "23.5"], 2: ["voh"], 4: ["23.5", "voh"], 5: ["ab", "zz"]}
    want = {(q, d, n) for q, ws in words.items() for n, d in enumerate(sorted(i for i, t in rows if t is not None and all(w in t.lower() for w in ws))[:7], 1)}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == want and len(got) == len(want) == 21
    assert seen == [5]


def plain_bm25(queries, docs, k, allowed=None):
    """Plain scores of words split at blanks; ties after nine digits go to the first id."""
    from collections import Counter
    from math import log

    words = {d: t.split() for d, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df, out = Counter(w for ws in words.values() for w in set(ws)), set()
    for q, text in queries:
        hits = []
        for d, ws in words.items():
            s = sum(log((len(words) - df[w] + 0.5) / (df[w] + 0.5) + 1) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in set(text.split()) if w in ws)
            if s > 0 and (allowed is None or (q, d) in allowed):
                hits.append((-round(s, 9), d))
        out |= {(q, d, -s, n) for n, (s, d) in enumerate(sorted(hits)[:k], 1)}
    return out


def test_texts_are_scored_where_they_lie_as_by_plain_search(spark, monkeypatch):
    import random
    import re

    from sheetmill.operators import retrieval

    r = random.Random(5)
    docs = [(f"d{k:03}", " ".join(r.choices(["aa", "bb", "cc", "dd", "ee", "ff"], k=r.randrange(0, 9)))) for k in range(150)] + [(f"c{k:03}", "aa bb cc") for k in range(60)]
    queries = [(1, "aa bb"), (2, "cc"), (3, "none"), (4, "ff ee dd"), (5, "")]
    d, q = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(queries, "query_id int, query string")
    key = lambda df: {(x.query_id, x.doc_id, round(x.score, 9), x["rank"]) for x in df.collect()}
    found = retrieval.bm25(q, d, 12)
    assert key(found) == plain_bm25(queries, docs, 12) != set()
    # Postings are dealt once, by text; pairs are no rows of a join.
    plan = plan_of(found)
    assert "FlatMapCoGroupsInArrow" in plan and not re.search(r"hashpartitioning\(query_id#\d+, doc_id", plan)
    allowed = {(a, b) for a, _ in queries for b, _ in docs[::3]}
    some = retrieval.bm25(q, d, 12, allowed=spark.createDataFrame(sorted(allowed), "query_id int, doc_id string"))
    assert key(some) == plain_bm25(queries, docs, 12, allowed)
    monkeypatch.setattr(retrieval, "ASKED", 2)
    assert key(retrieval.bm25(q, d, 12)) == plain_bm25(queries, docs, 12)


def test_scores_that_are_equal_after_nine_digits_go_to_the_first(spark):
    import numpy as np

    from sheetmill.operators import retrieval

    assert set(retrieval._may_lead(np.array([1.0, 1.0, 1.0 + 1e-12, 0.5, 2.0]), 2)) == {0, 1, 2, 4}
    assert set(retrieval._may_lead(np.array([1.0] * 50 + [0.9]), 3)) == {0, 1, 2}


def test_words_of_a_batch_are_dealt_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from sheetmill.sources import index_store

    plans, write = {}, DataFrameWriter.parquet

    def watched(self, path, *more, **options):
        plans[path.split("/")[-2]] = plan_of(self._df)
        return write(self, path, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    chunks = spark.createDataFrame([("a_p1_c0", "a", 1, "red red gain"), ("b_p1_c0", "b", 1, "the"), ("b_p1_c1", "b", 1, None)], "chunk_id string, document_id string, page int, chunk string")
    index_store.add(spark, str(tmp_path / "s"), 0, chunks)
    assert plans["postings"].count("Exchange hashpartitioning") == 1 and "Generate" not in plans["lengths"]
    rows = lambda name, *cols: {tuple(r) for r in index_store.live(spark, str(tmp_path / "s"), name).select(*cols).collect()}
    assert rows("postings", "term", "chunk_id", "tf") == {("red", "a_p1_c0", 2), ("gain", "a_p1_c0", 1)}
    assert rows("lengths", "chunk_id", "dl") == {("a_p1_c0", 3), ("b_p1_c0", 0), ("b_p1_c1", 0)}


def test_sentences_end_where_the_pattern_of_the_twin_ends_them(spark):
    import random

    from sheetmill.operators import text
    from sheetmill.plans.sql_parts import SENTENCES

    r = random.Random(3)
    rows = [("".join(r.choices([".", ".", " ", "!", "。", "a", "b", "\n", "?"], k=r.randrange(0, 14))),) for _ in range(3000)] + [(None,), ("",), ("v1.2 is a. b... c..d e!? 好。x",)]
    F = text.F
    pattern = SENTENCES.split("'")[1]
    full = lambda a: F.filter(a, lambda s: F.length(s) > 0)
    d = spark.createDataFrame(rows, "t string")
    assert d.where(~full(text.sentence_array(d.t)).eqNullSafe(full(F.regexp_extract_all("t", F.lit(pattern), F.lit(1))))).isEmpty()
    assert "regexp_extract_all" not in plan_of(text.packed_chunks(d.select(F.lit("a").alias("document_id"), F.lit(1).alias("page"), F.col("t").alias("text"))))
