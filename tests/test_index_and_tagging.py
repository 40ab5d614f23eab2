"""Dictionary tagging, segmentation, linear folds, figures and the stored index, against plain versions."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetmill.functions import dicts
from sheetmill.functions.folds import prefix_sums, scan
from sheetmill.functions.values import CAPTION_CLASS_WORDS, CIRCUIT_WORDS
from sheetmill.operators import cells, extraction, figures, late, maintenance, retrieval, tables, tagging, text
from sheetmill.sources import index_store
from sheetmill.streaming import ingest

WORDS = "word string, tag string, tag_no int"


def test_scan_is_a_fold_that_gives_rows(spark):
    items = list(range(1, 700))
    d = spark.createDataFrame([(items,), ([],)], "x array<long>")
    kept = scan(F.col("x"), F.lit(0).cast("long"), lambda s, x: (s + x, F.when(s % 2 == 0, F.array(s + x)).otherwise(F.array().cast("array<bigint>"))), "bigint", lambda s: F.array(s))
    got = [r.x for r in d.select(kept.alias("x")).collect()]
    want, s = [], 0
    for x in items:
        want += [s + x] if s % 2 == 0 else []
        s += x
    assert got == [[*want, s], [0]] and [r.x for r in d.select(prefix_sums(F.col("x")).alias("x")).collect()] == [[0, *itertools.accumulate(items)], [0]]


def test_chunks_of_a_hundred_thousand_sentences(spark):
    sentences = [f"Sentence number {k}." for k in range(100_000)]
    rows = text.packed_chunks(spark.createDataFrame([(1, 1, " ".join(sentences))], "document_id long, page int, text string")).orderBy("pos").collect()
    assert rows[0].chunk.startswith(sentences[0]) and rows[-1].chunk.endswith(sentences[-1]) and max(len(r.chunk) for r in rows) <= 800
    places = [sentences.index(r.chunk[: r.chunk.index(".") + 1]) for r in rows[:50]]
    assert places == sorted(places) and [r.pos for r in rows] == list(range(len(rows)))


def test_chunking_shuffles_nothing(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")
    assert "Exchange" not in text.packed_chunks(d)._jdf.queryExecution().executedPlan().toString()


def test_tags_are_those_of_plain_search(spark):
    r = random.Random(3)
    classes = [*CIRCUIT_WORDS, ("double", ["gain", "g"])]
    known = [w for _, ws in classes for w in ws]
    texts = ["", None, "nothing", *(" ".join(r.choices([*known, "xx", "gainful"], k=r.randrange(1, 6))) for _ in range(100))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    dictionary = dicts.tag_words(spark, classes)
    want = {k: [tag for tag, ws in classes if any(w in (t or "") for w in ws)] for k, t in enumerate(texts)}
    for part in (200_000, 40):  # one automaton, or several
        tags = tagging.tagger(dictionary, part)
        assert {x.k: x.tags for x in df.select("k", tags(F.col("t")).alias("tags")).collect()} == want
    places = tagging.occurrences(df, dictionary, "k", "t", 40).collect()
    plain = sorted((k, tag, w, p) for k, t in enumerate(texts) for tag, ws in classes for w in ws for p in range(len(t or "")) if (t or "").startswith(w, p))
    assert sorted(map(tuple, places)) == plain


def test_empty_dictionaries(spark):
    df = spark.createDataFrame([("放大器 amplifier",)], "t string")
    assert df.select(tagging.tagger(spark.createDataFrame([], WORDS))(F.col("t")).alias("x")).first().x == []
    cut = tagging.segmenter(spark.createDataFrame([], "word string, weight double"))
    assert df.select(cut(F.col("t")).alias("x")).first().x == ["放大", "大器", "amplifier"]


def test_captions_follow_their_own_dictionary(spark):
    df = spark.createDataFrame([("低通 LPF Power 555", "sketch"), ("lpf", "logo"), (None, None)], "t string, label string")
    x = [r.x for r in df.select(text.circuit_types(F.col("t"), tagging.tagger(dicts.caption_words(spark)), F.coalesce("label", F.lit("other"))).alias("x")).collect()]
    assert x == [["sketch", "filter", "power", "timer"], ["unknown"], ["unknown"]] and len(CAPTION_CLASS_WORDS) == 12


def test_the_cheapest_path_is_that_of_all_paths():
    r = random.Random(4)
    for _ in range(200):
        run = "".join(r.choices("甲乙丙丁", k=r.randrange(1, 9)))
        words = {"".join(r.choices("甲乙丙丁", k=r.randrange(1, 4))): r.choice([0.5, 1.0, 2.0]) for _ in range(6)}
        arcs = {}
        for a in range(len(run)):
            for b in range(a + 1, len(run) + 1):
                if run[a:b] in words:
                    arcs.setdefault(b, []).append((b - a, words[run[a:b]]))
        got = tagging.shortest_path(run, arcs, 5.0)
        cost = lambda ws: sum(min([words.get(w, 9e9), *([5.0] if len(w) == 1 else [])]) for w in ws)
        every = [[run[i:j] for i, j in itertools.pairwise([0, *cuts, len(run)])] for n in range(len(run)) for cuts in itertools.combinations(range(1, len(run)), n)]
        assert "".join(got) == run and cost(got) == pytest.approx(min(map(cost, every)))


def test_a_chinese_question_finds_a_chunk_by_an_inner_word(spark):
    docs = spark.createDataFrame([(1, "这是一个同相放大器电路的增益"), (2, "低通滤波器"), (3, "nothing here")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "放大器"), (8, "滤波器的")], "query_id long, query string")
    cut = tagging.segmenter(dicts.chinese_words(spark), retrieval.STOP_WORDS)
    for tokenizer in (retrieval.tokens, cut):
        assert {(r.query_id, r.doc_id) for r in retrieval.bm25(asked, docs, tokenizer=tokenizer).collect()} == {(7, 1), (8, 2)}
    words = docs.select(cut(F.col("text")).alias("w")).first().w
    assert "放大器" in words and "的" not in words and docs.where("doc_id = 2").select(retrieval.expanded(cut(F.col("text"))).alias("w")).first().w[-1] == "filter"


def test_words_of_mixed_and_long_runs(spark):
    t = spark.createDataFrame([("A放b大器cd 一个 x",), ("放" * 20_000,), (None,)], "t string").select(retrieval.tokens(F.col("t")).alias("w")).collect()
    assert t[0].w == ["大器", "cd"] and len(t[1].w) == 19_999 and t[2].w == []


QUERIES = [(1, "ne5532 amplifier"), (2, "filter r1"), (3, "title"), (4, "H桥 driver lm358"), (5, ""), (6, "zz yy")]


def plain_relevance(query, words, f):
    file, n = f["filename"].lower().replace(".pdf", ""), max(len(words), 1)
    met = lambda t: sum(w in t for w in words)
    if not words:
        return min(f["visual"], 1.0) * 0.5
    mc, mf = met(f["caption"]), sum(w in file and len(w) >= 2 for w in words)
    caption = 1.0 if query in f["caption"] else min(mc / n * 1.2, 1.0) if mc >= 2 else mc / n
    named = any(any(x in query for x in v) and any(x in file for x in v) for v in figures.CHIP_SYNONYMS.values())
    named = 1.0 if query in file else max(mf / n, 0.8 if named and mf else 0.0)
    return min(caption * 0.3 + met(f["types"]) / n * 0.2 + met(f["parts"]) / n * 0.15 + min(f["visual"] / 1.5, 1.0) * 0.15 + named * 0.2, 1.0)


def plain_bonus(query, f):
    query, caption, types = query.lower(), f["caption"].lower(), f["types"].lower()
    file = f["filename"].lower()
    bonus = 0.15 if any(c in query and (c in caption or c in file) for c in figures.RANKED_CHIPS) else 0.0
    for ws in CAPTION_CLASS_WORDS.values():
        if any(w.lower() in query for w in ws):
            bonus += sum(0.05 * (w.lower() in caption) + 0.08 * (w.lower() in types) for w in ws)
    return min(bonus, 0.3)


def test_figures_are_ranked_as_by_all_pairs(spark):
    r = random.Random(6)
    rows = [
        {"image_id": k, "caption": " ".join(r.choices(["title", "filter", "ne5532 amplifier", "driver h桥", "plain", "lm358"], k=2)), "types": r.choice(["amplifier", "filter lpf", "", "driver"]), "parts": r.choice(["r1 c1", "u1", ""]), "filename": r.choice(["NE5532.pdf", "sheet.pdf", "lm358_r1.pdf"]), "visual": r.randrange(0, 18) / 10}
        for k in range(60)
    ]
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    f = spark.createDataFrame(rows, "image_id long, caption string, types string, parts string, filename string, visual double")
    words = {x.query_id: x.w for x in q.select("query_id", figures.query_keywords(F.col("query")).alias("w")).collect()}
    relevance, bonus = figures.figure_relevance(q, f), figures.rank_bonus(q, f)
    pairs = {(x.query_id, x.image_id): x.relevance for x in relevance.collect()}
    rest = {x.image_id: (x.rest, x.wordless) for x in figures.figure_constants(f).collect()}
    every = {(i, g["image_id"]): plain_relevance(t.lower(), words[i], g) for i, t in QUERIES for g in rows}
    assert {k: pytest.approx(v) for k, v in every.items()} == {k: pairs.get(k, rest[k[1]][not words[k[0]]]) for k in every} and 0 < len(pairs) < len(every)
    total = {k: min(v + plain_bonus(dict(QUERIES)[k[0]], rows[k[1]]), 1.0) for k, v in every.items()}
    want = {i: sorted((g for q_, g in total if q_ == i), key=lambda g: (-round(total[i, g], 9), g))[:5] for i, _ in QUERIES}
    got = {}
    for x in figures.ranked_figures(q, f, relevance, bonus).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.image_id)
    assert got == want


def test_figure_plans_write_no_pairs(spark):
    f = spark.createDataFrame([], "image_id long, caption string, types string, parts string, filename string, visual double")
    plan = figures.figure_relevance(spark.createDataFrame(QUERIES, "query_id long, query string"), f)._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" not in plan and "Cross" not in plan


def store_of(spark, folder):
    pages = lambda rows: spark.createDataFrame(rows, "document_id string, page int, text string")
    ingest.index_pages(pages([("a", 1, "Red gain. Blue gain."), ("a_p_b", 1, "Red volts."), ("c", 1, "Green amps.")]), folder, 0)
    for _ in range(2):  # the second time is a replay
        ingest.index_pages(pages([("c", 1, "Red amps."), ("d", 2, "Violet."), ("e", 1, "")]), folder, 1)
    index_store.add(spark, folder, 2, index_store.stored(spark, folder, "chunks").where("false"), spark.createDataFrame([("a",)], "document_id string"))
    return spark.createDataFrame([(1, "red amps"), (2, "gain"), (3, "violet green")], "query_id long, query string")


def test_search_over_the_store_is_batch_search_over_what_lives(spark, tmp_path):
    folder = str(tmp_path / "store")
    asked = store_of(spark, folder)
    alive = spark.createDataFrame([("a_p_b_p1_c0", "Red volts."), ("c_p1_c0", "Red amps."), ("d_p2_c0", "Violet.")], "doc_id string, text string")
    key = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 12), r["rank"]) for r in df.collect())
    assert key(index_store.search(spark, folder, asked)) == key(retrieval.bm25(asked, alive)) != []
    assert tuple(index_store.corpus(spark, folder).first()) == (3, 5 / 3) and index_store.inconsistencies(spark, folder).count() == 0
    assert index_store.live(spark, folder, "vectors").count() == 3
    # A batch that was written but not committed does not exist.
    index_store.add(spark, folder, 3, spark.createDataFrame([("z_p1_c0", "z", 1, "Red red.")], "chunk_id string, document_id string, page int, chunk string"))
    (tmp_path / "store" / "manifest" / "batch=3").rename(tmp_path / "hidden")
    assert key(index_store.search(spark, folder, asked)) == key(retrieval.bm25(asked, alive))


def test_a_search_reads_the_buckets_of_its_words_only(spark, tmp_path):
    folder = str(tmp_path / "store")
    asked = store_of(spark, folder).where("query_id = 2")
    plan = index_store.search(spark, folder, asked)._jdf.queryExecution().executedPlan().toString()
    bucket = asked.select(index_store.bucket_of(F.lit("gain")).alias("b")).first().b
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "/postings" in line)
    assert re.search(rf"PartitionFilters: \[.*bucket#\d+ (= {bucket}\b|IN \({bucket}\))", scan)


def test_documents_whose_id_holds_the_mark_go_and_others_stay(spark):
    store = spark.createDataFrame([("x", "a_p_b_p1_c0"), ("x", "a_p1_c0"), ("a_p_b", "other"), ("y", "ab_p1"), ("z", None)], "document_id string, chunk_id string")
    gone = spark.createDataFrame([("a_p_b",)], "document_id string")
    assert {tuple(r) for r in maintenance.without_documents(store, gone).collect()} == {("x", "a_p1_c0"), ("y", "ab_p1"), ("z", None)}


def test_all_rows_of_a_long_pin_table_count(spark):
    data = [["pin", "name"], *([str(k), "x"] for k in range(1, 100_001)), *([str(k), "x"] for k in range(100_002, 250_000, 2))]
    df = spark.createDataFrame([(1, "pin_configuration", data, 1.0)], "table_id long, table_type string, data array<array<string>>, confidence double")
    pins = [int(r[0]) for r in data[1:]]
    share = sum(b - a > 1 for a, b in itertools.pairwise(pins)) / len(pins)
    assert tables.pin_gap_penalty(df).first().confidence == pytest.approx(1 - share * 0.5)


def test_substring_look_up_equals_plain_search_and_leaves_texts_behind(spark):
    r = random.Random(1)
    hays = ["".join(r.choices("abc", k=r.randrange(0, 30))) for _ in range(150)] + ["", None, "x" * 20_000, "放大器电路的增益"]
    needles = sorted({"".join(r.choices("abc", k=r.randrange(1, 8))) for _ in range(90)} | {"", "zzzz", "aaaaa", "xxxxxx", "电路的增", "增益"})
    rows = spark.createDataFrame(list(enumerate(hays)), "row_id long, hay string")
    found = retrieval.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), rows)
    assert {tuple(x) for x in found.collect()} == {(n, k) for n in needles for k, h in enumerate(hays) if h is not None and n in h}
    before = found._jdf.queryExecution().optimizedPlan().toString().split("Filter Contains")[0]
    assert "_part" not in before


@pytest.mark.parametrize(
    "answer,want",
    [
        (None, ""),
        ("", ""),
        ("Short.", ""),
        ("<think>so</think>The supply voltage is 5 V. The supply voltage is 5 V.", "The supply voltage is 5V."),
        ("Thinking Process: step one\nSupply voltage is 12 V. It is stable enough.", "Supply voltage is 12V.\nIt is stable enough."),
        ("Thinking Process: nothing that answers", ""),
        ("Let me think: 该芯片的电源电压为 5 V，输出电流最大。", "该芯片的电源电压为 5V，输出电流最大。"),
        ("The output current is 20 mA here. user: what next", "The output current is 20mA here."),
        ("First good sentence.\n\n\nSecond sentence is dropped.", "First good sentence."),
        ("**Gain** is &lt; 5. 5 V for this part.", "Gain is < 5.\n5V for this part."),  # a sentence ends at every stop
        ("Answer:\n```markdown\nThe gain is one hundred.\n```", "The gain is one hundred."),
        ("ok **x** y", ""),
        ("**a** or b?", "a or b?"),
        ("a. b. c. d. e. f.", "a. b. c. d. e. f."),
        ("Wait, the limit is 7. 5 A for all parts.", "the limit is 7.\n5A for all parts."),
    ],
)
def test_answers_are_cleaned(spark, answer, want):
    assert spark.createDataFrame([(answer,)], "t string").select(text.cleaned_answer(F.col("t")).alias("x")).first().x == want


def test_of_many_sentences_twelve_stay(spark):
    long = " ".join(f"Fact {k:03d} stands here." for k in range(40)) + " Fact 000 stands here."
    x = spark.createDataFrame([(long,)], "t string").select(text.cleaned_answer(F.col("t")).alias("x")).first().x
    assert x.split("\n") == [f"Fact {k:03d} stands here." for k in range(12)]


def test_later_stages_see_open_pairs_only(spark):
    wanted = spark.createDataFrame([(c, p) for c in ("a", "b", "c") for p in ("VOH", "VOL", "IOL")], "chip string, param string")
    tables_ = spark.createDataFrame([("a", "VOH", 3.0, 0.9), ("a", "VOL", 0.2, 0.9), ("a", "IOL", 4.0, 0.9), ("b", "VOH", 2.9, 0.8), ("b", "VOH", 2.8, 0.95), ("z", "VOH", 1.0, 1.0)], "chip string, param string, value double, confidence double")
    texts = spark.createDataFrame([(c, "VOH = 3.3 V\nVOL = 0.3 V") for c in ("a", "b", "c")], "chip string, text string")
    answers = spark.createDataFrame([(c, "IOL: 8 mA [25C]\nVOL: 0.1 V") for c in ("a", "b", "c")], "chip string, response string")
    seen = {}

    def watched(name, stage):
        def run(open_):
            seen[name] = {tuple(r) for r in open_.select("chip", "param").collect()}
            return stage(open_)

        return run

    def ask(asked):
        seen["asked"] = {(r.chip, tuple(r.asked)) for r in asked.collect()}
        return asked.join(answers, "chip")

    params = ["VOH", "VOL", "IOL"]
    stages = [watched("tables", extraction.stage_of_tables(tables_)), watched("texts", extraction.stage_of_texts(texts, params)), watched("answers", extraction.stage_of_responses(ask, params))]
    got = {(r.chip, r.param): (r.value, r.stage) for r in extraction.cascade(wanted, stages).collect()}
    assert got == {("a", "VOH"): (3.0, 1), ("a", "VOL"): (0.2, 1), ("a", "IOL"): (4.0, 1), ("b", "VOH"): (2.8, 1), ("b", "VOL"): (0.3, 2), ("c", "VOH"): (3.3, 2), ("c", "VOL"): (0.3, 2), ("b", "IOL"): (8.0, 3), ("c", "IOL"): (8.0, 3)}
    assert len(seen["tables"]) == 9 and len(seen["texts"]) == 5 and seen["answers"] == {("b", "IOL"), ("c", "IOL")} and seen["asked"] == {("b", ("IOL",)), ("c", ("IOL",))}


def test_probing_cells_finds_what_plain_search_finds(spark, monkeypatch):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 8))
    rows = [(k, [float(x) for x in centres[k % 12] + 0.1 * r.normal(size=8)]) for k in range(400)]
    rows += [(1_000 + k, rows[5][1]) for k in range(150)]  # many alike
    rows += [(2_000, [0.0] * 8), (2_001, [-x for x in rows[5][1]]), (2_002, None), (2_003, [])]
    asked = [(1, rows[5][1]), (2, [0.0] * 8), (3, rows[7][1]), (4, [-x for x in rows[7][1]]), (5, None)]
    v = spark.createDataFrame(rows, "doc_id long, v array<double>")
    q = spark.createDataFrame(asked, "query_id long, q array<double>")
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1.0)
    want = {}
    for i, x in asked[:4]:
        s = {k: round(float(np.clip(unit(x) @ unit(y), 0, 1)), 9) for k, y in rows if y}
        want[i] = sorted(s, key=lambda k: (-s[k], k))[:20]
    monkeypatch.setattr(cells, "PART", 40)
    index, made = cells.cell_index(v, 12)
    got = {}
    for x in cells.nearest(q, index, made, 20).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.doc_id)
    assert got == want
    # A query within a cluster leaves most cells alone.
    near = cells._probes(q.where("query_id = 3"), made, 20).collect()
    assert sum(x.early or x.bound >= 0.9 for x in near) <= 4 < len(near)
    assert retrieval.dense(q, v.limit(0), 5).count() == 0


def test_a_stream_stores_what_the_batch_fold_stores(spark, tmp_path):
    r = random.Random(8)
    times = sorted(r.randrange(0, 4_000) for _ in range(300))
    rows = [(r.randrange(6), k, t) for k, t in enumerate(times)]
    log = spark.createDataFrame(rows, "document_id long, entry long, at long")
    want = {tuple(x) for x in maintenance.kept_within_ttl(log, "document_id", 500).select("document_id", "at", "entry").collect()}
    timed = log.withColumn("ts", F.timestamp_seconds("at")).select("document_id", "entry", "ts")
    for k in range(3):  # three batches, one after the other in time
        timed.where(F.col("entry").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    q = ingest.stored_entries(stream, 500).writeStream.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/batch={k}")).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(x) for x in spark.read.parquet(out).select("document_id", "at", "entry").collect()} == want
    plain, last = set(), {}
    for d, e, t in sorted(rows, key=lambda x: (x[2], x[1])):
        if d not in last or t - last[d] >= 500:
            last[d] = t
            plain.add((d, t, e))
    assert plain == want


@pytest.mark.parametrize(("how", "threshold"), [("avg", 0.0), ("sum", -5.0)])
def test_late_interaction_by_bounds_is_that_of_all_pairs(spark, how, threshold):
    r = np.random.default_rng(8)
    heads = r.normal(size=(30, 16))
    images = [[(heads[i % 30] + 0.05 * r.normal(size=16)).tolist() for _ in range(4)] for i in range(300)]
    images[7], images[8] = [[0.0] * 16], images[9]  # no direction; equal images
    patches = [(i, p, v) for i, ps in enumerate(images) for p, v in enumerate(ps)] + [(400, 0, None)]
    asked = {0: images[3][:3], 1: [(-heads[2]).tolist(), images[9][0]], 2: [[0.0] * 16]}
    tokens = spark.createDataFrame([(q, t, v) for q, vs in asked.items() for t, v in enumerate(vs)] + [(2, 9, None)], "query_id long, token_no int, q array<double>")
    table = spark.createDataFrame(patches, "image_id long, patch_no int, v array<double>")
    got = {(x.query_id, x.rank): (x.image_id, round(x.score, 8)) for x in late.max_sim(tokens, table, 5, threshold, how).collect()}
    want = {}
    for q, vs in asked.items():
        each = [cells.unit(np.array(vs)) @ cells.unit(np.array(ps)).T for ps in images]
        scores = [(s.max(axis=1).mean() if how == "avg" else s.max(axis=1).sum(), i) for i, s in enumerate(each)]
        best = sorted((-round(s, 9), i, s) for s, i in scores if s >= threshold)[:5]
        want |= {(q, k): (i, round(s, 8)) for k, (_, i, s) in enumerate(best, 1)}
    assert got == want
    few = tokens.where("query_id = 0").select("query_id", "token_no", retrieval.normalised(F.col("q")).alias("q"))
    index, found = cells.cell_index(table.select(F.struct("image_id", "patch_no").alias("doc_id"), "v"))
    early, surviving = late.early_and_surviving(few, index, found, 5, threshold, how)
    assert early.count() + surviving.count() < 100  # of 300 images


def test_late_interaction_over_empty_tables(spark):
    tokens = spark.createDataFrame([(1, 0, [1.0, 0.0])], "query_id long, token_no int, q array<double>")
    table = spark.createDataFrame([], "image_id long, patch_no int, v array<double>")
    assert late.max_sim(tokens, table).count() == 0
    assert late.max_sim(tokens.limit(0), spark.createDataFrame([(1, 0, [1.0, 0.0])], table.schema)).count() == 0
