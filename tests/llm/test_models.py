"""Classifiers, filters, search and decontamination."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetmill.llm import onebit_ann, queries, rule_quality, template_decontam, toxicity, url_filter

SMALL = "/root/testdata/sf0.01"


def scores_of(rows, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in held) / len(held), held


def test_quality_on_held_out_rows(spark):
    rows = queries.op9_rule_quality(spark, SMALL).collect()
    right, held = scores_of(rows, queries.table(spark, SMALL, "labels"), "quality")
    assert right > 0.95 and {b for _, b in held} == {0, 1} and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_quality_is_one_projection(spark, capsys):
    docs = queries.table(spark, SMALL, "documents")
    model = rule_quality.RuleModel((rule_quality.Rule((("signs", True, 0.1), ("words", False, 9.0))),), (-2.0,), 1.0)
    rule_quality.scores(docs, model).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan


def test_quality_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "x" * 50_000, "c"), (2, "x", "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one_kind = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    for labels, want in ((none, 0.5), (one_kind, 0.999)):
        model = rule_quality.fit(docs, labels, "quality")
        assert {round(r.score, 6) for r in rule_quality.scores(docs, model).collect()} == {want}
    kept = rule_quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    assert rule_quality.scores(docs.limit(0), model).collect() == []


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op4_toxicity(spark, SMALL).collect()
    right, held = scores_of(rows, queries.table(spark, SMALL, "labels"), "toxic")
    clean = [a for a, b in held if b == 0]
    assert right > 0.9 and sum(clean) <= 0.03 * len(clean)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_what_the_distance_allows():
    words = {w: 1.0 for w in ("idiot", "moron", "worthless", "disgusting", "ass")}
    lexicon, r = toxicity.Lexicon(words, {"vequ": 2.0}), random.Random(4)
    for _ in range(3000):
        w = list(r.choice(list(words)))
        for _ in range(r.randint(0, 3)):
            k, what = r.randrange(len(w) + 1), r.randint(0, 2)
            if what == 0:
                w.insert(k, r.choice("abcdiost"))
            elif w and k < len(w):
                w[k : k + 1] = [] if what == 1 else [r.choice("abcdiost")]
        token = "".join(w)
        allowed = {x: d for x in words if (d := plain_distance(token, x)) <= toxicity.errors_allowed(x)}
        got = lexicon.find(token)
        assert (got is None) == (not allowed) and (got is None or got[0] == min(allowed.values()))
    assert lexicon.find("vequxyz") == (0, 2.0, "vequ") and lexicon.find("veq") is None


def test_halves_lose_no_misspelling():
    """All tokens within two edits of a word, wherever they are, are met, and with the least number of errors."""
    letters, words = "aeb", {"abbaeaeb": 1.0, "abeab": 2.0, "abeabbe": 1.5, "eba": 1.0}
    lexicon = toxicity.Lexicon(words, {})
    near = lambda w: {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for d in (0, 1) for c in ("", *letters)}
    tokens = {y for w in words for x in near(w) for y in near(x)}
    assert len(tokens) > 1000
    for token in tokens:
        fits = [(d, -weight, w) for w, weight in words.items() if (d := plain_distance(token, w)) <= toxicity.errors_allowed(w)]
        want = min(fits, default=None)
        assert lexicon.find(token) == (want and (want[0], -want[1], want[2]))


def test_quotation_weighs_less_than_abuse():
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {})
    said = dict(zip(toxicity.FEATURES, toxicity.features('the article said "idiot" is a word', lexicon)))
    meant = dict(zip(toxicity.FEATURES, toxicity.features("you are an idi0t! you", lexicon)))
    assert said["quoted"] > 0 == meant["quoted"] and said["abuse"] < meant["abuse"] and meant["fuzzy"] > 0


def test_stems_may_have_one_error_and_common_language_none():
    lexicon = toxicity.Lexicon({"worthless": 3.0}, {"achlich": 2.0}, frozenset({"worthlest"}), {1: 0.6, 2: 0.4})
    assert lexicon.find("achlichkeit") == (0, 2.0, "achlich") and lexicon.find("achljchkeit") == (1, 2.0, "achlich") and lexicon.find("abhljchkeit") is None
    assert lexicon.find("worthles") == (1, 3.0, "worthless") and lexicon.find("worthlest") is None
    one, two = (toxicity.features(t, lexicon) for t in ("a worthless thing", "a worthles thing"))
    assert all(0 < b < a for a, b, f in zip(one, two, toxicity.FEATURES) if f in ("hits", "abuse", "weight", "different", "share"))


def test_states_of_an_automaton_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 50)
    lexicon, r = toxicity.Lexicon({"worthless": 3.0, "disgusting": 2.0}, {}), random.Random(1)
    for _ in range(500):
        lexicon.find("".join(r.choices("worthlesdigun", k=9)))
        assert max(len(lexicon.forward.sets), len(lexicon.backward.sets)) < 50 + 30
    assert lexicon.find("worthles") == (1, 3.0, "worthless")


def edited(word, r):
    k = r.randrange(1, len(word))
    return r.choice([word[:k] + word[k + 1 :], word[:k] + r.choice("bqxz") + word[k:], word[:k] + r.choice("bqxz") + word[k + 1 :]])


def test_misspelled_terms_score_above_clean_rows(spark):
    """One random edit in each term of a held-out toxic row still leaves it above nearly all clean rows."""
    docs, labels = queries.table(spark, SMALL, "documents"), queries.table(spark, SMALL, "labels")
    fold = F.crc32(labels["doc_id"].cast("string")) % 4
    model = toxicity.fit(docs, labels.where(fold != 2), "toxic")
    assert all(w >= 0 for w, f in zip(model.weights, toxicity.FEATURES) if f != "quoted") and all(0 < t <= 1 for t in model.trust.values())
    r, terms = random.Random(9), {w for w in model.words if toxicity.errors_allowed(w)}
    held = docs.join(labels.where(fold == 2), "doc_id").select("doc_id", "text", "toxic").collect()
    rows = []
    for x in held:
        words = x.text.split(" ")
        if x.toxic and any(w.strip(".,").lower() in terms for w in words):
            rows.append((x.doc_id, " ".join(edited(w, r) if w.strip(".,").lower() in terms else w for w in words), "wrong"))
            rows.append((x.doc_id, x.text, "right"))
        elif not x.toxic:
            rows.append((x.doc_id, x.text, "clean"))
    rows += [(-1, "You are a worthles person.", "short"), (-2, "You are pathetlc!", "short"), (-3, "You are a good person.", "calm")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {}
    for s, (_, _, kind) in zip(sorted(toxicity.scores(df, model).collect(), key=lambda s: (s.doc_id, s.exact)), sorted(rows, key=lambda x: (x[0], x[2] == "right"))):
        got.setdefault(kind, []).append(s.score)
    clean = sorted(got["clean"])
    assert len(got["wrong"]) >= 3 and min(got["wrong"]) > clean[int(0.97 * len(clean))] and min(got["short"]) > got["calm"][0] and min(got["short"]) >= 0.3


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "idiot " * 20_000), (2, "fine")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.scores(docs, model).collect()} == {0.5}
    assert toxicity.scores(docs.limit(0), model).collect() == []


def test_toxicity_with_clashing_columns_and_a_tie_at_the_threshold(spark):
    docs = spark.createDataFrame([(1, "you idiot", 9, "x"), (1, "you idiot", 8, "y"), (None, "calm", 7, None)], "doc_id long, text string, label int, score string")
    docs = docs.withColumns({"exact": F.lit("e"), "weight": F.lit(1), "predicted": F.lit("p"), "held_out": F.lit(None).cast("string")})
    labels = spark.createDataFrame([(1, 1, "a"), (1, 0, "b"), (None, 1, "c")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    out = toxicity.scores(docs, toxicity.ToxicModel(model.words, {}, (0.0,) * len(toxicity.FEATURES), 0.0), threshold=0.5).collect()
    assert [(r.score, r.predicted) for r in out] == [(0.5, 1)] * 3 and sorted(r.exact for r in out)[0] == 0.0 < max(r.exact for r in out)


def test_neighbours_equal_exact_search(spark):
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in queries.op6_onebit_ann(spark, SMALL).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = sorted(c.execute(queries.OP6_SQL).fetchall())
    same = len({x[:1] + x[2:3] for x in got} & {x[:1] + x[2:3] for x in want}) / len(want)
    assert len(got) == len(want) and same >= 0.9


def test_neighbours_in_parts_with_ties_and_bad_vectors(spark):
    r = np.random.default_rng(1)
    v = [[float(x) for x in r.standard_normal(16)] for _ in range(300)]
    v[7:60] = [v[7]] * 53  # ties
    rows = list(enumerate(v)) + [(400, None), (420, [0.0] * 16), (440, [float("nan")] * 16), (460, [1.0, None] * 8), (480, [1.0]), (None, v[0])]
    df = spark.createDataFrame([(i, x, "z") for i, x in rows], "vec_id long, embedding array<double>, score string")
    got = onebit_ann.search(df, F.col("vec_id") % 20 == 0, 5, part=64, block=4).collect()
    for q in range(0, 300, 20):
        ranked = sorted(((-float(sum(a * b for a, b in zip(v[q], v[c]))), c) for c in range(300) if c != q))[:5]
        assert [(x.vec_id, x.rank) for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)] == [(c, k) for k, (_, c) in enumerate(ranked, 1)]
    assert {x.query_id for x in got} == set(range(0, 300, 20))
    assert onebit_ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_hold():
    r = np.random.default_rng(3)
    x, q = r.standard_normal((2000, 64)), r.standard_normal((20, 64))
    guess, error = onebit_ann.estimates(*onebit_ann.codes(x), q)
    assert (np.abs(guess - q @ x.T) <= error).mean() > 0.99


URLS = [
    ("https://A.Example.com/en/7?x=1", "a.example.com", "/en/7", "example.com/en/7", "allow"),
    ("http://b.example.com/en/8#t", "b.example.com", "/en/8", "com/en/", "block"),
    ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
    ("http://x.net/de/9", "x.net", "/de/9", "net/de/", "allow"),
    ("http://badcom/en/9", "badcom", "/en/9", None, None),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://a.org?q=/es/", "a.org", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("http://É.com/fr/", "É.com", "/fr/", None, None),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u[0], "h") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in url_filter.judged(df).collect():
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert url_filter.judged(df.limit(0)).collect() == []
    assert {r.verdict for r in url_filter.judged(df.where("page_id >= 6")).collect()} == {"allow"}


def labelled_urls(spark, sf):
    rows = url_filter.with_features(queries.table(spark, sf, "pages").select("page_id", "url"))
    rule, verdict = url_filter.matching_rule(F.col("host"), F.col("path"))
    return rows.withColumn("by", verdict).where("by is not null").withColumn("label", (F.col("by") == "block").cast("double"))


def test_url_trees_learn_their_labels(spark):
    marked = labelled_urls(spark, SMALL)
    out = url_filter.fit(marked).verdicts(marked)
    assert out.where("own = by").count() > 0.9 * out.count()


def test_url_trees_beat_the_commoner_verdict_on_held_out_urls(spark):
    marked = labelled_urls(spark, "/root/testdata/sf0.1").withColumn("held", F.crc32("url") % 4 == 0)
    out = url_filter.fit(marked.where("not held")).verdicts(marked.where("held"))
    n, blocked, right = out.agg(F.count("*"), F.sum("label"), F.count_if(F.col("own") == F.col("by"))).first()
    assert n > 100 and right > max(blocked, n - blocked)


def test_repeated_and_very_long_urls(spark):
    long = "http://a.com/en/" + "x/7-" * 50_000
    urls = [long, long, "http://b.net/de/1", "http://b.net/de/1", "://", "", None, None]
    df = spark.createDataFrame([(k, u, 0, 0) for k, u in enumerate(urls)], "page_id long, url string, label int, fold int")
    out = {r.page_id: r for r in url_filter.judged(df).collect()}
    assert sorted(out) == list(range(len(urls))) and out[0].path == long[len("http://a.com") :]
    assert [out[k].verdict for k in range(4)] == ["block", "block", "allow", "allow"]
    assert {(out[k].host, out[k].path, out[k].rule) for k in (4, 5, 6, 7)} == {("", "", None)}
    assert out[6][1:] == out[7][1:]


def test_leaks_are_found_and_clean_rows_are_not(spark):
    docs, bench = queries.table(spark, SMALL, "documents"), queries.table(spark, SMALL, "benchmark")
    d, b = docs.toPandas(), bench.toPandas()
    want = {(int(i), int(j)) for i, t in zip(d.doc_id, d.text) for j, x in zip(b.item_id, b.text) if x in (t or "")}
    got = {(r.doc_id, r.item_id) for r in queries.op3_template_decontamination(spark, SMALL).collect()}
    assert want and got == want
    left = template_decontam.without_matches(docs, bench)
    assert left.columns == docs.columns and left.count() == len(d) - len({i for i, _ in want})


def test_slots(spark):
    item = "Then Alice Smith bought 12 kg of fresh apples at the market and gave 5 kg to Bob before leaving town"
    texts = {
        1: "hello there. Carol Jones bought 7 lb of fresh apples at the market and gave 3 lb to Dave before leaving town ok",
        2: "so Carol bought 7 lb of fresh apples at the market and gave 3 lb to Carol before leaving town",
        3: None,
        4: "",
        5: "fresh apples at the market and gave nothing to anybody " * 3,
        6: item.upper() + " x" * 50_000,
    }
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()] + [(1, texts[1], 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, item), (10, None), (11, "two words"), (None, "")], "item_id long, text string")
    got = template_decontam.matches(docs, bench).collect()
    assert [(r.doc_id, r.item_id) for r in got if r.doc_id != 6] == [(1, 9)] and all(r.slots_changed > 0 for r in got if r.doc_id == 1)
    assert template_decontam.matches(docs, bench.limit(0)).collect() == []
    assert template_decontam.matches(docs.limit(0), bench).collect() == []


def test_verbatim_copies_of_odd_items(spark):
    items = {
        1: "Compute 12 + 7 * 3 - 45 / 9 + 8 * 11",
        2: "The Old Man And The Sea Was Sold Here In May",
        3: "What is the capital of France?",
        4: "Which river runs through the old town of Basel",
    }
    texts = [f'they asked "{t}" and went on, ' for t in items.values()]
    docs = spark.createDataFrame([(k, "before it, " + t) for k, t in enumerate(texts, 1)] + [(9, "they asked, What is the capital of Spain?"), (10, "nothing of it here, 12 and 7")], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in template_decontam.matches(docs, bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (9, 3)}


def test_clean_texts_under_the_id_of_a_leak_stay(spark):
    item = "Which river runs through the old town of Basel"
    rows = [(None, "ask: " + item), (None, "clean"), (5, "ask: " + item), (5, "clean too"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = template_decontam.without_matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(r.doc_id, r.text) for r in left.collect()} == {(None, "clean"), (5, "clean too"), (5, None)}


def test_lexicon_counts_all_labelled_rows(spark):
    rows = [(k, "zorblat" if k < 40 else "calm words" if k > 400 else "grobian", int(k <= 400)) for k in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), sample=200)
    lexicon = toxicity.Lexicon(model.words, model.stems)
    assert lexicon.find("zorblat") and lexicon.find("grobian") and not lexicon.find("calm")
