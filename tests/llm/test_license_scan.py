"""Licence signatures against a plain word-by-word version."""

import random
import re
from collections import Counter

import duckdb

from sheetmill.llm import license_scan
from sheetmill.llm.license_rules import CLASSES, Rule, rules

SCHEMA = "doc_id long, text string, scan string, found int"


def plain(text, signatures=None):
    """The report of one text, rules matched on lists of words and detections compared pair by pair."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    line = " ".join(words)
    begins = {sum(len(w) + 1 for w in words[:i]): i for i in range(len(words))}
    found = []
    for r in signatures or rules():
        at = 0
        rule = re.compile("(?<![^ ])(?:" + r.pattern.replace(" ?", "(?: )?") + ")(?![^ ])")
        while (m := rule.search(line, at)) is not None:
            start = begins[m.start()]
            found.append((start, start + m[0].count(" ") + 1, r))
            at = m.end()
    less = lambda e, d: e[0] <= d[0] and e[1] >= d[1] and (e[2].priority, -(e[1] - e[0]), e[2].number) < (d[2].priority, -(d[1] - d[0]), d[2].number)
    kept = [d for d in found if not any(less(e, d) for e in found)]
    base = [d for d in found if d[2].kind == "base"]
    return (
        len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None),
        ",".join(sorted({d[2].label for d in base})), ",".join(sorted({d[2].label for d in kept + base})), max((d[2].weight for d in kept), default=0.0), len(kept),
    )


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"]
TEXTS = [
    None,
    "",
    " .,;\x00 ",
    "CC BY cc-by CC/BY\tcc by",
    "The MIT License, the Apache License and the GNU General Public License; écc by, cc byé mit licenses",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. All rights reserved.",
    "see http://www.apache.org/licenses/LICENSE-2.0 for the Apache License, Version 2.0",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0, beerware license",
    "Kmit license İmit license mit license",
    "no rights at all, mit der und die",
    "word " * 30_000 + "Apache License, version 2.0",
    "Released under the MIT License. " * 2_000,
]


def test_report_equals_the_plain_version(spark):
    rng = random.Random(5)
    parts = ["gnu", "general", "public", "license", "version", "2", "0", "mit", "cc", "by", "nc", "apache", "the", "under", "licensed", "spdx license identifier", "all rights reserved", "é", "lgpl", "bsd", "3 clause"]
    texts = TEXTS + [" ".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(200)]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in license_scan.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    small = {i: t for i, t in enumerate(texts) if t is None or len(t) < 10_000}
    assert {i: got[i] for i in small} == {i: plain(t) for i, t in small.items()}
    assert got[12] == (30_005, 1, 30_000, 30_000, "apache", "apache,apache-2.0", 0.75, 1)
    assert got[13] == (10_000, 2_000, 3, 9_998, "mit", "mit", 0.9, 2_000)


def test_report_equals_its_sql(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "x", 1), (None, TEXTS[6], "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = Counter(map(tuple, license_scan.report(docs).collect()))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    assert got == Counter(con.execute(license_scan.twin()).fetchall())


def test_scan_keeps_columns_and_resolves(spark):
    docs = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0.", "x", 3)], "doc_id long, text string, scan string, found int")
    row = license_scan.scanned(docs, into="scan").first()
    assert row["found"] == 3 and [(d["start"], d["after"], d["label"]) for d in row["scan"]["kept"]] == [(0, 8, "apache-2.0")]
    assert {d["label"] for d in row["scan"]["found"]} == {"apache", "apache-2.0"}
    assert license_scan.report(docs.limit(0)).count() == 0


def test_own_signatures_and_order(spark):
    own = [Rule(0, "a", "name", "one", "one two"), Rule(1, "b", "name", "one", "one two"), Rule(2, "c", "tag", "two", "two"), Rule(3, "d", "base", "two", "two three")]
    docs = spark.createDataFrame([(1, "One two three")], "doc_id long, text string")
    assert [d["label"] for d in license_scan.scanned(docs, signatures=own).first()["scan"]["kept"]] == ["a", "d", "c"]


def test_keywords_follow_from_their_patterns():
    assert len(rules()) > 200
    for r in rules():
        assert r.keyword.strip() in r.pattern and r.kind in CLASSES and not re.search(r"\((?!\?:)", r.pattern), r


def test_plan_has_no_python_and_no_exchange(spark, sf):
    plan = license_scan.report(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Exchange|Join|Arrow", plan)
