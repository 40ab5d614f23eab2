"""Licence scan: ordered signature rules over the words of whole texts, as one projection.

A text becomes its words with a blank on both sides of each, so that a rule matches whole words only and
matches that follow each other do not share a blank. A rule runs only where its keyword occurs; that is
decided by plain substring search, so most texts meet no regular expression but the one that splits words.
Its places are found by marking every match and looking for the marks among the words.

Detections are then resolved: one whose words lie within those of a detection of higher priority, or of
the same priority and greater length (or the same words and an earlier rule), is suppressed; partial
overlaps stay, as they say different things. Suppression is one sweep over the detections in order of
their starts. The plain phrases of class ``base`` are reported at every place, suppressed or not.

All of it is column functions on one row: no shuffle, no join, nothing that grows with the corpus.

Defined results: a null text counts as empty; an empty text has no words, no labels ('' and not null),
null places and score 0; repeated rows are judged alike, each in its own row; an empty table gives an
empty table; further columns are ignored by ``report`` and kept by ``scanned``, whose new column has the
given name; texts of any length are read whole.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmill.llm.license_rules import Rule, rules

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARK = "\x01"  # a separator, so it stands in no word
CHUNK = 256
DETECTION = "struct<start:int,after:int,priority:int,number:int,label:string,weight:double,base:boolean>"


def word_pattern(pattern: str) -> str:
    """A signature over texts with a blank on both sides of each word; its words are group 1."""
    return " (" + re.sub(r" \?| ", lambda m: "(?:  )?" if m[0] == " ?" else "  ", pattern) + ") "


def padded_words(text: Column) -> Column:
    """The words of a text, a blank before and after each.

    Lower case is made of all letters: a translation of A-Z alone takes twenty times as long. Signatures
    are ASCII, and the one other sign whose lower case is an ASCII word is the Kelvin sign.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, SEPARATORS, "  ")), F.lit(" "))


def word_count(padded: Column) -> Column:
    """Words of a padded text: between two words stand two blanks."""
    gaps = F.octet_length(padded) - F.octet_length(F.replace(padded, F.lit("  "), F.lit("")))
    return F.when(F.octet_length(padded) <= 2, F.lit(0)).otherwise(gaps / 2 + 1).cast("long")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def places(padded: Column, rule: Column) -> Column:
    """Detections of one rule: the words of its matches, from ``start`` up to but without ``after``."""

    def located(hits: Column) -> Column:
        marked = F.split(F.trim(F.regexp_replace(padded, rule["pattern"], " " + MARK + "$1 ")), "  ")
        starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i)), lambda i: i.isNotNull())
        return F.zip_with(
            starts, hits,
            lambda i, hit: F.struct(i.alias("start"), (i + word_count(F.concat(F.lit(" "), hit, F.lit(" ")))).cast("int").alias("after"), rule["priority"].alias("priority"), rule["number"].alias("number"), rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base")),
        )

    return bound(F.regexp_extract_all(padded, rule["pattern"], F.lit(1)), lambda hits: F.when(F.size(hits) > 0, located(hits)).otherwise(F.array().cast(f"array<{DETECTION}>")))


def detections(padded: Column, signatures: Sequence[Rule]) -> Column:
    """All detections of the rules whose keyword the text holds, by start, the longest first."""
    keywords = sorted({r.keyword for r in signatures})
    of = {k: F.array(*(F.struct(F.lit(word_pattern(r.pattern)).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.number).alias("number"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"), F.lit(r.kind == "base").alias("base")) for r in signatures if r.keyword == k)) for k in keywords}
    gates = F.array(*(F.struct(F.lit(k).alias("keyword"), of[k].alias("rules")) for k in keywords))
    open_gates = F.filter(gates, lambda g: F.contains(padded, g["keyword"]))
    found = F.flatten(F.transform(F.flatten(F.transform(open_gates, lambda g: g["rules"])), lambda r: places(padded, r)))
    ordered = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["after"]).alias("minus"), d["priority"].alias("priority"), d["number"].alias("number"), d.alias("d")))
    return F.transform(F.sort_array(ordered), lambda o: o["d"])


def resolved(found: Column, priorities: Sequence[int]) -> Column:
    """The detections that no other suppresses.

    In the order of starts, the longest first, all that may contain a detection stand before it, but for
    those of higher priority with the same words, which the order also puts first. So it is contained if
    the furthest end so far, among detections of its priority or a higher one, reaches its own end. The
    sweep goes by chunks, so that what is kept is copied once for each chunk and not for each detection.
    """
    none = F.array().cast(f"array<{DETECTION}>")
    ends = lambda values: F.struct(*(v.alias(f"p{p}") for p, v in zip(priorities, values)))

    def step(state: Column, d: Column) -> Column:
        reach = F.greatest(F.lit(-1), F.lit(-1), *(F.when(d["priority"] >= p, state["ends"][f"p{p}"]) for p in priorities))
        kept = F.when(reach >= d["after"], state["out"]).otherwise(F.concat(state["out"], F.array(d)))
        return F.struct(ends([F.when(d["priority"] == p, F.greatest(state["ends"][f"p{p}"], d["after"])).otherwise(state["ends"][f"p{p}"]) for p in priorities]).alias("ends"), kept.alias("out"))

    def chunk(state: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(found, at, F.lit(CHUNK)), F.struct(state["ends"].alias("ends"), none.alias("out")), step)
        return bound(inner, lambda s: F.struct(s["ends"].alias("ends"), F.concat(state["out"], F.array(s["out"])).alias("out")))

    start = F.struct(ends([F.lit(-1)] * len(priorities)).alias("ends"), F.array().cast(f"array<array<{DETECTION}>>").alias("out"))
    swept = F.aggregate(F.sequence(F.lit(1), F.size(found), F.lit(CHUNK)), start, chunk)
    return F.when(F.size(found) > 0, F.flatten(swept["out"])).otherwise(none)


def scanned(docs: DataFrame, text: str = "text", signatures: Sequence[Rule] | None = None, into: str = "scan") -> DataFrame:
    """``docs`` with a struct ``into``: ``n_words``, ``found`` (all detections) and ``kept`` (after suppression)."""
    signatures = signatures or rules()
    priorities = sorted({r.priority for r in signatures})
    scan = bound(padded_words(docs[text]), lambda t: bound(detections(t, signatures), lambda found: F.struct(word_count(t).alias("n_words"), found.alias("found"), resolved(found, priorities).alias("kept"))))
    return docs.select(*(docs[c] for c in docs.columns if c != into), scan.alias(into))


def joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(labels)), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", signatures: Sequence[Rule] | None = None) -> DataFrame:
    """One row for each document: its words, the places of the plain phrases, labels and a score.

    ``labels`` are those of the plain phrases and of all kept detections; ``score`` is the confidence of
    the surest kept detection, 0 without any.
    """
    d = scanned(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), "text", signatures, "scan").select("doc_id", "scan")
    base = F.filter("scan.found", lambda x: x["base"])
    d = d.select("doc_id", "scan", base.alias("base"))
    return d.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.start")).cast("long").alias("first_word"),
        F.array_max(F.col("base.start")).cast("long").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "scan.kept.label")).alias("labels"),
        F.coalesce(F.array_max("scan.kept.weight"), F.lit(0.0)).alias("score"),
        F.size("scan.kept").cast("long").alias("n_detections"),
    )


def twin(table: str = "documents", signatures: Sequence[Rule] | None = None) -> str:
    """The same report in DuckDB SQL, detections compared pair by pair."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({r.number}, {q(r.label)}, {r.priority}, {r.weight:.2f}, {str(r.kind == 'base').lower()}, {q(r.keyword)}, {q(word_pattern(r.pattern))})" for r in signatures or rules())
    return rf"""
WITH rules(number, label, priority, weight, base, keyword, pattern) AS (VALUES {listed}),
t AS (SELECT row_number() OVER () AS row_no, doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{SEPARATORS}', '  ', 'g'), ' ') || ' ' AS p FROM {table}),
hits AS (
  SELECT row_no, number, label, priority, CAST(weight AS DOUBLE) AS weight, base, string_split(trim(regexp_replace(p, pattern, ' ' || chr(1) || '\1 ', 'g'), ' '), '  ') AS w, regexp_extract_all(p, pattern, 1) AS m
  FROM t JOIN rules ON contains(p, keyword) WHERE regexp_matches(p, pattern)),
found AS (
  SELECT row_no, number, label, priority, weight, base, s AS start, s + len(string_split(hit, '  ')) AS after
  FROM (SELECT * EXCLUDE (w, m), unnest(list_filter(list_transform(w, lambda x, i: CASE WHEN x[1] = chr(1) THEN i - 1 END), lambda i: i IS NOT NULL)) AS s, unnest(m) AS hit FROM hits)),
kept AS (
  SELECT * FROM found d WHERE NOT EXISTS (
    SELECT 1 FROM found e WHERE e.row_no = d.row_no AND e.start <= d.start AND e.after >= d.after AND e.priority <= d.priority
      AND (e.priority < d.priority OR e.after - e.start > d.after - d.start OR e.number < d.number))),
b AS (SELECT row_no, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM found WHERE base GROUP BY row_no),
l AS (SELECT row_no, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row_no, label FROM kept UNION SELECT row_no, label FROM found WHERE base) GROUP BY row_no),
k AS (SELECT row_no, max(weight) AS score, count(*) AS n_detections FROM kept GROUP BY row_no)
SELECT doc_id, CAST(CASE WHEN p = '  ' THEN 0 ELSE len(string_split(trim(p, ' '), '  ')) END AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, coalesce(n_detections, 0) AS n_detections
FROM t LEFT JOIN b USING (row_no) LEFT JOIN l USING (row_no) LEFT JOIN k USING (row_no)"""
