"""Dictionary tagging and segmentation: all words of a dictionary found in one pass over each text.

A dictionary is a DataFrame. Its words become one automaton in each Python worker, and texts go through it in
Arrow batches, so the cost of a text does not depend on the number of words. What is sent to the workers is
cut into parts of at most ``PART`` words, one automaton each, so its size is bounded whatever the dictionary.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmill.operators.retrieval import CJK, SEPARATORS

PART = 200_000
CJK = r"[一-龥]"
_automata: dict[Any, Any] = {}


def _parts(dictionary: DataFrame, columns: list[str], part: int) -> list[tuple]:
    """Broadcasts of the dictionary's rows with a name for each, each of at most about ``part`` rows; one at least."""
    rows = dictionary.select(*columns).where(F.coalesce(F.col(columns[0]), F.lit("")) != "").distinct()
    n = max(1, -(-rows.count() // part))
    sc = dictionary.sparkSession.sparkContext
    at = F.pmod(F.xxhash64(columns[0]), F.lit(n))
    return [(uuid.uuid4().hex, sc.broadcast([tuple(r) for r in (rows.where(at == k) if n > 1 else rows).collect()])) for k in range(n)]


def _automaton(words: list[tuple]):
    """The automaton of ``(word, payload...)`` rows; a word carries all of its payloads."""
    by: dict[str, list[tuple]] = {}
    for word, *rest in words:
        by.setdefault(word, []).append(tuple(rest))
    a = ahocorasick.Automaton()
    for word, payloads in by.items():
        a.add_word(word, (len(word), payloads))
    if by:
        a.make_automaton()
    return a


def _kept(sent: tuple):
    """The automaton of a broadcast part, made once in each worker; few are kept."""
    name, rows = sent
    if name not in _automata:
        if len(_automata) > 8:
            _automata.clear()
        _automata[name] = _automaton(rows.value)
    return _automata[name]


def tagger(dictionary: DataFrame, part: int = PART) -> Callable[[Column], Column]:
    """A function that gives, of a text, the tags of ``dictionary(word, tag, tag_no)`` whose words it contains.

    Tags come once each, in the order of ``tag_no``. Words are looked for as they are; give texts in lower
    case where the words are. A null text has no tags.
    """
    sent = _parts(dictionary, ["word", "tag", "tag_no"], part)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found: set[tuple] = set()
            for s in sent if t else ():
                a = _kept(s)
                for _, (_, payloads) in a.iter(t) if len(a) else ():
                    found.update(payloads)
            out.append([tag for _, tag in sorted({(no, tag) for tag, no in found})])
        return pd.Series(out, dtype=object)

    return run


def occurrences(rows: DataFrame, dictionary: DataFrame, key: str, text: str, part: int = PART) -> DataFrame:
    """``key, tag, word, place``: every place (from 0) at which a word of ``dictionary(word, tag)`` stands in a text."""
    sent = _parts(dictionary, ["word", "tag"], part)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in enumerate(b.column(1).to_pylist()):
                for s in sent if t else ():
                    a = _kept(s)
                    hits = [(tag, t[end - n + 1 : end + 1], end - n + 1) for end, (n, payloads) in (a.iter(t) if len(a) else ()) for (tag,) in payloads]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[k], len(hits)), *(pa.array(c) for c in zip(*hits, strict=True))], names=[key, "tag", "word", "place"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, tag string, word string, place long")


def shortest_path(run: str, arcs: dict[int, list[tuple[int, float]]], unknown: float) -> list[str]:
    """Words of a run of signs: the path of least cost through its word graph.

    ``arcs[end]`` holds (length, cost) of the dictionary's words that end before ``end``; any single sign is
    an arc of cost ``unknown``. Of equally cheap paths the one with the longer last word counts.
    """
    cost, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        best = (cost[end - 1] + unknown, 1)
        for n, c in arcs.get(end, ()):
            best = min(best, (cost[end - n] + c, n), key=lambda x: (x[0], -x[1]))
        cost.append(best[0])
        back.append(best[1])
    words, at = [], len(run)
    while at:
        words.append(run[at - back[at] : at])
        at -= back[at]
    return words[::-1]


def segmenter(dictionary: DataFrame, stop_words: tuple[str, ...] = (), part: int = PART) -> Callable[[Column], Column]:
    """A tokeniser by a word graph over ``dictionary(word, weight)``, to be used in place of ``tokens``.

    Runs of CJK signs are cut along the cheapest path, a word costing -log of its share of all weights and a
    sign outside of words more than any. Stretches of signs outside of words become overlapping pairs. Words
    of other letters are those of ``tokens``; words of one sign and stop words go.
    """
    total = float(dictionary.where("word is not null and word <> ''").agg(F.coalesce(F.sum("weight"), F.lit(1.0))).first()[0])
    costed = dictionary.where("weight > 0").groupBy("word").agg((F.log(F.lit(total)) - F.log(F.max("weight").cast("double"))).alias("cost"))
    unknown = float(costed.agg(F.coalesce(F.max("cost"), F.lit(0.0))).first()[0]) + math.log(2)
    sent, stop = _parts(costed, ["word", "cost"], part), frozenset(stop_words)

    def cut(run: str) -> list[str]:
        arcs: dict[int, list[tuple[int, float]]] = {}
        for s in sent:
            a = _kept(s)
            for end, (n, payloads) in a.iter(run) if len(a) else ():
                arcs.setdefault(end + 1, []).append((n, payloads[0][0]))
        known = {(end - n, end) for end, found in arcs.items() for n, _ in found}
        out, at, loose = [], 0, ""
        for w in shortest_path(run, arcs, unknown):
            if len(w) == 1 and (at, at + 1) not in known:
                loose += w
            else:
                out += [*pairs(loose), w]
                loose = ""
            at += len(w)
        return out + pairs(loose)

    def pairs(signs: str) -> list[str]:
        return [signs[k : k + 2] for k in range(len(signs) - 1)]

    @F.pandas_udf("array<string>")
    def run(words: pd.Series) -> pd.Series:
        out = []
        for ws in words:
            cut_words = [w for x in ws for w in (cut(x) if "一" <= x[:1] <= "龥" else [x])]
            out.append([w for w in cut_words if len(w) > 1 and w not in stop])
        return pd.Series(out, dtype=object)

    def tokenised(text: Column) -> Column:
        low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"({CJK}+)", " $1 ")
        return run(F.filter(F.split(low, SEPARATORS), lambda w: w != ""))

    return tokenised
