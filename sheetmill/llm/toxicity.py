"""Toxicity scores: misspelled lexicon terms by Levenshtein automata, weighed by their context.

The lexicon is a trie of words and one of stems. A Levenshtein automaton for all of its words at once is
the product of the trie with an error count; its states are made when a token first needs them and
kept, so that a token costs one dictionary look-up for each character. One automaton reads tokens forward and
takes fewer errors in the first half of a word, another reads them backward and takes none in the second half;
between them no misspelling is lost, and most tokens leave them after two or three letters. Words of 5 to 7 letters may have one error, longer ones two, shorter
ones none; stems of 5 letters or more may have one error, whatever follows them.

A token of common language is no misspelling: what stands near a term but is used in clean rows does
not count. What is left counts as a hit of its term, by the share that misspellings with as many errors
have earned in labelled rows, and otherwise like a term that is spelled right.

Every hit is looked at in a window of ``WINDOW`` tokens to both sides: quotation marks around it and
words of reporting speak for quotation, which halves what the hit counts; a second person, exclamation
marks and further hits speak for abuse. The counts of a text are columns, and a logistic model turns them
into a score; no evidence of abuse can lower it and no quotation can raise it.

The lexicon is learned from all labelled rows: a word, or all words with a common stem, joins it if
it is at least ``RATIO`` times as frequent in toxic rows and occurs in ``LEAST`` of them. Every such
term joins; this evidence alone bounds what is sent to the tasks, as a broadcast. Only the logistic model is fitted
to a sample (at most about ``SAMPLE`` rows, chosen by a hash of the id).

Defined results: a null text is empty; a text without hits has the score of one without hits, so an
empty one too; without labels of both kinds the lexicon is the seeds alone and the score is the
share of toxic labels (0.5 without any) whatever the text; null ids and labels teach nothing;
repeated ids among labels count once with their greatest label; repeated rows are scored each;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Matrices
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetmill.llm.common import checkpointed, sized_batches, strings

SAMPLE, RATIO, LEAST, WINDOW, THRESHOLD, KEPT = 16_000, 20.0, 6, 8, 0.3, 400_000
#: Terms that are in the lexicon before anything is learned.
SEEDS = ("idiot", "moron", "stupid", "pathetic", "worthless", "scum", "loser", "disgusting", "imbecile", "vermin")
#: Words of reporting, and second persons, in the corpus's languages.
REPORTING = frozenset("said says wrote writes quoted quote called calls term word phrase dit écrit mot terme sagte schrieb wort begriff dijo escribió palabra término".split())
SECOND_PERSON = frozenset("you your yours u ur tu toi vous votre ton du dich dir euch ihr usted ustedes vosotros".split())
_TOKENS = re.compile(r"\w+|[!\"“”„«»‘’]")
_QUOTES = frozenset("\"“”„«»‘’")


#: What a misspelling with so many errors counts before labels say more, how many labelled rows that is worth, and its least.
TRUST, PRIOR, LEAST_TRUST = {1: 0.7, 2: 0.5}, 20.0, 0.4
#: A near word that so many clean rows use, and that is not this much more frequent in toxic ones, is common language.
COMMON, COMMON_RATIO = 2, 5.0
STATES = 200_000


def errors_allowed(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 8 else 2


def stem_errors(stem: str) -> int:
    return min(1, errors_allowed(stem))


class Automaton:
    """A trie of terms and the automaton of its product with an error count.

    A place is a node with the errors so far, as ``3 * node + errors``; a state is a set of places, and 0 is the dead
    state. ``terms`` are (letters, end, errors, first, early): ``end`` is kept where the term is met, and while at
    most ``first`` of its letters are read, there are at most ``early`` errors.
    """

    def __init__(self, terms: list[tuple[str, tuple[float, str], int, int, int]]) -> None:
        self.children: list[dict[str, int]] = [{}]
        #: The most errors at a node: once its letter is read, after letters too many, and of all terms below.
        self.entered, self.stayed, self.limit = [0], [0], [0]
        self.end_at: dict[int, tuple[int, float, str]] = {}
        for letters, (weight, term), errors, first, early in terms:
            node = 0
            for depth in range(len(letters) + 1):
                if depth:
                    node = self._child(node, letters[depth - 1])
                self.entered[node] = max(self.entered[node], early if depth <= first else errors)
                self.stayed[node] = max(self.stayed[node], early if depth < first else errors)
                self.limit[node] = max(self.limit[node], errors)
            self.end_at.update((3 * node + e, (e, -weight, term)) for e in range(errors + 1))
        self.left_out: dict[int, frozenset[int]] = {}
        self.mistaken: dict[int, frozenset[int]] = {}
        self.restart()

    def restart(self) -> None:
        """No states but the dead one and the start."""
        self.states: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.next: list[dict[str, int]] = []
        #: Of each state the closest term that is met there.
        self.met: list[tuple[int, float, str] | None] = []
        self._state(frozenset())
        self.start = self._state(self._closest(self._closed(0)))

    def _child(self, node: int, letter: str) -> int:
        if letter not in self.children[node]:
            self.children[node][letter] = len(self.children)
            self.children.append({})
            for most in (self.entered, self.stayed, self.limit):
                most.append(0)
        return self.children[node][letter]

    def _closed(self, place: int) -> frozenset[int]:
        """With the places that are reached by leaving out letters of the terms."""
        if place not in self.left_out:
            node, e = divmod(place, 3)
            below = (self._closed(3 * child + e + 1) for child in self.children[node].values() if e < self.entered[child])
            self.left_out[place] = frozenset({place}).union(*below)
        return self.left_out[place]

    def _mistaken(self, place: int) -> frozenset[int]:
        """Where any letter leads that is another one, or one too many."""
        if place not in self.mistaken:
            node, e = divmod(place, 3)
            others = [3 * child + e + 1 for child in self.children[node].values() if e < self.entered[child]]
            more = [place + 1] if e < self.stayed[node] else []
            self.mistaken[place] = frozenset().union(*map(self._closed, others + more))
        return self.mistaken[place]

    @staticmethod
    def _closest(places: frozenset[int] | set[int]) -> frozenset[int]:
        """Of each node the place with the fewest errors."""
        return frozenset(p for p in places if not (p % 3 and (p - 1 in places or (p % 3 == 2 and p - 2 in places))))

    def _state(self, places: frozenset[int]) -> int:
        if places not in self.states:
            self.states[places] = len(self.sets)
            self.sets.append(places)
            self.next.append({})
            self.met.append(min((self.end_at[p] for p in places if p in self.end_at), default=None))
        return self.states[places]

    def step(self, state: int, ch: str) -> int:
        known = self.next[state].get(ch)
        if known is None:
            after: set[int] = set()
            for place in self.sets[state]:
                child = self.children[place // 3].get(ch)
                if child is not None and place % 3 <= self.limit[child]:
                    after |= self._closed(3 * child + place % 3)
                after |= self._mistaken(place)
            known = self.next[state][ch] = self._state(self._closest(after))
        return known

    def end(self, token: str) -> tuple[int, float, str] | None:
        """The closest term that the whole token is."""
        state, known = self.start, self.next
        for ch in token:
            after = known[state].get(ch)
            state = self.step(state, ch) if after is None else after
            if not state:
                return None
        return self.met[state]

    def closest_start(self, token: str) -> tuple[int, float, str] | None:
        """The closest, and of equally close ones the longest term that the token begins with."""
        state, known, found = self.start, self.next, None
        for ch in token:
            after = known[state].get(ch)
            state = self.step(state, ch) if after is None else after
            if not state:
                break
            met = self.met[state]
            if met and (found is None or (met[0], -len(met[2])) < (found[0], -len(found[2]))):
                found = met
        return found


class Lexicon:
    """Words and stems as automata. Of a word's two halves, one has fewer errors than the word: either the first,
    and it is met by an automaton that reads forward, or all are in the first, and one that reads the second,
    faultless half first, backward, meets it. So few tokens are followed far.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], common: frozenset[str] = frozenset(), trust: dict[int, float] = TRUST) -> None:
        self.words, self.stems = words, stems
        terms = [(w, (weight, w), errors_allowed(w), len(w) // 2) for w, weight in words.items()]
        self.forward = Automaton([(w, end, e, half, max(0, e - 1)) for w, end, e, half in terms])
        self.backward = Automaton([(w[::-1], end, e, len(w) - half, 0) for w, end, e, half in terms if e])
        self.begin = Automaton([(x, (weight, x), stem_errors(x), 0, stem_errors(x)) for x, weight in stems.items()])
        self.seen: dict[str, tuple[int, float, str] | None] = {}
        self.judge_by(common, trust)

    def judge_by(self, common: frozenset[str], trust: dict[int, float]) -> Lexicon:
        """The same automata with other common language and trust."""
        self.common, self.trust = common, {0: 1.0, **trust}
        self.seen.clear()
        return self

    def find(self, token: str) -> tuple[int, float, str] | None:
        """(errors, weight, term) of the closest term of a lower-case token, or nothing."""
        if token in self.seen:
            return self.seen[token]
        for automaton in (self.forward, self.backward, self.begin):
            if len(automaton.sets) > STATES:
                automaton.restart()
        ends = (self.begin.closest_start(token), self.forward.end(token), self.backward.end(token[::-1]))
        found = min((x for x in ends if x), default=None)
        if found and found[0] and token in self.common:
            found = None
        out = (found[0], -found[1], found[2]) if found else None
        if len(self.seen) > KEPT:
            self.seen.clear()
        self.seen[token] = out
        return out


#: What the model weighs, and behind it counts of exact and misspelled hits, which it does not.
WEIGHED = ("hits", "abuse", "quoted", "weight", "different", "share")
FEATURES = (*WEIGHED, "exact", "fuzzy")


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The values of ``FEATURES`` for one text."""
    tokens = _TOKENS.findall(text.lower())
    find, seen = lexicon.find, lexicon.seen
    hit_words = {w for w in set(tokens) if (seen[w] if w in seen else find(w)) is not None}
    if not hit_words:
        return [0.0] * len(FEATURES)
    places = [i for i, w in enumerate(tokens) if w in hit_words]
    hits = exact = fuzzy = abuse = quoted = weight = 0.0
    terms: dict[str, float] = {}
    hit_at = set(places)
    for i in places:
        errors, w, term = find(tokens[i])  # type: ignore[misc]
        trust = lexicon.trust[errors]
        low, high = max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1)
        before, after = tokens[low:i], tokens[i + 1 : high]
        quotes = any(t in _QUOTES for t in before) and any(t in _QUOTES for t in after)
        reports = any(t in REPORTING for t in before) or any(t in REPORTING for t in after)
        sharp = sum(t in SECOND_PERSON or t == "!" for t in before + after) + sum(j in hit_at for j in range(low, high)) - 1
        quotation = 0.7 * quotes + 0.3 * reports
        counted = trust * (1.0 - 0.5 * quotation)
        hits += counted
        quoted += quotation
        abuse += trust * max(0.0, 1.0 + 0.5 * min(sharp, 4) - 1.5 * quotation)
        weight += w * counted
        exact += not errors
        fuzzy += errors > 0
        terms[term] = max(counted, terms.get(term, 0.0))
    log = lambda x: math.log1p(x)
    return [log(hits), log(abuse), log(quoted), log(weight), min(sum(terms.values()), 10.0), log(1000.0 * hits / len(tokens)), exact, fuzzy]


class ToxicModel(NamedTuple):
    words: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, ...]
    intercept: float
    common: frozenset[str] = frozenset()
    trust: dict[int, float] = TRUST


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word, toxic and other texts that have it."""
    for b in sized_batches(batches, most=8 << 20):
        counts: dict[str, list[int]] = {}
        for t, label in zip(strings(b.column("text")), b.column("label").to_pylist(), strict=True):
            for w in set(re.findall(r"\w+", t.lower())):
                counts.setdefault(w, [0, 0])[label <= 0] += 1
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["word", "toxic", "other"])


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, toxic, other``: how many toxic and other labelled rows have a word."""
    return checkpointed(rows.select("text", "label").mapInArrow(_word_counts, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))


def learned_terms(words: DataFrame, toxic: int, other: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems of labelled rows that mark toxic rows, with their log ratios; ``words`` are ``word_counts``."""
    strong = (F.col("toxic") >= LEAST) & ((F.col("toxic") + 0.5) / (toxic + 1) >= RATIO * (F.col("other") + 0.5) / (other + 1))
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    own = {r["word"]: r for r in words.where(strong).select("word", "toxic", ratio.alias("ratio")).collect()}
    starts = words.select(F.explode(F.transform(F.sequence(F.lit(4), F.lit(9)), lambda k: F.struct(k.alias("k"), F.substring("word", F.lit(1), k).alias("start")))).alias("s"), "word", "toxic", "other")
    starts = starts.where(F.length("word") >= F.col("s.k")).groupBy(F.col("s.start").alias("start")).agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.sum((F.col("toxic") > 0).cast("int")).alias("words"))
    begin = starts.where(strong & (F.col("words") >= 4)).select("start", "toxic", ratio.alias("ratio")).collect()
    # The longest stem that still has nearly all that a shorter one has; and of nested ones the shortest such.
    count = {r["start"]: r["toxic"] for r in begin}
    below: dict[str, list[str]] = {}
    for x in sorted(count, key=lambda x: (-count[x], x)):
        below.setdefault(x[:-1], []).append(x)
    stems: dict[str, float] = {}
    for r in sorted(begin, key=lambda r: (len(r["start"]), r["start"])):
        s = r["start"]
        if any(s[:k] in stems for k in range(4, len(s) + 1)):
            continue
        while longer := [x for x in below.get(s, []) if count[x] >= 0.95 * count[s]]:
            s = longer[0]
        stems[s] = float(r["ratio"])
    words_out = {w: float(r["ratio"]) for w, r in own.items() if not any(w[:k] in stems for k in range(4, 10))}
    # A seed or a word that marks toxic rows by itself is met with errors, so it is kept as a word too.
    return {**{s: 3.0 for s in SEEDS}, **words_out}, stems


def near_words(words: DataFrame, lexicon: Lexicon, toxic: int, other: int) -> tuple[frozenset[str], dict[int, float]]:
    """Words near a term that are common language, and what the rest of the misspellings have earned by errors.

    Only words that the automaton meets with errors come back to the driver, and of them those that clean
    rows use; the evidence of all others is summed where it is.
    """
    run = _with_lexicon(lexicon.words, lexicon.stems)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = run()
        for b in batches:
            hits = [known.find(w) for w in strings(b.column("word"))]
            at = pa.array([k for k, h in enumerate(hits) if h and h[0]], pa.int64())
            yield pa.record_batch([b.column(c).take(at) for c in ("word", "toxic", "other")] + [pa.array([h[0] for h in hits if h and h[0]], pa.int32())], names=["word", "toxic", "other", "errors"])

    near = checkpointed(words.mapInArrow(met, "word string, toxic long, other long, errors int"))
    rate = lambda n, of: (n + 0.5) / (of + 1)
    usual = (F.col("other") >= COMMON) & (rate(F.col("toxic"), toxic) < COMMON_RATIO * rate(F.col("other"), other))
    common = frozenset(r["word"] for r in near.where(usual).select("word").collect())
    trust = dict(TRUST)
    mean = sum(lexicon.words.values()) / len(lexicon.words)
    for r in near.where(~usual).groupBy("errors").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).collect():
        n, earned = r["toxic"] + r["other"], math.log(rate(r["toxic"], toxic)) - math.log(rate(r["other"], other))
        blend = (n * earned / mean + PRIOR * TRUST[r["errors"]]) / (n + PRIOR)
        trust[r["errors"]] = min(1.0, max(LEAST_TRUST, blend))
    return common, trust


_lexicons: dict[str, Lexicon] = {}


def _with_lexicon(words: dict[str, float], stems: dict[str, float], common: frozenset[str] = frozenset(), trust: dict[int, float] = TRUST):
    """A function that gives a worker its lexicon. One of the same terms keeps its states, whatever it is judged by."""
    name = hashlib.sha256(repr((sorted(words.items()), sorted(stems.items()))).encode()).hexdigest()
    sent = SparkSession.getActiveSession().sparkContext.broadcast((words, stems, common, trust))

    def run() -> Lexicon:
        words, stems, common, trust = sent.value
        if name not in _lexicons:
            _lexicons.clear()
            _lexicons[name] = Lexicon(words, stems)
        lexicon = _lexicons[name]
        return lexicon if (lexicon.common, lexicon.trust) == (common, {0: 1.0, **trust}) else lexicon.judge_by(common, trust)

    return run


def _featured(model: ToxicModel, columns: list[str], types: str):
    lexicon_of = _with_lexicon(model.words, model.stems, model.common, model.trust)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of()
        for b in sized_batches(batches, most=8 << 20):
            rows = [features(t, lexicon) for t in strings(b.column("text"))]
            out = [b.column(c) for c in columns] + [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(FEATURES))]
            yield pa.record_batch(out, names=[*columns, *FEATURES])

    return run, ", ".join([types, *(f"{f} double" for f in FEATURES)])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> ToxicModel:
    """Learns lexicon and weights from the rows of ``docs`` that ``labels(doc_id, <label>)`` names."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    n = marked.count()
    share = min(1.0, sample / max(n, 1))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    # At most about ``sample`` rows of two numbers, whatever the number of labels: small enough to send to all.
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    # Labels grow with the documents, so at every size both are shuffled; the side of two numbers is the hashed one.
    labelled = texts.join(marked.hint("shuffle_hash"), "doc_id").select("text", "label")
    own = texts.join(F.broadcast(chosen), "doc_id").select("text", "label")
    ones, rows = labelled.agg(F.sum((F.col("label") > 0).cast("int")), F.count("*")).first()
    if not rows or not ones or ones == rows:
        p = min(max((ones or 0) / rows, 0.001), 0.999) if rows else 0.5
        return ToxicModel({s: 3.0 for s in SEEDS}, {}, (0.0,) * len(FEATURES), math.log(p / (1 - p)))
    counted = word_counts(labelled)
    words, stems = learned_terms(counted, ones, rows - ones)
    common, trust = near_words(counted, Lexicon(words, stems), ones, rows - ones)
    none = ToxicModel(words, stems, (0.0,) * len(FEATURES), 0.0, common, trust)
    run, schema = _featured(none, ["label"], "label double")
    table = checkpointed(own.mapInArrow(run, schema))
    low, high = table.agg(F.min("label"), F.max("label")).first()
    if low is None or low == high:  # a sample of one kind fits nothing
        p = min(max(ones / rows, 0.001), 0.999)
        return none._replace(intercept=math.log(p / (1 - p)))
    quotes = [f == "quoted" for f in WEIGHED]
    low, high = (Matrices.dense(1, len(WEIGHED), b) for b in ([-50.0 if q else 0.0 for q in quotes], [0.0 if q else 50.0 for q in quotes]))
    logistic = LogisticRegression(regParam=0.001, maxIter=80, lowerBoundsOnCoefficients=low, upperBoundsOnCoefficients=high)
    fitted = logistic.fit(VectorAssembler(inputCols=list(WEIGHED), outputCol="features").transform(table))
    return none._replace(weights=(*(float(x) for x in fitted.coefficients.toArray()), 0.0, 0.0), intercept=float(fitted.intercept))


def scores(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of each row, with the counts that the score is made of."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    run, schema = _featured(model, ["doc_id"], "doc_id long")
    z = F.lit(model.intercept)
    for w, f in zip(model.weights, FEATURES, strict=True):
        z = z + F.lit(w) * F.col(f)
    out = rows.mapInArrow(run, schema).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *FEATURES)
