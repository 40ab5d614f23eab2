"""Benchmark decontamination by template canonicalisation.

A text becomes a row of template words: numbers, names (capitalised words inside a sentence; a run
of them is one name) and units (after a number) become typed placeholders, all else is lower-cased.
Windows of ``window`` template words are hashed and joined with those of the benchmark. Windows on
one diagonal (same shift between text and item) form an alignment; it counts only if its slots are
filled consistently: a value of the item always gives the same value of the text, and two names
of the item never become one. A text holds an item if its consistent alignments cover at least
``cover`` of the item's words, so re-parameterised questions are found as well as copies.

An item is looked for in three forms, each judged by itself: its template; the same with its first
word as a name, as that is what a capital letter means inside running text; and its plain words in
lower case without any placeholder, which finds copies of items that are mostly numbers or names.

Tasks drop windows that no benchmark item has, by a sorted array of the benchmark's window hashes.
It is broadcast only while it has at most ``MOST_WINDOWS`` entries (32 MB); beyond that all windows
go to the join.

Defined results: null and empty texts and items of fewer than ``shortest`` plain words match nothing; a
template of fewer than ``shortest`` template words is not looked for, its plain words are; an
item shorter than a window is one window; template windows with fewer than half of their words spelled
out are skipped; counts and places are those of the first form that matches, in template words or
plain ones; rows that repeat give one result row; null ids are reported as null; further columns
are ignored by ``matches`` and kept by ``without_matches``; empty tables give no matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmill.llm.common import GOLDEN, U64, mix, sized_batches, strings, tidied

WINDOW, COVER, SHORTEST, MOST_WINDOWS, KEPT = 8, 0.5, 5, 4_000_000, 150_000
WORD, NUMBER, UNIT, NAME, STOP = 0, 1, 2, 3, 4
TEMPLATE, NAMED, PLAIN = 0, 1, 2
#: Words that are units when they follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal ms s sec secs min mins h hr hrs hz khz mhz ghz kb mb gb tb"
    " pa kpa v mv kv a ma w kw mw j kj cal kcal k c f inch inches foot feet yard yards mile miles metre metres meter meters"
    " kilometre kilometres kilometer kilometers gram grams kilogram kilograms tonne tonnes pound pounds ounce ounces litre"
    " litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years"
    " percent degree degrees dollar dollars euro euros cent cents volt volts watt watts ohm ohms".split()
)
_TOKENS = re.compile(r"\w+|[.!?:;\n]")
PLACEHOLDER = mix(np.arange(1, 6, dtype=U64) * GOLDEN)


class Kinds(dict):
    """Token -> (hash of its lower-case form with the kind in its lowest three bits)."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if any(ch.isdigit() for ch in token):
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif token in ".!?:;\n":
            kind = STOP
        elif len(token) > 1 and token[0].isupper() and token[1:].islower():
            kind = NAME
        else:
            kind = WORD
        if len(self) > KEPT:
            self.clear()
        out = self[token] = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) & ~7 | kind
        return out


_kinds = Kinds()
_END = np.array([_kinds["."]], U64)


def coded(text: str) -> np.ndarray:
    tokens = _TOKENS.findall(text)
    return np.fromiter(map(_kinds.__getitem__, tokens), dtype=U64, count=len(tokens))


def template_of(code: np.ndarray, named: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each template word: its hash, its kind, the hash of what filled it, and its place among the tokens.

    ``named`` reads the tokens as if words came before them.
    """
    kind = (code & U64(7)).astype(np.int8)
    before = np.concatenate([[WORD if named else STOP], kind[:-1]]) if len(kind) else kind
    kind = np.where((kind == NAME) & (before == STOP), WORD, kind)
    kind = np.where((kind == UNIT) & (before != NUMBER), WORD, kind)
    place = np.flatnonzero(kind != STOP)
    kind, value = kind[place], code[place] & ~U64(7)
    if (kind == NAME).any():  # a run of names is one slot, filled by all of its words
        again = np.concatenate([[False], (kind[1:] == NAME) & (kind[:-1] == NAME)])
        first = np.flatnonzero(~again)
        with np.errstate(over="ignore"):
            value = np.add.reduceat(np.where(again, mix(value), value), first)
        kind, place = kind[first], place[first]
    return np.where(kind == WORD, mix(value), PLACEHOLDER[kind]), kind, value, place


def plain_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of plain words, which have no slots."""
    place = np.flatnonzero((code & U64(7)) != STOP)
    value = code[place] & ~U64(7)
    return mix(value ^ GOLDEN), np.zeros(len(value), np.int8), value, place


def template(code: np.ndarray, named: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return template_of(code, named)[:3]


def plain(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return plain_of(code)[:3]


def windows(words: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of ``size`` words, at least half of them spelled out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    # Runs of 1, 2, 4 ... words; a window is put together from them.
    with np.errstate(over="ignore"):
        out, done, run, length = np.full(n, U64(size)), 0, words, 1
        while done < size:
            if size & length:
                out = (out ^ (out >> U64(29))) * GOLDEN + run[done : done + n]
                done += length
            if done < size:
                run = (run[:-length] ^ (run[:-length] >> U64(29))) * GOLDEN + run[length:]
                length *= 2
    if not kinds.any():
        return np.arange(n), mix(out)
    spelled = np.concatenate([[0], np.cumsum(kinds == WORD)])
    at = np.flatnonzero(2 * (spelled[size:] - spelled[:-size]) >= size)
    return at, mix(out[at])


ITEM = "hash long, size int, item_id long, form int, item_words int, at int, kinds binary, fills binary"


def _item_rows(window: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for item, t in zip(b.column("item_id").to_pylist(), strings(b.column("text")), strict=True):
                code = coded(t)
                forms = [(TEMPLATE, template(code)), (PLAIN, plain(code))]
                if len(code) and code[0] & U64(7) == NAME:
                    forms.append((NAMED, template(code, named=True)))
                for form, (words, kinds, fills) in forms:
                    size = min(window, len(words))
                    if len(words) < shortest:
                        continue
                    for at, h in zip(*windows(words, kinds, size), strict=True):
                        rows.append((int(h.view(np.int64)), size, item, form, len(words), int(at), kinds[at : at + size].astype("i1").tobytes(), fills[at : at + size].tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in ITEM.split(", ")])

    return run


def _text_rows(sizes: list[int], known):
    """Windows of texts: all of them, or those whose hash is among the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None if known is None else known.value
        if have is not None:  # beginnings of known hashes, which most other ones do not share
            shift = U64(64 - min(24, max(16, len(have).bit_length() + 4)))
            begins = np.zeros(1 << (64 - int(shift)), bool)
            begins[have >> shift] = True
        for b in sized_batches(batches, most=1 << 20):
            # All texts of a batch in a row, a stop behind each, so that arrays are long; what reaches over two texts goes.
            codes = [coded(t) for t in strings(b.column("text"))]
            code = np.concatenate([x for c in codes for x in (c, _END)])
            text_no = np.repeat(np.arange(len(codes)), [len(c) + 1 for c in codes])
            out: list[list] = [[] for _ in range(5)]
            for words, kinds, fills, token in (template_of(code), plain_of(code)):
                owner = text_no[token]
                first = np.searchsorted(owner, np.arange(len(codes)))
                for size in sizes:
                    at, h = windows(words, kinds, size)
                    if have is not None and len(h):
                        maybe = np.flatnonzero(begins[h >> shift])
                        at, h = at[maybe], h[maybe]
                        hit = have[np.minimum(np.searchsorted(have, h), len(have) - 1)] == h
                        at, h = at[hit], h[hit]
                    whole = owner[at] == owner[at + size - 1] if len(at) else np.zeros(0, bool)
                    at, h = at[whole], h[whole]
                    for o, x in zip(out, (h.view(np.int64), np.full(len(at), size, np.int32), owner[at], (at - first[owner[at]]).astype(np.int32)), strict=False):
                        o.append(x)
                    out[4] += [fills[p : p + size].tobytes() for p in at.tolist()]
            hashes, size, no, place = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out[:4])
            take = pa.array(no.astype(np.int64))
            yield pa.record_batch(
                [pa.array(hashes.astype(np.int64)), pa.array(size.astype(np.int32)), b.column("doc_id").take(take), b.column("tk").take(take), pa.array(place.astype(np.int32)), pa.array(out[4], pa.binary())],
                names=["hash", "size", "doc_id", "tk", "place", "filled"],
            )

    return run


def consistent(pairs: set[tuple[int, int, int]]) -> bool:
    """Of (kind, value in the item, value in the text): one value for each, and names stay apart."""
    there: dict[tuple[int, int], int] = {}
    back: dict[int, int] = {}
    for kind, own, new in pairs:
        if there.setdefault((kind, own), new) != new or kind == NAME and back.setdefault(new, own) != own:
            return False
    return True


def judged_rows(rows: list[tuple]) -> tuple[int, int, int]:
    """Of all windows (place, at, size, kinds, fills, filled) that a text shares with a form of an item: words covered, slots changed, first place."""
    shifts: dict[int, list[tuple]] = {}
    for row in rows:
        shifts.setdefault(row[0] - row[1], []).append(row)
    covered: set[int] = set()
    changed = 0
    for part in shifts.values():
        pairs = set()
        for _, _, _, kinds, fills, filled in part:
            k = np.frombuffer(kinds, "i1")
            if k.any():
                pairs |= {(int(x), int(y), int(z)) for x, y, z in zip(k, np.frombuffer(fills, "<u8"), np.frombuffer(filled, "<u8"), strict=True) if x != WORD}
        if consistent(pairs):
            changed += sum(y != z for _, y, z in pairs)
            for _, at, size, *_ in part:
                covered.update(range(at, at + size))
    return len(covered), changed, min(r[0] for r in rows)


KEYS = ("doc_id", "tk", "item_id", "form")


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of ``KEYS``; a group is done when the next begins."""

    def done(key: tuple, words: int, rows: list[tuple]) -> tuple:
        doc, tk, item, form = key
        return (doc, tk, form, item, words, *judged_rows(rows))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 8
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in MATCH.split(", ")])

    key, words, group = None, 0, []
    for b in batches:
        out = []
        columns = (b.column(c).to_pylist() for c in (*KEYS, "item_words", "place", "at", "size", "kinds", "fills", "filled"))
        for doc, tk, item, form, n, *row in zip(*columns, strict=True):
            if key != (doc, tk, item, form):
                if group:
                    out.append(done(key, words, group))
                key, words, group = (doc, tk, item, form), n, []
            group.append(tuple(row))
        yield batch(out)
    if group:
        yield batch([done(key, words, group)])


MATCH = "doc_id long, tk long, form int, item_id long, item_words int, covered int, slots_changed int, first_word int"


def _text_key(docs: DataFrame):
    t = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return F.xxhash64(t, F.octet_length(t))


def held(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, shortest: int = SHORTEST) -> DataFrame:
    """The columns of ``matches`` for each different text (key ``tk``) under an id."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).mapInArrow(tidied(_item_rows(window, shortest)), ITEM)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``window`` of them
    found = [r[0] for r in items.select("hash").distinct().limit(MOST_WINDOWS + 1).collect()]
    known = None if len(found) > MOST_WINDOWS or not found else sc.broadcast(np.sort(np.array(found, np.int64).view(U64)))
    t = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _text_key(docs).alias("tk"), t.alias("text"))
    own = rows.mapInArrow(tidied(_text_rows(sizes, known), _kinds.clear), "hash long, size int, doc_id long, tk long, place int, filled binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    judged = own.join(items, ["hash", "size"]).repartition(parts, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(tidied(_judged), MATCH)
    best = judged.where(F.col("covered") >= cover * F.col("item_words")).groupBy("doc_id", "tk", "item_id").agg(F.min_by(F.struct("item_words", "covered", "slots_changed", "first_word"), "form").alias("best"))
    return best.select("doc_id", "tk", "item_id", "best.*")


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id`` of texts that hold items, how many of the item's words they cover and how many slots differ."""
    return held(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("item_words", "covered", "slots_changed")), F.min("first_word").alias("first_word"))


def without_matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark; other texts under the same id, null or not, stay.

    A row is carried as a whole, so no name of a column can clash.
    """
    hit = held(docs, benchmark, **options).select(F.col("doc_id").alias("hit"), "tk").distinct()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _text_key(docs).alias("tk"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return rows.join(hit, F.col("doc_id").eqNullSafe(F.col("hit")) & (rows["tk"] == hit["tk"]), "left_anti").select("row.*")
