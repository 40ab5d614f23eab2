"""Splitting a text where a piece tokenizer can never join what stands on the two sides.

A byte-pair merge across a place needs a piece that holds the two characters beside it. A
vocabulary in which a word mark only follows other word marks has no piece with "any character,
then a word mark", so a run of blanks with the word behind it is encoded the same wherever it
stands. ``proves_units`` checks this for a vocabulary; nothing is assumed about it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

MARK = "▁"
_UNITS = re.compile(r" *[^ ]+| +")


def proves_units(pieces: Iterable[str]) -> bool:
    """True if no piece holds a word mark behind another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)


def units(text: str) -> list[str]:
    """Runs of blanks, each with the word behind it, as they are to be encoded alone.

    The encoder puts one word mark before its input. It stands for the first blank of a run; so
    that blank is left out, but for the first run, which has a mark of its own before it. Word
    marks in the input mean the same as blanks.
    """
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    found = _UNITS.findall(text)
    return [u if k == 0 else u[1:] for k, u in enumerate(found)]
