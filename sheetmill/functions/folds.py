"""Sequential passes over arrays, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str, finish: Callable[[Column], Column] | None = None, chunk: int = 256) -> Column:
    """All that ``step(state, item) -> (state, array of out)`` gives over an array, and ``finish(state)`` behind it.

    A plain fold that appends copies all that it holds at each item, which is quadratic. Here a chunk of
    items fills an array of its own, and the chunks are put together once.
    """
    none = F.array().cast(f"array<{out}>")

    def inner(acc: Column, x: Column) -> Column:
        state, more = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], more).alias("out"))

    def outer(acc: Column, at: Column) -> Column:
        part = F.aggregate(F.slice(items, at, F.lit(chunk)), F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return bound(part, lambda p: F.struct(p["state"].alias("state"), F.concat(acc["out"], F.array(p["out"])).alias("out")))

    zero = F.struct(start.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out"))
    end = lambda acc: F.flatten(acc["out"]) if finish is None else F.concat(F.flatten(acc["out"]), finish(acc["state"]))
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(chunk))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(starts, zero, outer, end)


def prefix_sums(numbers: Column) -> Column:
    """Sums of the first 0, 1, 2, ... numbers."""
    return F.concat(F.array(F.lit(0).cast("long")), scan(numbers, F.lit(0).cast("long"), lambda s, x: (s + x, F.array(s + x)), "bigint"))
