"""Running values over an array, as an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements per chunk. Appending copies an array, so a plain fold is quadratic; folds of chunks stay near linear.
CHUNK = 1000


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def _fold(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The running value after each element, started from `zero`."""
    start = F.struct(zero.alias("last"), F.array().cast("array<int>").alias("all"))

    def add(state: Column, value: Column) -> Column:
        return bound(step(state["last"], value), lambda now: F.struct(now.alias("last"), F.array_append(state["all"], now).alias("all")))

    return F.aggregate(values, start, add)["all"]


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running `step` (a sum, a maximum) from 0 over an array of INT, as an array of INT."""

    def over(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        chunks = F.transform(starts, lambda i: F.slice(v, i * CHUNK + 1, F.lit(CHUNK)))

        def joined(c: Column) -> Column:
            totals = F.transform(c, lambda chunk: F.aggregate(chunk, F.lit(0), step))
            return bound(_fold(totals, F.lit(0), step), lambda t: F.flatten(F.transform(
                c, lambda chunk, i: _fold(chunk, F.coalesce(F.get(t, i - 1), F.lit(0)), step)
            )))

        return bound(chunks, joined)

    return bound(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(over(v)))
