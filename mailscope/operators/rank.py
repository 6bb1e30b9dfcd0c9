"""Shares, top lists and first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscope.functions.labels import percent
from mailscope.operators.cleaning import share


def with_share(
    counts: DataFrame, of: DataFrame | None = None, digits: int | None = None, label_digits: int = 2
) -> DataFrame:
    """Add ``perc`` and ``labels``: each ``n`` as a part of the sum of ``n`` over all of ``of``.

    The sum is a scalar subquery on the aggregate, not a window without partitions, which would move
    every group to one task.
    """
    total = (counts if of is None else of).agg(F.sum("n")).scalar()
    return counts.withColumn("perc", share(F.col("n"), total, digits)).withColumn(
        "labels", percent(F.col("perc"), label_digits)
    )


def top(counts: DataFrame, k: int, key: str, n: str = "n") -> DataFrame:
    """The k largest, ties in the order of the key; each task keeps only k rows."""
    return counts.orderBy(F.desc(n), F.asc_nulls_last(key)).limit(k)


def first_value(df: DataFrame, keys: Sequence[str], value: Column, order: str) -> DataFrame:
    """``value`` of the first row of each key group, by aggregation instead of a sorted window."""
    return df.groupBy(*keys).agg(F.min_by(value, F.col(order)).alias("first"))


def first_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key group with all its columns, again without a sorted window."""
    rest = [c for c in df.columns if c not in keys and c != order]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*keys, "_first.*")


def peek(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop``, counted from 1 in key order."""
    return df.orderBy(key).offset(start - 1).limit(stop - start + 1)
