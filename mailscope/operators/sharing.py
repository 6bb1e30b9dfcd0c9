"""Letting several uses of one aggregate share its computation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_whole(df: DataFrame, counts: Sequence[str]) -> DataFrame:
    """``df`` unchanged, but with its counts needed by whoever reads it.

    Spark runs equal shuffles once. Uses that need different columns are pruned differently and stop
    being equal; a filter on the counts, true for every row, keeps the columns in all of them.
    """
    columns = [F.col(c) for c in counts]
    return df.where((F.least(*columns) if len(columns) > 1 else columns[0]) >= 0)


def always(*columns: Column) -> Column:
    """True for every row, but only known to be so by reading all the columns."""
    return F.xxhash64(*columns).bitwiseAND(1) >= 0


def read_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` unchanged, but with all (or these) columns read by whoever uses it, so that uses have equal shuffles."""
    return df.where(always(*[F.col(c) for c in columns or df.columns]))
