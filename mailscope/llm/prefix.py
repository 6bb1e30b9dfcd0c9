"""Running totals over any number of rows without one task seeing them all.

The order key is cut into chunks of a bounded width; chunks into wider chunks, and so on. Every window runs
over one chunk, so no key, source or table size makes a window larger than a chunk is wide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shifts for dense keys such as row numbers or document ids.
DENSE = (10, 20, 32, 48)


def hashed_shifts(rows: int, bits: int, width: int = 512) -> tuple[int, ...]:
    """Shifts for keys spread evenly over `bits` bits: about `width` rows in a first chunk, 1024 chunks in each next."""
    first = max(0, bits - max(0, (max(rows, 1) // width).bit_length()))
    return tuple(range(first, bits, 10)) or (first,)


def _exclusive(value: str, by: Sequence[str], order: Sequence[Column]) -> Column:
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(window) - F.col(value)


def _chunk_offsets(totals: DataFrame, by: list[str], shifts: Sequence[int]) -> DataFrame:
    """`totals` has `by`, `_chunk` and `_total`; adds `_offset`, the total of all earlier chunks."""
    if not shifts:
        return totals.withColumn("_offset", _exclusive("_total", by, [F.col("_chunk")]))
    wide = totals.withColumn("_parent", F.shiftright("_chunk", shifts[0]))
    parents = wide.groupBy(*by, F.col("_parent").alias("_chunk")).agg(F.sum("_total").alias("_total"))
    outer = _chunk_offsets(parents, by, [s - shifts[0] for s in shifts[1:]]).select(
        *by, F.col("_chunk").alias("_parent"), F.col("_offset").alias("_outer")
    )
    inner = wide.withColumn("_inner", _exclusive("_total", [*by, "_parent"], [F.col("_chunk")]))
    return inner.join(outer, [*by, "_parent"]).select(
        *by, "_chunk", "_total", (F.col("_inner") + F.col("_outer")).alias("_offset")
    )


def total_before(
    df: DataFrame, value: str, order: str, into: str, by: Sequence[str] = (), ties: Sequence[str] = (),
    shifts: Sequence[int] = DENSE,
) -> DataFrame:
    """Add `into`: the sum of `value` over the rows of the same `by` that come earlier by `order`, then `ties`.

    `order` is a LONG without nulls, `by` has no nulls, `value` is a LONG. `df` is read twice: hand in something
    cheap or written. Rows equal in `order` and `ties` are put one after the other in either order.
    """
    by = list(by)
    keyed = df.withColumn("_chunk", F.shiftright(F.col(order), shifts[0]))
    totals = keyed.groupBy(*by, "_chunk").agg(F.sum(value).alias("_total"))
    offsets = _chunk_offsets(totals, by, [s - shifts[0] for s in shifts[1:]]).select(*by, "_chunk", "_offset")
    local = keyed.withColumn("_local", _exclusive(value, [*by, "_chunk"], [F.col(order), *map(F.col, ties)]))
    joined = local.join(offsets, [*by, "_chunk"])
    return joined.withColumn(into, F.col("_local") + F.col("_offset")).drop("_chunk", "_local", "_offset")
