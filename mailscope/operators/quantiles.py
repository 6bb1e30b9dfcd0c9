"""Exact quantiles of groups of any size, with any number of distinct values.

The built-in exact percentile keeps every distinct value of a group in one task, which identifiers and measurements do
not allow. Here every value has a 64-bit key that sorts as the value does, and the key is found sixteen bits at a time:
each level counts, in one shuffle for all groups and all quantiles, how many values go on with which bits below the
prefixes found so far. No task holds more than the 65,536 cells of a prefix, and map tasks combine them first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

#: Bits per level; four levels make a key.
DIGIT = 16
LEVELS = 4
#: Decimals of more digits have no 64-bit key.
MOST_DIGITS = 18

WHOLE = ("byte", "short", "integer", "long")


def _double_key(value: Column) -> Column:
    """The bits of a double as a whole number that sorts as the double does, put together by arithmetic that is exact.

    Exponent and fraction of the absolute value, the exponent first estimated and then corrected, minus for
    negative numbers. Both zeros have key 0; NaN comes after infinity, as Spark sorts it.
    """
    size = F.abs(value.cast("double"))
    least, most, step = -1022, 1023, 2.0**52
    guess = F.greatest(F.least(F.coalesce(F.floor(F.log2(size)), F.lit(least)), F.lit(most)), F.lit(least)).cast("int")
    up = (guess < most) & (size >= F.pow(F.lit(2.0), guess + 1))
    down = (guess > least) & (size < F.pow(F.lit(2.0), guess))
    exponent = guess + up.cast("int") - down.cast("int")
    fraction = (size / F.pow(F.lit(2.0), exponent) * step).cast("long")
    whole = (exponent - least).cast("long") * int(step) + fraction
    beyond = 2047 * int(step)
    return (
        F.when(F.isnan(value), F.lit(beyond + 1))
        .when(size == float("inf"), F.when(value < 0, F.lit(-beyond)).otherwise(F.lit(beyond)))
        .when(value < 0, -whole)
        .otherwise(whole)
    )


def order_key(value: Column, kind: DataType) -> Column:
    """A LONG that sorts as the value does and is equal where values are."""
    name = kind.typeName()
    if name in WHOLE:
        return value.cast("long")
    if name in ("float", "double"):
        return _double_key(value)
    if isinstance(kind, DecimalType) and kind.precision <= MOST_DIGITS:
        return (value * F.lit(10**kind.scale).cast(f"decimal({kind.scale + 1},0)")).cast("long")
    if name == "date":
        return F.unix_date(value).cast("long")
    if name == "timestamp":
        return F.unix_micros(value)
    raise TypeError(f"no exact quantiles of {kind.simpleString()}")


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def _digit(level: int) -> Column:
    """The bits of this level; the first has the sign."""
    shifted = F.shiftright("_key", DIGIT * (LEVELS - 1 - level))
    return shifted if level == 0 else shifted.bitwiseAND((1 << DIGIT) - 1)


def _prefix(level: int) -> Column:
    """The bits of all earlier levels."""
    return F.shiftright("_key", DIGIT * (LEVELS - level))


def _chosen(cells: DataFrame, by: Sequence[str], level: int) -> DataFrame:
    """Of the cells below a prefix, those that a wanted rank falls into, with the ranks counted within them."""
    before = F.sum("_n").over(Window.partitionBy(*by, "_prefix").orderBy("_digit")) - F.col("_n")
    inside = F.filter("_wanted", lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_before") + F.col("_n")))
    moved = F.transform(inside, lambda w: F.struct(
        w["id"].alias("id"), (w["rank"] - F.col("_before")).alias("rank"), w["low"].alias("low"), w["high"].alias("high")
    ))
    known = "_digit" if level == 0 else f"_prefix * {1 << DIGIT} + _digit"
    kept = ["_value"] if "_value" in cells.columns else []
    found = cells.withColumn("_before", before).withColumn("_wanted", moved).where(F.size("_wanted") > 0)
    return found.select(*by, F.expr(known).alias("_prefix"), "_wanted", *kept)


def _wanted(total: Column, shares: Sequence[float]) -> Column:
    """The two ranks each share lies between, with their weights in the result."""
    ranks = []
    for i, p in enumerate(shares):
        position = F.lit(p) * (total - 1)
        low, high = F.floor(position), F.ceil(position)
        weights = (high - position).alias("low"), (position - low).alias("high")
        for side, rank in enumerate((low, high)):
            ranks.append(F.struct(F.lit(2 * i + side).alias("id"), rank.cast("long").alias("rank"), *weights))
    return F.array(*ranks)


def keyed_quantiles(keyed: DataFrame, by: Sequence[str], shares: Sequence[float], few: bool = False) -> DataFrame:
    """``by`` and ``q0, q1, …`` of rows with ``_key``, ``_value`` (what a key stands for) and ``_weight``.

    ``few`` says that a setting bounds the groups. The prefixes found, two a share and group, then go to the rows; by a
    shuffle all rows that go on with one prefix would meet in one task, and identifiers have the same first bits.
    """
    by, cell = list(by), [F.col("_weight")]
    first = keyed.groupBy(*by, F.lit(0).cast("long").alias("_prefix"), _digit(0).alias("_digit"))
    cells = first.agg(F.sum(*cell).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*by, "_prefix"))
    live = _chosen(cells.withColumn("_wanted", _wanted(total, shares)), by, 0)
    for level in range(1, LEVELS):
        below = keyed.withColumn("_prefix", _prefix(level)).alias("k").join(
            (F.broadcast(live) if few else live).alias("l"), _same("k", "l", [*by, "_prefix"])
        )
        # The wanted ranks go with the group, so that the prefixes are computed once.
        grouped = below.groupBy(*[F.col(f"l.{c}") for c in (*by, "_prefix", "_wanted")], _digit(level).alias("_digit"))
        last = [F.max("_value").alias("_value")] if level == LEVELS - 1 else []
        live = _chosen(grouped.agg(F.sum(*cell).alias("_n"), *last), by, level)
    found = live.select(*by, "_value", F.inline("_wanted"))
    results = []
    for i in range(len(shares)):
        low, high = (F.max(F.when(F.col("id") == 2 * i + side, F.col("_value"))) for side in (0, 1))
        weights = [F.max(F.when(F.col("id") == 2 * i, F.col(c))) for c in ("low", "high")]
        results.append(F.when(low == high, low).otherwise(weights[0] * low + weights[1] * high).alias(f"q{i}"))
    return found.groupBy(*by).agg(*results)


def _kind(df: DataFrame, column: str) -> DataType:
    return df.schema[column].dataType


def _number(value: Column, kind: DataType) -> Column:
    """What quantiles of a column are made of, as DOUBLE: days of dates, seconds of timestamps."""
    if kind.typeName() == "date":
        value = F.unix_date(value)
    elif kind.typeName() == "timestamp":
        value = F.unix_micros(value) / 1_000_000
    return value.cast("double")


def grouped_quantiles(
    df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], weight: str | None = None
) -> DataFrame:
    """Quantiles ``q0, q1, …`` of a column per group, as :func:`percentile` has them: interpolated between ranks.

    Rows count ``weight`` times if given. Missing values and weights of 0 are left out; a group without others has no row.
    """
    x, kind = F.col(value), _kind(df, value)
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    keyed = df.where(x.isNotNull()).select(*by, order_key(x, kind).alias("_key"), _number(x, kind).alias("_value"), w.alias("_weight"))
    return keyed_quantiles(keyed.where("_weight > 0"), by, shares)


def column_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``column`` and quantiles ``q0, q1, …`` of several columns of different types; all share each level's shuffle."""
    parts = [
        F.struct(
            F.lit(c).alias("column"), order_key(F.col(c), _kind(df, c)).alias("_key"),
            _number(F.col(c), _kind(df, c)).alias("_value"), F.lit(1).cast("long").alias("_weight"),
        )
        for c in columns
    ]
    keyed = df.select(F.inline(F.array(*parts)))
    return keyed_quantiles(keyed.where(F.col("_key").isNotNull()), ["column"], shares, few=True)


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """Quantiles ``q0, q1, …`` of one column in one row; NULL if it has no values."""
    names = [f"q{i}" for i in range(len(shares))]
    found = column_quantiles(df, [column], shares)
    return found.agg(*[F.max(name).alias(name) for name in names])
