"""Exact descriptive statistics per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATISTICS = ("mean", "median", "sd", "min", "q1", "q3", "max")


def _quartiles(value: Column, weight: Column | None = None) -> Column:
    """The three quartiles as one array, so that the values of a group are gathered once."""
    shares = F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])
    return F.percentile(value, shares) if weight is None else F.percentile(value, shares, weight)


def _shown(prefix: str, named: str, digits: int | None) -> list[Column]:
    """The seven statistics out of the aggregates that start with ``prefix``."""
    q = F.col(f"{prefix}q")
    columns = {
        "mean": F.col(f"{prefix}mean"),
        "median": q[1],
        "sd": F.col(f"{prefix}sd"),
        "min": F.col(f"{prefix}min").cast("double"),
        "q1": q[0],
        "q3": q[2],
        "max": F.col(f"{prefix}max").cast("double"),
    }
    return [(c if digits is None else F.round(c, digits)).alias(f"{named}{name}") for name, c in columns.items()]


def _aggregates(value: str, prefix: str) -> list[Column]:
    aggregates = {
        "mean": F.avg(value), "sd": F.stddev_samp(value), "min": F.min(value), "max": F.max(value),
        "q": _quartiles(F.col(value)),
    }
    return [c.alias(f"{prefix}{name}") for name, c in aggregates.items()]


def describe(
    df: DataFrame, by: Sequence[str], value: str, digits: int | None = None, extra: Sequence[str] = ()
) -> DataFrame:
    """Row count and the seven statistics of ``value`` per group; ``extra`` names flags to add up.

    Quantiles interpolate linearly, and the deviation of a single value is NULL. Meant for counts: an
    exact quantile keeps one entry per distinct value and group, and k distinct counts need about k*k/2
    counted rows, so the state stays near the square root of the input.
    """
    sums = [F.count_if(F.col(flag)).alias(flag) for flag in extra]
    grouped = df.groupBy(*by).agg(F.count("*").alias("n"), *sums, *_aggregates(value, "_"))
    return grouped.select(*by, "n", *extra, *_shown("_", "", digits))


def describe_many(df: DataFrame, by: Sequence[str], values: Sequence[str], digits: int | None = None) -> DataFrame:
    """The seven statistics of several columns, named ``{column}_{statistic}``."""
    grouped = df.groupBy(*by).agg(*[c for v in values for c in _aggregates(v, f"_{v}_")])
    return grouped.select(*by, *[c for v in values for c in _shown(f"_{v}_", f"{v}_", digits)])


def describe_weighted(
    df: DataFrame, by: Sequence[str], values: Sequence[str], weight: str, digits: int | None = None
) -> DataFrame:
    """As :func:`describe_many`, each row standing for ``weight`` equal rows.

    The input is already aggregated (one row per day or month and group), which bounds the window.
    The spread is summed around the mean, not from squares, to keep it exact for large values.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = F.col(weight)
    total = F.sum(w).over(group)
    means = [(F.sum(F.col(v) * w).over(group) / total).alias(f"_mean_{v}") for v in values]
    kept = df.where(w > 0).select("*", total.alias("_n"), *means)
    aggregates = [F.first("_n").alias("n")]
    for v in values:
        x, mean = F.col(v), F.col(f"_mean_{v}")
        spread = F.sum(w * (x - mean) * (x - mean))
        aggregates += [
            F.first(mean).alias(f"_{v}_mean"),
            F.sqrt(F.try_divide(spread, F.first("_n") - 1)).alias(f"_{v}_sd"),
            F.min(x).alias(f"_{v}_min"),
            F.max(x).alias(f"_{v}_max"),
            _quartiles(x, w).alias(f"_{v}_q"),
        ]
    names = {v: "" if len(values) == 1 else f"{v}_" for v in values}
    return kept.groupBy(*by).agg(*aggregates).select(
        *by, "n", *[c for v in values for c in _shown(f"_{v}_", names[v], digits)]
    )


def value_histogram(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """``(by…, value, n)``: how often each value occurs in each group, rows counting ``weight`` times."""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*by, F.col(value).alias("value")).agg(n.alias("n"))


def box_statistics(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Quartiles and whiskers per group; a whisker is the last value within 1.5 interquartile ranges."""
    group = Window.partitionBy(*by)
    x, n = F.col("value"), F.col("n")
    hinges = value_histogram(df, by, value, weight).withColumn(
        "_q", _quartiles(x, n).over(group)
    )
    q1, median, q3 = (F.col("_q")[i] for i in range(3))
    reach = 1.5 * (q3 - q1)
    return hinges.groupBy(*by).agg(
        F.sum(n).alias("n"),
        F.min(F.when(x >= q1 - reach, x)).cast("double").alias("lower_whisker"),
        F.first(q1).alias("q1"),
        F.first(median).alias("median"),
        F.first(q3).alias("q3"),
        F.max(F.when(x <= q3 + reach, x)).cast("double").alias("upper_whisker"),
    )


def in_range(df: DataFrame, value: str, value_range: tuple[float, float] | None) -> DataFrame:
    """Leave out values beyond the limits of an axis before anything is computed from them."""
    return df if value_range is None else df.where(F.col(value).between(*value_range))
