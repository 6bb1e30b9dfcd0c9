"""Gaussian density curve per group, the data behind a violin."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscope.operators.describe import in_range, value_histogram


def _grid(counted: DataFrame, group: str, points: int) -> DataFrame:
    """One row per group: size, bandwidth, and start and step of the grid that reaches three bandwidths past the data.

    Bandwidth by the rule of thumb 0.9 * min(sd, IQR / 1.34) * n ** -0.2. Groups without spread have none.
    """
    x, n = F.col("value"), F.col("n")
    quartiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)), n)
    moments = counted.groupBy(F.col(group).alias("_g")).agg(
        F.sum(n).alias("_total"), (F.sum(x * n) / F.sum(n)).alias("_mean"), quartiles.alias("_q"),
        F.min(x).alias("_min"), F.max(x).alias("_max"),
    )
    known = [F.max(c).alias(c) for c in ("_total", "_min", "_max")] + [F.first("_q").alias("_q")]
    spread = F.sum(n * (x - F.col("_mean")) * (x - F.col("_mean")))
    met = counted.join(moments, F.col(group).eqNullSafe(F.col("_g"))).groupBy("_g").agg(*known, spread.alias("_spread"))
    deviation = F.sqrt(F.try_divide(F.col("_spread"), F.col("_total") - 1))
    iqr = (F.col("_q")[1] - F.col("_q")[0]) / 1.34
    # Without spread between the quartiles the deviation alone sets the width.
    narrow = F.when(iqr > 0, F.least(deviation, iqr)).otherwise(deviation)
    sized = met.withColumn("_bw", 0.9 * narrow * F.pow(F.col("_total"), F.lit(-0.2))).where(F.col("_bw") > 0)
    start, end = F.col("_min") - 3 * F.col("_bw"), F.col("_max") + 3 * F.col("_bw")
    return sized.select("_g", "_total", "_bw", start.alias("_from"), ((end - start) / (points - 1)).alias("_step"))


def density(
    df: DataFrame,
    group: str,
    value: str,
    points: int = 512,
    value_range: tuple[float, float] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """``(group, point, x, density)`` on an even grid.

    The curve is the direct sum of the kernels of all values, at every point. Equal values are counted first, so the work is
    distinct values times grid points; sums combine before the shuffle, and no group is put in order.
    """
    counted = value_histogram(in_range(df, value, value_range), [group], value, weight)
    grid = _grid(counted, group, points)
    bw, x = F.col("_bw"), F.col("_from") + F.col("point") * F.col("_step")
    # One row per curve; sent to the values, so that those of a hot group stay in many tasks.
    spread = counted.join(F.broadcast(grid), F.col(group).eqNullSafe(F.col("_g"))).withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    z = (x - F.col("value")) / bw
    kernel = F.col("n") * F.exp(-0.5 * z * z) / (F.col("_total") * bw * math.sqrt(2 * math.pi))
    return spread.groupBy(F.col("_g").alias(group), "point", x.alias("x")).agg(F.sum(kernel).alias("density"))
